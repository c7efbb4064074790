import hashlib
import random
from collections import Counter

from regolith.llm import lines


def brute(rows, ratio, least):
    pages, having = Counter(h for _, h, _ in rows), Counter()
    for _, h, t in rows:
        having.update({(h, x) for x in (t or "").split("\n")})
    out = []
    for i, h, t in rows:
        parts = (t or "").split("\n")
        rest = [x for x in parts if not x.strip(" ") or not (having[h, x] >= least and having[h, x] > ratio * pages[h])]
        out.append((i, None if t is None else "\n".join(rest), len(parts), len(parts) - len(rest)))
    return sorted(out, key=str)


def test_as_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        host = rng.choice(["a", "a", "b", "c", None])
        body = [f"own {rng.randrange(10**6)}" for _ in range(rng.randrange(5))]
        body += [f"menu {k}" for k in range(8) if rng.random() < 0.04 * k] + [""] * rng.randrange(2) + ["same"] * rng.randrange(3)
        rng.shuffle(body)
        rows.append((i, host, "\n".join(body)))
    rows += [(7, "a", "menu 7"), (None, "b", "menu 7\nx"), (400, "d", "only page\nmenu 7"), (401, "c", None), (402, None, "")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, host string, text string, n_lines int")
    for most in (lines.BROADCAST_LINES, 0):
        monkeypatch.setattr(lines, "BROADCAST_LINES", most)
        got = lines.dedup(df, "host", ratio=0.15, least_pages=3)
        assert got.columns == ["doc_id", "host", "text", "n_lines", "n_dropped"]
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == brute(rows, 0.15, 3)
    assert lines.dedup(df.limit(0), "host").count() == 0


def test_pages_have_hosts_and_lines(spark):
    html = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- ad --><p>One <b>two</b><br>three</p></body>'
    df = spark.createDataFrame([("HTTP://u:p@Www.Ex.org:80/a?b#c", html), ("nonsense", None)], "url string, html string")
    got = df.select(lines.host_of("url").alias("h"), lines.page_text("html").alias("t")).collect()
    assert [(r.h, r.t) for r in got] == [("www.ex.org", "T\nHome\nOne two\nthree"), ("", None)]


def test_copies_are_one_page_where_asked(spark):
    rng = random.Random(4)
    texts = ["\n".join([f"own {k}", *(f"menu {m}" for m in range(6) if rng.random() < 0.08 * m)]) for k in range(60)] + ["", None]
    rows = [(i, rng.choice(["a", "b", None]), t) for i, t in enumerate(texts * 2 + texts[:1] * 40)]
    kept = {(h, t) for _, h, t in rows}
    gone = {(i, h, t) for i, (h, t) in enumerate(kept)}
    want = {(h, t): out for (_, h, t), (_, out, _, _) in zip(sorted(gone, key=lambda r: str(r[0])), brute(gone, 0.15, 3))}
    df = spark.createDataFrame(rows, "doc_id long, host string, text string")
    got = lines.dedup(df, "host", ratio=0.15, least_pages=3, distinct=True).collect()
    assert len(got) == len(rows)
    by_id = {i: (h, t) for i, h, t in rows}
    assert all(r.text == want[by_id[r.doc_id]] for r in got)
    assert any(r.n_dropped for r in got)


def test_query_over_pages(spark, tmp_path):
    """The registered query drops lines by host; hosts of two to four pages lose what all of them have."""
    from regolith.llm.registry import QUERIES

    def html(k, *more):
        return f"<html><head><title>own {k}</title></head><body><nav><li>Home</li></nav><p>prose {k}</p>" + "".join(f"<p>{m}</p>" for m in more) + "</body></html>"

    urls = [f"http://Big.org/{k}" for k in range(40)] + [f"https://small.org:8/{k}" for k in range(3)] + ["http://one.org/", "http://twin.org/a", "http://twin.org/b", None]
    pages = [html(k, *["offer"] * (k % 8 == 0 or k in (40, 41)), *["rare"] * (k < 2)) for k in range(len(urls))]
    pages[45] = pages[44]  # twin.org has one text
    spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(zip(urls, pages))], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in QUERIES["op9_pages"](spark, str(tmp_path)).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        host = None if u is None else u.split("/")[2].split(":")[0].lower()
        parts = [f"own {44 if k == 45 else k}", "Home", f"prose {44 if k == 45 else k}", *["offer"] * (k % 8 == 0 or k in (40, 41)), *["rare"] * (k < 2)]
        if k == 45:
            parts = parts[:3] + ["offer"] * (44 % 8 == 0)
        gone = {"big.org": {"Home", "offer"}, "small.org": {"Home"}}.get(host, set())
        text = "\n".join(x for x in parts if x not in gone)
        assert (got[k].host, got[k].n_lines, got[k].n_dropped, got[k].n_chars) == (host, len(parts), len(parts) - len([x for x in parts if x not in gone]), len(text))
        assert got[k].text_md5 == hashlib.md5(text.encode()).hexdigest()
