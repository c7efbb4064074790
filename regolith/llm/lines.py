"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it over the host's page total;
lines above the boilerplate ratio are dropped from that host's pages. A line counts once for each page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.functions.lineage import cut
from regolith.llm.common import read

#: A line goes if more than this share of its host's pages have it, and at least so many of them.
RATIO, LEAST_PAGES = 0.05, 5
#: Lines above the ratio that are broadcast at most; more than that are joined by shuffle. About 60 bytes each.
BROADCAST_LINES = 200_000


_BLOCK_TAGS = "p|div|br|li|ul|ol|nav|article|section|header|footer|main|aside|h[1-6]|tr|td|th|table|title|head|body|html|blockquote|pre"


def host_of(url: str) -> F.Column:
    """Lower-cased host of a url column: after the scheme and any user, before port, path, query or fragment."""
    return F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def page_text(html: str) -> F.Column:
    """The lines of an html column: scripts, styles and comments removed, a break at every block tag, other tags dropped."""
    text = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    text = F.regexp_replace(text, rf"(?i)</?({_BLOCK_TAGS})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    return F.trim(F.regexp_replace(text, r"[ \t\r]*\n\s*", "\n"), F.lit("\n "))


def _lines(text: str) -> F.Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, distinct: bool = False, small: bool = False) -> DataFrame:
    """(host, lines): of each host the md5 of the lines that go, from ``pages`` (host, text). Blank lines never go.
    With ``distinct`` a host's copies of one whole text are one page, in its total too. With ``small`` a line of a host of
    fewer than ``least_pages`` pages goes if all of them, two at least, have it.

    A page gives its own lines once, so the counts' partial sums leave one row for each host, line and task. A host keeps
    at most (mean lines of a page / ratio) lines above the ratio, whatever the number of its pages."""
    if distinct:  # a page is its text's hash; texts are not shuffled, and no task gathers the pages of a host
        pages = pages.withColumn("page", F.xxhash64("text"))
        each = pages.select("host", "page").distinct()
    else:
        each = pages = pages.withColumn("page", F.lit(0))
    totals = each.groupBy("host").agg(F.count("*").alias("pages"))
    lines = (
        pages.select("host", "page", F.explode(F.array_distinct(_lines("text"))).alias("line"))
        .where(F.trim("line") != "")
        .select("host", F.md5("line").alias("mark"), "page")
    )
    lines = (
        (lines.distinct() if distinct else lines)
        .groupBy("host", "mark")
        .agg(F.count("*").alias("having"))
        .where(F.col("having") >= (min(2, least_pages) if small else least_pages))
    )
    often = lines.join(totals, lines.host.eqNullSafe(totals.host)).where(F.col("having") > F.lit(ratio) * F.col("pages"))
    if small:
        often = often.where(F.col("having") >= F.least(F.lit(least_pages), "pages"))
    return often.groupBy(lines.host).agg(F.collect_list("mark").alias("lines"))


def dedup(docs: DataFrame, host_col: str, text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, distinct: bool = False, small: bool = False) -> DataFrame:
    """``docs`` with its text stripped of its host's boilerplate lines, and n_lines, n_dropped (columns of these names are
    replaced). Rows of a null host are one site. A null text stays null and has one line, an empty one, that is kept; a
    text whose lines all go becomes empty. Repeated rows count as pages of their own, unless ``distinct`` makes a
    host's copies of one text one page; ``small`` as for boilerplate. Texts are not shuffled while the
    boilerplate lines are few enough to broadcast."""
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    found = cut(boilerplate(docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text")), ratio, least_pages, distinct, small))
    many = found.agg(F.sum(F.size("lines"))).first()[0] or 0
    found = found.select(F.col("host").alias("_host"), F.col("lines").alias("_lines"))
    if many <= BROADCAST_LINES:
        found = F.broadcast(found)
    joined = docs.join(found, docs[host_col].eqNullSafe(F.col("_host")), "left").withColumn("_all", _lines(text_col))
    left = joined.withColumn(
        "_left", F.when(F.col("_lines").isNull(), F.col("_all")).otherwise(F.filter("_all", lambda x: ~F.array_contains("_lines", F.md5(x))))
    )
    text = F.when(F.col(text_col).isNotNull(), F.array_join("_left", "\n")).alias(text_col)
    return left.select(
        *(text if c == text_col else F.col(f"`{c}`") for c in names),
        F.size("_all").cast("long").alias("n_lines"),
        (F.size("_all") - F.size("_left")).cast("long").alias("n_dropped"),
    )


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, whose host is their source. Copies of a text are one page, and sources of few pages lose the lines that all
    of them have, as in op9_pages."""
    found = dedup(read(spark, sf_dir, "documents", "doc_id", "source", "text"), "source", distinct=True, small=True)
    return found.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


def op9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages, whose host is that of their url; urls without one are one site. Copies of a text are one page, and hosts
    of few pages lose the lines that all of their pages have."""
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    pages = cut(pages.select("page_id", host_of("url").alias("host"), page_text("html").alias("text")))  # markup is read once
    found = dedup(pages, "host", distinct=True, small=True)
    return found.select("page_id", "host", "n_lines", "n_dropped", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


OP9_SQL = f"""
with cut as (select doc_id, source, text, string_split(coalesce(text, ''), chr(10)) as parts from documents),
totals as (select source, count(*) as pages from (select distinct source, text from cut) group by source),
counted as (
  select source, line, count(*) as having_it from (select distinct source, text, unnest(parts) as line from cut) where trim(line) <> '' group by source, line),
gone as (
  select c.source, list(c.line) as lines from counted c join totals t on t.source is not distinct from c.source
  where c.having_it >= 2 and c.having_it > {RATIO}::double * t.pages and c.having_it >= least({LEAST_PAGES}, t.pages) group by c.source),
kept as (
  select doc_id, text, parts, case when lines is null then parts else list_filter(parts, lambda x: not list_contains(lines, x)) end as rest
  from cut left join gone on gone.source is not distinct from cut.source
)
select doc_id, len(parts)::bigint as n_lines, (len(parts) - len(rest))::bigint as n_dropped,
       case when text is not null then md5(array_to_string(rest, chr(10))) end as text_md5,
       case when text is not null then length(array_to_string(rest, chr(10)))::bigint end as n_chars
from kept
"""

OP9_PAGES_SQL = f"""
with plain as (
  select page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host,
         regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', '', 'g'),
           '(?i)</?({_BLOCK_TAGS})\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') as marked
  from pages),
cut as (
  select page_id, host, text, string_split(coalesce(text, ''), chr(10)) as parts
  from (select page_id, host, trim(regexp_replace(marked, '[ \\t\\r]*\\n\\s*', chr(10), 'g'), chr(10) || ' ') as text from plain)),
totals as (select host, count(*) as pages from (select distinct host, text from cut) group by host),
counted as (
  select host, line, count(*) as having_it from (select distinct host, text, unnest(parts) as line from cut) where trim(line) <> '' group by host, line),
gone as (
  select c.host, list(c.line) as lines from counted c join totals t on t.host is not distinct from c.host
  where c.having_it >= 2 and c.having_it > {RATIO}::double * t.pages and c.having_it >= least({LEAST_PAGES}, t.pages) group by c.host),
kept as (
  select page_id, cut.host, text, parts, case when lines is null then parts else list_filter(parts, lambda x: not list_contains(lines, x)) end as rest
  from cut left join gone on gone.host is not distinct from cut.host)
select page_id, host, len(parts)::bigint as n_lines, (len(parts) - len(rest))::bigint as n_dropped,
       case when text is not null then md5(array_to_string(rest, chr(10))) end as text_md5,
       case when text is not null then length(array_to_string(rest, chr(10)))::bigint end as n_chars
from kept
"""
