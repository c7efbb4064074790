"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents are counted into cells of (source, language, topic) by tokens. Raking scales the cells' weights in turn until
their sums by source, by language and by topic are the target marginals; a cell's weight over its share of the tokens is
its rate. A document is sampled with the probability scale * rate, at most 1, the scale being such that the expected
tokens are the budget; whether it is sampled depends on a hash of its id alone.

Cells number at most sources x languages x topics, whatever the number of documents: counting leaves partial sums, so a
source with a third of all rows is a few rows after the first stage, and the loops below run on cells only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regolith.functions.lineage import cut
from regolith.llm.common import read

DIMENSIONS = ("source", "lang", "topic")
#: Cells that are broadcast to the documents at most, about 100 bytes each; more are joined by shuffle.
BROADCAST_CELLS = 200_000


@dataclass(frozen=True)
class Mix:
    """``flatten``: target marginals are natural token shares to this power, normalised; ``targets`` gives shares of
    values by dimension instead (values not named share what is left as they do naturally). ``budget``: expected share
    of all tokens that is sampled. ``sweeps`` of raking and ``steps`` of the scale are fixed, so any run does the same."""

    flatten: float = 0.5
    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    budget: float = 0.5
    sweeps: int = 12
    steps: int = 6
    seed: str = "mix"


def n_tokens(text: str) -> F.Column:
    """White-space separated words."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic(text: str) -> F.Column:
    """Topic by what the text is made of: table rows, list or code lines, licence terms, short notes, long or plain prose."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (
        F.when(t.contains(" | "), "table")
        .when(F.lower(t).contains("license"), "licence")
        .when(F.length(t) < 400, "note")
        .when(F.length(t) >= 4000, "long")
        .otherwise("prose")
    )


def chance(id_col: str, seed: str) -> F.Column:
    """Uniform in [0, 1) from the md5 of seed and id."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def with_cells(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with _tokens and the dimensions as _source, _lang, _topic; nulls are the value ``(none)``."""
    named = {f"_{d}": F.coalesce(F.col(d).cast("string"), F.lit("(none)")) for d in ("source", "lang")}
    return docs.withColumns(named | {"_topic": topic(text_col), "_tokens": n_tokens(text_col)})


def _targets(cells: DataFrame, dim: str, mix: Mix) -> DataFrame:
    """(value, target) of one dimension, summing to 1."""
    natural = cells.groupBy(f"_{dim}").agg(F.sum("tokens").alias("t"))
    every = Window.partitionBy(F.lit(1))
    given = mix.targets.get(dim, {})
    if not given:
        power = F.pow(F.col("t").cast("double"), F.lit(mix.flatten))
        return natural.select(f"_{dim}", (power / F.sum(power).over(every)).alias(f"target_{dim}"))
    named = F.create_map(*(F.lit(x) for pair in given.items() for x in pair))[F.col(f"_{dim}")]
    open_ = F.when(named.isNull(), F.col("t")).otherwise(0)
    left = max(0.0, 1 - sum(given.values()))
    part = F.coalesce(named, F.lit(left) * F.col("t") / F.nullif(F.sum(open_).over(every), F.lit(0)))
    return natural.select(f"_{dim}", part.alias("p")).select(f"_{dim}", (F.col("p") / F.sum("p").over(every)).alias(f"target_{dim}"))


def rake(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Cells (_source, _lang, _topic) with tokens, weight (sums to 1) and prob, of ``docs`` from with_cells."""
    keys = [f"_{d}" for d in DIMENSIONS]
    cells = cut(docs.groupBy(*keys).agg(F.sum("_tokens").alias("tokens")))
    total, n = cells.agg(F.sum("tokens"), F.count("*")).first()
    total = total or 0
    if n <= BROADCAST_CELLS:
        cells = cells.coalesce(1)  # windows over so few rows need no exchange then
    now = cells.withColumn("weight", F.col("tokens") / F.lit(float(max(total, 1))))
    for dim in DIMENSIONS:
        now = now.join(_targets(cells, dim, mix), f"_{dim}")
    now = cut(now)
    for sweep in range(mix.sweeps):
        for dim in DIMENSIONS:
            sums = F.sum("weight").over(Window.partitionBy(f"_{dim}"))
            now = now.withColumn("weight", F.when(sums > 0, F.col("weight") * F.col(f"target_{dim}") / sums).otherwise(F.lit(0.0)))
        if sweep % 4 == 3 or sweep == mix.sweeps - 1:
            now = cut(now)
    rate = F.when(F.col("tokens") > 0, F.col("weight") / (F.col("tokens") / F.lit(float(max(total, 1))))).otherwise(F.lit(1.0))
    now = cut(now.select(*keys, "tokens", "weight", rate.alias("rate")))
    budget, scale = mix.budget * total, mix.budget
    for _ in range(mix.steps):
        expected = now.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("rate") * F.lit(scale)))).first()[0] or 0.0
        scale = scale * budget / expected if expected else scale
    return now.select(*keys, "tokens", "weight", F.least(F.lit(1.0), F.col("rate") * F.lit(scale)).alias("prob"))


def sample(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with topic, n_tokens, weight, prob and sampled (columns of these names are replaced).

    Null texts have no tokens; a cell without tokens has the rate 1; a null id has a chance of its own; repeated rows share
    theirs. Documents are joined to their cells without a shuffle while the cells are few enough to broadcast. An empty
    table gives no rows."""
    docs = docs.drop("topic", "n_tokens", "weight", "prob", "sampled")
    names, marked = docs.columns, with_cells(docs, text_col)
    cells = cut(rake(marked, mix).drop("tokens"))
    if cells.count() <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    return marked.join(cells, [f"_{d}" for d in DIMENSIONS]).select(
        *(F.col(f"`{c}`") for c in names),
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"),
        "weight",
        "prob",
        (chance(id_col, mix.seed) < F.col("prob")).alias("sampled"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sample(read(spark, sf_dir, "documents", "doc_id", "source", "lang", "text"))
    rounded = {c: F.round(c, 9) for c in ("weight", "prob")}
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "prob", "sampled").withColumns(rounded)


def oracle(mix: Mix = Mix()) -> str:
    """The same in DuckDB: the sweeps and steps as a chain of queries (flattened natural targets)."""
    ctes = [
        """marked as (
  select doc_id, source, lang, coalesce(source, '(none)') as s, coalesce(lang, '(none)') as l,
         case when contains(t, ' | ') then 'table' when contains(lower(t), 'license') then 'licence'
              when length(t) < 400 then 'note' when length(t) >= 4000 then 'long' else 'prose' end as k,
         len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::bigint as n
  from (select *, coalesce(text, '') as t from documents))""",
        "cells as (select s, l, k, sum(n)::double as n from marked group by all)",
    ]
    for d in "slk":
        ctes.append(f"t_{d} as (select {d}, p / sum(p) over () as target from (select {d}, pow(sum(n), {mix.flatten}) as p from cells group by {d}))")
    ctes.append("w_0 as materialized (select *, n / (select sum(n) from cells) as w from cells)")
    step = 0
    for _ in range(mix.sweeps):
        for d in "slk":
            ctes.append(
                f"w_{step + 1} as materialized (select s, l, k, n, case when z > 0 then w * target / z else 0 end as w"
                f" from (select w.*, target, sum(w) over (partition by {d}) as z from w_{step} w join t_{d} using ({d})))"
            )
            step += 1
    ctes.append(f"rates as materialized (select *, case when n > 0 then w / (n / (select sum(n) from cells)) else 1 end as rate from w_{step})")
    ctes.append(f"c_0 as materialized (select {mix.budget}::double as scale)")
    for i in range(mix.steps):
        ctes.append(f"c_{i + 1} as materialized (select scale * {mix.budget} * sum(n) / sum(n * least(1, rate * scale)) as scale from rates, c_{i} group by scale)")
    return "with " + ",\n".join(ctes) + f"""
select doc_id, source, lang, k as topic, n_ as n_tokens, round(w, 9) as weight, round(p, 9) as prob,
       (('0x' || substr(md5('{mix.seed}:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint / pow(2, 52)) < p as sampled
from (select m.*, m.n as n_, r.w, least(1, r.rate * c.scale) as p from marked m join rates r using (s, l, k), c_{mix.steps} c)
"""


OP4_SQL = oracle()
