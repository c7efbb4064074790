"""Importance resampling towards a target distribution.

Features are hashed runs of one and two words. Their counts by bucket, over all documents and over all target texts, give each
bucket a gain, the logarithm of how much likelier it is in the target. A document's weight is the mean gain of its
features, looked up in one array of gains; a weight with Gumbel noise that is fixed by the document's id is its score, and the
highest scores are drawn: a sample without replacement.

The cutoff is not found by sorting all scores. A quantile sketch gives a bracket around it; exact counts of the scores above and
inside tell whether the cutoff lies in it, else it is widened; only the bracket is sorted. The rows above the cutoff are then
ranked in ranges, one for each partition.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.functions.lineage import cut
from regolith.llm.common import read

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: What parts words, once A-Z are lower-cased: all of ASCII but digits and letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words that are looked at together.
CHUNK = 1_000_000
#: Share of the rows on either side of the cutoff that the first bracket takes, and the sketch's accuracy.
MARGIN, ACCURACY = 0.005, 10_000


def _shift_tables() -> np.ndarray:
    """[k, byte, value]: what that byte of a crc becomes when 2^k zero bytes follow."""
    byte = np.arange(256, dtype=np.uint32)
    step = byte
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    now = np.stack([step, byte, byte << 8, byte << 16]).astype(np.uint32)
    tables = [now]
    for _ in range(30):
        now = _shift(now, now)
        tables.append(now)
    return np.stack(tables)


def _shift(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


_TABLES: list[np.ndarray] = []


def joined_crc(first: np.ndarray, second: np.ndarray, second_bytes: np.ndarray) -> np.ndarray:
    """The crc32 of two texts in a row from theirs and the bytes of the second."""
    if not _TABLES:
        _TABLES.append(_shift_tables())
    out = first.copy()
    for k in range(int(second_bytes.max(initial=0)).bit_length()):
        on = (second_bytes >> k & 1).astype(bool)
        out[on] = _shift(_TABLES[0][k], out[on])
    return out ^ second


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and the number of each text's."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts.cast(pa.large_string())), GAPS)
    words = parts.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    ends = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return words.filter(real), np.diff(upto[ends])


def features(texts: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the text, bucket) of all features, some at a time."""
    words, counts = word_lists(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    for a in range(0, len(words), CHUNK):
        own = owner[a : a + CHUNK + 1]  # with the next chunk's first word, for the pair over the border
        coded = words.slice(a, CHUNK + 1).dictionary_encode()
        known = coded.dictionary.cast(pa.large_binary()).to_pylist()
        code = coded.indices.to_numpy()
        crc = np.fromiter((zlib.crc32(w) for w in known), np.uint32, len(known))
        after = np.fromiter((zlib.crc32(b" " + w) for w in known), np.uint32, len(known))
        size = np.fromiter((len(w) + 1 for w in known), np.int64, len(known))
        yield own[:CHUNK], crc[code[:CHUNK]] % buckets
        pair = np.flatnonzero(own[:-1] == own[1:])
        yield own[pair], joined_crc(crc[code[pair]], after[code[pair + 1]], size[code[pair + 1]]) % buckets


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows by bucket: a task sums its own, so one row for each bucket and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in features(batch.column(0), buckets):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = texts.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share in the target over that in the source, each count plus one, floored."""
    s, t, n = float(source.sum()), float(target.sum()), len(source)
    ratio = ((target + 1.0) * (s + n)) / ((source + 1.0) * (t + n))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def noise(key: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of ``docs`` (doc_id, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for own, found in features(texts, len(gain)):
                total += np.bincount(own, gain[found], len(texts))  # whole numbers below 2^53
                n += np.bincount(own, minlength=len(texts))
            weight = np.where(n > 0, total.astype(np.int64) // np.maximum(n, 1), 0)
            drawn = weight + np.fromiter((noise(i, seed) for i in ids.to_pylist()), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays([ids, pa.array((n + 1) // 2), pa.array(n), pa.array(weight), pa.array(drawn)], ["doc_id", "n_words", "n_features", "weight", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return narrow.mapInArrow(each, "doc_id long, n_words long, n_features long, weight long, score long")


ORDER = (F.desc, "score"), (F.asc_nulls_last, "doc_id"), (F.asc, "weight"), (F.asc, "n_features")


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with rank from 1 in ORDER. Each partition sorts a range; only the ranges' sizes meet."""
    order: list[Column] = [f(c) for f, c in ORDER]
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(rows.repartitionByRange(spread, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = parts.groupBy(F.shiftright("_at", 33).alias("_part")).count().orderBy("_part").collect()  # one row a partition
    before, upto = [], 0
    for r in sizes:
        before.append((r["_part"], upto))
        upto += r["count"]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "_part long, _before long"))
    met = parts.withColumn("_part", F.shiftright("_at", 33)).join(offsets, "_part")
    return met.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(2**33 - 1) + 1).drop("_part", "_before", "_at")


def cutoff(rows: DataFrame, k: int, n: int, margin: float = MARGIN) -> tuple[int, int | None]:
    """(score, doc_id) of the ``k``-th of ``n`` rows in ORDER: the sketch's bracket around it, validated by exact counts
    and widened until it holds the row, is all that is sorted."""
    share = 1 - k / n
    while True:
        ends = [max(0.0, share - margin), min(1.0, share + margin)]
        about = F.percentile_approx("score", ends, ACCURACY)
        low, high = rows.agg(about).first()[0] if margin < 1 else rows.agg(F.min("score"), F.max("score")).first()
        inside = F.col("score").between(low, high)
        above, held = rows.agg(F.count_if(F.col("score") > high), F.count_if(inside)).first()
        if above < k <= above + held:
            row = ranked(rows.where(inside)).where(F.col("rank") == k - above).first()
            return row["score"], row["doc_id"]
        margin *= 4


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text), drawn towards the texts of ``target``
    (text): ``rank`` is null for those that are not among the ``percent`` hundredths of highest scores of the rows with at least
    ``least_words`` words.

    A null or empty text has no features and weight 0. A null id takes the noise of an empty one and comes last among
    equal scores; rows that repeat an id are rows of their own, with one noise, then ordered by weight and features. Either
    table may be empty; other columns do not matter. Whole texts count, however long."""
    gain = gains(bucket_counts(docs, buckets=buckets), bucket_counts(target, buckets=buckets))
    rows = cut(score(docs, gain, seed))
    fit = F.col("n_words") >= least_words
    n = rows.where(fit).count()
    k = percent * n // 100
    names = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not k:
        return rows.select(*names, none)
    least, last = cutoff(rows.where(fit).select(*names), k, n)
    tied = (F.col("score") == least) & (F.lit(True) if last is None else F.coalesce(F.col("doc_id") <= last, F.lit(False)))
    taken = fit & ((F.col("score") > least) | tied)
    drawn = ranked(rows.where(taken).select(*names)).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))  # of an id that is repeated at the cutoff not all
    return drawn.select(*names, "rank").unionByName(rows.where(~taken).select(*names, none))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "text"))


OP13_SQL = r"""with crc as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i)),
texts as (select 'd' as side, doc_id as id, text from documents union all select 'b', item_id, text from benchmark),
words as materialized (
  select side, id, row_number() over () as no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
feature as (
  select side, no, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from words),
hashed as (
  select f, hex(encode(f)) as h, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::bigint)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket
  from (select distinct f from feature) cross join crc),
counted as (
  select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t, sum(s) over () as all_s, sum(t) over () as all_t from feature join hashed using (f) group by bucket),
gain as (
  select bucket, floor(1000 * ln((t + 1)::double * (all_s + 10000)::double / ((s + 1)::double * (all_t + 10000)::double)))::bigint as gain from counted),
weighed as (select no, count(*) as n_features, sum(gain)::bigint as total from feature join hashed using (f) join gain using (bucket) where side = 'd' group by no),
scored as (
  select id as doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::bigint as weight,
         weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from words left join weighed using (no) where side = 'd'),
placed as (select *, row_number() over (order by n_words < 20, score desc, doc_id) as place, count(*) filter (n_words >= 20) over () as n from scored)
select doc_id, n_features, weight, score, case when place <= 25 * n // 100 then place end as rank from placed"""
