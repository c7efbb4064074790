"""SimHash near-duplicates with pigeonring candidate filtering.

Each text gets a 64-bit fingerprint of its word shingles. Fingerprints link at ``DISTANCE`` or fewer differing bits.
The bits lie on a ring of four 16-bit segments. If two fingerprints differ in at most three bits, some start on the
ring has cumulative differences of at most 3/4, 6/4, 9/4 and 12/4 over its first one, two, three and four segments
(pigeonring principle), that is 0, 1, 2 and 3 bits. The first two links of this chain make an equality key (the
segment itself, and the next one with at most one bit turned), so only pairs that pass them ever meet; the third link
and then the full distance are checked inside the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.functions.graph import components
from regolith.functions.lineage import cut
from regolith.llm.common import in_blocks, in_groups, read, roots

SHINGLE = 3
DISTANCE = 3
SEED = 42
SEGMENTS, SEGMENT_BITS = 4, 16
#: Fingerprints of one bucket that are compared in one piece; larger buckets are dealt into pairs of blocks.
BLOCK_ROWS = 600

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash. Null, empty and blank texts have fingerprint zero; a text shorter than a shingle is one
    shingle; a bit is set if more than half of the shingle hashes have it."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts words
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        starts = [0, *ends]
        hashes = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])), np.uint64)
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(by_byte[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, mark, fp) for every row, whole texts; ``mark`` is a hash of the text, which tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], ["doc_id", "mark", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), mark(text_col), text).mapInArrow(run, "doc_id long, mark long, fp long")


def mark(text_col: str) -> F.Column:
    return F.xxhash64(F.col(text_col).cast("string")).alias("mark")


def chain_keys(fps: DataFrame) -> DataFrame:
    """(key, fp, plain): for each start on the ring the fingerprint's own two-segment key, and as ``not plain`` the 16
    keys with one bit of the second segment turned."""
    n = 1 + SEGMENT_BITS
    segment = lambda i: F.expr(f"(shiftrightunsigned(fp, {SEGMENT_BITS} * cast({i} as int)) & {2**SEGMENT_BITS - 1})")
    return (
        fps.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS * n - 1))))
        .withColumn("start", F.expr(f"at div {n}"))
        .withColumn("turn", F.expr(f"cast(at % {n} as int)"))
        .withColumn("second", F.expr("cast((start + 1) % 4 as int)"))
        .withColumn("b", segment("second").bitwiseXOR(F.expr("case when turn = 0 then 0L else shiftleft(1L, turn - 1) end")))
        .select(
            F.expr(f"shiftleft(cast(start as bigint), 32) | shiftleft({segment_sql('start')}, 16) | b").alias("key"),
            "fp",
            (F.col("turn") == 0).alias("plain"),
        )
    )


def segment_sql(i: str) -> str:
    return f"(shiftrightunsigned(fp, {SEGMENT_BITS} * cast({i} as int)) & {2**SEGMENT_BITS - 1})"


def _linked(group: pd.DataFrame) -> pd.DataFrame:
    """Edges (a, b) that connect what the group's pairs connect: the rest of the chain, then the full distance."""
    fps = group["fp"].to_numpy().astype(np.uint64)
    plain, block = group["plain"].to_numpy(), group["block"].to_numpy()
    start = group["key"].to_numpy() >> 32
    differ = fps[:, None] ^ fps[None, :]
    upto3 = np.zeros(differ.shape, np.uint8)
    for k in range(3):
        shift = ((start + k) % SEGMENTS * SEGMENT_BITS).astype(np.uint64)[:, None]
        upto3 += np.bitwise_count((differ >> shift) & np.uint64(2**SEGMENT_BITS - 1))
    links = (upto3 <= 2) & (np.bitwise_count(differ) <= DISTANCE)
    links &= plain[:, None] | plain[None, :]
    links &= start[:, None] == start[None, :]
    if group["mixed"].iloc[0]:
        links &= block[:, None] != block[None, :]
    order = np.argsort(group["fp"].to_numpy(), kind="stable")
    root = np.empty(len(order), np.int64)
    root[order] = order[roots(links[np.ix_(order, order)])]
    signed = group["fp"].to_numpy()
    out = pd.DataFrame({"a": signed[root], "b": signed})
    return out[out.a != out.b].drop_duplicates()


def link_fingerprints(classes: DataFrame) -> DataFrame:
    """(node, component) of classes(node, fp), one for each fingerprint, that link with another one. A node begins with what
    a component is to be known by (without a column ``node`` it is the fingerprint); the smallest node is the component."""
    if "node" not in classes.columns:
        classes = classes.select("fp", F.col("fp").alias("node"))
    keys = chain_keys(classes.select("fp"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("size"), F.max("plain").alias("any_plain")).where("size > 1 and any_plain").select("key", "size")
    met = in_blocks(keys.join(sizes, "key"), "key", "size", "fp", BLOCK_ROWS)
    edges = in_groups(met.select("pair", "key", "fp", "plain", "block", "mixed"), "pair", _linked, "a long, b long").distinct()
    of = lambda end: classes.select(F.col("node").alias(f"{end}_node"), F.col("fp").alias(end))
    named = edges.join(of("a"), "a").join(of("b"), "b")
    return components(named.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, mark, fp, component_id (the smallest id reachable over linked fingerprints) and
    root_fp (the fingerprint of the component's first text, that of the smallest id).

    Null and empty texts share fingerprint zero and link with each other. Rows with a null id get the component of
    their fingerprint, which is null if no row of it has an id. Repeated rows each keep their row, and rows that repeat an
    id with another text stand for that text. An empty table gives no rows. Other columns of ``docs`` are not read."""
    found = cut(fingerprints(docs, id_col, text_col, shingle))
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.min("doc_id")
    node = F.struct(first.isNull().alias("unnamed"), first.alias("id"), F.col("fp"))  # an id may have several fingerprints
    classes = cut(found.groupBy("fp").agg(node.alias("node")).repartition(spread, "fp"))  # each makes 68 keys: not merged by their bytes
    linked = link_fingerprints(classes)
    reach = classes.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("root"))
    return found.join(reach, "fp").select("doc_id", "mark", "fp", F.col("root.id").alias("component_id"), F.col("root.fp").alias("root_fp"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
