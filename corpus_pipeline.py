"""Corpus pipeline: language, line and near-duplicate filters, a mix of sources, then tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next one's
docs. All but the last return the columns of documents. Columns beyond those of documents pass through.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.functions.lineage import cut, shared_dir
from regolith.llm import bpe, language, lines, mixing, simhash
from regolith.llm.common import small_batches


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go (no letter, or far from every language of the labelled rows); a missing
    lang is filled with the prediction."""
    small_batches(spark)
    found = language.identify(docs, language.train(docs.select("doc_id", "text", "lang")))
    kept = found.where("not rejected").withColumn("lang", F.coalesce("lang", "lang_pred"))
    return kept.select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go from its texts; n_chars follows. No document goes. Copies of a text are one page
    of their source, so that a large group of them does not empty itself before one of it is chosen."""
    found = lines.dedup(docs, "source", distinct=True)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id; of a group without any id one of its
    rows. Documents are told apart by id and text, so rows that repeat an id with another text are documents of their own,
    and of rows that repeat both one stays."""
    small_batches(spark)
    found = cut(simhash.near_duplicates(docs))
    firsts = found.where("doc_id <=> component_id and fp = root_fp")
    texts = firsts.groupBy("component_id", "root_fp", "mark").agg(F.count("*").alias("rows"))
    first = texts.groupBy("component_id", "root_fp").agg(F.min(F.struct("mark", "rows")).alias("first"))
    kept = cut(first.select(F.col("component_id").alias("kept_id"), F.col("first.mark").alias("kept_mark"), F.col("first.rows").alias("kept_rows")))
    same = docs["doc_id"].cast("long").eqNullSafe(kept["kept_id"]) & (simhash.mark("text") == kept["kept_mark"])
    out = docs.join(kept, same, "left_semi")
    if kept.where("kept_rows > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", "text"])
    return out.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated probabilities sample stay."""
    return mixing.sample(docs).where("sampled").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to. A null text has no ids; a null or
    repeated id keeps all its rows."""
    small_batches(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: The first stage's model is not SQL; the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is a table in the shared folder before the next stage reads it."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs.drop("ids")
