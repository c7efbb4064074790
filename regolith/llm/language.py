"""Language identification by nearest centroid.

A text is a vector of its letter n-grams (one to three characters, words parted by one space), counted over the whole
text, dampened, weighted by inverse document frequency and normalised. Each language has a few centroids, found by
clustering its training vectors by cosine, so that one language may have several kinds of text. A text takes the language
of the nearest centroid; if even that one is farther than texts of such a length ever are, the text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from regolith.llm.common import held_out, read

#: Texts of one language that the model is fitted on at most, and of all together: documented bounds.
SAMPLE_ROWS, SAMPLE_TOTAL = 800, 6000
#: Languages that are learned at most, those of most rows, and characters of a text of the sample.
MOST_LANGS, SAMPLE_CHARS = 300, 50_000
CENTROIDS, SIZE, SMALLEST_SHARE = 3, 4096, 0.1
#: Characters whose n-grams are counted together.
CHUNK = 200_000
#: A text is rejected if its cosine is below this share of the lowest hundredth of training texts of its length.
REJECT_SHARE = 0.5
SHARPNESS = 40.0
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    centroids: np.ndarray  # (languages * CENTROIDS, SIZE)
    owner: np.ndarray  # language of each centroid
    idf: np.ndarray
    floor: np.ndarray  # least cosine by length class


_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def counts(text: str | None) -> tuple[np.ndarray, int]:
    """N-gram counts by hash, and the number of letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    letters = int(np.count_nonzero(letter))
    if not letters:
        return np.zeros(SIZE, np.float32), 0
    keep = letter | np.concatenate([[False], letter[:-1]])  # of each run between words only its first character
    points = np.concatenate([[32], np.where(letter, points, 32)[keep], [32]])
    found = np.zeros(SIZE, np.float32)
    for a in range(0, len(points), CHUNK):  # long texts in chunks, each with the two points behind it that its n-grams reach
        part = points[a : a + CHUNK + 2].astype(np.uint64)
        one, two = part[:CHUNK], part[:-1] << np.uint64(21) | part[1:]
        three = two[:-1] << np.uint64(21) | part[2:]
        inner = one[int(a == 0) : len(one) - int(a + CHUNK >= len(points))]  # not the spaces that were set around the text
        for grams in (inner, two[:CHUNK], three[:CHUNK]):
            slots = (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SIZE.bit_length() + 1)
            found += np.bincount(slots.astype(np.int64), minlength=SIZE).astype(np.float32)
    return found, letters


def _length_class(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(int), 12)


def _vectors(found: list[tuple[np.ndarray, int]], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(np.array([c for c, _ in found]).reshape(-1, SIZE)) * idf
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _cluster(x: np.ndarray) -> np.ndarray:
    """Spherical k-means from starts spread over the vectors' similarity to their mean. Clusters of less than a tenth
    of the vectors are left out: wrongly labelled texts gather there."""
    order = np.argsort(-(x @ x.mean(axis=0)), kind="stable")
    c = x[order[np.linspace(0, 0.8 * (len(x) - 1), min(CENTROIDS, len(x))).astype(int)]].copy()
    for _ in range(12):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.array([x[near == k].sum(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    sizes = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
    return c[(sizes >= SMALLEST_SHARE * len(x)) | (sizes == sizes.max())]


def _fragments(text: str) -> list[str]:
    """The text, and spans of a few words from its middle: training texts are seldom as short as texts can be."""
    words = text.split()
    middle = len(words) // 2
    return [text, *(" ".join(words[middle : middle + n]) for n in (1, 2, 5, 12, 40) if n < len(words))]


def fit(texts: list[str], langs: list[str]) -> Model | None:
    """Model of labelled texts; None if none of them has a letter."""
    rows = [(c, lang, t) for t, lang in zip(texts, langs) if (c := counts(t))[1]]
    if not rows:
        return None
    seen = sum(c[0] > 0 for c, _, _ in rows)
    idf = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32)
    x, names = np.vstack([_vectors([c for c, _, _ in rows[k : k + 500]], idf) for k in range(0, len(rows), 500)]), sorted({lang for _, lang, _ in rows})
    of = np.array([names.index(lang) for _, lang, _ in rows])
    parts = [_cluster(x[of == k]) for k in range(len(names))]
    owner = np.repeat(np.arange(len(names)), [len(p) for p in parts])
    model = Model(tuple(names), np.vstack(parts).astype(np.float32), owner, idf, np.zeros(13))
    best, letters = [], []
    for k in range(0, len(rows), 100):
        found = [c for _, _, t in rows[k : k + 100] for f in _fragments(t) if (c := counts(f))[1]]
        best.append(_best(model, found).max(axis=1))
        letters += [n for _, n in found]
    best, classes = np.concatenate(best), _length_class(np.array(letters))
    floor = np.zeros(13)
    for k in range(13):
        if (classes == k).sum() >= 20:
            floor[k] = REJECT_SHARE * np.quantile(best[classes == k], 0.01)
    for k in range(1, 13):
        if not (classes == k).sum() >= 20:
            floor[k] = floor[k - 1]
    return Model(model.langs, model.centroids, owner, idf, floor)


def _best(model: Model, found: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Per text and language the largest cosine with one of the language's centroids."""
    out = []
    for k in range(0, len(found), 500):
        cosines = _vectors(found[k : k + 500], model.idf) @ model.centroids.T
        out.append(np.stack([cosines[:, model.owner == j].max(axis=1) for j in range(len(model.langs))], axis=1))
    return np.vstack(out) if out else np.zeros((0, len(model.langs)))


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    found = [counts(t) for t in texts]
    letters = np.array([n for _, n in found], np.int64)
    if model is None or not found:
        return [UNDETERMINED] * len(found), np.zeros(len(found)), np.ones(len(found), bool)
    best = _best(model, found)
    top = best.argmax(axis=1)
    cosine = best.max(axis=1)
    shares = np.exp(SHARPNESS * (best - cosine[:, None]).astype(np.float64))
    none = letters == 0
    score = np.where(none, 0.0, np.clip(1 / shares.sum(axis=1), 0, 1))
    rejected = none | (cosine < model.floor[_length_class(letters)])
    return [UNDETERMINED if n else model.langs[k] for n, k in zip(none, top)], score, rejected


def train(docs: DataFrame) -> Model | None:
    """Fits on a bounded sample of ``docs`` (doc_id, text, lang) that are not held out and have a language and a text:
    for each language those with the smallest hashes of id and text, of at most SAMPLE_CHARS characters; a row that repeats
    another counts once. The counts of rows by language are over all rows."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out("doc_id"))
    known = known.where(F.length("text") <= SAMPLE_CHARS)
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()}
    if not sizes:
        return None
    rows = max(20, min(SAMPLE_ROWS, SAMPLE_TOTAL // len(sizes)))
    share = F.create_map(*(F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, (1.2 * rows + 30) / n))))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**40)) / float(2**40)
    some = known.withColumn("place", place).where(F.col("place") < share[F.col("lang")]).select("doc_id", "text", "lang", "place").distinct().toPandas()
    some = some.sort_values(["lang", "place", "doc_id"]).groupby("lang", sort=True).head(rows)
    return fit(some["text"].tolist(), some["lang"].tolist())


_SCHEMA = "lang_pred string, score double, rejected boolean"


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected; columns of these names are replaced. Null texts and texts without a
    letter are ``und`` with score 0 and rejected; so is every text if there was nothing to learn from. All other texts
    have a learned language. Repeated rows keep their rows."""
    out_names = [x.split()[0] for x in _SCHEMA.split(", ")]
    docs = docs.drop(*out_names)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: languages x CENTROIDS x SIZE floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score, rejected = predict(shared.value, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*batch.schema.names, *out_names])

    schema = StructType(list(docs.schema.fields))
    for name, kind in (x.split() for x in _SCHEMA.split(", ")):
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    found = identify(read(spark, sf_dir, "documents", "doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
