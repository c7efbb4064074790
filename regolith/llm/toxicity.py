"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text's windows are compressed with
each; where the toxic dictionary saves bytes over the ordinary one, the window resembles toxic text. A window is one
word with a fixed terminator: within so short a window the lengths differ only by what a dictionary knows of the word,
and equal windows need compressing once. Both dictionaries hold the same frequent ordinary windows, so that ordinary
words cost the same in either; then one holds the windows that are typical of toxic text (frequent there in many
contexts, rare in ordinary text) and the other as many bytes of further ordinary windows. The largest savings of a
text give its score through a logistic curve fitted on the training rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.llm.common import held_out, read

#: Labelled rows of each class that the model is fitted on at most, the smallest hashes of their ids: a documented bound.
SAMPLE_ROWS = 2000
#: Characters of a text of the sample at most.
SAMPLE_CHARS = 50_000
#: Distinct words of the sample, by class, that are looked at: those in most contexts. Contexts of one word that count.
SAMPLE_WORDS, WORD_CONTEXTS = 200_000, 5_000
SHARED_BYTES, TYPICAL_BYTES = 20_000, 16_000
#: A toxic window's log frequency ratio times the root of its contexts must exceed a bound: that of these which, fitted on one
#: half of the training texts, tells the other half apart best.
BOUNDS = (5.0, 8.0, 13.0, 20.0)
TERMINATOR = bytes(range(1, 25))
HELD_WINDOWS = 400_000
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


_WORD = re.compile(r"[^\W_]+(?:['\u2019][^\W_]+)*")


def _words(text: str | None) -> list[str]:
    """Runs of letters and digits: marks around a word do not change it."""
    return _WORD.findall((text or "").lower())


def _window(word: str) -> bytes:
    return f" {word} ".encode() + TERMINATOR


class Scorer:
    """The model's two compressors, and the savings of windows met so far."""

    def __init__(self, model: Model):
        self.weights = np.array(model.weights)
        self.pair = [self._compressor(model.ordinary), self._compressor(model.toxic)]
        self.held: dict[str, int] = {}

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        params = zstandard.ZstdCompressionParameters(
            compression_level=3, strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=16, hash_log=15, chain_log=15, search_log=5, target_length=32,
            write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=params)

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.held]
        if len(self.held) + len(new) > HELD_WINDOWS:
            self.held, new = {}, list(words)
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            windows = [_window(w) for w in some]
            lengths = [[len(x) for x in c.multi_compress_to_buffer(windows, threads=1)] for c in self.pair]
            self.held.update((w, a - b) for w, a, b in zip(some, *lengths, strict=True))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text: the largest saving, the mean of the three largest, and 1. A text without words saves nothing."""
        words = [_words(t) for t in texts]
        self._learn(set().union(*words) if words else set())
        out = np.zeros((len(texts), 3))
        out[:, 2] = 1
        for row, found in zip(out, words, strict=True):
            if found:
                saved = np.fromiter(map(self.held.__getitem__, found), np.int64, len(found))
                top = np.sort(np.partition(saved, -3)[-3:] if len(saved) > 3 else saved)[::-1]
                row[0], row[1] = top[0], np.clip(top, 0, None).sum() / 3
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return _logistic(self.features(texts) @ self.weights)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _contexts(texts: list[str | None]) -> Counter[str]:
    """Per word the number of different neighbours it stands between: copies of a passage do not make its words frequent."""
    seen: dict[str, set[int]] = {}
    for text in texts:
        words = _words(text)
        for before, word, after in zip(["", *words], words, [*words[1:], ""]):
            around = seen.setdefault(word, set())
            if len(around) < WORD_CONTEXTS:
                around.add(hash((before, after)))
    return Counter(dict(Counter({w: len(s) for w, s in seen.items()}).most_common(SAMPLE_WORDS)))


def _content(words: list[str], most: int) -> bytes:
    """Windows of the words up to that many bytes; the first word comes last, where matches are cheapest."""
    windows, held = [], 0
    for word in words:
        windows.append(_window(word))
        held += len(windows[-1])
        if held >= most:
            break
    return b"".join(reversed(windows))[-most:]


def _loss(texts: list[str | None], marked: np.ndarray, job: int) -> float:
    """How badly one half of the texts, fitted with one of the bounds, tells the other half apart. Jobs are numbered by half,
    then by bound."""
    fold = np.arange(len(marked)) // 2 % 2 == 1  # neighbours in order of id may be copies: pairs go together
    side, bound = (fold, ~fold)[job // len(BOUNDS)], BOUNDS[job % len(BOUNDS)]
    own, other = [t for t, f in zip(texts, side) if f], [t for t, f in zip(texts, side) if not f]
    model = _fitted(own, marked[side], _by_class(own, marked[side]), bound)
    p = np.clip(Scorer(model).scores(other), 1e-6, 1 - 1e-6) if model else np.full(len(other), 1e-9)
    return -float(np.log(np.where(marked[~side], p, 1 - p)).sum())


def _in_tasks(spark: SparkSession) -> Callable[[list[str | None], np.ndarray], list[float]]:
    """All jobs of _loss, each a task: the sample, which is bounded, goes to the executors once."""

    def run(texts: list[str | None], marked: np.ndarray) -> list[float]:
        n, sample = 2 * len(BOUNDS), spark.sparkContext.broadcast((texts, marked))

        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame({"job": frame["id"], "loss": [_loss(*sample.value, int(job)) for job in frame["id"]]})

        return [r["loss"] for r in spark.range(0, n, 1, n).mapInPandas(each, "job long, loss double").orderBy("job").collect()]

    return run


def _in_turn(texts: list[str | None], marked: np.ndarray) -> list[float]:
    return [_loss(texts, marked, job) for job in range(2 * len(BOUNDS))]


def fit(texts: list[str | None], toxic: list[int], share: float | None = None, judge: Callable[[list[str | None], np.ndarray], list[float]] = _in_turn) -> Model:
    """Dictionaries and curve from labelled texts. ``share`` is the toxic share of all labelled rows, to which the curve
    is set if the texts are a sample with another share. Without rows of both classes every text scores the share. ``judge``
    runs the jobs of _loss."""
    marked = np.array(toxic, bool)
    own = float(np.clip(marked.mean() if len(marked) else 0, 0.001, 0.999))
    share = own if share is None else float(np.clip(share, 0.001, 0.999))
    flat = Model(TERMINATOR, TERMINATOR, (0.0, 0.0, float(np.log(share / (1 - share)))))
    if marked.all() or not marked.any():
        return flat
    losses = np.array(judge(texts, marked)).reshape(2, len(BOUNDS)).sum(axis=0)
    model = _fitted(texts, marked, _by_class(texts, marked), BOUNDS[int(np.argmin(losses))])
    if model is None:
        return flat
    shift = np.log(share / (1 - share)) - np.log(own / (1 - own))
    return Model(model.ordinary, model.toxic, (*model.weights[:2], model.weights[2] + float(shift)))


def _by_class(texts: list[str | None], marked: np.ndarray) -> tuple[Counter[str], Counter[str]]:
    return _contexts([t for t, m in zip(texts, marked) if m]), _contexts([t for t, m in zip(texts, marked) if not m])


def _fitted(texts: list[str | None], marked: np.ndarray, seen: tuple[Counter[str], Counter[str]], bound: float) -> Model | None:
    """Both dictionaries and the curve over the texts' own share; None if no window is typical of toxic text."""
    if marked.all() or not marked.any():
        return None
    bad, good = seen
    n_bad, n_good = max(1, sum(bad.values())), max(1, sum(good.values()))
    excess = {w: (np.log((n + 0.5) / n_bad) - np.log((good[w] + 0.5) / n_good)) * np.sqrt(n) for w, n in bad.items() if n >= 5}
    typical = sorted((w for w, x in excess.items() if x > bound), key=lambda w: (-excess[w], w))
    if not typical:
        return None
    chosen = set(typical)
    frequent = sorted((w for w in good if w not in chosen), key=lambda w: (-good[w], w))
    shared, extra = _content(frequent, SHARED_BYTES), _content(typical, TYPICAL_BYTES)
    begun = len(shared) // (len(TERMINATOR) + 4)
    other = _content(frequent[begun:] or frequent, len(extra))
    model = Model(shared + other, shared + extra, (0.0, 0.0, 0.0))
    x, y = Scorer(model).features(texts), marked.astype(float)
    weights = np.zeros(3)
    for _ in range(50):  # Newton steps, slightly ridged so that separable classes stay finite
        p = _logistic(x @ weights)
        grad = x.T @ (p - y) + 0.05 * weights * [1, 1, 0]
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.05, 0.05, 1e-6])
        weights -= np.linalg.solve(hess, grad)
    return Model(model.ordinary, model.toxic, tuple(float(w) for w in weights))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most ``rows`` labelled texts of each class that are not held out, those with the smallest hashes of
    their ids; rows with a null label, null id or null text, or a text of over SAMPLE_CHARS characters, do not count, and a row
    that repeats another counts once."""
    marks = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic").where(~held_out("doc_id"))
    chosen = None
    for kind in (0, 1):
        some = marks.where(F.col("toxic") == kind).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = some if chosen is None else chosen.unionByName(some)
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.length("text") <= SAMPLE_CHARS).distinct().toPandas()
    got = got.sort_values(["doc_id", "toxic", "text"])
    share = marks.agg(F.avg("toxic")).first()[0]
    return fit(got["text"].tolist(), got["toxic"].tolist(), share, _in_tasks(docs.sparkSession))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Null, empty and blank texts score as texts that save nothing;
    repeated rows keep their rows; a null id is not held out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = scorer.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return score(docs, train(docs, read(spark, sf_dir, "labels", "doc_id", "toxic")))
