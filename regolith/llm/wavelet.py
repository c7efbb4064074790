"""Token shards as wavelet matrices.

A shard holds the token ids of consecutive documents (ascending doc_id) as bit-planes: plane by plane, from the highest
bit, the sequence is split stably into zeros and ones. With rank and select over the planes one shard answers which
token stands at a place, how often a token occurs before a place, and where its occurrences are, without being unpacked.

Layout of a shard, little-endian: magic ``WVM2``; u64 tokens, u32 planes, u64 documents; the documents' ids (i64) and
token counts (u32); for every plane its number of zeros (u64) and the length (u64) and bytes of its bits (lowest bit
first, padded to whole 64-bit words) followed by its rank directory (u32: the ones before every eighth word), together
compressed with zstandard. The directory takes a sixteenth of the bits; a rank adds up to eight words to its sample.
Shards are rows of a Parquet table in the cluster's
shared folder, one file each, so any store that Spark writes can hold them.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regolith.functions.lineage import shared_dir
from regolith.llm.common import read
from regolith.llm.pieces import Coded, WordPieces, Words, gathered, portions

#: This id ends every document.
END = 0
#: Aimed size of a shard. A document is never parted, so a shard may exceed it by one document.
SHARD_TOKENS = 4_000_000
#: Words and pieces between spaces that a worker remembers; bytes of text that it looks at together.
HELD_WORDS, HELD_PIECES, BATCH_BYTES = 700_000, 1_000_000, 8_000_000
#: 64-bit words between two samples of the rank directory.
STRIDE = 8
#: Bits of a plane that are split together.
RUN = 65_536

_MAGIC = b"WVM2"


def _sampled(words: np.ndarray) -> np.ndarray:
    """The ones before each run of STRIDE words, and before the end."""
    counts = np.bitwise_count(np.append(words, np.zeros(-len(words) % STRIDE, words.dtype))).reshape(-1, STRIDE)
    return np.concatenate([[0], np.cumsum(counts.sum(axis=1, dtype=np.int64))])


def _places(ones: np.ndarray, zeros: int) -> Iterator[tuple[slice, list[tuple[np.ndarray, slice]]]]:
    """Where a plane's split puts its bits, run by run so that places stay in a processor's cache: the run, and for its zeros
    and its ones their places in it and their slice of the split sequence, in which all zeros come first. The bits are
    not kept."""
    at = [0, zeros]
    for begin in range(0, len(ones), RUN):
        run, places = ones[begin : begin + RUN], []
        for one in (1, 0):
            here = np.flatnonzero(run)
            places.append((here, slice(at[one], at[one] + len(here))))
            at[one] += len(here)
            if one:
                np.logical_not(run, out=run)
        yield slice(begin, begin + RUN), places


def pack(doc_ids: np.ndarray, counts: np.ndarray, tokens: np.ndarray) -> bytes:
    """The bytes of one shard."""
    if len(tokens) >= 2**32:
        raise ValueError("a shard holds fewer than 2**32 tokens")
    planes = max(1, int(tokens.max(initial=0)).bit_length())
    out = [_MAGIC, struct.pack("<QIQ", len(tokens), planes, len(doc_ids)), doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes()]
    now = tokens.astype(np.uint16 if planes <= 16 else np.uint32)
    split = np.empty_like(now)
    squeeze = zstandard.ZstdCompressor(level=1)
    for shift in range(planes - 1, -1, -1):
        ones = (now & now.dtype.type(1 << shift)) != 0
        bits = np.packbits(ones, bitorder="little").tobytes()
        words = np.frombuffer(bits + bytes(-len(bits) % 8), "<u8")
        data = squeeze.compress(words.tobytes() + _sampled(words).astype("<u4").tobytes())
        zeros = len(now) - int(np.count_nonzero(ones))
        out += [struct.pack("<QQ", zeros, len(data)), data]
        for part, places in _places(ones, zeros) if shift else ():  # nothing is read below the last plane
            for here, there in places:
                now[part].take(here, out=split[there], mode="clip")  # other modes copy what they write
        now, split = split, now
    return b"".join(out)


class Shard:
    """Reads a shard. Places are 0-based; every method takes arrays."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a token shard")
        self.size, self.planes, documents = struct.unpack_from("<QIQ", data, 4)
        at = 4 + struct.calcsize("<QIQ")
        self.doc_ids = np.frombuffer(data, "<i8", documents, at)
        self.counts = np.frombuffer(data, "<u4", documents, at + 8 * documents)
        at += 12 * documents
        self.zeros, self.words, self.before = [], [], []
        n = (self.size + 63) // 64
        for _ in range(self.planes):
            zeros, length = struct.unpack_from("<QQ", data, at)
            plain = zstandard.decompress(data[at + 16 : at + 16 + length])
            self.zeros.append(zeros)
            self.words.append(np.frombuffer(plain, "<u8", n))
            self.before.append(np.frombuffer(plain, "<u4", offset=8 * n))
            at += 16 + length

    def _bits(self, plane: int) -> np.ndarray:
        return np.unpackbits(self.words[plane].view(np.uint8), count=self.size, bitorder="little").astype(bool)

    def _ones_before(self, plane: int, place: np.ndarray) -> np.ndarray:
        words, word, bit = self.words[plane], place >> 6, (place & 63).astype(np.uint64)
        out = self.before[plane][word // STRIDE].astype(np.int64)
        for k in range(STRIDE):  # whole words since the sample, then the part of the last
            at = word // STRIDE * STRIDE + k
            inside = at < np.minimum(word, len(words))
            out[inside] += np.bitwise_count(words[at[inside]])
        part = (bit > 0) & (word < len(words))
        out[part] += np.bitwise_count(words[word[part]] & ((np.uint64(1) << bit[part]) - np.uint64(1)))
        return out

    def tokens(self) -> np.ndarray:
        """The whole sequence: the last plane's bits, then the splits above it undone from the last to the first."""
        now = self._bits(self.planes - 1).astype(np.uint16 if self.planes <= 16 else np.uint32)
        back = np.empty_like(now)
        for plane in range(self.planes - 2, -1, -1):
            now[self.zeros[plane] :] |= now.dtype.type(1 << (self.planes - 1 - plane))
            for part, places in _places(self._bits(plane), self.zeros[plane]):
                for here, there in places:
                    back[part][here] = now[there]
            now, back = back, now
        return now

    def access(self, place: np.ndarray) -> np.ndarray:
        """The tokens at these places."""
        place, token = np.asarray(place, np.int64), np.zeros(len(place), np.int64)
        for plane in range(self.planes):
            ones = self._ones_before(plane, place)
            one = self._ones_before(plane, place + 1) > ones
            token = token * 2 + one
            place = np.where(one, self.zeros[plane] + ones, place - ones)
        return token

    def _down(self, token: int, place: np.ndarray) -> tuple[np.ndarray, int]:
        """Where a prefix of that length ends, and the token's block begins, below the last plane."""
        place, first = np.asarray(place, np.int64), np.zeros(1, np.int64)
        for plane in range(self.planes):
            both = np.concatenate([first, place])
            ones = self._ones_before(plane, both)
            both = self.zeros[plane] + ones if token >> (self.planes - 1 - plane) & 1 else both - ones
            first, place = both[:1], both[1:]
        return place, int(first[0])

    def rank(self, token: int, place: np.ndarray) -> np.ndarray:
        """How often the token occurs before these places."""
        if token >> self.planes:
            return np.zeros(len(place), np.int64)
        end, first = self._down(token, place)
        return end - first

    def count(self, token: int) -> int:
        return int(self.rank(token, np.array([self.size]))[0])

    def occurrences(self, token: int) -> np.ndarray:
        """All places of the token, ascending: its block below the last plane, followed up by select."""
        if token >> self.planes:
            return np.zeros(0, np.int64)
        end, first = self._down(token, np.array([self.size]))
        place = np.arange(first, int(end[0]))
        for plane in range(self.planes - 1, -1, -1):
            one = token >> (self.planes - 1 - plane) & 1
            place = self._select(plane, place - self.zeros[plane], True) if one else self._select(plane, place, False)
        return place

    def _select(self, plane: int, nth: np.ndarray, one: bool) -> np.ndarray:
        """The places of the nth ones or zeros: the run of words by its sample, the word in it, then the bit."""
        before, words = self.before[plane].astype(np.int64), self.words[plane] if one else ~self.words[plane]
        if not one:
            before = np.arange(len(before)) * (64 * STRIDE) - before
        run = np.clip(np.searchsorted(before, nth, side="right") - 1, 0, max(0, len(before) - 2))
        word, left = run * STRIDE, nth - before[run]
        for _ in range(STRIDE - 1):
            here = np.bitwise_count(words[word]).astype(np.int64)
            on = (left >= here) & (word + 1 < len(words))
            left, word = np.where(on, left - here, left), np.where(on, word + 1, word)
        bits, place = words[word], np.zeros(len(nth), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(bits & np.uint64((1 << step) - 1)).astype(np.int64)
            up = left >= low
            left, place = np.where(up, left - low, left), np.where(up, place + step, place)
            bits = np.where(up, bits >> np.uint64(step), bits)
        return word * 64 + place


class Encoder:
    """A tokenizers file applied to whole texts. Equal words have equal ids, so each is encoded once while remembered.

    With ``added`` the result is the library's own: the strings of added tokens are these tokens. The pattern would part
    them, so a text that contains one goes through the library as a whole, as texts do that Pieces cannot cut. Without
    it they are ordinary text."""

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = not added
        tokens = [t.content for t in self.own.get_added_tokens_decoder().values()]
        self.added = "|".join(map(re.escape, tokens)) if added else ""
        self.words = Words(regex.compile(public_tokenizers.PATTERN).findall, self._learn, HELD_WORDS)
        self.pieces = WordPieces(self.words, self._each, HELD_PIECES)
        self.tokenize = self.own.model.tokenize
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = iter(range(256, 512))
        self.letters = {b: b if b in visible else next(hidden) for b in range(256)}  # the letter that stands for each byte

    def _each(self, texts: list[str]) -> Coded:
        """Texts by the whole library."""
        got = [np.array(e.ids, np.uint32) for e in self.own.encode_batch(texts, add_special_tokens=False)]
        return np.concatenate(got) if got else np.zeros(0, np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def _learn(self, words: list[str]) -> Coded:
        """Words by the library's model, which takes one word of the pattern with its bytes as letters."""
        letters, tokenize, space = self.letters, self.tokenize, chr(self.letters[32])
        plain = lambda w: w.replace(" ", space) if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(letters)
        found = [tokenize(plain(w)) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(map(attrgetter("id"), chain.from_iterable(found)), np.uint32, int(sizes.sum())), sizes

    def encode(self, texts: pa.StringArray) -> Coded:
        """Ids of all texts and how many each has; a null text is empty."""
        parts = [self._encode(part) for part in portions(texts, BATCH_BYTES)]
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([counts for _, counts in parts])

    def _encode(self, texts: pa.StringArray) -> Coded:
        whole = pc.match_substring_regex(texts, self.added) if self.added else None
        if whole is None or not pc.any(whole).as_py():
            return self.pieces.code(texts)
        ids, sizes = self.pieces.code(texts.filter(pc.invert(whole)))
        others, more = self._each(texts.filter(whole).to_pylist())
        mask = whole.to_numpy(zero_copy_only=False)
        counts = np.zeros(len(texts), np.int64)
        counts[~mask], counts[mask] = sizes, more
        out, mine = np.empty(int(counts.sum()), np.uint32), np.repeat(~mask, counts)
        out[mine], out[~mine] = ids, others
        return out, counts


_ENCODERS: dict[tuple[str, bool], Encoder] = {}

SHARDS = T.StructType(
    [T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("shard", T.BinaryType())]
)


def write_shards(docs: DataFrame, path: str, folder: str, shard_tokens: int = SHARD_TOKENS, added: bool = False) -> None:
    """Range-partitions the rows of ``docs`` (doc_id, text) by doc_id, encodes the texts (null is empty) and packs each partition's documents, in ascending order, into
    shards. Only the shard in hand is in a task's memory. Rows without an id come first; a repeated id keeps all its
    rows. The texts are dealt before they are encoded, since range partitioning reads its input twice. ``added`` as for
    Encoder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        if (path, added) not in _ENCODERS:
            _ENCODERS[path, added] = Encoder(path, added)  # one for each Python worker, kept over its tasks
        ids, counts, tokens = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

        def shard(documents: int, n: int) -> pa.RecordBatch:
            data = pack(ids[:documents], counts[:documents], tokens[:n])
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], SHARDS.names)

        for batch in gathered(batches, 1, BATCH_BYTES):
            found, sizes = _ENCODERS[path, added].encode(batch.column(1))
            ends = np.cumsum(sizes + 1) - 1
            ended = np.full(len(found) + len(sizes), END, np.uint32)
            inner = np.ones(len(ended), bool)
            inner[ends] = False
            ended[inner] = found
            ids = np.concatenate([ids, pc.fill_null(batch.column(0), NO_ID).to_numpy()])
            counts, tokens = np.concatenate([counts, sizes + 1]), np.concatenate([tokens, ended])
            while len(tokens) >= shard_tokens:
                upto = np.cumsum(counts)
                documents = int(np.searchsorted(upto, shard_tokens)) + 1
                n = int(upto[documents - 1])
                yield shard(documents, n)
                before, ids, counts, tokens = before + n, ids[documents:], counts[documents:], tokens[n:]
        if len(ids):
            yield shard(len(ids), len(tokens))

    pieces = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(pieces, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, SHARDS).write.option("compression", "none").option("maxRecordsPerFile", 1).parquet(folder)


#: Stands for a null id inside a shard.
NO_ID = -(2**63)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_end_ids of every document in the shards of ``folder``; start counts the ids of
    all documents before it. How often the end id occurs in a document (text can hold it too) is told by rank over the
    planes, and that the last of its ids is the end id by access. Only one total for each range partition is gathered."""
    shards = spark.read.schema(SHARDS).parquet(folder)
    begins, total = {}, 0
    for r in sorted(shards.groupBy("part").agg(F.sum("tokens").alias("tokens")).collect()):
        begins[r.part] = total
        total += r.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                shard = Shard(data)
                counts = shard.counts.astype(np.int64)
                ends = np.cumsum(counts)
                if (shard.access(ends - 1) != END).any():
                    raise ValueError("a document of the shard does not end with the end id")
                seen = np.diff(shard.rank(END, ends), prepend=0)
                raw = memoryview(shard.tokens().astype("<u4")).cast("B")
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == NO_ID), pa.array(begins[part] + before + ends - counts), pa.array(counts), pa.array(crcs, pa.int64()), pa.array(seen, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "n_end_ids"],
                )

    return shards.select("part", "before", "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_end_ids long")


def op10_wavelet(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_50k.json")) -> DataFrame:
    """Encodes as the library does, added tokens included, writes the shards below the shared folder and reads the files
    back."""
    folder = f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    write_shards(read(spark, sf_dir, "documents", "doc_id", "text"), path, folder, added=True)
    return read_shards(spark, folder)
