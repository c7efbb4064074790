"""Byte-level BPE encoding and decoding with DuckDB queries inside each Spark partition.

Encoding: a text is split by the tokenizer's pattern. The distinct words of a batch become token-position rows; a
recursive query joins neighbouring tokens with the merge table and contracts, in every round, each word's leftmost pair
of minimum rank, until no word has a pair left. Decoding joins the token-position rows of whole documents with the
vocabulary and concatenates them by an ordered aggregation; it sees nothing but a document's own ids. Nothing is
shuffled: each task works on its own rows, in batches of bounded bytes, and keeps a bounded store of words that it has
met.

The position rows of a word shrink by one in each round, so a word of n bytes costs up to n*n/2 rows. Words of more
than ``LONG_WORD`` bytes (runs without any space) go through a second recursive query, which contracts in one round all
occurrences of a word's pair of minimum rank, from the left, up to the first that would give rise to a pair of lower rank:
just those that one after the other would be contracted next. It runs a bounded number of rounds at a time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.llm.common import read
from regolith.llm.pieces import Coded, Pieces, Words, binaries, gathered, portions

#: Bytes of text, and tokens, that one round of queries takes together.
BATCH_BYTES, BATCH_TOKENS = 2_000_000, 300_000
#: Words in one recursive query; words, and pieces between single spaces, that a task remembers.
QUERY_WORDS, HELD_WORDS, HELD_PIECES = 10_000, 200_000, 200_000
LONG_WORD = 256
#: Bytes of long words that go into one query, and position rows that its rounds hold, about.
LONG_BYTES, LONG_ROWS = 50_000, 1_000_000

#: A token's place is word * 256 + position, so that a place, a pair and a pair's rank with its position are one integer each.
_CONTRACT = """
create or replace temp table contracted as
with recursive step as (
  select 0::smallint as round, s.place, s.tok, s.nxt, m.merged
  from (select place, tok, lead(tok) over (partition by place // 256 order by place) as nxt from start) s
  left join merges m on m.pair = (s.tok::bigint * 65536 + s.nxt)::uinteger
  union all
  select n.round, n.place, n.tok, n.nxt, m.merged
  from (
    select (s.round + 1)::smallint as round, s.place - (s.place > b.spot)::int as place,
           case when s.place = b.spot then b.best else s.tok end as tok,
           case when s.place = b.spot then b.after when s.place + 1 = b.spot then b.best else s.nxt end as nxt
    from step s
    join (
      select c.word, c.word * 256 + c.low % 256 as spot, c.low // 256 as best, r.nxt as after
      from (
        select place // 256 as word, min(merged * 256 + place % 256) as low from step where merged is not null group by 1
      ) c
      join step r on r.place = c.word * 256 + c.low % 256 + 1
    ) b on b.word = s.place // 256
    where s.place <> b.spot + 1
  ) n
  left join merges m on m.pair = (n.tok::bigint * 65536 + n.nxt)::uinteger
)
select s.place // 256 as doc, s.place % 256 as pos, s.tok
from step s
join (select place // 256 as word, max(round) as round from step group by 1) l on l.word = s.place // 256 and l.round = s.round
"""
#: The same for long words: hits are the occurrences of a word's minimum rank, every second of a run of overlapping ones;
#: ``stop`` is the first whose contraction makes a pair of lower rank with the token before or behind it.
_CONTRACT_LONG = """
create or replace temp table contracted as
with recursive step as (
  select 0 as round, s.word, s.pos, s.tok, m.merged
  from (select word, pos, tok, lead(tok) over (partition by word order by pos) as nxt from start) s
  left join merges m on m.pair = (s.tok::bigint * 65536 + s.nxt)::uinteger
  union all
  select n.round, n.word, n.pos, n.tok, m.merged
  from (
    select round, word, pos, tok, lead(tok) over (partition by word order by pos) as nxt
    from (
      select c.round + 1 as round, c.word, c.pos, c.merge_at and c.nth <= c.stop as now,
             lag(c.merge_at and c.nth <= c.stop, 1, false) over (partition by c.word order by c.nth) as gone, case when now then c.low else c.tok end as tok
      from (
        select p.*, coalesce(min(case when p.merge_at and (x.merged < p.low or y.merged < p.low) then p.nth end) over (partition by p.word), 2147483647) as stop
        from (
          select h.*, case when lag(h.merge_at, 2, false) over w then h.low else lag(h.tok) over w end as before, lead(h.tok, 2) over w as behind
          from (
            select r.*, r.hit and row_number() over (partition by r.word, r.hit, r.nth - r.hits order by r.nth) % 2 = 1 as merge_at
            from (
              select q.*, q.merged is not distinct from q.low as hit, row_number() over (partition by q.word order by q.pos) as nth,
                     row_number() over (partition by q.word, q.merged is not distinct from q.low order by q.pos) as hits
              from (select s.*, min(s.merged) over (partition by s.word) as low from step s where s.round < (select most from rounds)) q
              where q.low is not null
            ) r
          ) h
          window w as (partition by h.word order by h.nth)
        ) p
        left join merges x on p.merge_at and x.pair = (p.before::bigint * 65536 + p.low)::uinteger
        left join merges y on p.merge_at and y.pair = (p.low::bigint * 65536 + p.behind)::uinteger
      ) c
    )
    where not gone
  ) n
  left join merges m on m.pair = (n.tok::bigint * 65536 + n.nxt)::uinteger
)
select s.word, s.pos, s.tok, max(s.merged) over (partition by s.word) is not null as open
from step s join (select word, max(round) as round from step group by 1) l on l.word = s.word and l.round = s.round
"""
_DECODE = """
select t.doc, array_to_string(list(v.bytes order by t.pos), '') as decoded
from tokens t join vocabulary v on v.tok = t.tok group by t.doc
"""


class Codec:
    """A rank file as DuckDB tables: merges(pair, merged) and vocabulary(tok, bytes), bytes as Latin-1 characters."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if max(self.ranks.values()) >= 65536:
            raise ValueError(f"{path} has ranks that do not fit a pair of 16-bit tokens")
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        rows = [
            (left * 65536 + right, merged)
            for token, merged in self.ranks.items()
            for i in range(1, len(token))
            if (left := self.ranks.get(token[:i])) is not None and (right := self.ranks.get(token[i:])) is not None
        ]
        pair, merged = zip(*rows, strict=True)
        self._table("merges", pair=pa.array(pair, pa.uint32()), merged=pa.array(merged, pa.int32()))
        self._table("vocabulary", tok=pa.array(self.ranks.values(), pa.int32()), bytes=pa.array([t.decode("latin-1") for t in self.ranks]))
        self.words = Words(regex.compile(pattern).findall, self._contract, HELD_WORDS)
        self.pieces = Pieces(self.words.of_pieces, self.words.of_texts, HELD_PIECES)

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.con.register("_rows", pa.table(columns))
        self.con.execute(f"create or replace temp table {name} as select * from _rows")
        self.con.unregister("_rows")

    def _contract(self, words: list[str]) -> Coded:
        """The ids of each word, and their number."""
        raw = [word.encode() for word in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # number of the word and id, in order within a word
        short = np.flatnonzero(lengths <= LONG_WORD)
        for k in range(0, len(short), QUERY_WORDS):
            some = short[k : k + QUERY_WORDS]
            place, tok = self._bytes([raw[i] for i in some.tolist()], 256)
            self._table("start", place=pa.array(place.astype(np.int32)), tok=pa.array(tok))
            self.con.execute(_CONTRACT)
            got = self.con.execute("select doc, tok from contracted order by doc, pos").fetchnumpy()
            parts.append((some[got["doc"]], got["tok"]))
        long = np.flatnonzero(lengths > LONG_WORD)
        for group in np.split(long, np.flatnonzero(np.diff(np.cumsum(lengths[long]) // LONG_BYTES)) + 1):
            parts += self._contract_long(group, [raw[i] for i in group.tolist()]) if len(group) else []
        word = np.concatenate([w for w, _ in parts]) if parts else np.zeros(0, np.int64)
        ids = np.concatenate([t for _, t in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(word, minlength=len(words)).astype(np.int64)

    def _bytes(self, words: list[bytes], stride: int) -> tuple[np.ndarray, np.ndarray]:
        """The place (word * stride + position) and token of every byte."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(words)) * stride - first, lengths)
        return place, self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]

    def _contract_long(self, numbers: np.ndarray, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(number, ids) of long words: rounds of the query, as many at a time as LONG_ROWS allows, until none has a pair left."""
        place, tok = self._bytes(words, 2**32)
        word, pos, done = place >> 32, place & (2**32 - 1), []
        while len(word):
            self._table("rounds", most=pa.array([max(1, LONG_ROWS // len(word))], pa.int32()))
            self._table("start", word=pa.array(word.astype(np.int32)), pos=pa.array(pos.astype(np.int32)), tok=pa.array(tok.astype(np.int32)))
            self.con.execute(_CONTRACT_LONG)
            got = self.con.execute("select word, pos, tok, open from contracted order by word, pos").fetchnumpy()
            going = got["open"].astype(bool)
            done.append((numbers[got["word"][~going]], got["tok"][~going]))
            word, pos, tok = (got[c][going] for c in ("word", "pos", "tok"))
        return done

    def encode(self, texts: pa.StringArray) -> Coded:
        """Ids of all texts, and the number of each; a null text is empty."""
        parts = [self.pieces.code(part) for part in portions(texts, BATCH_BYTES)]
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([counts for _, counts in parts])

    def forget(self) -> None:
        """Leaves the worker, which other stages use too, with the rank tables only."""
        self.words.store.forget()
        self.pieces.forget()
        for name in ("start", "contracted", "tokens", "rounds"):
            self.con.execute(f"drop table if exists {name}")

    def decode(self, coded: Coded) -> list[bytes]:
        """The bytes that each run of ids stands for. An id that the vocabulary lacks has none."""
        ids, counts = coded
        out, ends = [b""] * len(counts), np.cumsum(counts)
        a = 0
        while a < len(counts):
            begin = int(ends[a] - counts[a])
            b = max(a + 1, int(np.searchsorted(ends, begin + BATCH_TOKENS, side="right")))
            some, n = counts[a:b], int(ends[b - 1]) - begin
            if n:
                pos = np.arange(n) - np.repeat(ends[a:b] - some - begin, some)
                self._table("tokens", doc=pa.array(np.repeat(np.arange(a, b, dtype=np.int32), some)), pos=pa.array(pos.astype(np.int32)), tok=pa.array(ids[begin : begin + n].astype(np.int32)))
                got = self.con.execute(_DECODE).fetchnumpy()
                for doc, text in zip(got["doc"].tolist(), got["decoded"], strict=True):
                    out[doc] = text.encode("latin-1")
            a = b
        return out


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker, kept over its tasks."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) for every row: the ids of the whole text as little-endian unsigned 32-bit integers, and the
    bytes that they decode to. Each distinct word is encoded by the queries, and a text's ids are those of its words in
    order; the decoding query takes all ids of each document, not its words.

    Null and empty texts have no ids (an empty binary). Repeated rows keep their rows; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in gathered(batches, 1, BATCH_BYTES):
            coded = own.encode(batch.column(1))
            plain = pa.array(own.decode(coded), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), binaries(coded), plain], ["doc_id", "ids", "decoded"])
        own.forget()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return chosen.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Stored ids (doc_id, ids) with a third column ``decoded``: the text's bytes. Null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = pc.fill_null(batch.column(1), b"")
            coded = np.frombuffer(b"".join(ids.to_pylist()), "<u4"), pc.binary_length(ids).to_numpy().astype(np.int64) // 4
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.decode(coded), pa.binary())], ["doc_id", "ids", "decoded"])
        own.forget()

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids themselves."""
    pattern = public_tokenizers.PATTERN
    return round_trip(docs, path, pattern).select(
        "doc_id",
        F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


def op3_bpe(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")) -> DataFrame:
    return digests(read(spark, sf_dir, "documents", "doc_id", "text"), path).drop("ids")
