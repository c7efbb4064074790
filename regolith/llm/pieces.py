"""Texts put together from pieces whose ids are remembered.

Byte-level tokenizers split a text into words by a pattern and code each word by itself. Words repeat, so each is coded
once while it is remembered. Between two other characters a single space always begins a word of the pattern, and a
single line break is a word of its own; a text in which all spaces and line breaks are of that kind is cut there by
Arrow, which also finds the distinct pieces of a batch, and the batch's ids are gathered from theirs in one step. Any
other text is coded as a whole.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Ids of several strings in a row, and the number of ids of each.
Coded = tuple[np.ndarray, np.ndarray]

#: Marks that make one word of the pattern when they stand together.
_MARKS = "!#$%&()*+,./:;<=>?@[]^_`{|}~\"-"
_SPACES = "".join(c for c in map(chr, range(0x3100)) if c.isspace())


def gather(ids: np.ndarray, start: np.ndarray, size: np.ndarray, rows: np.ndarray) -> Coded:
    """The ids of the strings numbered ``rows``, in that order."""
    sizes = size[rows]
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(ids)) < 2**31 else np.int64
    at = np.arange(total, dtype=kind)
    at += np.repeat((start[rows] - (ends - sizes)).astype(kind), sizes)
    return ids[at], sizes


class Store:
    """Ids by string. At most ``most`` strings are remembered, those that came first; the others are learnt for the batch
    in hand. A store of which a batch knows less than half is begun anew, so that it follows a change of language."""

    def __init__(self, learn: Callable[[list[str]], Coded], most: int):
        self.learn, self.most = learn, most
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.ids, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def of(self, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The row of each name, which are distinct, in (ids, start, size)."""
        rows = np.fromiter(map(self.rows.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(rows < 0)
        if len(self.rows) >= self.most and len(new) * 2 > len(names):
            self.forget()
            rows[:], new = -1, np.arange(len(names))
        ids, size = self.ids, self.size
        if len(new):
            unknown = [names[i] for i in new.tolist()]
            more, sizes = self.learn(unknown)
            rows[new] = np.arange(len(size), len(size) + len(new))
            kept = max(0, min(len(new), self.most - len(self.rows)))
            self.rows.update(zip(unknown[:kept], range(len(size), len(size) + kept)))
            ids, size = np.concatenate([ids, more]), np.concatenate([size, sizes])
            if kept:
                self.size = size[: len(self.size) + kept].copy()
                self.ids = ids[: int(self.size.sum())].copy()
        return rows, ids, np.cumsum(size) - size, size

    def code(self, lists: list[list[str]]) -> Coded:
        """The ids of lists of names, each list's joined."""
        every = list(chain.from_iterable(lists))
        distinct = list(dict.fromkeys(every))
        rows, *held = self.of(distinct)
        place = dict(zip(distinct, rows.tolist(), strict=True))
        every = np.fromiter(map(place.__getitem__, every), np.int64, len(every))
        ids, sizes = gather(*held, every)
        return ids, _sums(sizes, np.fromiter(map(len, lists), np.int64, len(lists)))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``counts`` values."""
    upto = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return upto[ends] - upto[ends - counts]


class Words:
    """Pieces and texts by the words of a pattern: each distinct word is coded once while it is remembered."""

    def __init__(self, split: Callable[[str], list[str]], learn: Callable[[list[str]], Coded], most: int):
        self.split, self.store = split, Store(learn, most)

    def of_texts(self, texts: list[str]) -> Coded:
        return self.store.code(list(map(self.split, texts)))

    def of_pieces(self, pieces: list[str]) -> Coded:
        """Letters after a space, with or without marks behind them, are one or two words; other pieces are split by the
        pattern. A piece begins with its space or line break unless a text begins with it."""
        body = pc.utf8_slice_codeunits(pa.array(pieces, pa.string()), 1)
        stem = pc.utf8_rtrim(body, _MARKS)
        spaced = np.fromiter((p[0] == " " for p in pieces), bool, len(pieces))
        plain = pc.utf8_is_alpha(stem).to_numpy(zero_copy_only=False) & spaced
        size = pc.utf8_length(stem).to_numpy() + 1
        marked = plain & (pc.utf8_length(body).to_numpy() >= size)
        lists = [[p] for p in pieces]
        for i in np.flatnonzero(marked).tolist():
            p, n = pieces[i], size[i]
            lists[i] = [p[:n], p[n:]]
        for i in np.flatnonzero(~plain).tolist():
            lists[i] = self.split(pieces[i])
        return self.store.code(lists)


class Pieces:
    def __init__(self, learn: Callable[[list[str]], Coded], whole: Callable[[list[str]], Coded], most: int):
        """``learn`` codes distinct pieces, each with its space or line break in front (the first of a text has neither) and
        no white space at its ends otherwise; ``whole`` codes texts that cannot be cut."""
        self.pieces, self.whole = Store(learn, most), whole

    def forget(self) -> None:
        """Gives the store's memory back, to the system too where the allocators can."""
        self.pieces.forget()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    def code(self, texts: pa.StringArray) -> Coded:
        """The ids of all texts, which must not be null, and how many each has."""
        gc.disable()  # millions of strings and lists, none of them in a cycle
        try:
            return self._code(texts)
        finally:
            gc.enable()

    def _code(self, texts: pa.StringArray) -> Coded:
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded = lists.flatten().dictionary_encode()
        at, seen = coded.indices.to_numpy(), coded.dictionary
        cuts = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        broken = pc.starts_with(seen, "\n")
        inner = pc.if_else(broken, pc.utf8_slice_codeunits(seen, 1), seen)
        fits = pc.and_(pc.not_equal(inner, ""), pc.equal(pc.utf8_trim(inner, _SPACES), inner)).to_numpy(zero_copy_only=False)
        names = pc.if_else(broken, seen, pc.binary_join_element_wise(" ", seen, ""))
        heads, sound = at[cuts[:-1]], np.concatenate([[0], np.cumsum(fits[at])])
        easy = (sound[cuts[1:]] - sound[cuts[:-1]] == np.diff(cuts)) & ~broken.to_numpy(zero_copy_only=False)[heads]
        # pieces of easy texts, the first of each by itself: no space is before it
        first = np.zeros(len(at), bool)
        first[cuts[:-1][easy]] = True
        every = at if easy.all() else at[np.repeat(easy, np.diff(cuts))]
        first = first if easy.all() else first[np.repeat(easy, np.diff(cuts))]
        there = np.zeros(len(seen), bool)
        there[every[~first]] = True
        inside, begin = np.flatnonzero(there), np.unique(heads[easy])
        place = np.full(len(seen), -1, np.int32)
        place[inside] = np.arange(len(inside))
        every = place[every]
        every[first] = len(inside) + np.searchsorted(begin, heads[easy])
        counts = np.zeros(len(texts), np.int64)
        ids, counts[easy] = self._join(pa.concat_arrays([names.take(inside), seen.take(begin)]), every, np.diff(cuts)[easy])
        if easy.all():
            return ids, counts
        others, more = self.whole(texts.filter(pa.array(~easy)).to_pylist())
        counts[~easy] = more
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]), np.uint32)
        mine = np.repeat(easy, counts)
        out[mine], out[~mine] = ids, others
        return out, counts


    def _join(self, pieces: pa.StringArray, every: np.ndarray, cuts: np.ndarray) -> Coded:
        """The ids of texts of ``cuts`` pieces each, which ``every`` numbers among these distinct ones."""
        rows, *held = self.pieces.of(pieces.to_pylist())
        ids, sizes = gather(*held, rows[every])
        return ids, _sums(sizes, cuts)


class WordPieces(Pieces):
    """Pieces for a coder whose words cost little. Letters behind a space or a line break, with or without marks behind them,
    are not remembered as pieces: Arrow cuts them into words and joins their ids anew in every batch, so that only
    distinct words become strings of Python. Other pieces are remembered."""

    def __init__(self, words: Words, whole: Callable[[list[str]], Coded], most: int):
        super().__init__(words.of_texts, whole, most)
        self.words = words

    def _join(self, pieces: pa.StringArray, every: np.ndarray, cuts: np.ndarray) -> Coded:
        broken, stem = pc.starts_with(pieces, "\n"), pc.utf8_rtrim(pc.utf8_slice_codeunits(pieces, 1), _MARKS)
        plain = pc.and_(pc.or_(broken, pc.starts_with(pieces, " ")), pc.utf8_is_alpha(stem))
        mine = plain.to_numpy(zero_copy_only=False)
        words, counts = _cut(pieces.filter(plain), broken.filter(plain), stem.filter(plain))
        rows, ids, _, size = self.words.store.of(_listed(words.dictionary))
        easy = _runs(_strings(ids, size).take(pa.array(rows[words.indices.to_numpy()])), counts)
        rows, ids, _, size = self.pieces.of(_listed(pieces.filter(pc.invert(plain))))
        coded = pa.concat_arrays([easy, _strings(ids, size).take(pa.array(rows))])
        place = np.where(mine, np.cumsum(mine) - 1, len(easy) + np.cumsum(~mine) - 1)
        out = _runs(coded.take(pa.array(place[every])), cuts)
        edges = _edges(out, np.int64)
        size = int(edges[-1] - edges[0]) // 4
        return np.frombuffer(out.buffers()[2], np.uint32, size, int(edges[0])) if size else np.zeros(0, np.uint32), np.diff(edges) // 4


def _cut(pieces: pa.StringArray, broken: pa.BooleanArray, stem: pa.StringArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of pieces that are a space or a line break, letters and marks, and how many each piece has: a space belongs
    to its letters, a line break is a word. They lie in a row, so more offsets into the same bytes part them."""
    edges = _edges(pieces, np.int32)
    starts = np.column_stack([edges[:-1], edges[:-1] + 1, edges[:-1] + 1 + pc.binary_length(stem).to_numpy()])
    begun = np.ones(starts.shape, bool)
    begun[:, 1], begun[:, 2] = broken.to_numpy(zero_copy_only=False), starts[:, 2] < edges[1:]
    offsets = np.append(starts[begun], edges[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pieces.buffers()[2]])
    return words.dictionary_encode(), begun.sum(axis=1)


def _listed(strings: pa.StringArray) -> list[str]:
    """As to_pylist, which makes an object of Arrow for each string first and takes several times as long."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def _edges(strings: pa.Array, kind: type) -> np.ndarray:
    """The offsets of strings in their bytes."""
    size = np.dtype(kind).itemsize
    return np.frombuffer(strings.buffers()[1], kind, len(strings) + 1, strings.offset * size) if len(strings) else np.zeros(1, kind)


def _strings(ids: np.ndarray, size: np.ndarray) -> pa.LargeBinaryArray:
    """Strings of ``size`` ids each as bytes, which Arrow takes without an index for each id."""
    offsets = np.concatenate([[0], np.cumsum(size * 4)])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype(np.uint32, copy=False))])


def _runs(strings: pa.LargeBinaryArray, counts: np.ndarray) -> pa.LargeBinaryArray:
    """Consecutive runs of ``counts`` strings, each run as one."""
    edges = _edges(strings, np.int64)[np.concatenate([[0], np.cumsum(counts)])]
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(edges), strings.buffers()[2]])


def binaries(coded: Coded) -> pa.BinaryArray:
    """One value for each string: its ids as little-endian unsigned 32-bit integers."""
    ids, counts = coded
    offsets = np.concatenate([[0], np.cumsum(counts * 4)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])


def portions(texts: pa.StringArray, most: int) -> Iterator[pa.StringArray]:
    """Consecutive texts of about ``most`` bytes together, nulls as empty texts."""
    texts = pc.fill_null(texts, "")
    group = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(texts)]
    return (texts.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)


def gathered(batches: Iterable[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until the texts in ``column`` reach ``most`` bytes, so that distinct words are sought among many."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)
