"""Exact removal of repeated passages by recompression.

A text is a row of word symbols.  A round first names each run of equal symbols, then
each pair of a left and a right symbol, where a bit of the symbol's hash and the round
tells its side.  A name is a hash of its parts, so all executors name alike without a
table, and equal passages are cut alike except near their ends.  Each symbol carries
its context: the words that decide that it is cut this way.  If a window of words
contains the context of a symbol, every other occurrence of the window contains that
symbol too.

1. Texts are stored in chunks of a few megabytes; copies inside a chunk count once.
2. Every chunk sends its high-level symbols, which are counted over the whole corpus.
   Each chunk learns which of its symbols occur once.
3. A window that contains the context of a symbol which occurs once cannot repeat.
   The other windows are candidates; they are counted by 128 bits of two independent
   hashes of their words, and each chunk learns which of them occur once.
4. Words covered by the other candidates go.

Counts are summed in each task before they are shuffled, so a symbol or a passage of
very many texts is one row a task, and what goes back to the chunks is only what occurs
once.  The hashes mix after every step, so equality of texts is decided by 128 bits
without any algebra that could make unlike texts agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .chunks import CHUNK_BYTES, each, opened, pack
from .storage import materialise, read

WINDOW = 35
ROUNDS = 6
#: Shorter symbols are not counted: alone they say little about a window
LEAST_WORDS = 3
_FAR = 1 << 40
_U, _MASK = np.uint64, (1 << 64) - 1
_A, _B, _C = _U(0xD1B54A32D192ED03), _U(0x8CB92BA72F3D8DD7), _U(0xAAAAAAAAAAAAAAAB)


class Symbols:
    """Symbols of a slice of texts after some rounds, as parallel arrays.

    start, end: words covered.  low, high: words of the context; beyond the text if the
    text's own end is part of it.
    """

    def __init__(self, names: np.ndarray, doc: np.ndarray):
        n = len(names)
        self.name, self.doc, self.words = names.copy(), doc, names
        self.start, self.end = np.arange(n), np.arange(1, n + 1)
        self.low, self.high = self.start.copy(), self.end.copy()

    def __len__(self) -> int:
        return len(self.name)

    def _joined(self, head: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Merge each stretch that begins at a head; ``head`` are positions."""
        tail = np.concatenate((head[1:], [len(self)])) - 1
        self.start, self.end = self.start[head], self.end[tail]
        self.low, self.high = np.minimum.reduceat(low, head), np.maximum.reduceat(high, head)
        self.name, self.doc = name, self.doc[head]

    def runs(self) -> None:
        """Name runs of equal symbols; the others depend on their neighbours being unequal."""
        n = len(self)
        if n < 2:
            return
        together = self.doc[1:] == self.doc[:-1]
        equal = together & (self.name[1:] == self.name[:-1])
        low, high = self.low.copy(), self.high.copy()
        # an unequal neighbour shows by the word next to the symbol, or else by its own context
        first, last = self.words[self.start], self.words[self.end - 1]
        right = np.where(first[1:] != first[:-1], self.end[:-1] + 1, self.high[1:])
        left = np.where(last[1:] != last[:-1], self.start[1:] - 1, self.low[:-1])
        apart = together & ~equal
        high[:-1] = np.where(apart, np.maximum(high[:-1], right), high[:-1])
        low[1:] = np.where(apart, np.minimum(low[1:], left), low[1:])
        high[np.flatnonzero(np.concatenate((~together, [True])))] = _FAR
        low[np.flatnonzero(np.concatenate(([True], ~together)))] = -_FAR
        if not equal.any():
            self.low, self.high = low, high
            return
        head = np.flatnonzero(np.concatenate(([True], ~equal)))
        size = np.diff(np.concatenate((head, [n])))
        name = self.name[head]
        many = size > 1
        name[many] = K.mix(name[many] * _A + size[many].astype(_U) * _C)
        self._joined(head, name, low, high)

    def pairs(self, level: int) -> None:
        """Name each left symbol that a right symbol follows, together with it."""
        n = len(self)
        if n < 2:
            return
        right = (K.mix(self.name + _U((level + 1) * int(_B) & _MASK)) & _U(1)).astype(bool)
        together = self.doc[1:] == self.doc[:-1]
        merge = together & ~right[:-1] & right[1:]
        low, high = self.low.copy(), self.high.copy()
        # what stays alone does so because of the neighbour on its open side
        alone_left = ~right & ~np.concatenate((merge, [False]))
        alone_right = right & ~np.concatenate(([False], merge))
        beyond = np.concatenate((np.where(together, self.high[1:], _FAR), [_FAR]))
        before = np.concatenate(([-_FAR], np.where(together, self.low[:-1], -_FAR)))
        high = np.where(alone_left, np.maximum(high, beyond), high)
        low = np.where(alone_right, np.minimum(low, before), low)
        head = np.flatnonzero(np.concatenate(([True], ~merge)))
        size = np.diff(np.concatenate((head, [n])))
        name, two = self.name[head], size == 2
        name[two] = K.mix(K.mix(name[two] * _A) + self.name[head[two] + 1] * _B + _C)
        self._joined(head, name, low, high)


def told(symbols: Symbols, window: int) -> np.ndarray:
    """Positions of the symbols that are counted: their context fits into a window."""
    length = symbols.end - symbols.start
    return np.flatnonzero((length >= LEAST_WORDS) & (symbols.high - symbols.low <= window))


def candidates(words, symbols: Symbols, unique: np.ndarray, window: int) -> np.ndarray:
    """First words of the windows that contain the context of no symbol in ``unique``."""
    n = len(words)
    if n < window:
        return np.empty(0, dtype=np.int64)
    free = np.zeros(n - window + 1, dtype=np.int64)
    low, high = symbols.low[unique], symbols.high[unique]
    step = np.zeros(n + 2, dtype=np.int64)
    np.add.at(step, np.maximum(high - window, 0), 1)
    np.add.at(step, low + 1, -1)
    free = np.cumsum(step[: n - window + 1]) == 0
    return np.flatnonzero(free & (words.doc[: n - window + 1] == words.doc[window - 1 :]))


class _Chunk:
    """The distinct texts of a chunk, as far as they are long enough for a window.

    of: for each text of the chunk, its place among the distinct ones, or -1 if it is short.
    """

    def __init__(self, whole: K.Text, window: int):
        words = K.Words(whole)
        hashes = words.hashes()
        self.n_words = words.count
        self.of = np.full(whole.n, -1, dtype=np.int64)
        self.keys: list[tuple[int, int]] = []
        places: dict[tuple[int, int], int] = {}
        fresh: list[int] = []
        other = words.hashes(1)
        for i in np.flatnonzero(words.count >= window).tolist():
            a, b = words.first[i], words.first[i + 1]
            key = (xxhash.xxh3_64_intdigest(hashes[a:b].tobytes(), 1), xxhash.xxh3_64_intdigest(other[a:b].tobytes(), 2))
            if key not in places:
                places[key] = len(fresh)
                fresh.append(i)
                self.keys.append(key)
            self.of[i] = places[key]
        self.copies = np.bincount(self.of[self.of >= 0], minlength=len(fresh))
        # words of the distinct texts, one text after the other
        at = [np.arange(words.first[i], words.first[i + 1]) for i in fresh]
        self.at = np.concatenate(at) if at else np.empty(0, dtype=np.int64)
        self.hashes, self.other = hashes[self.at], other[self.at]
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in at]))).astype(np.int64)
        self.doc = np.repeat(np.arange(len(fresh)), np.diff(self.first))
        self.words = words

    def __len__(self) -> int:
        return len(self.at)

    def windows(self, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(K.window_hash_at(x, at, window, w) for w, x in ((0, self.hashes), (1, self.other)))


def recompress(hashes: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    out = Symbols(hashes, doc)
    for level in range(rounds):
        out.runs()
        out.pairs(level)
    return out


def _symbol_rows(chunks: DataFrame, window: int, rounds: int) -> DataFrame:
    """(name, part, n, chunk): counted symbols of each chunk, with part 0, and a row for each long text.

    A text's row is named by a hash of its words, with further bits of another as the part.
    """

    def run(batches):
        for batch in batches:
            for chunk, body in each(batch, "chunk", "body"):
                own = _Chunk(opened(body.as_py())[1], window)
                symbols = recompress(own.hashes, own.doc, rounds)
                name, n = np.unique(symbols.name[told(symbols, window)], return_counts=True)
                texts = np.array(own.keys, dtype=_U).reshape(-1, 2)
                more = (texts[:, 1] >> _U(33)).astype(np.int32) | 1
                arrays = [
                    np.concatenate((name, texts[:, 0])).view(np.int64),
                    np.concatenate((np.zeros(len(name), dtype=np.int32), more)),
                    np.concatenate((np.minimum(n, 2), np.minimum(own.copies, 2))).astype(np.int32),
                    np.full(len(name) + len(texts), chunk.as_py(), dtype=np.int64),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["name", "part", "n", "chunk"])

    return chunks.mapInArrow(run, "name long, part int, n int, chunk long")


def _longs(value) -> np.ndarray:
    """A list of longs as an array; none is empty."""
    return np.empty(0, dtype=np.int64) if value is None or not value.is_valid else value.values.to_numpy(zero_copy_only=False)


def _candidates(own: _Chunk, once, texts, again, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows that may repeat, and which distinct texts occur elsewhere too.

    once: names of symbols that occur once in the corpus.  texts, again: names of the
    texts whose first chunk is this one, and whether they occur more than once.
    """
    symbols = recompress(own.hashes, own.doc, rounds)
    at = told(symbols, window)
    unique = at[np.isin(symbols.name[at], _longs(once).view(_U))]
    found = candidates(own, symbols, unique, window)
    alone = {t for t, more in zip(_longs(texts).tolist(), again.as_py() or ()) if not more} if texts.is_valid else set()
    copied = np.array([x[0] - (1 << 64 if x[0] >> 63 else 0) not in alone for x in own.keys], dtype=bool)
    return found, copied


def _window_rows(joined: DataFrame, window: int, rounds: int) -> DataFrame:
    """(h1, h2, n, chunk, at): candidate windows, each once in a chunk; n is 2 if it repeats there.

    Of the chunks with a copy of a text only the first one sends its windows.
    """

    def run(batches):
        for batch in batches:
            for chunk, body, *lists in each(batch, "chunk", "body", "once", "texts", "again"):
                own = _Chunk(opened(body.as_py())[1], window)
                found, copied = _candidates(own, *lists, window, rounds)
                first = set(_longs(lists[1]).tolist())
                mine = np.array([x[0] - (1 << 64 if x[0] >> 63 else 0) in first for x in own.keys], dtype=bool)
                found = found[mine[own.doc[found]]] if len(found) else found
                if not len(found):
                    continue
                h1, h2 = own.windows(found, window)
                order = np.lexsort((h2, h1))
                head = np.flatnonzero(np.concatenate(([True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1]))))
                n = np.diff(np.concatenate((head, [len(order)])))
                one = order[head]
                n = np.where(copied[own.doc[found[one]]], 2, np.minimum(n, 2)).astype(np.int32)
                arrays = [h1[one].view(np.int64), h2[one].view(np.int64), n, np.full(len(one), chunk.as_py()), found[one].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["h1", "h2", "n", "chunk", "at"])

    return joined.mapInArrow(run, "h1 long, h2 long, n int, chunk long, at int")


def mark_repeats(
    docs: DataFrame, keep: list[str], *, text: str = "text", window: int = WINDOW, rounds: int = ROUNDS, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """``keep`` columns with n_words, n_removed and kept, the remaining words joined by spaces.

    A word goes if some window of ``window`` words of its text that covers it starts
    anywhere else too, in this text or another; windows are judged on the input.  Rows
    with a null, empty or short text keep all words; rows with equal texts lose all if
    they have ``window`` words.  A null text comes back empty.  ids play no part, so null and repeated ids are rows
    like any other.  Columns of ``docs`` named like a result are replaced.
    """
    keep = [c for c in keep if c not in ("n_words", "n_removed", "kept")]
    chunks = materialise(pack(docs, [c for c in keep if c != text], text, chunk_bytes=chunk_bytes).select("chunk", "body"))
    counted = _symbol_rows(chunks, window, rounds).groupBy("name", "part").agg(F.sum("n").alias("n"), F.min("chunk").alias("chunk"))
    symbol = F.col("part") == 0
    # a chunk's own symbols and texts: as many as it has
    told_back = counted.where(~symbol | (F.col("n") == 1)).groupBy(F.col("chunk").alias("_chunk")).agg(
        F.collect_list(F.when(symbol, F.col("name"))).alias("once"),
        F.collect_list(F.when(~symbol, F.struct("name", (F.col("n") > 1).alias("again")))).alias("_texts"),
    )
    told_back = told_back.select("_chunk", "once", F.col("_texts.name").alias("texts"), F.col("_texts.again").alias("again"))
    joined = chunks.join(told_back, F.col("chunk") == F.col("_chunk"), "left").drop("_chunk")
    windows = _window_rows(joined, window, rounds).groupBy("h1", "h2")
    alone = windows.agg(F.sum("n").alias("n"), F.min("chunk").alias("_chunk"), F.min("at").alias("at")).where("n = 1")
    alone = alone.groupBy("_chunk").agg(F.collect_list("at").alias("alone"))
    return _apply(joined.join(alone, F.col("chunk") == F.col("_chunk"), "left"), docs, keep, text, window, rounds)


def _apply(rows: DataFrame, docs: DataFrame, keep: list[str], text: str, window: int, rounds: int) -> DataFrame:
    """Cut what the candidate windows cover, but for those that occur once."""
    inside = [c for c in keep if c != text]
    fields = [T.StructField(c, T.StringType()) if c == text else docs.schema[c] for c in keep]
    out = T.StructType([*fields, *T._parse_datatype_string("n_words long, n_removed long, kept string").fields])

    def run(batches):
        for batch in batches:
            for body, once, texts, again, alone in each(batch, "body", "once", "texts", "again", "alone"):
                source, whole = opened(body.as_py())
                own = _Chunk(whole, window)
                found, copied = _candidates(own, once, texts, again, window, rounds)
                found = np.setdiff1d(found, _longs(alone), assume_unique=True)
                gone = K.run_mask(len(own), found, window)
                many = copied | (own.copies > 1)
                gone |= many[own.doc] if len(gone) else gone
                yield from _cut(source, whole, own, gone)

    def _cut(source, whole, own, gone):
        words, raw = own.words, whole.data
        kept, removed = [], np.zeros(whole.n, dtype=np.int64)
        for i in range(whole.n):
            lo, hi = int(words.first[i]), int(words.first[i + 1])
            if (d := int(own.of[i])) >= 0:
                mine = gone[own.first[d] : own.first[d + 1]]
                removed[i] = mine.sum()
                left = np.flatnonzero(~mine) + lo
            else:
                left = np.arange(lo, hi)
            kept.append(b" ".join([raw[s:e].tobytes() for s, e in zip(words.start[left].tolist(), words.end[left].tolist())]).decode())
        columns = {c: source.column(i) for i, c in enumerate(inside)} | {text: source.column(source.num_columns - 1)}
        every = [columns[c] for c in keep] + [pa.array(words.count.astype(np.int64)), pa.array(removed), pa.array(kept, type=pa.string())]
        yield pa.RecordBatch.from_arrays(every, names=out.names)

    return rows.mapInArrow(run, out)


def op6(spark, sf_dir: str) -> DataFrame:
    """Digest of the contract over all ``documents``."""
    found = mark_repeats(read(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def digest(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()
