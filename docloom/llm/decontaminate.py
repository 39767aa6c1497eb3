"""Benchmark decontamination by winnowing.

Every window of ``width`` benchmark words is represented by the k-gram hashes that
winnowing selects: the minimum of each run of ``width - k + 1`` k-grams.  A text
that holds the window selects the same hash at the same place in it, so joining the
selected hashes of texts and items misses no span of ``width`` words.  A hit is then
extended: the windows around it are looked up and compared byte by byte.

The items' index is sent to the executors in blocks of at most ``block_bytes`` of
item text.  One block is the common case; a larger benchmark takes one pass over the
texts per block, and the passes are merged per document.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .kernels import LOWER

_U = np.uint64
WIDTH, GRAM = 10, 4
BLOCK_BYTES = 16 << 20

_HITS = "n_words long, n_hit long, item_ids array<string>, hit_spans array<struct<start:long,end:long>>"


class _Index:
    """What one block of items is looked up by: arrays of about eight bytes for each byte of item text.

    The words of all items stand in one buffer, lower-cased and parted by single blanks.
    ``tables``: for each window length, the hashes of the windows, sorted, and the first
    word of each.
    """

    def __init__(self, items: list[tuple[str, bytes]], width: int, gram: int):
        self.width, self.gram = width, gram
        self.names = [name for name, _ in items]
        data = LOWER[np.frombuffer(b" ".join(raw for _, raw in items), dtype=np.uint8)]
        size = np.array([len(raw) for _, raw in items], dtype=np.int64)
        first = np.cumsum(size + 1) - size - 1
        # a blank between two items belongs to the former
        words = K.Words(K.Text(data, np.append(first, len(data)).astype(np.int64)), K.ALPHANUMERIC)
        length = words.end - words.start
        at = np.cumsum(length + 1) - length - 1
        self.buffer = b" ".join(data[a:b].tobytes() for a, b in zip(words.start.tolist(), words.end.tolist()))
        self.start, self.length = at, length.astype(np.int32)
        self.owner = words.doc.astype(np.int32)
        hashes = words.hashes()
        count = words.count[words.doc] if len(words) else words.doc
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in sorted({min(int(n), width) for n in np.unique(words.count) if n}):
            places, window = words.windows(hashes, k)
            own = count[places] >= width if k == width else count[places] == k
            places, window = places[own], window[own]
            order = np.argsort(window, kind="stable")
            window = window[order]
            self.tables[k] = window, places[order].astype(np.int32), K.bitmap(window)
        self.grams = None
        if width in self.tables:
            places, grams = words.windows(hashes, gram)
            grams = np.unique(grams[count[places] >= width])
            self.grams = grams, K.bitmap(grams)
        self.known: dict[int, list[tuple[bytes, frozenset[int]]]] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def _owners(self, size: int, window: int, said: bytes) -> frozenset[int]:
        """Items with a window of this hash whose bytes are ``said``."""
        if window not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            every, places, _ = self.tables[size]
            lo, hi = np.searchsorted(every, _U(window), "left"), np.searchsorted(every, _U(window), "right")
            groups: dict[bytes, set[int]] = defaultdict(set)
            for w in places[lo:hi].tolist():
                last = w + size - 1
                groups[self.buffer[self.start[w] : self.start[last] + self.length[last]]].add(int(self.owner[w]))
            self.known[window] = [(k, frozenset(v)) for k, v in groups.items()]
        return next((own for text, own in self.known[window] if text == said), frozenset())

    def hits(self, words: K.Words) -> list[tuple[int, int, frozenset[int]]]:
        """First word, length and items of every occurrence of a window."""
        out, hashes = [], words.hashes(lower=True)

        def verify(at: np.ndarray, window: np.ndarray, size: int) -> None:
            here = K.members(window, *self.tables[size][::2])
            for i, h in zip(at[here].tolist(), window[here].tolist()):
                if own := self._owners(size, h, words.bytes(i, i + size, lower=True)):
                    out.append((i, size, own))

        if self.grams is not None:
            near = self._around(words, hashes)
            if len(near):
                at = near[words.doc[near] == words.doc[near + self.width - 1]]
                verify(at, K.window_hash_at(hashes, at, self.width), self.width)
        for size in self.tables:
            if size < self.width:
                verify(*words.windows(hashes, size), size)
        return out

    def _around(self, words: K.Words, hashes: np.ndarray) -> np.ndarray:
        """Possible first words of windows: those with a shared selected k-gram inside."""
        reach = self.width - self.gram + 1
        count = len(words) - self.width + 1
        if count <= 0:
            return np.empty(0, dtype=np.int64)
        gram = K.window_hash(hashes, self.gram)
        least, where = gram[:count].copy(), np.zeros(count, dtype=np.int64)
        for step in range(1, reach):
            other = gram[step : step + count]
            lower = other <= least
            least[lower] = other[lower]
            where[lower] = step
        inside = words.doc[:count] == words.doc[self.width - 1 :]
        selected = np.unique((np.arange(count) + where)[inside])
        shared = selected[K.members(gram[selected], *self.grams)]
        near = np.unique((shared[:, None] - np.arange(reach)[None, :]).ravel())
        return near[(near >= 0) & (near < count)]


def _pass(docs: DataFrame, text: str, keep: list[str], items, width: int, gram: int) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(_Index(items, width, gram))

    def work(_, own: K.Text) -> dict:
        words, known = K.Words(own, K.ALPHANUMERIC), index.value
        found = known.hits(words)
        covered = np.zeros(len(words), dtype=bool)
        items: dict[int, set[int]] = defaultdict(set)
        for i, size, owners in found:
            covered[i : i + size] = True
            items[int(words.doc[i])] |= owners
        total = np.concatenate(([0], np.cumsum(covered)))
        names: list[list[str]] = [[] for _ in range(own.n)]
        spans: list[list[dict]] = [[] for _ in range(own.n)]
        for d, owners in items.items():
            names[d] = sorted({known.names[o] for o in owners})
            lo, hi = words.first[d], words.first[d + 1]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], covered[lo:hi].view(np.int8), [0]))))
            spans[d] = [{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return {
            "n_words": words.count,
            "n_hit": total[words.first[1:]] - total[words.first[:-1]],
            "item_ids": pa.array(names, type=pa.list_(pa.string())),
            "hit_spans": pa.array(spans, type=span),
        }

    return K.map_texts(docs, text, keep, _HITS, work)


def _merged(passes: list[DataFrame], columns: list[str]) -> DataFrame:
    """One row per document from one row per document and block.

    Spans of several blocks may overlap; they are united in order.
    """
    key = F.struct(*columns) if columns else F.lit(0)
    rows = passes[0].withColumn("_key", key)
    for other in passes[1:]:
        rows = rows.unionByName(other.withColumn("_key", key))
    empty = F.array().cast("array<struct<start:long,end:long>>")

    def join_spans(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        apart = (F.size(done) == 0) | (x["start"] > F.try_element_at(done, F.lit(-1))["end"])
        return F.when(apart, F.concat(done, F.array(x))).otherwise(
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))
        )

    grouped = rows.groupBy("_key").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.array_sort(F.flatten(F.collect_list("hit_spans"))).alias("_spans"),
    )
    united = grouped.withColumn("hit_spans", F.aggregate("_spans", empty, lambda a, x: join_spans(a, x)))
    total = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return united.select(
        *[F.col("_key")[c].alias(c) for c in columns], "n_words", total.alias("n_hit"), "item_ids", "hit_spans"
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    keep: list[str] | None = None,
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    gram: int = GRAM,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``keep`` columns of ``docs`` with n_words, n_hit, item_ids and hit_spans.

    Words are ASCII-lower-cased runs of letters, digits and non-ASCII characters.  A
    hit is a word inside an occurrence of ``width`` consecutive item words; an item
    with fewer words is one window.  ``hit_spans`` are word positions, end exclusive.
    A null text, an empty text and a text without words have no hits; an item
    without words never occurs; items with equal texts are all reported; a null
    item id is reported as the string ``null``.  Columns of ``docs`` named like a
    result are replaced.  With several blocks of items a document is known by its
    row number; rows that repeat stay rows of their own.
    """
    if gram > width:
        raise ValueError("gram must not exceed width")
    keep = list(docs.columns) if keep is None else keep
    wanted = [c for c in keep if c not in {"n_words", "n_hit", "item_ids", "hit_spans"}]
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("name"),
        F.coalesce(F.col(item_text), F.lit("")).cast("binary").alias("raw"),
    )
    total = items.agg(F.sum(F.octet_length("raw") + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    if blocks == 1:
        return _pass(docs, text, wanted, [(r[0], bytes(r[1])) for r in items.collect()], width, gram)
    from .storage import materialise

    row = K.unused(docs.columns, "_row")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()))
    part = F.pmod(F.xxhash64("name", "raw"), F.lit(blocks))
    passes = [
        _pass(numbered, text, [row], [(r[0], bytes(r[1])) for r in items.where(part == b).collect()], width, gram)
        for b in range(blocks)
    ]
    return numbered.select(row, *wanted).join(_merged(passes, [row]), row).drop(row)


def op10(spark, sf_dir: str) -> DataFrame:
    """Digest of the contract over all ``documents``."""
    from .storage import read

    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("item_ids")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
