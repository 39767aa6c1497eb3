"""Best-fit packing by exact-complement hashing.

Documents become token counts; a longer one is cut into full pieces, the remainder
first.  What is planned is the histogram of lengths, at most ``CAPACITY`` counts, so
the plan does not grow with the corpus.  Sums of one, two and three lengths are
indexed; a gap is filled exactly by a combination of available lengths, consumed as
often as the counts allow.  Where no combination fits exactly, the largest length
that fits is taken and the smaller gap is tried again.  Pieces of a length are
numbered without gaps, and the plan's rank ranges tell each its sequence and offset.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .slots import numbered
from .storage import materialise, read

CAPACITY = 2048
END_ID = 0
#: Entries of a worker's cache of encoded words; a full cache is emptied
CACHE = 400_000


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _plain_bytes() -> np.ndarray:
    """Bytes that Latin text in single-blank style is made of: up to U+027F, no controls but line feeds."""
    out = np.zeros(256, dtype=bool)
    out[0x20:0x7F] = out[0x80:0xCA] = True
    out[10] = True
    return out


_PLAIN, _BLANK = _plain_bytes(), np.isin(np.arange(256), (10, 0x20))


def odd_texts(own: K.Text) -> np.ndarray:
    """Texts in which the two libraries could differ, or words are not cut at single blanks.

    These have characters beyond Latin, whose classes may depend on the library,
    controls, the special blanks and the soft hyphen of U+0080 to U+00AD, two blanks
    together, or a blank at an end.
    """
    data = own.data
    bad = ~_PLAIN[data]
    if len(data) > 1:
        after_c2 = (data[:-1] == 0xC2) & ((data[1:] <= 0xA0) | (data[1:] == 0xAD))
        blank = _BLANK[data]
        bad[:-1] |= after_c2 | (blank[:-1] & blank[1:])
    out = own.sums(bad) > 0
    some = np.flatnonzero(own.offsets[1:] > own.offsets[:-1])
    out[some] |= _BLANK[data[own.offsets[some]]] | _BLANK[data[own.offsets[some + 1] - 1]]
    return out


class _Words(dict):
    """Encoded words; what is missing is encoded and kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        # a word follows a space unless it starts a line
        out = self[word] = array("I", self.encode(word if word[0] == "\n" else " " + word)).tobytes()
        return out


class Encoder:
    """Ids of the byte-level BPE as little-endian unsigned 32-bit bytes.

    Words between single blanks are encoded once and kept.  ``tiktoken`` with the same
    vocabulary does the encoding of words, since it gives the ids of the ``tokenizers``
    file several times faster; odd texts go to the latter.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import base64

        import public_tokenizers
        import tiktoken

        self.json_path = json_path
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._plain = own.encode_ordinary
        self._words = _Words(own._core_bpe.encode_ordinary)

    @functools.cached_property
    def _slow(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def __call__(self, text: str, odd: bool) -> bytes:
        if not text:
            return b""
        if odd or "<|endoftext|>" in text:
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        first, *words = text.replace("\n", " \n").split(" ")
        if len(self._words) > CACHE:
            self._words.clear()
        return array("I", self._plain(first)).tobytes() + b"".join(map(self._words.__getitem__, words))


@functools.lru_cache(1)
def _encoder(json_path: str, ranks_path: str) -> Encoder:
    return Encoder(json_path, ranks_path)


def pieces(
    docs: DataFrame,
    keep: list[str],
    *,
    text: str = "text",
    capacity: int = CAPACITY,
    json_path: str | None = None,
    ranks_path: str | None = None,
    ids: bool = False,
) -> DataFrame:
    """One row per piece: ``keep`` columns, piece, start, length, ids_crc32, and ``ids`` if asked for.

    A null or empty text is one piece of one token, the end id.  The ids travel
    compressed; ``with_ids`` opens them.  Columns named like a result are replaced.
    """
    result = ["piece", "start", "length", "ids_crc32", "ids"]
    keep = [c for c in keep if c not in result[: 4 + ids]]
    json_path = json_path or _vocabulary("byte_bpe_50k.json")
    ranks_path = ranks_path or _vocabulary("byte_bpe_50k.tiktoken")
    closing = np.array([END_ID], dtype="<u4").tobytes()
    fields = [("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
    span = pa.struct(fields[: 4 + ids])
    packed = (lambda part: {"ids": zstandard.compress(part, 1)}) if ids else (lambda part: {})

    def work(_, own: K.Text) -> dict:
        encode = _encoder(json_path, ranks_path)
        raw, bounds, out = own.data.tobytes(), own.offsets.tolist(), []
        for a, b, odd in zip(bounds, bounds[1:], odd_texts(own).tolist()):
            said = encode(raw[a:b].decode(), odd) + closing
            n = len(said) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            out.append(
                [
                    {"piece": i, "start": s, "length": e - s, "ids_crc32": zlib.crc32(said[4 * s : 4 * e]), **packed(said[4 * s : 4 * e])}
                    for i, (s, e) in enumerate(zip(cuts, cuts[1:]))
                ]
            )
        return {name: pa.array(out, type=pa.list_(span))}

    name = K.unused([*docs.columns], "_pieces")
    ddl = f"{name} array<struct<piece:long,start:long,length:long,ids_crc32:long{',ids:binary' if ids else ''}>>"
    return K.map_texts(docs, text, keep, ddl, work).select(*keep, F.inline(name))


def with_ids(rows: DataFrame) -> DataFrame:
    """``rows`` with ``ids`` as a list of token ids."""
    fields = [T.StructField(f.name, T.ArrayType(T.IntegerType())) if f.name == "ids" else f for f in rows.schema.fields]
    at = rows.columns.index("ids")

    def run(batches):
        opened = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                raw = [opened(x) for x in part.column(at).to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in raw]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([lists if i == at else c for i, c in enumerate(part.columns)], names=part.schema.names)

    return rows.mapInArrow(run, T.StructType(fields))


@dataclass
class Run:
    """``count`` sequences that each take ``rows``: (length, copies) pairs."""

    rows: list[tuple[int, int]]
    count: int


class _Available:
    """Counts by length, and which sums of one, two and three lengths exist."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.capacity = counts, len(counts) - 1
        self.pairs: np.ndarray | None = None

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if self.counts[length] == 0:
            self.pairs = None  # some pair sums may be gone

    def _pair(self, total: int) -> tuple[int, int] | None:
        half = self.counts[1 : total // 2 + 1] > 0
        mate = self.counts[total - 1 : total - len(half) - 1 : -1] > 0 if len(half) else half
        both = half & mate
        if total % 2 == 0 and len(both) and self.counts[total // 2] < 2:
            both[-1] = False
        at = np.flatnonzero(both)
        return (total - int(at[0]) - 1, int(at[0]) + 1) if len(at) else None

    def _pair_sums(self) -> np.ndarray:
        if self.pairs is None:
            have, out = self.counts > 0, np.zeros(self.capacity + 1, dtype=bool)
            for a in np.flatnonzero(have).tolist():
                out[a:] |= have[: self.capacity + 1 - a]
            self.pairs = out
        return self.pairs

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """Available lengths with the sum ``gap``: one, else two, else three."""
        if self.counts[gap] > 0:
            return (gap,)
        if pair := self._pair(gap):
            return pair
        have, sums = self.counts[:gap] > 0, self._pair_sums()[gap:0:-1]
        for a in np.flatnonzero(have & sums).tolist()[::-1]:
            if a and 0 < gap - a:
                self.counts[a] -= 1
                pair = self._pair(gap - a)
                self.counts[a] += 1
                if pair:
                    return (a, *pair)
        return None

    def largest(self, gap: int) -> int:
        at = np.flatnonzero(self.counts[: gap + 1])
        return int(at[-1]) if len(at) else 0


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Sequences for all lengths of the histogram, the longest lengths first.

    Each run uses up some length, or all that a tighter fit needs, so there are at most
    a few runs for each length, whatever the counts are.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit")
        counts[length] += n
    left, out = _Available(counts), []
    while top := left.largest(capacity):
        taken, gap = [top], capacity - top
        left.counts[top] -= 1
        while gap:
            if found := left.exact(gap):
                taken += found
                break
            if not (best := left.largest(gap)):
                break
            taken.append(best)
            left.counts[best] -= 1
            gap -= best
        else:
            found = ()
        for x in taken[: len(taken) - len(found or ())]:
            left.counts[x] += 1
        lengths, copies = np.unique(taken, return_counts=True)
        times = int(min(left.counts[lengths] // copies))
        for x, k in zip(lengths.tolist(), copies.tolist()):
            left.take(x, times * k)
        out.append(Run(list(zip(lengths.tolist(), copies.tolist()))[::-1], times))
    return out


def places(runs: list[Run]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, copies, first offset) of each run's lengths."""
    out, used, sequence = [], {}, 0
    for run in runs:
        offset = 0
        for length, copies in run.rows:
            first = used.get(length, 0)
            end = first + copies * run.count
            out.append((length, first, end, sequence, copies, offset))
            used[length] = end
            offset += copies * length
        sequence += run.count
    return out


def pack(rows: DataFrame, order: list[str], *, capacity: int = CAPACITY) -> DataFrame:
    """Rows with a ``length`` of at most ``capacity``, with sequence_id and offset.

    ``rows`` is read three times: it should be stored.  Only the histogram, with at
    most ``capacity`` rows, reaches the driver; the ranges that go out are sorted into
    arrays by length, a few for each.
    """
    rank, length, found = K.unused(rows.columns, "_rank"), K.unused(rows.columns, "_length"), K.unused(rows.columns, "_ranges")
    spark = rows.sparkSession
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranges = places(plan(histogram, capacity))
    schema = "length long, first long, end long, sequence long, copies long, start_at long"
    by_length = (
        spark.createDataFrame(ranges, schema)
        .groupBy("length")
        .agg(F.array_sort(F.collect_list(F.struct("first", "end", "sequence", "copies", "start_at"))).alias(found))
        .withColumnRenamed("length", length)
    )
    ranked = numbered(rows, ["length"], order, rank)
    # at most ``capacity`` rows with a bounded number of ranges in all: bounded in size
    joined = ranked.join(F.broadcast(by_length), ranked["length"] == by_length[length])
    own = F.filter(found, lambda r: (r["first"] <= F.col(rank)) & (F.col(rank) < r["end"]))[0]
    nth = F.col(rank) - own["first"]
    return joined.select(
        *rows.columns,
        (own["sequence"] + F.floor(nth / own["copies"])).cast("long").alias("sequence_id"),
        (own["start_at"] + (nth % own["copies"]) * F.col("length")).cast("long").alias("offset"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    """Digest of the contract over all ``documents``."""
    cut = materialise(pieces(read(spark, sf_dir, "documents"), ["doc_id"]))
    packed = pack(cut, ["doc_id", "piece", "ids_crc32"])
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
