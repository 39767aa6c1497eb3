"""Vectorised text kernels shared by the operators of this subpackage.

Everything works on the UTF-8 bytes of a slice of an Arrow string column, a few
hundred kilobytes at a time, so the memory of a Python worker does not depend on
the size of a partition or of a record batch (one very long text forms a slice of
its own).  All separators of interest are ASCII, hence byte and code-point
tokenisation agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 19

_U = np.uint64
_ALL = (1 << 64) - 1
_MIX1, _MIX2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
_LEFT, _RIGHT = _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)
#: masks of the first 0 to 8 bytes of a little-endian value
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=_U)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> _U(33))
    h = h * _MIX1
    h ^= h >> _U(33)
    h *= _MIX2
    h ^= h >> _U(33)
    return h


def combine(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A hash of two hashes in order; mixing after every step leaves no algebra between texts."""
    return mix(a * _LEFT + (b ^ (b >> _U(29))) * _RIGHT + _U(salt * 0x9E3779B97F4A7C15 & _ALL))


#: Words and lines of more bytes are hashed one by one
_SHORT = 64


def bytes_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of byte ranges: eight bytes a step, mixed after each, or XXH3 for long ranges."""
    size = (end - start).astype(np.int64)
    out = mix(size.astype(_U) + _U(which * 0xD6E8FEB86659FD93 + 1 & _ALL))
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    long = size > _SHORT
    live = np.flatnonzero((size > 0) & ~long)
    for step in range(0, _SHORT, 8):
        if not len(live):
            break
        left = size[live] - step
        chunk = eight[start[live] + step] & _KEEP[np.minimum(left, 8)]
        out[live] = combine(out[live], chunk, step + which)
        live = live[left > 8]
    if long.any():
        raw = data.tobytes() if isinstance(data, np.ndarray) else data
        for i in np.flatnonzero(long).tolist():
            out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]], which)
    return out


def window_hash(hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of every ``k`` consecutive hashes, from those of its halves, quarters and so on."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=_U)
    out, level, size, done = None, hashes, 1, 0
    parts = []
    while size <= k:
        if k & size:
            parts.append((size, level))
        if 2 * size <= k:
            level = combine(level[:-size], level[size:], 2 * size + which * 4096)
        size *= 2
    for size, level in reversed(parts):
        piece = level[done : done + n]
        out = piece if out is None else combine(out, piece, 64 * size + 1 + which * 4096)
        done += size
    return mix(out + _U(k))


def window_hash_at(hashes: np.ndarray, at: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """``window_hash`` at some places only."""
    if 4 * len(at) * k > len(hashes) * max(k.bit_length(), 1):
        return window_hash(hashes, k, which)[at]
    out, done = None, 0
    for size in (1 << j for j in range(k.bit_length() - 1, -1, -1)):
        if k & size:
            level = hashes[at[:, None] + (done + np.arange(size))[None, :]]
            half = 1
            while level.shape[1] > 1:
                level = combine(level[:, ::2], level[:, 1::2], 2 * half + which * 4096)
                half *= 2
            piece = level[:, 0]
            out = piece if out is None else combine(out, piece, 64 * size + 1 + which * 4096)
            done += size
    return mix(out + _U(k))


#: ``[^\x20\x09-\x0D]``
BLANK_SEPARATED = np.ones(256, dtype=bool)
BLANK_SEPARATED[[0x20, 9, 10, 11, 12, 13]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` once A-Z are lower-cased
ALPHANUMERIC = np.zeros(256, dtype=bool)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    ALPHANUMERIC[_a : _b + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Text:
    """Bytes of the texts of a slice, with the bounds of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.n = len(offsets) - 1

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Sums of a value per byte over each text."""
        total = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(per_byte, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


class Words:
    """The words of a slice: bounds in the bytes, and the first word of each text."""

    def __init__(self, text: Text, chars: np.ndarray = BLANK_SEPARATED):
        self.text = text
        inside = chars[text.data]
        before = np.empty(len(inside) + 1, dtype=bool)
        before[0] = False
        before[1:] = inside
        after = before.copy()
        after[:-1], after[-1] = inside, False
        edges = text.offsets[:-1][text.offsets[:-1] < len(inside)]
        before[edges] = False
        after[text.offsets[1:]] = False
        self.inside = inside
        self.start = np.flatnonzero(inside & ~before[:-1])
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, text.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(text.n), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, which: int = 0, lower: bool = False) -> np.ndarray:
        data = self.text.data
        return bytes_hash(LOWER[data] if lower else data, self.start, self.end, which)

    def windows(self, hashes: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First words, and hashes, of all runs of ``k`` words within one text."""
        if len(self) < k:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=_U)
        at = np.flatnonzero(self.doc[: len(self) - k + 1] == self.doc[k - 1 :])
        return at, window_hash(hashes, k, which)[at]

    def bytes(self, a: int, b: int, lower: bool = False) -> bytes:
        """Words ``a`` to ``b``, exclusive, joined by one space."""
        raw = self.text.data
        if lower:
            return b" ".join(LOWER[raw[s:e]].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True))
        return b" ".join(raw[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True))


def run_mask(n: int, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Positions below ``n`` that some run ``[start, start + length)`` covers."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, np.minimum(start + length, n), -1)
    return np.cumsum(step[:-1]) > 0


def as_text(column: pa.Array) -> Text:
    """The bytes of an Arrow string or binary column; a null counts as empty."""
    column = column.cast(pa.binary()) if pa.types.is_string_view(column.type) else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or bounds is None:
        return Text(np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64))
    offsets = np.frombuffer(bounds, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return Text(raw, offsets - offsets[0])


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Text]]:
    """Parts of a batch with about ``most`` bytes of text each, or one row."""
    whole = as_text(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(whole.offsets, whole.offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        lo, hi = whole.offsets[at], whole.offsets[to]
        yield batch.slice(at, to - at), Text(whole.data[lo:hi], whole.offsets[at : to + 1] - lo)
        at = to


def unused(names: list[str], stem: str) -> str:
    """``stem``, or a longer name, that none of ``names`` has in any case."""
    taken = {n.lower() for n in names}
    while stem in taken:
        stem = f"_{stem}"
    return stem


def map_texts(df, text: str, keep: list[str], schema: str, work: Callable[[pa.RecordBatch, Text], dict], most: int = SLICE_BYTES):
    """``keep`` columns of ``df`` next to what ``work`` returns for each slice.

    ``schema``: DDL of the new columns.  ``work`` gives one array for each of them,
    as long as the slice.  No shuffle; a worker holds one slice at a time.
    """
    from pyspark.sql import types as T

    new = T._parse_datatype_string(schema)
    clash = set(new.names)
    keep = [c for c in keep if c not in clash]
    source = df.select(*keep, *([text] if text not in keep else []))
    out = T.StructType([source.schema[c] for c in keep] + new.fields)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {f.name: to_arrow_type(f.dataType) for f in new.fields}

    def run(batches):
        for batch in batches:
            for part, own in slices(batch, text, most):
                got = work(part, own)
                arrays = [part.column(c) for c in keep]
                for name, kind in kinds.items():
                    value = got[name]
                    arrays.append(value if isinstance(value, pa.Array) else pa.array(value, type=kind))
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *kinds])

    return source.mapInArrow(run, out)


def bitmap(hashes: np.ndarray, bits: int = 20) -> np.ndarray:
    """A filter that lets every member through, and few others."""
    out = np.zeros(1 << bits, dtype=bool)
    out[(hashes >> _U(64 - bits)).astype(np.int64)] = True
    return out


def members(hashes: np.ndarray, sorted_set: np.ndarray, filtered: np.ndarray) -> np.ndarray:
    """Positions of the ``hashes`` that are in ``sorted_set``."""
    bits = len(filtered).bit_length() - 1
    at = np.flatnonzero(filtered[(hashes >> _U(64 - bits)).astype(np.int64)])
    if not len(at) or not len(sorted_set):
        return at[:0]
    found = np.searchsorted(sorted_set, hashes[at])
    found[found == len(sorted_set)] = 0
    return at[sorted_set[found] == hashes[at]]
