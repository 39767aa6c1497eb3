"""Cross-entropy difference of a target and a background n-gram model.

Both models are interpolated bigram models over one vocabulary, all words of the corpus.
The background model counts all documents, the target model those labelled good; no word
or pair is left out, so the models grow with the corpus.  A document is scored by models
that have not seen it: its own counts are taken off first.

Models are never gathered.  Texts are stored in chunks; each chunk sends its distinct
words and pairs, as sorted and compressed keys, to the ranges of a table that is dealt
by key, and gets back what the rest of the corpus counts for them, in the same order.
A word or pair of all documents is one key a chunk.

A document's score is the mean over its words of the target model's loss minus the
background model's: low means alike to the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .chunks import each, opened, pack
from .storage import materialise, read

#: Share of the bigram level, and what is added to each word's count
WEIGHT, ADD = 0.7, 0.5
CHUNK_BYTES = 4 << 20
#: Bytes of corpus text for each range of the table: a task holds the keys of one range
RANGE_BYTES = 16 << 20
#: Labels of at most so many good rows are sent to all executors
BROADCAST_ROWS = 1_000_000
_U = np.uint64
#: Keys have 56 bits: odd ones are words, even ones pairs; two stand for starts of texts and for all words
_BITS, _START, _ALL = 56, 0, 2
_BEFORE = _U(0x5851F42D4C957F2D)


class Counts:
    """Distinct keys of a chunk, sorted, and how often all and the target's texts have them."""

    def __init__(self, own: K.Text, target: np.ndarray):
        words = self.words = K.Words(own)
        hashes = words.hashes(lower=True)
        before = np.full(len(hashes), _BEFORE, dtype=_U)
        if len(hashes) > 1:
            before[1:] = np.where(words.doc[1:] == words.doc[:-1], hashes[:-1], _BEFORE)
        drop = _U(64 - _BITS)
        word = hashes >> drop | _U(1)
        pair = K.combine(before, hashes, 1) >> drop & _U((1 << _BITS) - 2)
        filled = np.flatnonzero(words.count)
        special = np.array([_START, _ALL], dtype=_U)
        self.keys, place = np.unique(np.concatenate((word, pair, special)), return_inverse=True)
        n = len(word)
        self.word, self.pair, (self.start, self.all) = place[:n], place[n : 2 * n], place[2 * n :]
        self.n = np.zeros((2, len(self.keys)), dtype=np.int64)
        for m, weight in ((0, np.ones(own.n)), (1, target.astype(np.float64))):
            each_word = weight[words.doc]
            sums = np.bincount(self.word, each_word, len(self.keys)) + np.bincount(self.pair, each_word, len(self.keys))
            sums[self.start] += weight[filled].sum()
            sums[self.all] += each_word.sum()
            self.n[m] = sums.astype(np.int64)

    def ranges(self, many: int) -> list[int]:
        """Where each range of keys starts, and the end."""
        number = (self.keys >> _U(24)) * _U(many) >> _U(32)
        return np.searchsorted(number, np.arange(many + 1).astype(_U)).tolist()

    def own(self, place: np.ndarray) -> np.ndarray:
        """How often each word's text has the word's key."""
        both = self.words.doc.astype(np.int64) * len(self.keys) + place
        _, at, n = np.unique(both, return_inverse=True, return_counts=True)
        return n[at]


def _planes(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of 64-bit values, all first bytes first."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _values(raw: bytes, width: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def _request(keys: np.ndarray, n: np.ndarray) -> bytes:
    gaps = np.diff(keys, prepend=_U(0))
    return _planes(gaps, 7) + _planes(n[0].astype(_U), 4) + _planes(n[1].astype(_U), 4)


def _requested(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw) // 15
    gaps, every, target = _values(raw[: 7 * n], 7, n), _values(raw[7 * n : 11 * n], 4, n), _values(raw[11 * n :], 4, n)
    return np.cumsum(gaps, dtype=_U), every.astype(np.int64), target.astype(np.int64)


def _target(rows: int, good) -> np.ndarray:
    out = np.zeros(rows, dtype=bool)
    if good.is_valid:
        out[good.values.to_numpy(zero_copy_only=False)] = True
    return out


def _requests(chunks: DataFrame, many: int) -> DataFrame:
    """(range, chunk, body): the keys and counts of each chunk for every range of keys."""

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for chunk, body, good in each(batch, "chunk", "body", "good"):
                own = opened(body.as_py())[1]
                counts = Counts(own, _target(own.n, good))
                at = counts.ranges(many)
                bodies = [packer.compress(_request(counts.keys[a:b], counts.n[:, a:b])) for a, b in zip(at, at[1:])]
                arrays = [pa.array(np.arange(many)), pa.array(np.full(many, chunk.as_py())), pa.array(bodies, type=pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["range", "chunk", "body"])

    return chunks.mapInArrow(run, "range long, chunk long, body binary")


def _replies(requests: DataFrame) -> DataFrame:
    """(chunk, range, body, words): what all other chunks count for the keys of a request, and the distinct words of the range."""

    def run(batches):
        held: list[tuple[int, bytes]] = []
        now = None
        for batch in batches:
            for number, chunk, body in each(batch, "range", "chunk", "body"):
                if (number := number.as_py()) != now:
                    yield from done(now, held)
                    held, now = [], number
                held.append((chunk.as_py(), body.as_py()))
        yield from done(now, held)

    def done(number, held) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        opener, packer = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        parts = [_requested(opener.decompress(body)) for _, body in held]
        keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        sums = [np.bincount(place, np.concatenate([p[m] for p in parts]), len(keys)).astype(np.int64) for m in (1, 2)]
        at, out = 0, []
        distinct = int((keys & _U(1)).sum())
        for (chunk, _), part in zip(held, parts):
            mine = place[at : at + len(part[0])]
            at += len(mine)
            rest = [_planes((sums[m - 1][mine] - part[m]).astype(_U), 8) for m in (1, 2)]
            out.append((chunk, number, packer.compress(b"".join(rest)), distinct))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64())
        for lo in range(0, len(out), 512):
            columns = zip(*out[lo : lo + 512])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=["chunk", "range", "body", "words"])

    dealt = requests.repartition("range").sortWithinPartitions("range", "chunk")
    return dealt.mapInArrow(run, "chunk long, range long, body binary, words long")


def losses(counts: Counts, rest: np.ndarray, target: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Loss in bits of each word of a chunk under the background and the target model, its own text left out.

    ``rest``: what other chunks count for each key.  ``vocabulary``: distinct words of the corpus.
    """
    words = counts.words
    total = counts.n + rest
    word, pair = counts.own(counts.word), counts.own(counts.pair)
    first = np.ones(len(word), dtype=bool)
    first[1:] = words.doc[1:] != words.doc[:-1]
    context = np.where(first, counts.start, np.concatenate(([0], counts.word[:-1])))
    before = np.where(first, 1, np.concatenate(([0], word[:-1])))
    out = []
    for m in (0, 1):
        seen = np.ones(len(word), dtype=np.int64) if m == 0 else target[words.doc].astype(np.int64)
        a = total[m][context] - before * seen
        ab = total[m][counts.pair] - pair * seen
        b = total[m][counts.word] - word * seen
        n = total[m][counts.all] - words.count[words.doc] * seen
        p = (b + ADD) / (n + ADD * (vocabulary + 1))
        p = np.where(a > 0, WEIGHT * ab / np.maximum(a, 1) + (1 - WEIGHT) * p, p)
        out.append(-np.log2(p))
    return out[0], out[1]


def _chunks(docs: DataFrame, good: DataFrame, keep: list[str], text: str, row_id: str, chunk_bytes: int, broadcast_rows: int) -> DataFrame:
    """(chunk, size, body, good): all rows, and the places of those whose id is in ``good`` (_key)."""
    key = F.when(F.col(row_id).isNotNull(), F.xxhash64(F.col(row_id)))
    if good.count() <= broadcast_rows:
        name = K.unused(docs.columns, "good")
        known = good.select(F.col("_key").alias(name))
        packed = pack(docs.join(F.broadcast(known), key == F.col(name), "left"), keep, text, chunk_bytes=chunk_bytes, key=F.col(name))
        places = F.expr("filter(sequence(0, size(keys) - 1), i -> keys[i] is not null)")
        return materialise(packed.withColumn("good", places).drop("keys"))
    packed = materialise(pack(docs, keep, text, chunk_bytes=chunk_bytes, key=key))
    asked = packed.select("chunk", F.posexplode("keys").alias("_at", "_key")).where("_key is not null")
    listed = asked.join(good, "_key", "left_semi").groupBy(F.col("chunk").alias("_chunk")).agg(F.collect_list("_at").alias("good"))
    return materialise(packed.drop("keys").join(listed, F.col("chunk") == F.col("_chunk"), "left").drop("_chunk"))


def cross_entropy_difference(
    docs: DataFrame,
    labels: DataFrame,
    keep: list[str],
    *,
    text: str = "text",
    row_id: str = "doc_id",
    label_id: str = "doc_id",
    quality: str = "quality",
    broadcast_rows: int = BROADCAST_ROWS,
    chunk_bytes: int = CHUNK_BYTES,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """``keep`` columns, n_words, target_loss, background_loss (bits a word) and score.

    The target is what ``labels`` call good.  Words are compared with ASCII letters
    lower-cased.  A text without words (null, empty, blank) has 0 words and null losses.
    Rows with a null or repeated id are scored like any other, and a label counts for
    each row of its id; a null id has no label.  Each row is left out of the models that
    score it, but its copies are not.  Without good rows the target model is uniform
    over the vocabulary.  Columns of ``docs`` named like a result are replaced; a null
    text that is kept comes back empty.
    """
    keep = [c for c in keep if c not in ("n_words", "target_loss", "background_loss", "score")]
    inside = [c for c in keep if c != text]
    good = labels.where((F.col(quality) > 0) & F.col(label_id).isNotNull())
    good = good.select(F.xxhash64(F.col(label_id).cast(docs.schema[row_id].dataType)).alias("_key")).distinct()
    chunks = _chunks(docs, good, inside, text, row_id, chunk_bytes, broadcast_rows)
    size = chunks.agg(F.sum("size")).first()[0] or 0
    many = max(1, -(-size // range_bytes))
    # as many replies as there are ranges, and as many counts as the chunk has keys
    replies = _replies(_requests(chunks, many)).groupBy(F.col("chunk").alias("_chunk"))
    told = replies.agg(F.collect_list(F.struct("range", "body")).alias("told"), F.sum("words").alias("vocabulary"))
    joined = chunks.join(told, F.col("chunk") == F.col("_chunk"), "left")
    fields = [docs.schema[c] for c in keep]
    new = T._parse_datatype_string("n_words long, target_loss double, background_loss double, score double").fields
    out = T.StructType([*fields, *new])

    def run(batches):
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            for body, good, told, vocabulary in each(batch, "body", "good", "told", "vocabulary"):
                source, own = opened(body.as_py())
                target = _target(own.n, good)
                counts = Counts(own, target)
                rest = np.zeros((2, len(counts.keys)), dtype=np.int64)
                at = 0
                for one in sorted(told.as_py() or (), key=lambda x: x["range"]):
                    raw = opener.decompress(one["body"])
                    n = len(raw) // 16
                    for m in (0, 1):
                        rest[m, at : at + n] = _values(raw[8 * n * m : 8 * n * (m + 1)], 8, n).astype(np.int64)
                    at += n
                yield scored(source, own, counts, losses(counts, rest, target, vocabulary.as_py()))

    def scored(source, own, counts, loss) -> pa.RecordBatch:
        words = counts.words
        n, none = np.maximum(words.count, 1), words.count == 0
        background, target = (np.bincount(words.doc, x, own.n) / n for x in loss)
        columns = {c: source.column(i) for i, c in enumerate(inside)} | {text: source.column(source.num_columns - 1)}
        arrays = [columns[c] for c in keep] + [pa.array(words.count.astype(np.int64))]
        arrays += [pa.array(x, mask=none) for x in (target, background, target - background)]
        return pa.RecordBatch.from_arrays(arrays, names=out.names)

    return joined.mapInArrow(run, out)


def op1(spark, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` against the labelled good ones."""
    return cross_entropy_difference(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ["doc_id"])
