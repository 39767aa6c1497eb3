"""Quality rules: fixed rules, then an isolation forest on rule statistics.

The statistics of a text are counts over its whole length.  Ratios of them, which do
not depend on how long a text is, are the features of the forest.  Its trees are
grown on at most ``fit_rows`` rows labelled good (the smallest hashes of their ids):
random splits isolate an unusual document after few steps.  The threshold comes from
all labelled rows: scores are counted in ``bins`` bins for each label, and the limit
is the lowest one that rejects at most ``good_loss`` of the good rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import materialise, read

MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Fixed values of the contract's rule: ``[#*$%&|<>]``
SYMBOLS = b"#*$%&|<>"

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MORE = "n_chars_all long, n_lines long, n_upper long, n_digits long, n_punct long, n_distinct long, n_symbol_words long"
_NAMES = [x.split()[0] for x in f"{BASE}, {MORE}".split(", ")]


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_IS_SYMBOL = _table(SYMBOLS)
_UPPER = _table(bytes(range(65, 91)))
_DIGIT = _table(b"0123456789")
_PUNCT = _table(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
_LEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])


def _repeats(group: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where (group, hash) occurs more than once; hashes differ well between groups."""
    key = hashes ^ K.mix(group.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), dtype=bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _distinct(group: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each group."""
    key = hashes ^ K.mix(group.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(key, return_index=True)
    return np.bincount(group[first], minlength=n)


def statistics(own: K.Text) -> dict[str, np.ndarray]:
    words, data, n = K.Words(own), own.data, own.n
    hashes = words.hashes()
    at, window = words.windows(hashes, WINDOW)
    covered = K.run_mask(len(words), at[_repeats(words.doc[at], window)], WINDOW)
    total = np.concatenate(([0], np.cumsum(covered)))
    # lines: cut at \n and at the ends of the texts
    cut = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate((own.offsets[:-1], cut + 1)))
    owner = np.searchsorted(own.offsets, start, side="right") - 1
    # a \n that ends a text opens an empty last line, which starts where the next text does
    end = np.sort(np.concatenate((own.offsets[1:], cut)))
    filled = np.searchsorted(words.start, start) < np.searchsorted(words.start, end)
    start, end, owner = start[filled], end[filled], owner[filled]
    line = K.bytes_hash(data, start, end)
    n_lines = np.bincount(owner, minlength=n)
    has_symbol = np.concatenate(([0], np.cumsum(_IS_SYMBOL[data])))
    marked = has_symbol[words.end] > has_symbol[words.start]
    return {
        "n_words": words.count,
        "word_chars": own.sums(words.inside & _LEAD[data]),
        "n_symbols": own.sums(_IS_SYMBOL[data]),
        "n_dup_lines": n_lines - _distinct(owner, line, n),
        "n_repeat_words": total[words.first[1:]] - total[words.first[:-1]],
        "n_chars_all": own.sums(_LEAD[data]),
        "n_lines": n_lines,
        "n_upper": own.sums(_UPPER[data]),
        "n_digits": own.sums(_DIGIT[data]),
        "n_punct": own.sums(_PUNCT[data]),
        "n_distinct": _distinct(words.doc, hashes, n),
        "n_symbol_words": np.bincount(words.doc[marked], minlength=n),
    }


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > REPEAT_PERCENT * s["n_words"])


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios in which clean texts of any length look alike."""
    words = np.maximum(s["n_words"], 1)
    chars = np.maximum(s["word_chars"], 1)
    lines = np.maximum(s["n_lines"], 1)
    return np.column_stack(
        [
            np.sqrt(s["n_symbols"] / chars),
            s["n_symbol_words"] / words,
            np.sqrt(s["n_dup_lines"] / lines),
            np.sqrt(s["n_repeat_words"] / words),
            np.clip(s["word_chars"] / words, 0, 30),
            # a few digits or capitals in a short text say little: as if in 300 characters more
            np.sqrt(s["n_digits"] / (chars + 300)),
            np.sqrt(np.maximum(s["n_punct"] - s["n_symbols"], 0) / (chars + 300)),
            np.sqrt(s["n_upper"] / (chars + 300)),
        ]
    ).astype(np.float64)


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), split value, path length at a leaf, children."""

    feature: np.ndarray
    split: np.ndarray
    length: np.ndarray
    size: int
    limit: float = math.inf

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / expected path length): near 1 is anomalous."""
        if not len(self.feature):
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        depth = int(math.log2(self.feature.shape[1] + 1))
        lane = np.arange(len(rows))
        for feature, split, length in zip(self.feature, self.split, self.length, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(depth - 1):
                f = feature[node]
                right = rows[lane, np.maximum(f, 0)] >= split[node]
                node = np.where(f < 0, node, 2 * node + 1 + right)
            total += length[node]
        return np.exp2(-total / len(self.feature) / max(_expected(self.size), 1e-9))


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search in a random binary tree of n keys."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


def grow(rows: np.ndarray, trees: int, sample: int, seed: int) -> Forest:
    """An isolation forest; each split is uniform between the least and the largest value.

    A node's range is widened by a quarter on both sides, so that values which no
    fitted row has are cut off early too; with a constant feature, any other value is.
    """
    size = min(sample, len(rows))
    depth = max(1, math.ceil(math.log2(max(size, 2))))
    nodes = 2 ** (depth + 1) - 1
    feature, split = np.full((trees, nodes), -1), np.zeros((trees, nodes))
    length = np.zeros((trees, nodes))
    rnd = np.random.default_rng(seed)
    spread = rows.std(axis=0) + 1e-3 if len(rows) else None

    def build(t: int, node: int, at: np.ndarray, level: int) -> None:
        if level == depth or len(at) <= 1:
            length[t, node] = level + _expected(len(at))
            return
        f = int(rnd.integers(rows.shape[1]))
        low, high = rows[at, f].min(), rows[at, f].max()
        margin = max((high - low) / 4, spread[f])
        cut = rnd.uniform(low - margin, high + margin)
        feature[t, node], split[t, node] = f, cut
        right = rows[at, f] >= cut
        build(t, 2 * node + 1, at[~right], level + 1)
        build(t, 2 * node + 2, at[right], level + 1)

    for t in range(trees if len(rows) else 0):
        build(t, 0, rnd.choice(len(rows), size, replace=False), 0)
    if not len(rows):
        return Forest(feature[:0], split[:0], length[:0], 0)
    return Forest(feature, split, length, size)


def calibrate(
    stats: DataFrame,
    labels: DataFrame,
    *,
    row_id: str = "doc_id",
    label_id: str = "doc_id",
    quality: str = "quality",
    fit_rows: int = 4096,
    trees: int = 128,
    sample: int = 256,
    bins: int = 2000,
    good_loss: float = 0.0005,
    seed: int = 7,
) -> Forest:
    """A forest and its limit, from the statistics of labelled rows.

    Without a row labelled good nothing is called anomalous.  Labels with a null id or
    a null quality are ignored; if an id has several labels, the lowest holds.
    """
    said = labels.where(F.col(quality).isNotNull() & F.col(label_id).isNotNull())
    said = said.groupBy(F.col(label_id).alias("_id")).agg(F.min(quality).alias("_quality"))
    # rows that the base rules reject tell nothing about the forest's verdict
    some = stats.where(~F.col("base_failed")).select(F.col(row_id).alias("_id"), *_NAMES).join(said, "_id")
    order = [F.xxhash64("_id"), *_NAMES]
    fit = some.where("_quality > 0").orderBy(*order).limit(fit_rows).select(*_NAMES).toPandas()
    forest = grow(features({c: fit[c].to_numpy() for c in _NAMES}), trees, sample, seed)
    if not len(forest.feature):
        return forest
    scored = score(some, forest, ["_quality"])
    counts = scored.groupBy((F.col("_quality") > 0).alias("good"), F.floor(F.col("anomaly") * bins).alias("bin")).count()
    good, bad = np.zeros(bins + 2), np.zeros(bins + 2)
    for r in counts.collect():  # at most two rows a bin
        (good if r.good else bad)[r.bin] += r["count"]
    above = np.cumsum(good[::-1])[::-1]
    allowed = int(good_loss * good.sum())
    limit = int(np.argmax(above <= allowed))
    if bad[limit:].sum() <= above[limit]:
        return forest
    # far into the gap below the first rejected row: the same labelled rows go, and an
    # unusual but clean row has room
    limit += int(np.argmax((good + bad)[limit:] > 0)) * 3 // 4
    forest.limit = limit / bins
    return forest


def score(stats: DataFrame, forest: Forest, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``anomaly``, from rows that have the statistics."""
    from pyspark.sql import types as T

    shared = stats.sparkSession.sparkContext.broadcast(forest)
    fields = [stats.schema[c] for c in keep]

    def run(frames):
        for frame in frames:
            rows = features({c: frame[c].to_numpy() for c in _NAMES})
            yield frame[keep].assign(anomaly=shared.value.score(rows))

    return stats.mapInPandas(run, T.StructType([*fields, T.StructField("anomaly", T.DoubleType())]))


def rule_statistics(docs: DataFrame, keep: list[str], *, text: str = "text") -> DataFrame:
    """``keep`` columns, the statistics and ``base_failed``; a null text has no words."""

    def work(_, own: K.Text) -> dict:
        s = statistics(own)
        return s | {"base_failed": base_failed(s)}

    return K.map_texts(docs, text, keep, f"{BASE}, {MORE}, base_failed boolean", work)


def judge(docs: DataFrame, forest: Forest, keep: list[str], *, text: str = "text") -> DataFrame:
    """``keep`` columns, the base statistics, ``base_failed``, ``anomaly`` and ``kept``.

    One pass over the texts, without a shuffle.  Columns of ``docs`` named like a
    result are replaced.  Null and empty texts fail the base rules.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def work(_, own: K.Text) -> dict:
        s, f = statistics(own), shared.value
        failed, odd = base_failed(s), f.score(features(s))
        return s | {"base_failed": failed, "anomaly": odd, "kept": ~failed & ~(odd >= f.limit)}

    return K.map_texts(docs, text, keep, f"{BASE}, base_failed boolean, anomaly double, kept boolean", work)


def op2(spark, sf_dir: str) -> DataFrame:
    """Digest of the contract over all ``documents``."""
    docs = read(spark, sf_dir, "documents")
    stats = materialise(rule_statistics(docs, ["doc_id"]))
    forest = calibrate(stats, read(spark, sf_dir, "labels"))
    limit = forest.limit
    scored = score(stats, forest, ["doc_id", *_NAMES[:5], "base_failed"])
    return scored.withColumn("kept", ~F.col("base_failed") & ~(F.col("anomaly") >= F.lit(limit)))
