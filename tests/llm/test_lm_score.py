import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from docloom.llm import kernels as K
from docloom.llm import lm_score as L


def corpus(rnd):
    good = ["alpha", "beta", "gamma", "delta"]
    bad = ["spam", "buy", "now", "win"]
    both = ["the", "of", "Zé"]
    docs = []
    for i in range(120):
        own = good if i % 3 else bad
        docs.append((i, " ".join(rnd.choices(own + both, k=rnd.randrange(5, 60)))))
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 120, 2)]
    return docs, labels


def brute(docs, labels):
    """Plain dictionaries: the same models, counted anew without each document."""
    good = {k for k, q, _ in labels if q and k is not None}
    lists = [(k, [w.lower() for w in re.findall(r"[^ \t-\r]+", t or "")]) for k, t in docs]
    vocabulary = len({w for _, own in lists for w in own})
    every = []
    for m in (0, 1):
        uni, bi = Counter(), Counter()
        for k, own in lists:
            if m == 0 or k in good:
                uni.update([None, *own] if own else [])
                bi.update(zip([None, *own], own))
        every.append((uni, bi))
    out = []
    for k, own in lists:
        means = []
        for m, (uni, bi) in enumerate(every):
            mine = m == 0 or k in good
            less = Counter([None, *own]) if mine else Counter()
            less_pairs = Counter(zip([None, *own], own)) if mine else Counter()
            n = sum(uni.values()) - uni[None] - (len(own) if mine else 0)
            total = 0
            for a, b in zip([None, *own], own):
                p = (uni[b] - less[b] + L.ADD) / (n + L.ADD * (vocabulary + 1))
                if (first := uni[a] - less[a]) > 0:
                    p = L.WEIGHT * (bi[a, b] - less_pairs[a, b]) / first + (1 - L.WEIGHT) * p
                total -= math.log2(p)
            means.append(total / len(own) if own else None)
        out.append((k, len(own), means[1], means[0]))
    return out


def rounded(rows):
    return sorted((str(k), n, *(None if x is None else round(x, 6) for x in more)) for k, n, *more in rows)


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0}, {"chunk_bytes": 300, "range_bytes": 500}, {"chunk_bytes": 1, "broadcast_rows": 0}])
def test_equals_dictionaries(spark, options):
    docs, labels = corpus(random.Random(1))
    docs += [(500, None), (501, ""), (502, "Unseen words Unseen alpha"), (503, "the " * 5_000), (2, "one id, another text"), (None, "no id")]
    docs += [(504, "a pair of copies"), (505, "a pair of copies")]
    frame = spark.createDataFrame([(k, t, "x", "y") for k, t in docs], "doc_id long, text string, score string, _label string").repartition(3)
    said = spark.createDataFrame([*labels, (None, 1, 0), (2, 0, 0)], "doc_id int, quality int, toxic int")
    got = L.cross_entropy_difference(frame, said, ["doc_id", "_label"], **options).collect()
    assert rounded((r.doc_id, r.n_words, r.target_loss, r.background_loss) for r in got) == rounded(brute(docs, labels))
    assert all(r.score is None if r.n_words == 0 else r.score == pytest.approx(r.target_loss - r.background_loss) for r in got)
    assert {r._label for r in got} == {"y"}


def test_held_out_documents_are_told_apart(spark, tmp_path):
    docs, labels = corpus(random.Random(2))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.score for r in L.op1(spark, str(tmp_path)).collect()}
    held = [i for i in range(120) if i % 2]
    good, bad = [got[i] for i in held if i % 3], [got[i] for i in held if i % 3 == 0]
    assert max(good) < min(bad)


def test_probabilities_sum_to_one():
    """After a word, the chances of all words of the vocabulary and of an unknown one are one in all, but for ends of texts."""
    rnd = random.Random(3)
    said = [rnd.choices("abcd", k=50) for _ in range(8)]
    raw = [" ".join(w).encode() for w in said]
    text = K.Text(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    counts = L.Counts(text, np.ones(8, dtype=bool))
    background, target = L.losses(counts, np.zeros((2, len(counts.keys))), np.ones(8, dtype=bool), 4)
    assert (background == target).all()
    own = [w for x in said for w in x]
    for d in range(8):
        rest = [x for i, x in enumerate(said) if i != d]
        unseen = L.ADD / (350 + L.ADD * 5)
        for a in "abcd":
            ends = sum(x[-1] == a for x in rest) / sum(x.count(a) for x in rest)
            chances = {own[i]: 2 ** -background[i] for i in range(50 * d + 1, 50 * d + 50) if own[i - 1] == a}
            if len(chances) == 4:
                assert sum(chances.values()) + (1 - L.WEIGHT) * unseen + L.WEIGHT * ends == pytest.approx(1)


def test_keys_and_counts_survive_packing():
    rnd = np.random.default_rng(1)
    keys = np.unique(rnd.integers(0, 1 << 56, 1000).astype(np.uint64))
    n = rnd.integers(0, 1 << 31, (2, len(keys)))
    got = L._requested(L._request(keys, n))
    assert (got[0] == keys).all() and (got[1] == n[0]).all() and (got[2] == n[1]).all()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert L.cross_entropy_difference(docs, labels, ["doc_id"]).count() == 0
    some = spark.createDataFrame([(1, "a b a b")], "doc_id long, text string")
    assert L.cross_entropy_difference(some, labels, ["doc_id"]).first().n_words == 4
