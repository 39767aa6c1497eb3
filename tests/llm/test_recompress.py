import random
import re
from collections import Counter

import numpy as np
import pytest

from docloom.llm import kernels as K
from docloom.llm import recompress as R


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(texts, window):
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def texts(rnd, window):
    few, many = ["a", "b"], ["w%d" % i for i in range(400)] + ["É", "the", "the", "the"]
    passage = rnd.choices(many, k=3 * window)
    out = [None, "", " \n", "a", "a " * (window - 1), "a " * window, "a " * (window + 1), "b a " * window, "x\ty\x0b" * 3]
    for _ in range(60):
        own = rnd.choices(rnd.choice([few, many, many, many]), k=rnd.randrange(6 * window))
        for _ in range(rnd.randrange(3)):
            at, size = rnd.randrange(len(own) + 1), rnd.choice([window - 1, window, window + 1, 2 * window])
            start = rnd.randrange(len(passage) - size)
            own[at:at] = passage[start : start + size]
        out.append(rnd.choice([" ", "  ", "\n"]).join(own))
    out += [out[12], out[12].replace(" ", "\n"), out[20], " ".join(rnd.choices(many, k=60_000))]
    return out


@pytest.mark.parametrize("window,seed", [(35, 1), (35, 2), (8, 3), (12, 4)])
def test_equals_brute_force(spark, window, seed):
    rnd = random.Random(seed)
    own = texts(rnd, window)
    rows = [(i if i % 9 else None, t, i, "clash") for i, t in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, i int, kept string").repartition(3)
    got = {r.i: r for r in R.mark_repeats(docs, ["doc_id", "i", "text"], window=window, chunk_bytes=seed * 3000).collect()}
    assert len(got) == len(own)
    for i, want in enumerate(brute(own, window)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == want, i
        assert got[i].text == (own[i] or "")


@pytest.mark.parametrize("vocabulary", [2, 3, 50])
def test_every_window_keeps_its_inner_symbols(vocabulary):
    """A symbol whose context lies in a window occurs wherever the window does."""
    rnd = random.Random(vocabulary)
    for _ in range(60):
        core = rnd.choices(range(vocabulary), k=40)
        lines = []
        for _ in range(2):
            lines.append(" ".join(map(str, rnd.choices(range(vocabulary), k=rnd.randrange(30)) + core + rnd.choices(range(vocabulary), k=rnd.randrange(30)))))
        found = []
        for line in lines:
            data = np.frombuffer(line.encode(), dtype=np.uint8)
            w = K.Words(K.Text(data, np.array([0, len(data)])))
            s = R.recompress(w.hashes(), w.doc)
            text = line.split()
            at = next(i for i in range(len(text)) if text[i : i + 40] == list(map(str, core)))
            inner = np.flatnonzero((s.low >= at) & (s.high <= at + 40))
            found.append({(int(s.name[j]), int(s.start[j]) - at) for j in inner})
            everything = {(int(s.name[j]), int(s.start[j]) - at) for j in range(len(s))}
            found[-1] = (found[-1], everything)
        assert found[0][0] <= found[1][1] and found[1][0] <= found[0][1]


def test_repeats_across_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        own = texts(random.Random(8), 8)[:40]
        docs = spark.createDataFrame(list(enumerate(own)), "i int, text string").repartition(2)
        got = {r.i: r for r in R.mark_repeats(docs, ["i"], window=8).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(got[i].n_words, got[i].n_removed, got[i].kept) for i in range(40)] == brute(own, 8)


def thue_morse(n, zero="a", one="b"):
    return [one if bin(i).count("1") % 2 else zero for i in range(n)]


def test_words_that_agree_modulo_powers_of_two(spark):
    """Long words and rows of words whose polynomial hashes agree whatever the base is."""
    word, complement = "".join(thue_morse(1024)), "".join(thue_morse(1024, "b", "a"))
    same = ["w%d" % i for i in range(34)]
    rows, other = thue_morse(2048, "x", "y"), thue_morse(2048, "y", "x")
    own = [" ".join([*same, word]), " ".join([*same, complement]), " ".join(rows), " ".join(other), " ".join([*rows, "z", *other])]
    docs = spark.createDataFrame(list(enumerate(own)), "i int, text string").repartition(2)
    got = {r.i: r for r in R.mark_repeats(docs, ["i"]).collect()}
    assert [(got[i].n_words, got[i].n_removed, got[i].kept) for i in range(5)] == brute(own, 35)
    assert got[0].n_removed == got[1].n_removed == 0


def test_columns_with_clashing_names(spark):
    names = ["_text", "_whole", "_at", "_shared", "_blob", "_row", "_k1", "chunk", "body", "n", "once", "t", "c0", "at"]
    own = ["a b c d e f g h", "x y", "a b c d e f g h i", None]
    docs = spark.createDataFrame([(t, *[f"{c}{i}" for c in names]) for i, t in enumerate(own)], ["text", *names])
    got = R.mark_repeats(docs, names, window=5).collect()
    assert sorted((r._row, r.once, r.n_removed) for r in got) == [("_row0", "once0", 8), ("_row1", "once1", 0), ("_row2", "once2", 8), ("_row3", "once3", 0)]


def test_hashes_of_windows_and_bytes():
    rnd = np.random.default_rng(3)
    hashes = rnd.integers(0, 1 << 63, 500).astype(np.uint64)
    for k in (1, 2, 3, 4, 5, 10, 35, 64):
        every = K.window_hash(hashes, k, 1)
        some = np.array([0, 7, len(every) - 1])
        assert (K.window_hash_at(hashes, some, k, 1) == every[some]).all()
        assert len(np.unique(every)) == len(every) == 501 - k
        assert (K.window_hash(hashes[9 : 9 + k], k, 1) == every[9]).all()
    data = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz" * 9, dtype=np.uint8)
    spans = [(a, a + n) for n in (0, 1, 7, 8, 9, 16, 63, 64, 65, 150) for a in (0, 26, 52)]
    start, end = (np.array(x) for x in zip(*spans))
    got = K.bytes_hash(data, start, end).reshape(-1, 3)
    assert (got == got[:, :1]).all() and len(np.unique(got)) == 10


def test_query_and_empty(spark, tmp_path):
    own = texts(random.Random(5), 35)
    spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in R.op6(spark, str(tmp_path)).collect()}
    assert got == {i: (n, k, R.digest(left.split())) for i, (n, k, left) in enumerate(brute(own, 35))}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert R.mark_repeats(empty, ["doc_id"]).count() == 0
