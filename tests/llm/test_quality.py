import random
import re
from collections import Counter

import numpy as np

from docloom.llm import quality as Q

_TM = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
_SWAP = str.maketrans("ab", "ba")
CASES = [
    None, "", " \n\t", "one", "a b c d e f g h i j", "a b a b a b a b a b a b", "x#y $ | <b> %&*\n\nx#y $ | <b> %&*\n",
    "L one\nL one\nL one \n\nü É 1\n", "\n\n\n", "a\x0bb\x0cc\rd", "word " * 50_000, "ünïcode wörds 漢字 🚀 " * 9, "\nq", "q\n", "q\nq",
    # a long word and its complement, as words and as lines: their polynomial hashes agree
    "%s %s" % (_TM, _TM.translate(_SWAP)), "%s\n%s\n" % (_TM, _TM.translate(_SWAP)), " ".join(_TM + _TM.translate(_SWAP)),
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def test_statistics_equal_brute_force(spark):
    rnd = random.Random(1)
    rows = list(enumerate(CASES))
    rows += [(100 + i, " ".join(rnd.choices(["a", "b", "é", "c\n", "#"], k=rnd.randrange(60)))) for i in range(200)]
    rows += [(None, "null id")]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, kept int").repartition(3)
    got = Q.rule_statistics(docs, ["doc_id"]).collect()
    want = {k: brute(t) for k, t in rows}
    assert len(got) == len(rows)
    for r in got:
        own = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert own == want[r.doc_id], r.doc_id


def corpus():
    rnd = random.Random(5)
    clean = [" ".join(rnd.choices(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"], k=rnd.randrange(40, 400))) for _ in range(400)]
    junk = [" ".join(w + "###" for w in rnd.choices(["alpha", "beta", "gamma", "delta", "zeta", "eta"], k=rnd.randrange(40, 400))) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(clean + junk)]
    labels = [(i, int(i < 400), 0) for i, _ in docs if i % 2]
    return docs, labels


def test_forest_rejects_junk_and_keeps_clean(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame([*docs, (None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Q.op2(spark, str(tmp_path)).toPandas()
    assert len(got) == len(docs) + 1
    held = got[(got.doc_id % 2 == 0) & ~got.base_failed]  # rows without a label
    assert held[held.doc_id < 400].kept.mean() == 1
    assert held[held.doc_id >= 400].kept.mean() < 0.1
    assert not got[got.base_failed].kept.any()
    again = Q.op2(spark, str(tmp_path)).toPandas()
    assert sorted(map(str, got.itertuples(index=False))) == sorted(map(str, again.itertuples(index=False)))


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    forest = Q.calibrate(Q.rule_statistics(docs, ["doc_id"]), none)
    assert Q.judge(docs, forest, ["doc_id"]).first().kept
    assert Q.judge(docs.limit(0), forest, ["doc_id"]).count() == 0


def test_constant_rows_make_other_values_anomalous():
    rows = np.zeros((300, 3))
    forest = Q.grow(rows, 64, 128, 1)
    odd = np.array([[0, 0, 0], [0.5, 0, 0]])
    near, far = forest.score(odd)
    assert far > near
