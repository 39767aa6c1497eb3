import hashlib
import random
import re

import pytest

from docloom.llm.decontaminate import decontaminate, op10


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, width=10):
    out = {}
    for key, text in docs:
        w, hit, own = words(text), set(), set()
        for item, said in items:
            v = words(said)
            size = min(len(v), width)
            windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if size else set()
            for i in range(len(w) - size + 1):
                if size and tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    own.add(str(item))
        out[key] = (len(w), len(hit), sorted(own))
    return out


def cases():
    rnd = random.Random(3)
    vocabulary = ["the", "of", "Ünd", "a1", "x", "DE", "lo", "été"]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(90, None), (91, ""), (92, "..."), (93, items[3][1]), (None, "only nullish words")]
    docs = [(None, "x"), (0, None), (1, ""), (2, "the"), (3, "only NULLISH-words here")]
    for i in range(60):
        text = rnd.choices(vocabulary, k=rnd.randrange(40))
        if rnd.random() < 0.6:
            at = rnd.randrange(len(text) + 1)
            text[at:at] = re.split(" ", rnd.choice(items[:12])[1])
        docs.append((10 + i, rnd.choice([" ", ", ", "\n"]).join(text)))
    docs += [(500, " ".join(rnd.choices(vocabulary, k=30_000))), (10, docs[5][1])]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_equals_brute_force(spark, block_bytes):
    docs, items = cases()
    frame = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, n_words string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(frame, bench, block_bytes=block_bytes).collect()
    assert len(got) == len(docs)
    want = [(k, *brute([(k, t)], [("null" if i is None else i, s) for i, s in items])[k]) for k, t in docs]
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert sum(s.end - s.start for s in r.hit_spans) == r.n_hit


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, bench).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate(some, bench).first().n_hit == 0


def test_query(spark, tmp_path):
    docs, items = cases()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items[:12], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted((k, *brute([(k, t)], items[:12])[k]) for k, t in docs if k is not None)
    got = sorted(tuple(r) for r in op10(spark, str(tmp_path)).collect() if r.doc_id is not None)
    assert [(k, n, h, len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), h > 0) for k, n, h, own in want] == got
