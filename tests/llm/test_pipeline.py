import random
import zlib

import numpy as np

import corpus_pipeline as C
from tests.llm.test_packing import plain  # noqa: F401
from tests.llm.test_pii import brute as spans
from tests.llm.test_quality import brute as statistics
from tests.llm.test_simhash import brute_components, brute_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, n_hit string, fp string, _in0 int"


def documents():
    rnd = random.Random(11)
    vocabulary = [a + b + c for a in "bdgklm" for b in "aeiou" for c in ["n", "r", "st", "", "lo"]]

    def prose(n):
        """Sentences, some with a number or an address, as clean documents have them."""
        own = rnd.choices(vocabulary, k=n)
        for _ in range(rnd.randrange(6)):
            own[rnd.randrange(n)] = rnd.choice(["1984", "(12)", "3.50", "web-site", "Kilo", "A.B", "555-12"])
        for i in range(0, n, rnd.randrange(8, 25)):
            own[i] = own[i].capitalize()
            own[i - 1] += "."
        return " ".join(own)

    items = [(i, prose(20)) for i in range(4)]
    docs = {i: prose(rnd.randrange(30, 300)) for i in range(160)}
    for i in range(160, 190):
        docs[i] = " ".join(w + "###" for w in prose(80).split())
    docs |= {200: docs[3], 201: docs[3].upper(), 202: docs[5], 203: "too short", 204: None, 205: ""}
    docs |= {210: prose(30) + " " + items[1][1] + " " + prose(30), 211: items[2][1] + " " + prose(20)}
    docs |= {220: prose(40) + " mail a.b@example.com or +1 (222) 333-4444", 221: prose(40) + " jane [at] example [dot] org"}
    docs[222] = prose(6000)
    labels = [(i, int(i < 160), 0) for i in range(0, 190, 2)]
    return docs, items, labels


def test_stages(spark, tmp_path, plain):  # noqa: F811
    docs, items, labels = documents()
    rows = [(k, t, "en", "src0", len(t or ""), 1, "n", "f", 3) for k, t in docs.items()]
    rows += [(9, " ".join(reversed(docs[12].split())), "en", "x", 0, 1, "n", "f", 3)]  # another text under a known id
    rows += [rows[7], (None, "One two three four five six seven eight nine ten dozen words without an id.", "en", "s", 9, 1, "n", "f", 3), (None, docs[9], "en", "s", 9, 1, "n", "f", 3)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, results = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (name, stage) in enumerate(C.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out{i}")
        before, now = now, spark.read.parquet(f"{tmp_path}/out{i}")
        if i < len(C.STAGES) - 1:
            assert now.dtypes == before.dtypes, name
        results.append(now.collect())
    # quality: no base failure stays, all clean documents do, junk goes
    kept = {r.doc_id for r in results[0]}
    failed = {k for k, t in docs.items() if statistics(t)[-1]}
    assert failed >= {203, 204, 205} and not kept & failed
    assert {k for k in docs if k < 160 or k >= 200} - failed <= kept
    assert len(kept & set(range(160, 190))) <= 3
    # near-duplicates: the least id of each brute-force component
    ids = sorted(k for k in kept if k is not None)
    parts = brute_components([(k, brute_fingerprint(docs[k])) for k in ids])
    named = [r.doc_id for r in results[1] if r.doc_id is not None]
    want = brute_components([(k, brute_fingerprint(docs[k])) for k in ids] + [(9, brute_fingerprint(rows[-4][1]))])
    assert sorted(named) == sorted([*(k for k, c in zip(ids, parts) if k == c), *([9] if want[-1] == 9 else [])])
    assert len({(r.doc_id, r.text) for r in results[1]}) == len(results[1])
    assert sum(r.doc_id is None for r in results[1]) == 1
    # decontamination
    assert {r.doc_id for r in results[1]} - {r.doc_id for r in results[2]} == {210, 211}
    # personal data
    texts = {r.doc_id: r for r in results[3]}
    assert set(texts) == {r.doc_id for r in results[2]}
    assert texts[220].text.endswith(" mail [EMAIL] or [PHONE]") and texts[221].text.endswith(" [EMAIL]")
    for r in results[3]:
        assert r.n_chars == len(r.text) and not spans(r.text)
        if r.doc_id in docs and r.doc_id not in (9, 220, 221):
            assert r.text == docs[r.doc_id]
    # packing
    tokens = {k: len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for k, r in texts.items()}
    size = {}
    for r in results[4]:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    assert {k: n for k, n in size.items() if k != 9} == {k: n for k, n in tokens.items() if k != 9}
    said = {r.doc_id: [] for r in results[4]}
    for r in sorted((r for r in results[4] if r.doc_id != 9), key=lambda r: r.piece):
        said[r.doc_id] += r.ids
    assert all(said[k] == [*plain.encode(r.text, add_special_tokens=False).ids, 0] for k, r in texts.items() if k != 9)
    whole = sorted(map(tuple, C.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=str)
    assert whole == sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in results[4]), key=str)


def test_empty_tables(spark, tmp_path):
    for name, ddl in [("documents", SCHEMA), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")]:
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
