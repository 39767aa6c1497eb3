import zlib

import pytest
from pyspark.sql import functions as F

from docloom.llm import sharding as S
from docloom.llm.slots import numbered


def test_growth_moves_rows_only_into_the_new_shard(spark):
    rows = spark.range(4000).withColumnRenamed("id", "doc_id")
    got = S.shard(S.shard(rows, {i: 1.0 for i in range(5)}), {i: 1.0 for i in range(6)}, name="grown").toPandas()
    moved = got[got["shard"] != got["grown"]]
    assert set(moved["grown"]) == {5}
    assert 4000 / 6 * 0.8 < len(moved) < 4000 / 6 * 1.2
    assert got.groupby("shard").size().between(650, 950).all()


def test_weights(spark):
    got = S.shard(spark.range(6000).withColumnRenamed("id", "doc_id"), {0: 1.0, 1: 3.0}).groupBy("shard").count()
    share = {r["shard"]: r["count"] / 6000 for r in got.collect()}
    assert abs(share[1] - 0.75) < 0.03
    with pytest.raises(ValueError):
        S.assign(F.col("doc_id"), {0: 0.0})


def test_query(spark, tmp_path):
    docs = [(i, "t%d" % (i % 7) * (i % 50)) for i in range(500)]
    docs += [(None, None), (None, "é"), (3, docs[3][1]), (3, docs[3][1]), (4, "other"), (9000, "ü" * 200_000)]
    frame = spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "doc_id long, text string, shard int, slot int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = S.op5(spark, str(tmp_path)).toPandas()
    assert len(got) == len(docs)
    want = sorted((str(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in docs)
    ids = ["None" if k != k else str(int(k)) for k in got.doc_id]
    assert sorted(zip(ids, got["size"], got.text_crc32)) == want
    for _, group in got.groupby("shard"):
        assert sorted(group.slot) == list(range(len(group)))
    assert ((got.grown_shard == got.shard) | (got.grown_shard == 16)).all()
    assert set(got.shard) == set(range(16))
    assert got.groupby("doc_id").shard.nunique().max() == 1


def test_numbering_of_empty_null_and_hot_groups(spark):
    rows = spark.createDataFrame([(None, 1)] * 30 + [("a", i) for i in range(20)], "g string, x int")
    got = numbered(rows, ["g"], ["x"], "n", buckets=4).toPandas()
    assert sorted(got[got.g.isna()].n) == list(range(30))
    assert sorted(got[got.g == "a"].n) == list(range(20))
    assert numbered(rows.limit(0), ["g"], ["x"], "n").count() == 0
