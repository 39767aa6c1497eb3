"""Plans that the engine promises: what reaches the scan, what is sorted, and which joins there are."""

import pytest

from docloom import Client, Database, aggregate
from docloom.errors import DuplicateKey


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans"))
    rows = [(i, i % 7, "ab"[i % 2]) for i in range(50)]
    spark.createDataFrame(rows, "k long, c long, s string").coalesce(1).write.parquet(f"{path}/left")
    spark.createDataFrame([(i, f"n{i}") for i in range(5)], "id long, name string").write.parquet(f"{path}/right")
    return spark.read.parquet(f"{path}/left"), spark.read.parquet(f"{path}/right")


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_find_pushes_filters_and_sorts_nothing(spark, tables):
    c = Database(spark).register("left", tables[0])
    said = plan(c.find({"s": "a"}, {"_id": 0, "k": 1}).df())
    assert "EqualTo(s,a)" in said and "Exchange" not in said and "Sort" not in said
    assert "ReadSchema: struct<k:bigint,s:string>" in said
    assert [d["k"] for d in c.find({"s": "a"}).limit(3)] == [0, 2, 4]


def test_sort_before_a_group_is_not_run(spark, tables):
    stages = [{"$sort": {"k": -1}}, {"$group": {"_id": "$c", "ks": {"$push": "$k"}}}]
    df = aggregate(tables[0], stages)
    assert "rangepartitioning" not in plan(df)
    assert {r._id: r.ks for r in df.collect()}[1] == [43, 36, 29, 22, 15, 8, 1]
    first = aggregate(tables[0], [{"$sort": {"k": -1}}, {"$limit": 3}, {"$group": {"_id": None, "ks": {"$push": "$k"}}}])
    assert first.first().ks == [49, 48, 47]


def lookup(tables, *more):
    stages = [{"$lookup": {"from": "right", "localField": "c", "foreignField": "id", "as": "r"}}, *more]
    return aggregate(tables[0], stages, collections={"right": tables[1]})


def test_lookups_become_joins(spark, tables):
    inner = lookup(tables, {"$unwind": "$r"}, {"$project": {"k": 1, "name": "$r.name"}})
    assert "collect_list" not in plan(inner) and "Inner" in plan(inner)
    assert inner.count() == sum(i % 7 < 5 for i in range(50))
    kept = lookup(tables, {"$unwind": {"path": "$r", "preserveNullAndEmptyArrays": True}})
    assert kept.count() == 50 and kept.where("r is null").count() == sum(i % 7 >= 5 for i in range(50))
    anti = lookup(tables, {"$match": {"r": {"$size": 0}}})
    assert "LeftAnti" in plan(anti) and {r.c for r in anti.collect()} == {5, 6} and anti.first().r == []
    semi = lookup(tables, {"$match": {"r": {"$ne": []}}}, {"$project": {"k": 1}})
    assert "LeftSemi" in plan(semi) and semi.count() == inner.count()
    needed = lookup(tables, {"$match": {"r": {"$ne": []}}}, {"$project": {"r": 1}})
    assert "LeftSemi" not in plan(needed) and all(len(r.r) == 1 for r in needed.collect())


def test_lookup_pipelines_join_on_equalities(spark, tables):
    inner = [{"$match": {"$expr": {"$and": [{"$eq": ["$c", "$$c"]}, {"$lt": ["$k", "$$k"]}]}}}, {"$sort": {"k": -1}}, {"$skip": 1}, {"$limit": 2}, {"$project": {"_id": 0, "k": 1}}]
    stages = [{"$lookup": {"from": "left", "let": {"c": "$c", "k": "$k"}, "pipeline": inner, "as": "p"}}]
    df = aggregate(tables[0], stages, collections={"left": tables[0]})
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
    for r in df.collect():
        assert [x.k for x in r.p] == [k for k in (r.k - 14, r.k - 21) if k >= 0]


def test_bounded_accumulators_rank_first(spark, tables):
    df = aggregate(tables[0], [{"$group": {"_id": "$c", "top": {"$topN": {"sortBy": {"k": -1}, "output": "$k", "n": 2}}}}])
    assert "WindowGroupLimit" in plan(df)
    assert {r._id: r.top for r in df.collect()}[1] == [43, 36]
    both = aggregate(tables[0], [{"$group": {"_id": "$s", "n": {"$sum": 1}, "most": {"$maxN": {"input": "$k", "n": 2}}}}])
    assert {r._id: (r.n, r.most) for r in both.collect()} == {"a": (25, [48, 46]), "b": (25, [49, 47])}


def test_appends_are_read_again(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    for i in range(4):
        db["c"].insert_many([{"_id": 2 * i, "v": i}, {"_id": 2 * i + 1, "v": i}])
    db["c"].delete_one({"_id": 3})
    db["c"].insert_frame(spark.createDataFrame([(100, 7), (101, 8)], "_id long, v long"))
    again = Database(spark, str(tmp_path / "db"))["c"]
    want = [0, 1, 2, 4, 5, 6, 7, 100, 101]
    assert [d["_id"] for d in again.find({})] == want == [d["_id"] for d in db["c"].find({})]
    with pytest.raises(DuplicateKey):
        db["c"].insert_frame(spark.createDataFrame([(100, 7)], "_id long, v long"))
    db.drop_collection("c")
    assert list(Database(spark, str(tmp_path / "db")).list_collections()) == []


def test_a_client_watches_all_databases(spark):
    client = Client(spark)
    client["one"]["x"]
    stream = client.watch()
    client["one"]["x"].insert_one({"_id": 1})
    client["two"]["y"].insert_frame(spark.createDataFrame([(5, "a"), (6, "b")], "_id long, v string"))
    client["two"]["y"].delete_many({"v": "a"})
    got = [(e["ns"]["db"], e["operationType"], e["documentKey"]["_id"]) for e in stream]
    assert got == [("one", "insert", 1), ("two", "insert", 5), ("two", "insert", 6), ("two", "delete", 5)]
