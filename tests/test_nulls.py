"""Fields that hold a null are told from missing ones."""

import pytest

from docloom import CompileError, Database


@pytest.fixture
def db(spark):
    db = Database(spark)
    db["a"].insert_many([{"_id": 1, "v": 1, "o": {"x": None, "y": 2}}, {"_id": 2, "v": None, "w": 5}, {"_id": 3, "o": {"y": 3}}, {"_id": 4, "v": 4, "t": [1, None], "o": None}])
    return db


def ids(c, query):
    return [d["_id"] for d in c.find(query)]


def test_documents_come_back_as_they_were(db):
    want = [{"_id": 1, "v": 1, "o": {"x": None, "y": 2}}, {"_id": 2, "v": None, "w": 5}, {"_id": 3, "o": {"y": 3}}, {"_id": 4, "v": 4, "t": [1, None], "o": None}]
    assert db["a"].find().to_list() == want
    assert db["a"].find_one({"_id": 2}) == want[1]
    assert db["a"].find().df().columns == ["_id", "v", "o", "w", "t"]
    assert "_nulls" not in db["a"].aggregate([{"$match": {"v": 1}}]).columns


@pytest.mark.parametrize(
    "said,want",
    [
        ({"v": {"$exists": True}}, [1, 2, 4]),
        ({"v": {"$exists": False}}, [3]),
        ({"v": {"$not": {"$exists": True}}}, [3]),
        ({"o.x": {"$exists": True}}, [1]),
        ({"o": {"$exists": True}}, [1, 3, 4]),
        ({"o.x": {"$exists": False}}, [2, 3, 4]),
        ({"v": None}, [2, 3]),
        ({"v": {"$ne": None}}, [1, 4]),
        ({"v": {"$type": "null"}}, [2]),
        ({"v": {"$type": 10}}, [2]),
        ({"v": {"$type": ["null", "number"]}}, [1, 2, 4]),
        ({"t": {"$type": "null"}}, [4]),
        ({"o.x": {"$type": "null"}}, [1]),
        ({"$expr": {"$eq": [{"$type": "$v"}, "null"]}}, [2]),
        ({"$expr": {"$eq": [{"$type": "$v"}, "missing"]}}, [3]),
    ],
)
def test_filters(db, said, want):
    assert ids(db["a"], said) == want


def test_projections_keep_the_nulls_of_the_fields_they_keep(db):
    c = db["a"]
    assert c.find({"_id": 2}, {"v": 1}).to_list() == [{"_id": 2, "v": None}]
    assert c.find({"_id": 2}, {"w": 1}).to_list() == [{"_id": 2, "w": 5}]
    assert c.find({"_id": 2}, {"w": 0}).to_list() == [{"_id": 2, "v": None}]
    assert c.find({"_id": 1}, {"o.x": 1}).to_list() == [{"_id": 1, "o": {"x": None}}]
    assert c.find({"_id": 1}, {"o.x": 0}).to_list() == [{"_id": 1, "v": 1, "o": {"y": 2}}]
    assert c.find({"_id": 2}, {"v": "$w"}).to_list() == [{"_id": 2, "v": 5}]
    kept = c.aggregate([{"$project": {"v": 1}}, {"$match": {"v": {"$exists": True}}}])
    assert sorted(r["_id"] for r in kept.collect()) == [1, 2, 4]
    made = c.aggregate([{"$addFields": {"v": "$w"}}, {"$match": {"v": {"$exists": True}}}])
    assert [r["_id"] for r in made.collect()] == [2]
    spread = c.aggregate([{"$unwind": {"path": "$t", "preserveNullAndEmptyArrays": True}}, {"$match": {"v": {"$type": "null"}}}])
    assert [r["_id"] for r in spread.collect()] == [2]


def test_joins_and_groups_of_collections_with_nulls(db):
    found = db["a"].aggregate([{"$lookup": {"from": "a", "localField": "w", "foreignField": "w", "as": "f"}}, {"$match": {"v": {"$type": "null"}}}])
    assert [(r["_id"], len(r["f"])) for r in found.collect()] == [(2, 1)]
    grouped = db["a"].aggregate([{"$group": {"_id": "$v", "n": {"$sum": 1}}}])
    assert sorted(((r["_id"], r["n"]) for r in grouped.collect()), key=str) == [(1, 1), (4, 1), (None, 2)]


def test_distinct(db):
    assert db["a"].distinct("v") == [None, 1, 4]
    assert db["a"].distinct("w") == [5]
    assert db["a"].distinct("t") == [None, 1]


def test_writes(db):
    c = db["a"]
    assert c.update_one({"_id": 3}, {"$set": {"v": None}})["modified_count"] == 1
    assert c.update_one({"_id": 3}, {"$set": {"v": None}})["modified_count"] == 0
    assert c.find_one({"_id": 3}) == {"_id": 3, "v": None, "o": {"y": 3}}
    assert c.update_many({"v": {"$type": "null"}}, {"$unset": {"v": ""}})["modified_count"] == 2
    assert ids(c, {"v": {"$exists": False}}) == [2, 3]
    c.update_one({"_id": 3}, {"$set": {"new": None}})
    assert c.find_one({"_id": 3}) == {"_id": 3, "o": {"y": 3}, "new": None}
    c.update_one({"_id": 4}, {"$set": {"o.y": 7}})
    assert c.find_one({"_id": 4}) == {"_id": 4, "v": 4, "t": [1, None], "o": {"y": 7}}
    c.update_one({"_id": 4}, {"$unset": {"o": ""}})
    assert c.find_one({"_id": 4}) == {"_id": 4, "v": 4, "t": [1, None]}
    c.update_one({"_id": 1}, [{"$set": {"v": None}}])
    assert c.find_one({"_id": 1}) == {"_id": 1, "v": None, "o": {"x": None, "y": 2}}
    c.update_one({"_id": 1}, [{"$unset": "v"}])
    assert c.find_one({"_id": 1}) == {"_id": 1, "o": {"x": None, "y": 2}}
    c.replace_one({"_id": 1}, {"w": None})
    assert c.find_one({"_id": 1}) == {"_id": 1, "w": None}
    c.update_one({"_id": 9}, {"$set": {"v": None}}, upsert=True)
    assert c.find_one({"_id": 9}) == {"_id": 9, "v": None}


def test_nulls_begin_in_a_collection_without(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    db["b"].insert_many([{"_id": 1, "v": 1}])
    db["b"].insert_one({"_id": 2, "v": None})
    db["b"].insert_one({"_id": 3})
    assert ids(Database(spark, str(tmp_path))["b"], {"v": {"$exists": True}}) == [1, 2]
    assert db["b"].update_many({}, {"$set": {"v": None}})["modified_count"] == 2
    assert db["b"].find().to_list() == [{"_id": 1, "v": None}, {"_id": 2, "v": None}, {"_id": 3, "v": None}]


def test_a_kind_is_free_until_there_is_a_value(db):
    c = db["free"]
    c.insert_many([{"_id": 1, "v": None, "o": {"x": None}, "t": []}])
    c.insert_one({"_id": 2, "v": None, "o": {"x": None}, "t": []})
    c.insert_one({"_id": 3, "v": 5, "o": {"x": 1.5}, "t": [1]})
    c.insert_one({"_id": 4, "v": None, "o": {"x": None}, "t": []})
    empty = {"v": None, "o": {"x": None}, "t": []}
    assert c.find().to_list() == [{"_id": 1, **empty}, {"_id": 2, **empty}, {"_id": 3, "v": 5, "o": {"x": 1.5}, "t": [1]}, {"_id": 4, **empty}]
    with pytest.raises(CompileError):
        c.insert_one({"_id": 5, "v": "s"})
