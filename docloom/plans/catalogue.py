"""Registered queries of the engine, and the SQL that gives the same rows.

Results are flat: lists become comma-joined text, fractions are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import Database, aggregate
from ..functions import Context, compile_expression
from ..operators.filters import compile_filter
from ..operators.projection import find_projection
from . import values as V
from .expression_queries import EXPRESSIONS, KEYS
from .filter_queries import FILTERS

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def flat(df: DataFrame) -> DataFrame:
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "null")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.NullType):
            c = c.cast("string")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def _sql_value(sql: str, kind: str) -> str:
    return {"list": f"array_to_string([coalesce(x::varchar, 'null') for x in {sql}], ',')", "double": f"round(({sql})::double, 6)"}.get(kind, sql)


_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__.strip("_")
        _QUERIES[key] = lambda spark, sf_dir: flat(f(spark, sf_dir))
        if sql:
            _SQL[key] = sql
        return f

    return add


def _expression(name: str) -> None:
    table, e, sql = EXPRESSIONS[name]

    def run(spark, sf_dir):
        df = read(spark, sf_dir, table)
        v = compile_expression(Context(df.schema), e)
        return df.select(*KEYS[table], v.col.alias("value"))

    doubles = "add subtract multiply divide abs ceil floor sqrt pow round trunc exp ln log10 log avg let toDouble"
    trig = "sin cos tan asin acos atan sinh cosh tanh asinh atanh acosh atan2 degreesToRadians radiansToDegrees similarityDotProduct similarityCosine similarityEuclidean"
    lists = "reverseArray slice slice_skip concatArrays sortArray firstN lastN maxN minN range map filter setUnion setIntersection setDifference objectToArray"
    kind = "list" if name in lists.split() else "double" if name in f"{doubles} {trig}".split() else ""
    query(f"select {', '.join(KEYS[table])}, {_sql_value(sql, kind)} as value from {table}", f"expr_{name}")(run)


def _filter(name: str) -> None:
    table, said, sql = FILTERS[name]

    def run(spark, sf_dir):
        df = read(spark, sf_dir, table)
        return df.where(compile_filter(Context(df.schema), said)).select(*KEYS[table])

    query(f"select {', '.join(KEYS[table])} from {table} where {sql}", f"filter_{name}")(run)


for _n in EXPRESSIONS:
    _expression(_n)
for _n in FILTERS:
    _filter(_n)


# --- stages ---------------------------------------------------------------------------


def _pipeline(name: str, table: str, stages: list, sql: str, *others: str) -> None:
    def run(spark, sf_dir):
        return aggregate(read(spark, sf_dir, table), stages, collections={t: read(spark, sf_dir, t) for t in others})

    query(sql, name)(run)


_FLAGSHIP = [
    {"$match": {"o_orderstatus": {"$in": ["F", "O"]}}},
    {"$lookup": {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "customer"}},
    {"$unwind": "$customer"},
    {"$lookup": {"from": "nation", "localField": "customer.c_nationkey", "foreignField": "n_nationkey", "as": "nation"}},
    {"$unwind": "$nation"},
    {"$group": {"_id": {"segment": "$customer.c_mktsegment", "nation": "$nation.n_name"}, "orders": {"$sum": 1}, "total": {"$sum": "$o_totalprice"}, "largest": {"$max": "$o_totalprice"}}},
    {"$project": {"_id": 0, "segment": "$_id.segment", "nation": "$_id.nation", "orders": 1, "total": {"$round": ["$total", 2]}, "largest": 1}},
    {"$sort": {"segment": 1, "nation": 1}},
]


def flagship(spark, sf_dir: str) -> DataFrame:
    return aggregate(read(spark, sf_dir, "orders"), _FLAGSHIP, collections={t: read(spark, sf_dir, t) for t in ("customer", "nation")})


query(
    "select c_mktsegment segment, n_name nation, count(*) orders, round(sum(o_totalprice), 2) total, max(o_totalprice) largest from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderstatus in ('F', 'O') group by 1, 2",
    "flagship",
)(flagship)

_pipeline("stage_match_twice", "orders", [{"$match": {"o_orderstatus": "F"}}, {"$match": {"o_totalprice": {"$gt": 100000}}}, {"$project": {"_id": 0, "o_orderkey": 1}}], "select o_orderkey from orders where o_orderstatus = 'F' and o_totalprice > 100000")
_pipeline("stage_match_after_group", "orders", [{"$group": {"_id": "$o_custkey", "n": {"$sum": 1}}}, {"$match": {"n": {"$gte": 10}}}], "select o_custkey _id, count(*) n from orders group by 1 having count(*) >= 10")
_pipeline("stage_sort_skip_limit", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$skip": 5}, {"$limit": 10}, {"$project": {"o_orderkey": 1, "o_totalprice": 1}}], "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 5")
_pipeline("stage_limit_skip", "orders", [{"$sort": {"o_orderkey": 1}}, {"$limit": 10}, {"$skip": 4}, {"$project": {"o_orderkey": 1}}], "select o_orderkey from (select o_orderkey from orders order by 1 limit 10) order by 1 offset 4")
_pipeline("stage_limit_zero", "orders", [{"$limit": 0}, {"$project": {"o_orderkey": 1}}], "select o_orderkey from orders limit 0")
_pipeline("stage_count", "orders", [{"$match": {"o_orderstatus": "F"}}, {"$count": "n"}], "select count(*) n from orders where o_orderstatus = 'F'")
_pipeline("stage_count_empty", "orders", [{"$match": {"o_orderstatus": "?"}}, {"$count": "n"}], "select count(*) n from orders where o_orderstatus = '?' having count(*) > 0")
_pipeline("stage_group_null", "orders", [{"$group": {"_id": None, "total": {"$sum": "$o_totalprice"}}}, {"$project": {"_id": 0, "total": {"$round": ["$total", 2]}}}], "select round(sum(o_totalprice), 2) total from orders")
_pipeline("stage_group_empty", "orders", [{"$match": {"o_orderkey": -1}}, {"$group": {"_id": None, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "n": 1}}], "select count(*) n from orders where o_orderkey = -1 having count(*) > 0")
_pipeline("stage_group_missing", "orders", [{"$group": {"_id": "$absent", "n": {"$sum": 1}}}, {"$project": {"_id": 0, "n": 1}}], "select count(*) n from orders")
_pipeline("stage_sort_by_count", "orders", [{"$sortByCount": "$o_orderpriority"}], "select o_orderpriority _id, count(*) count from orders group by 1")
_pipeline("stage_project_exclude", "nation", [{"$project": {"n_regionkey": 0}}], "select n_nationkey, n_name from nation")
_pipeline("stage_project_computed", "lineitem", [{"$project": {"_id": 0, "l_orderkey": 1, "revenue": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}}}], "select l_orderkey, round(l_extendedprice * (1 - l_discount), 6) revenue from lineitem")
_pipeline("stage_add_fields", "nation", [{"$addFields": {"n_name": {"$toLower": "$n_name"}, "old": "$n_name"}}], "select n_nationkey, lower(n_name) n_name, n_regionkey, n_name old from nation")
_pipeline("stage_add_fields_nested", "nation", [{"$set": {"a.b": "$n_nationkey", "a.c": 1}}, {"$project": {"x": {"$add": ["$a.b", "$a.c"]}}}], "select n_nationkey + 1 x from nation")
_pipeline("stage_unset", "nation", [{"$unset": ["n_name", "absent"]}], "select n_nationkey, n_regionkey from nation")

_NESTED = [{"$sort": {"l_linenumber": 1, "l_partkey": 1, "l_suppkey": 1, "l_quantity": 1, "l_shipdate": 1}}, {"$group": {"_id": "$l_orderkey", "lines": {"$push": {"part": "$l_partkey", "qty": "$l_quantity", "no": "$l_linenumber"}}}}]
_pipeline("stage_unwind", "lineitem", [*_NESTED, {"$unwind": {"path": "$lines", "includeArrayIndex": "i"}}, {"$project": {"i": 1, "part": "$lines.part", "qty": "$lines.qty", "_id": 1}}], "select l_orderkey _id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) - 1 i, l_partkey part, l_quantity qty from lineitem")
_pipeline("stage_unwind_preserve", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$unwind": {"path": "$o", "preserveNullAndEmptyArrays": True}}, {"$project": {"c_custkey": 1, "key": "$o.o_orderkey"}}], "select c_custkey, o_orderkey as key from customer left join orders on o_custkey = c_custkey", "orders")
_pipeline("stage_unwind_scalar", "nation", [{"$unwind": {"path": "$n_name", "includeArrayIndex": "i"}}], "select n_nationkey, n_name, n_regionkey, null::bigint i from nation")
_pipeline("nested_filter_path", "lineitem", [*_NESTED, {"$match": {"lines.qty": {"$gte": 49}}}, {"$project": {"_id": 1}}], "select l_orderkey _id from lineitem group by 1 having max(l_quantity) >= 49")
_pipeline("nested_elem_match", "lineitem", [*_NESTED, {"$match": {"lines": {"$elemMatch": {"qty": {"$gte": 40}, "no": 1}}}}, {"$project": {"_id": 1}}], "select distinct l_orderkey _id from lineitem where l_quantity >= 40 and l_linenumber = 1")
_pipeline("nested_size", "lineitem", [*_NESTED, {"$match": {"lines": {"$size": 3}}}, {"$project": {"_id": 1}}], "select l_orderkey _id from lineitem group by 1 having count(*) = 3")

# --- accumulators ---------------------------------------------------------------------

_BY = "$o_orderpriority"


def _accumulator(name: str, spec: dict, sql: str, *first: dict) -> None:
    _pipeline(f"acc_{name}", "orders", [*first, {"$group": {"_id": _BY, "v": spec}}], f"select o_orderpriority _id, {sql} v from orders group by 1")


_accumulator("sum", {"$sum": "$o_orderkey"}, "sum(o_orderkey)::bigint")
_accumulator("sum_strings", {"$sum": "$o_orderstatus"}, "0::bigint")
_accumulator("avg", {"$avg": "$o_totalprice"}, "round(avg(o_totalprice), 6)")
_accumulator("min", {"$min": "$o_totalprice"}, "min(o_totalprice)")
_accumulator("max", {"$max": "$o_orderdate"}, "max(o_orderdate)")
_accumulator("count", {"$count": {}}, "count(*)")
_accumulator("first", {"$first": "$o_orderkey"}, "arg_min(o_orderkey, (o_totalprice, o_orderkey))", {"$sort": {"o_totalprice": 1, "o_orderkey": 1}})
_accumulator("last", {"$last": "$o_orderkey"}, "arg_max(o_orderkey, (o_totalprice, o_orderkey))", {"$sort": {"o_totalprice": 1, "o_orderkey": 1}})
_accumulator("first_descending", {"$first": "$o_orderkey"}, "arg_max(o_orderkey, (o_orderstatus, o_totalprice, -o_orderkey))", {"$sort": {"o_orderstatus": -1, "o_totalprice": -1, "o_orderkey": 1}})
_accumulator("push", {"$push": "$o_orderkey"}, "string_agg(o_orderkey::varchar, ',' order by o_orderkey desc)", {"$sort": {"o_orderkey": -1}})
_accumulator("addToSet", {"$addToSet": "$o_orderstatus"}, "array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',')")
_accumulator("stdDevPop", {"$stdDevPop": "$o_totalprice"}, "round(stddev_pop(o_totalprice), 6)")
_accumulator("stdDevSamp", {"$stdDevSamp": "$o_totalprice"}, "round(stddev_samp(o_totalprice), 6)")
_accumulator("firstN", {"$firstN": {"input": "$o_orderkey", "n": 2}}, "array_to_string(list(o_orderkey order by o_orderkey)[1:2], ',')", {"$sort": {"o_orderkey": 1}})
_accumulator("lastN", {"$lastN": {"input": "$o_orderkey", "n": 2}}, "array_to_string(list_reverse(list(o_orderkey order by o_orderkey desc)[1:2]), ',')", {"$sort": {"o_orderkey": 1}})
_accumulator("maxN", {"$maxN": {"input": "$o_orderkey", "n": 3}}, "array_to_string(list(o_orderkey order by o_orderkey desc)[1:3], ',')")
_accumulator("minN", {"$minN": {"input": "$o_orderkey", "n": 3}}, "array_to_string(list(o_orderkey order by o_orderkey)[1:3], ',')")
_accumulator("top", {"$top": {"sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "output": "$o_orderkey"}}, "arg_max(o_orderkey, (o_totalprice, -o_orderkey))")
_accumulator("bottom", {"$bottom": {"sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "output": "$o_orderkey"}}, "arg_min(o_orderkey, (o_totalprice, -o_orderkey))")
_accumulator("topN", {"$topN": {"sortBy": {"o_orderkey": -1}, "output": "$o_orderkey", "n": 2}}, "array_to_string(list(o_orderkey order by o_orderkey desc)[1:2], ',')")
_accumulator("bottomN", {"$bottomN": {"sortBy": {"o_orderkey": -1}, "output": "$o_orderkey", "n": 2}}, "array_to_string(list_reverse(list(o_orderkey order by o_orderkey)[1:2]), ',')")
_pipeline("acc_mergeObjects", "orders", [{"$sort": {"o_orderkey": 1}}, {"$group": {"_id": _BY, "v": {"$mergeObjects": {"k": "$o_orderkey", "c": "$o_custkey"}}}}, {"$project": {"k": "$v.k", "c": "$v.c", "_id": 1}}], "select o_orderpriority _id, max(o_orderkey) k, arg_max(o_custkey, o_orderkey) c from orders group by 1")

# --- lookups --------------------------------------------------------------------------

_pipeline("lookup_equality", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$project": {"c_custkey": 1, "n": {"$size": "$o"}, "total": {"$round": [{"$sum": "$o.o_totalprice"}, 2]}, "t": {"$round": [{"$sum": {"$map": {"input": "$o", "in": "$$this.o_totalprice"}}}, 2]}}}, {"$unset": "total"}], "select c_custkey, count(o_orderkey)::int n, coalesce(round(sum(o_totalprice), 2), 0) t from customer left join orders on o_custkey = c_custkey group by 1", "orders")
_pipeline("lookup_anti", "supplier", [{"$lookup": {"from": "customer", "localField": "s_suppkey", "foreignField": "c_nationkey", "as": "c"}}, {"$match": {"c": {"$size": 0}}}, {"$project": {"s_suppkey": 1}}], "select s_suppkey from supplier where not exists (select 1 from customer where c_nationkey = s_suppkey)", "customer")
_pipeline("lookup_semi", "supplier", [{"$lookup": {"from": "customer", "localField": "s_suppkey", "foreignField": "c_nationkey", "as": "c"}}, {"$match": {"c": {"$ne": []}}}, {"$project": {"s_suppkey": 1}}], "select s_suppkey from supplier where exists (select 1 from customer where c_nationkey = s_suppkey)", "customer")
_pipeline("lookup_array_local", "region", [{"$addFields": {"keys": ["$r_regionkey", {"$add": ["$r_regionkey", 1]}]}}, {"$lookup": {"from": "nation", "localField": "keys", "foreignField": "n_regionkey", "as": "n"}}, {"$project": {"r_regionkey": 1, "n": {"$size": "$n"}}}], "select r_regionkey, (select count(*) from nation where n_regionkey in (r_regionkey, r_regionkey + 1))::int n from region", "nation")
_pipeline("lookup_correlated", "customer", [{"$lookup": {"from": "orders", "let": {"k": "$c_custkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$o_custkey", "$$k"]}}}, {"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 2}, {"$project": {"o_orderkey": 1}}], "as": "top"}}, {"$project": {"c_custkey": 1, "top": {"$map": {"input": "$top", "in": "$$this.o_orderkey"}}}}], "select c_custkey, coalesce((select string_agg(o_orderkey::varchar, ',' order by r) from (select o_orderkey, o_custkey k, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) r from orders) where k = c_custkey and r <= 2), '') top from customer", "orders")
_pipeline("lookup_theta", "supplier", [{"$lookup": {"from": "nation", "let": {"n": "$s_nationkey"}, "pipeline": [{"$match": {"$expr": {"$lt": ["$n_nationkey", "$$n"]}}}, {"$count": "n"}], "as": "before"}}, {"$project": {"s_suppkey": 1, "n": {"$sum": {"$map": {"input": "$before", "in": "$$this.n"}}}}}], "select s_suppkey, (select count(*) from nation where n_nationkey < s_nationkey) n from supplier", "nation")
_pipeline("lookup_as_of", "orders", [{"$lookup": {"from": "orders", "let": {"c": "$o_custkey", "k": "$o_orderkey"}, "pipeline": [{"$match": {"$expr": {"$and": [{"$eq": ["$o_custkey", "$$c"]}, {"$lt": ["$o_orderkey", "$$k"]}]}}}, {"$sort": {"o_orderkey": -1}}, {"$limit": 1}], "as": "p"}}, {"$project": {"o_orderkey": 1, "before": {"$getField": {"field": "o_orderkey", "input": {"$first": "$p"}}}}}], "select o_orderkey, (select max(p.o_orderkey) from orders p where p.o_custkey = o.o_custkey and p.o_orderkey < o.o_orderkey) as before from orders o", "orders")
_pipeline("lookup_group_inside", "region", [{"$lookup": {"from": "customer", "let": {"r": "$r_regionkey"}, "pipeline": [{"$match": {"$expr": {"$eq": [{"$mod": ["$c_nationkey", 5]}, "$$r"]}}}, {"$group": {"_id": "$c_mktsegment", "n": {"$sum": 1}, "keys": {"$push": "$c_custkey"}, "first": {"$min": "$c_custkey"}}}, {"$sort": {"_id": 1}}], "as": "s"}}, {"$unwind": "$s"}, {"$project": {"r_regionkey": 1, "segment": "$s._id", "n": "$s.n", "m": {"$size": "$s.keys"}, "first": "$s.first"}}], "select r_regionkey, c_mktsegment segment, count(*) n, count(*)::int m, min(c_custkey) as first from region join customer on c_nationkey % 5 = r_regionkey group by 1, 2", "customer")
_pipeline("lookup_uncorrelated", "region", [{"$lookup": {"from": "nation", "pipeline": [{"$match": {"n_regionkey": 1}}, {"$project": {"n_nationkey": 1}}], "as": "n"}}, {"$project": {"r_regionkey": 1, "n": {"$size": "$n"}}}], "select r_regionkey, (select count(*) from nation where n_regionkey = 1)::int n from region", "nation")


# --- projections of find --------------------------------------------------------------


def _find_projection(name: str, spec: dict, post: Callable, sql: str, where: dict | None = None) -> None:
    def run(spark, sf_dir):
        df = aggregate(read(spark, sf_dir, "lineitem"), _NESTED)
        c = Context(df.schema)
        if where:
            df = df.where(compile_filter(c, where))
        out = find_projection(df, c, spec, where)
        return out.select(F.col("_id"), post(out).alias("v"))

    query(sql, f"projection_{name}")(run)


_QTYS = "list(l_partkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate)"
_join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
_find_projection("nested_include", {"lines.part": 1}, lambda d: _join(F.col("lines.part")), f"select l_orderkey _id, array_to_string({_QTYS}, ',') v from lineitem group by 1")
_find_projection("nested_exclude", {"lines.qty": 0}, lambda d: F.lit(",".join(d.schema["lines"].dataType.elementType.names)), "select distinct l_orderkey _id, 'part,no' v from lineitem")
_find_projection("slice", {"lines": {"$slice": -2}}, lambda d: _join(F.col("lines.part")), "select l_orderkey _id, array_to_string(list_reverse(list(l_partkey order by l_linenumber desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_shipdate desc)[1:2]), ',') v from lineitem group by 1")
_find_projection("slice_skip", {"lines": {"$slice": [1, 2]}}, lambda d: _join(F.col("lines.part")), f"select l_orderkey _id, array_to_string({_QTYS}[2:3], ',') v from lineitem group by 1")
_find_projection("elem_match", {"lines": {"$elemMatch": {"qty": {"$gte": 45}}}}, lambda d: F.col("lines")[0]["part"], "select l_orderkey _id, (list(l_partkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) filter (l_quantity >= 45))[1] v from lineitem group by 1")
_find_projection("positional", {"lines.$": 1}, lambda d: F.col("lines")[0]["part"], "select l_orderkey _id, (list(l_partkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) filter (l_quantity >= 45))[1] v from lineitem group by 1 having max(l_quantity) >= 45", {"lines.qty": {"$gte": 45}})


# --- updates --------------------------------------------------------------------------


def _update(name: str, table: str, where: dict, change, sql: str, **more) -> None:
    def run(spark, sf_dir):
        from ..collection import _rewritten
        from ..operators.filters import matches
        from ..operators.updates import compile_update

        df = aggregate(read(spark, sf_dir, "lineitem"), _NESTED) if table == "nested" else read(spark, sf_dir, table)
        c = Context(df.schema)
        update = compile_update(c, change, where, more.get("array_filters"))
        out, _ = _rewritten(df, matches(c, where), update)
        if table == "nested":
            return out.select("_id", _join(F.col("lines.qty").cast("array<long>")).alias("v"), F.size("lines").alias("n"))
        return out

    query(sql, f"update_{name}")(run)


_C = "select c_custkey, {name} c_name, {nation} c_nationkey, {bal} c_acctbal, c_mktsegment from customer"
_cust = lambda **k: _C.format(**({"name": "c_name", "nation": "c_nationkey", "bal": "c_acctbal"} | k))
_W, _WS = {"c_custkey": {"$lt": 50}}, "c_custkey < 50"
_update("set", "customer", _W, {"$set": {"c_name": "new"}}, _cust(name=f"case when {_WS} then 'new' else c_name end"))
_update("unset", "customer", _W, {"$unset": {"c_name": ""}}, _cust(name=f"case when {_WS} then null else c_name end"))
_update("inc", "customer", _W, {"$inc": {"c_acctbal": 1.5}}, _cust(bal=f"round(case when {_WS} then c_acctbal + 1.5 else c_acctbal end, 6)"))
_update("mul", "customer", _W, {"$mul": {"c_acctbal": 2}}, _cust(bal=f"round(case when {_WS} then c_acctbal * 2 else c_acctbal end, 6)"))
_update("min", "customer", _W, {"$min": {"c_acctbal": 100}}, _cust(bal=f"case when {_WS} then least(c_acctbal, 100) else c_acctbal end"))
_update("max", "customer", _W, {"$max": {"c_acctbal": 100}}, _cust(bal=f"case when {_WS} then greatest(c_acctbal, 100) else c_acctbal end"))
_update("bit", "customer", _W, {"$bit": {"c_nationkey": {"and": 6, "or": 1}}}, _cust(nation=f"(case when {_WS} then (c_nationkey & 6) | 1 else c_nationkey end)::bigint"))
_update("rename", "customer", {}, {"$rename": {"c_name": "label"}}, "select c_custkey, null::varchar c_name, c_nationkey, c_acctbal, c_mktsegment, c_name label from customer")
_update("setOnInsert", "customer", _W, {"$setOnInsert": {"c_name": "x"}, "$set": {"c_name": "y"}}, _cust(name=f"case when {_WS} then 'y' else c_name end"))
_Q = "list(l_quantity::bigint order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate)"
_nested = lambda e, n="count(*)": f"select l_orderkey _id, array_to_string({e}, ',') v, ({n})::int n from lineitem group by 1"
_update("push", "nested", {}, {"$push": {"lines": {"$each": [{"part": 0, "qty": 1.0, "no": 9}], "$position": 0}}}, _nested(f"list_concat([1], {_Q})", "count(*) + 1"))
_update("push_slice", "nested", {}, {"$push": {"lines": {"$each": [{"part": 0, "qty": 1.0, "no": 9}], "$slice": -2}}}, _nested(f"list_concat({_Q}, [1])[-2:]", "least(count(*) + 1, 2)"))
_update("push_sort", "nested", {}, {"$push": {"lines": {"$each": [], "$sort": {"qty": 1, "no": 1}}}}, _nested("list(l_quantity::bigint order by l_quantity)"))
_update("addToSet", "nested", {}, {"$addToSet": {"lines": {"part": 0, "qty": 1.0, "no": 9}}}, _nested(f"list_concat({_Q}, [1])", "count(*) + 1"))
_update("pop", "nested", {}, {"$pop": {"lines": 1}}, _nested("list_reverse(list(l_quantity::bigint order by l_linenumber desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_shipdate desc)[2:])", "count(*) - 1"))
_update("pop_first", "nested", {}, {"$pop": {"lines": -1}}, _nested(f"{_Q}[2:]", "count(*) - 1"))
_update("pull", "nested", {}, {"$pull": {"lines": {"qty": {"$gt": 20}}}}, _nested("coalesce(list(l_quantity::bigint order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) filter (l_quantity <= 20), [])", "count(*) filter (l_quantity <= 20)"))
_update("positional", "nested", {"lines.qty": {"$gt": 20}}, {"$set": {"lines.$.qty": 0.0}}, _nested("list(case when l_quantity > 20 and f = k then 0 else l_quantity::bigint end order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate)").replace("from lineitem", "from (select *, min(case when l_quantity > 20 then k end) over (partition by l_orderkey) f from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) k from lineitem))"))
_update("positional_all", "nested", {}, {"$inc": {"lines.$[].qty": 1}}, _nested("list((l_quantity + 1)::bigint order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate)"))
_update("positional_filtered", "nested", {}, {"$set": {"lines.$[big].qty": 99.0}}, _nested("list(case when l_quantity >= 30 then 99 else l_quantity::bigint end order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate)"), array_filters=[{"big.qty": {"$gte": 30}}])


def _orders(spark, sf_dir, name: str = "orders"):
    """All orders as a collection of a new database."""
    return Database(spark).register(name, read(spark, sf_dir, "orders").withColumn("_id", F.col("o_orderkey")), order="o_orderkey")


def _written(name: str, sql: str, work: Callable) -> None:
    def run(spark, sf_dir):
        c = _orders(spark, sf_dir)
        work(c)
        return c.find({}).df()

    query(sql, f"write_{name}")(run)


def _ord(**k: str) -> str:
    own = {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_orderstatus": "o_orderstatus", "o_totalprice": "round(o_totalprice, 6)", "o_orderdate": "o_orderdate", "o_orderpriority": "o_orderpriority", "_id": "o_orderkey"}
    return "select " + ", ".join(f"{v} {n}" for n, v in (own | k).items()) + " from orders"


_FIRST = "(select min(o_orderkey) from orders where o_orderstatus = 'P')"
_NEW = {"_id": -1, "o_orderkey": -1, "o_custkey": 5, "o_orderstatus": "N"}
_NEW_SQL = "null::double, null::timestamp, null::varchar"
_written("delete_many", f"{_ord()} where o_orderstatus <> 'P'", lambda c: c.delete_many({"o_orderstatus": "P"}))
_written("delete_one", f"{_ord()} where o_orderkey <> {_FIRST}", lambda c: c.delete_one({"o_orderstatus": "P"}))
_written("update_one", _ord(o_orderstatus=f"case when o_orderkey = {_FIRST} then 'X' else o_orderstatus end"), lambda c: c.update_one({"o_orderstatus": "P"}, {"$set": {"o_orderstatus": "X"}}))
_written("update_many", _ord(o_totalprice="round(case when o_orderstatus = 'F' then o_totalprice + 1 else o_totalprice end, 6)"), lambda c: c.update_many({"o_orderstatus": "F"}, {"$inc": {"o_totalprice": 1}}))
_written("pipeline_update", _ord(o_orderpriority="lower(o_orderpriority)"), lambda c: c.update_many({}, [{"$set": {"o_orderpriority": {"$toLower": "$o_orderpriority"}}}]))
_written("insert", f"{_ord()} union all select -1, 5, 'N', {_NEW_SQL}, -1", lambda c: c.insert_one(dict(_NEW)))
_written("upsert", f"{_ord()} union all select -7, null::bigint, 'U', {_NEW_SQL}, -7", lambda c: c.update_one({"_id": -7, "o_orderkey": -7}, {"$set": {"o_orderstatus": "U"}}, upsert=True))
_written("replace", f"{_ord()} where o_orderkey <> {_FIRST} union all select {_FIRST}, 5, 'R', {_NEW_SQL}, {_FIRST}", lambda c: c.replace_one({"o_orderstatus": "P"}, {"o_orderkey": c.find_one({"o_orderstatus": "P"})["o_orderkey"], "o_custkey": 5, "o_orderstatus": "R"}))
_written("bulk", f"{_ord()} where o_orderstatus <> 'P' union all select -1, 5, 'N', {_NEW_SQL}, -1 union all select -2, 5, 'N', {_NEW_SQL}, -2", lambda c: c.bulk_write([{"insert_one": {"document": dict(_NEW)}}, {"insert_one": {"document": {**_NEW, "_id": -2, "o_orderkey": -2}}}, {"delete_many": {"filter": {"o_orderstatus": "P"}}}, {"update_many": {"filter": {"o_orderstatus": "P"}, "update": {"$set": {"o_custkey": 0}}}}]))
_written("insert_frame", f"{_ord()} union all {_ord(o_orderkey='-o_orderkey - 1', _id='-o_orderkey - 1')}", lambda c: c.insert_frame(c.source.drop("_id").withColumn("o_orderkey", -F.col("o_orderkey") - 1).withColumn("_id", F.col("o_orderkey"))))


def _rows(name: str, schema: str, sql: str, work: Callable) -> None:
    """A query whose few rows are what ``work`` returns for a collection of all orders."""
    query(sql, name)(lambda spark, sf_dir: spark.createDataFrame(work(_orders(spark, sf_dir)), schema))


def _failed(work: Callable) -> int:
    from ..errors import DocError

    try:
        work()
    except DocError as e:
        return e.code or 0
    return -1


def _one_and(method: str, *args, **more):
    def run(c):
        got = getattr(c, method)({"o_orderstatus": "F"}, *args, sort={"o_totalprice": -1}, **more)
        return [(got["o_orderkey"], got["o_custkey"], c.count_documents({}), c.count_documents({"o_custkey": -1}))]

    return run


_ONE = "o_orderkey long, o_custkey long, n long, changed long"
_BEST = "from (select * from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 1)"
_EVERY = "(select count(*) from orders)"
_rows("find_one_and_update", _ONE, f"select o_orderkey, -1 o_custkey, {_EVERY} n, 1 changed {_BEST}", _one_and("find_one_and_update", {"$set": {"o_custkey": -1}}, return_document="after"))
_rows("find_one_and_replace", _ONE, f"select o_orderkey, o_custkey, {_EVERY} n, 1 changed {_BEST}", _one_and("find_one_and_replace", {"o_custkey": -1}))
_rows("find_one_and_delete", _ONE, f"select o_orderkey, o_custkey, {_EVERY} - 1 n, 0 changed {_BEST}", _one_and("find_one_and_delete"))
_rows("find_one", "o_orderkey long", "select min(o_orderkey) o_orderkey from orders where o_custkey = 10", lambda c: [(d["o_orderkey"],) for d in [c.find_one({"o_custkey": 10})] if d] or [(None,)])
_rows("count_documents", "n long, every long, windowed long, cursor long", "select count(*) filter (o_orderstatus = 'F') n, count(*) every, 7 windowed, count(*) filter (o_custkey < 50) cursor from orders", lambda c: [(c.count_documents({"o_orderstatus": "F"}), c.estimated_document_count(), c.count_documents({}, skip=3, limit=7), c.find({"o_custkey": {"$lt": 50}}).count())])
_rows("update_counts", "matched long, modified long", "select count(*) matched, count(*) filter (o_custkey <> 10) modified from orders where o_orderstatus = 'P'", lambda c: [(r["matched_count"], r["modified_count"]) for r in [c.update_many({"o_orderstatus": "P"}, {"$set": {"o_custkey": 10}})]])
_rows("duplicate_key", "code int, n long", "select 11000 code, count(*) + 1 n from orders", lambda c: [(_failed(lambda: c.insert_many([dict(_NEW), {"_id": 1}, {"_id": -5}]) if c.find_one({"_id": 1}) else c.insert_many([dict(_NEW), dict(_NEW)])), c.count_documents({}))])


def _indexed(c):
    c.create_index({"o_orderkey": 1}, unique=True)
    c.create_index({"o_custkey": 1}, unique=True, partial_filter={"o_orderkey": {"$lt": 0}})
    codes = [_failed(lambda d=d: c.insert_one(d)) for d in ({"_id": -9, "o_orderkey": 1}, {"_id": -1, "o_orderkey": -1, "o_custkey": 3}, {"_id": -2, "o_orderkey": -2, "o_custkey": 3})]
    return [(*codes, c.count_documents({"o_orderkey": {"$lt": 0}}))]


_rows("unique_index", "plain int, partial_new int, partial_again int, n long", "select 11000 plain, -1 partial_new, 11000 partial_again, 1 n", _indexed)


def _nested_transactions(c):
    def outer(db):
        c.delete_many({"o_orderstatus": "P"})
        _failed(lambda: db.with_transaction(inner))

    def inner(db):
        from ..errors import DocError

        c.delete_many({})
        raise DocError("no")

    c.db.with_transaction(outer)
    return [(c.count_documents({}),)]


_rows("transaction_nested", "n long", "select count(*) n from orders where o_orderstatus <> 'P'", _nested_transactions)


@query("select (o_custkey % 10)::int k, count(*) n from orders group by 1", "collections_renamed")
def _renamed(spark, sf_dir):
    c = _orders(spark, sf_dir)
    c.db.rename_collection("orders", "sales")
    c.db.create_collection("gone")
    c.db.drop_collection("gone")
    (name,) = (x["name"] for x in c.db.list_collections())
    return c.db[name].aggregate([{"$group": {"_id": {"$mod": ["$o_custkey", 10]}, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "k": {"$toInt": "$_id"}, "n": 1}}])


@query("(select o_custkey k from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O') except select o_custkey from orders where o_orderstatus = 'P' union select -1", "sql_set_operations")
def _set_operations(spark, sf_dir):
    c = _orders(spark, sf_dir)
    t = c.db.table("orders")
    part = lambda s: f"select o_custkey k from {t} where o_orderstatus = '{s}'"
    return c.db.sql(f"(({part('F')}) intersect ({part('O')})) except ({part('P')}) union select -1")


# --- null and missing values, whole objects, arrays ---------------------------------------

_SOME = {"$addFields": {"v": {"$cond": [{"$eq": [{"$mod": ["$o_orderkey", 3]}, 0]}, None, "$o_custkey"]}}}
_KEY = {"$project": {"_id": 0, "o_orderkey": 1}}
for _name, _said, _where in (
    ("eq_null", {"v": None}, "o_orderkey % 3 = 0"),
    ("ne_missing", {"v": {"$ne": 10}}, "o_orderkey % 3 = 0 or o_custkey <> 10"),
    ("exists", {"v": {"$exists": True}}, "o_orderkey % 3 <> 0"),
    ("exists_not", {"v": {"$exists": False}}, "o_orderkey % 3 = 0"),
    ("in_null", {"v": {"$in": [None, 10]}}, "o_orderkey % 3 = 0 or o_custkey = 10"),
    ("nin_null", {"v": {"$nin": [None, 10]}}, "o_orderkey % 3 <> 0 and o_custkey <> 10"),
    ("not_null", {"v": {"$not": {"$lt": 500}}}, "o_orderkey % 3 = 0 or o_custkey >= 500"),
    ("type_code", {"o_orderstatus": {"$type": [2, "bool"]}, "v": {"$type": "number"}}, "o_orderkey % 3 <> 0"),
):
    _pipeline(f"filter_{_name}", "orders", [_SOME, {"$match": _said}, _KEY], f"select o_orderkey from orders where {_where}")
_pipeline("stage_sort_nulls_first", "orders", [_SOME, {"$sort": {"v": 1, "o_orderkey": 1}}, {"$limit": 7000}, _KEY], "select o_orderkey from orders order by case when o_orderkey % 3 <> 0 then o_custkey end nulls first, o_orderkey limit 7000")
_pipeline("stage_group_null_key", "orders", [_SOME, {"$group": {"_id": "$v", "n": {"$sum": 1}}}], "select case when o_orderkey % 3 <> 0 then o_custkey end _id, count(*) n from orders group by 1")
_OBJECT = [{"$group": {"_id": {"s": "$o_orderstatus", "p": "$o_orderpriority"}, "n": {"$sum": 1}}}, {"$match": {"_id": {"s": "F", "p": "2-HIGH"}}}, {"$project": {"_id": 0, "n": 1}}]
_pipeline("filter_whole_object", "orders", _OBJECT, "select count(*) n from orders where o_orderstatus = 'F' and o_orderpriority = '2-HIGH' having count(*) > 0")
_KEYS_OF = {"$group": {"_id": "$o_custkey", "keys": {"$push": "$o_orderkey"}}}
_BY_KEY = {"$sort": {"o_orderkey": 1}}
_pipeline("filter_whole_array", "orders", [_BY_KEY, {"$match": {"o_orderkey": {"$mod": [40, 1]}}}, _KEYS_OF, {"$match": {"keys": {"$ne": [1]}}}, {"$project": {"_id": 1}}], "select o_custkey _id from orders where o_orderkey % 40 = 1 group by 1 having list(o_orderkey order by o_orderkey) <> [1]")
_pipeline("filter_elemMatch_empty", "orders", [_BY_KEY, _KEYS_OF, {"$match": {"keys": {"$elemMatch": {}}}}, {"$count": "n"}], "select 0 n where false")
_pipeline("stage_sort_array", "orders", [_BY_KEY, {"$match": {"o_orderkey": {"$mod": [40, 1]}}}, _KEYS_OF, {"$sort": {"keys": 1, "_id": 1}}, {"$limit": 20}, {"$project": {"_id": 1}}], "select o_custkey _id from (select o_custkey, '[' || string_agg(o_orderkey, ',' order by o_orderkey) || ']' k from orders where o_orderkey % 40 = 1 group by 1) order by k, o_custkey limit 20")
_pipeline("stage_sort_array_descending", "orders", [_BY_KEY, {"$match": {"o_orderkey": {"$mod": [40, 1]}}}, _KEYS_OF, {"$sort": {"keys": -1, "_id": 1}}, {"$limit": 20}, {"$project": {"_id": 1}}], "select o_custkey _id from (select o_custkey, '[' || string_agg(o_orderkey, ',' order by o_orderkey) || ']' k from orders where o_orderkey % 40 = 1 group by 1) order by k desc, o_custkey limit 20")
_pipeline("lookup_unwind", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$unwind": "$o"}, {"$project": {"_id": 0, "c_custkey": 1, "key": "$o.o_orderkey", "price": "$o.o_totalprice"}}], "select c_custkey, o_orderkey as key, round(o_totalprice, 6) price from customer join orders on o_custkey = c_custkey", "orders")
_pipeline("lookup_null_keys", "orders", [_SOME, {"$lookup": {"from": "customer", "localField": "v", "foreignField": "c_custkey", "as": "c"}}, {"$match": {"c": {"$size": 0}}}, {"$group": {"_id": None, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "n": 1}}], "select count(*) n from orders where o_orderkey % 3 = 0 or o_custkey not in (select c_custkey from customer)", "customer")
_pipeline("lookup_nested", "region", [{"$lookup": {"from": "nation", "let": {"r": "$r_regionkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$n_regionkey", "$$r"]}}}, {"$lookup": {"from": "supplier", "localField": "n_nationkey", "foreignField": "s_nationkey", "as": "s"}}, {"$project": {"n": {"$size": "$s"}}}], "as": "x"}}, {"$project": {"r_regionkey": 1, "n": {"$sum": {"$map": {"input": "$x", "in": "$$this.n"}}}}}], "select r_regionkey, (select count(*) from supplier join nation on s_nationkey = n_nationkey where n_regionkey = r_regionkey) n from region", "nation", "supplier")


def _null(name: str, sql: str, work: Callable) -> None:
    """Orders whose v is null, 5 or missing, by the remainder of the key by 3."""

    def run(spark, sf_dir):
        c = _orders(spark, sf_dir)
        c.update_many({"o_orderkey": {"$mod": [3, 0]}}, {"$set": {"v": None}})
        c.update_many({"o_orderkey": {"$mod": [3, 1]}}, {"$set": {"v": 5}})
        return work(c)

    query(sql, name)(run)


_FIND_KEY = {"_id": 0, "o_orderkey": 1}
_null("filter_exists_null", "select o_orderkey from orders where o_orderkey % 3 < 2", lambda c: c.find({"v": {"$exists": True}}, _FIND_KEY).df())
_null("filter_exists_null_not", "select o_orderkey from orders where o_orderkey % 3 = 2", lambda c: c.find({"v": {"$exists": False}}, _FIND_KEY).df())
_null("filter_type_null", "select o_orderkey from orders where o_orderkey % 3 = 0", lambda c: c.find({"v": {"$type": "null"}}, _FIND_KEY).df())
_null("filter_eq_null_stored", "select o_orderkey from orders where o_orderkey % 3 <> 1", lambda c: c.find({"v": None}, _FIND_KEY).df())
_null("expr_type_null", "select case o_orderkey % 3 when 0 then 'null' when 1 then 'int' else 'missing' end _id, count(*) n from orders group by 1", lambda c: c.aggregate([{"$group": {"_id": {"$type": "$v"}, "n": {"$sum": 1}}}]))
_null("stage_project_null", "select o_orderkey from orders where o_orderkey % 3 < 2", lambda c: c.aggregate([{"$project": {"o_orderkey": 1, "v": 1}}, {"$match": {"v": {"$exists": True}}}, _KEY]))


def _unset_nulls(c):
    c.update_many({"v": {"$type": "null"}}, {"$unset": {"v": ""}})
    return c.find({"v": {"$exists": False}}, _FIND_KEY).df()


_null("update_unset_null", "select o_orderkey from orders where o_orderkey % 3 <> 1", _unset_nulls)


@query("select true in_range", "filter_sampleRate")
def _sample(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    n = df.where(compile_filter(Context(df.schema), {"$sampleRate": 0.5})).agg(F.count("*").alias("n"))
    every = df.agg(F.count("*").alias("every"))
    # within six standard deviations of a half
    return n.join(every).select((F.abs(F.col("n") - F.col("every") / 2) <= 3 * F.sqrt("every")).alias("in_range"))


@query("select o_custkey _id, array_to_string([x for x in list(o_orderkey order by o_orderkey) if x not in (1, 2, 3, 500, 1000)], ',') v from orders group by 1", "update_pullAll")
def _pull_all(spark, sf_dir):
    c = Database(spark).register("lists", aggregate(read(spark, sf_dir, "orders"), [_BY_KEY, _KEYS_OF]), order="_id")
    c.update_many({}, {"$pullAll": {"keys": [1, 2, 3, 500, 1000]}})
    return c.find({}).df().select("_id", _join(F.col("keys")).alias("v"))


@query("select o_orderkey, o_orderstatus = 'F' touched from orders", "update_currentDate")
def _current_date(spark, sf_dir):
    c = _orders(spark, sf_dir)
    c.update_many({"o_orderstatus": "F"}, {"$currentDate": {"at": True}})
    recent = F.coalesce(F.abs(F.unix_timestamp(F.col("at").cast("timestamp")) - F.unix_timestamp(F.current_timestamp())) < 90_000, F.lit(False))
    return c.find({}).df().select("o_orderkey", recent.alias("touched"))


@query("select n_nationkey, n_name, n_regionkey, n_nationkey::bigint _id from nation", "transaction_rollback")
def _rollback(spark, sf_dir):
    db = Database(spark)
    c = db.register("nation", read(spark, sf_dir, "nation").withColumn("_id", F.col("n_nationkey").cast("long")), order="n_nationkey")
    session = db.start_session()
    session.start_transaction()
    c.delete_many({})
    session.abort_transaction()
    return c.find({}).df()


@query("select distinct o_orderpriority v from orders where o_orderstatus = 'F'")
def _distinct(spark, sf_dir):
    c = Database(spark).register("orders", read(spark, sf_dir, "orders"), order="o_orderkey")
    return spark.createDataFrame([(v,) for v in c.distinct("o_orderpriority", {"o_orderstatus": "F"})], "v string")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'O' order by o_totalprice desc, o_orderkey limit 5 offset 2", "find_cursor")
def _cursor(spark, sf_dir):
    c = Database(spark).register("orders", read(spark, sf_dir, "orders"), order="o_orderkey")
    return c.find({"o_orderstatus": "O"}, {"_id": 0, "o_orderkey": 1, "o_totalprice": 1}).sort({"o_totalprice": -1}).skip(2).limit(5).df()


@query("select o_custkey, o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) r from orders where o_totalprice > 1000", "sql_passthrough_window")
def _sql(spark, sf_dir):
    db = Database(spark)
    db.register("orders", read(spark, sf_dir, "orders"), order="o_orderkey")
    return db.sql(f"select o_custkey, o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) r from {db.table('orders')} where o_totalprice > :least", least=1000)


@query("select doc_id from documents where len([x for x in regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') if x = 'the']) > 0 and len([x for x in regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') if starts_with(x, 'thin')]) > 0", "search_boolean")
def _search(spark, sf_dir):
    c = Database(spark).register("documents", read(spark, sf_dir, "documents"), order="doc_id")
    c.create_search_index("text", ["text"])
    return c.search_text("the AND thin*").select("doc_id")


@query(
    """with t as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from documents),
f as (select doc_id, len(w) n, len([x for x in w if x = 'with']) a, len([x for x in w if x = 'from']) b from t),
s as (select count(*) n, avg(n) l, count(*) filter (a > 0) da, count(*) filter (b > 0) db from f)
select doc_id, round(ln((s.n - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * f.n / s.l)) + ln((s.n - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * f.n / s.l)), 6) score
from f, s where a > 0 or b > 0""",
    "search_ranked",
)
def _ranked(spark, sf_dir):
    c = Database(spark).register("documents", read(spark, sf_dir, "documents"), order="doc_id")
    c.create_search_index("text", ["text"])
    return c.search_text("with OR from").select("doc_id", "score")


@query("select vec_id, round(list_inner_product(embedding::double[], (select embedding from embeddings where vec_id = 0)::double[]), 6) score from embeddings order by list_inner_product(embedding::double[], (select embedding from embeddings where vec_id = 0)::double[]) desc, vec_id limit 10", "vector_top_k")
def _top_k(spark, sf_dir):
    df = read(spark, sf_dir, "embeddings")
    vector = [float(x) for x in df.where("vec_id = 0").first().embedding]
    return aggregate(df, [{"$addFields": {"score": {"$similarityDotProduct": ["$embedding", vector]}}}, {"$sort": {"score": -1, "vec_id": 1}}, {"$limit": 10}, {"$project": {"vec_id": 1, "score": 1}}])


@query("select event_id _id, 'insert' kind from events union all select event_id, 'delete' from events where event_type = 'click'", "change_stream")
def _changes(spark, sf_dir):
    db = Database(spark)
    c = db["events"]
    stream = c.watch([{"$match": {"operationType": {"$in": ["insert", "delete"]}}}])
    c.insert_frame(read(spark, sf_dir, "events").select(F.col("event_id").alias("_id"), "event_type"))
    c.delete_many({"event_type": "click"})
    return stream.read().select(F.get_json_object("documentKey", "$._id").cast("long").alias("_id"), F.col("operationType").alias("kind"))


@query("select time_bucket(interval 1 hour, ts) bucket, event_type, count(*) n from events group by 1, 2", "stream_windowed_counts")
def _windowed(spark, sf_dir):
    from ..streaming.windows import hourly_counts

    return hourly_counts(spark, sf_dir)


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["V", "flagship", "oracle_sql", "queries"]
