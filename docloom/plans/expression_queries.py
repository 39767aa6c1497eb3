"""One query per expression operator: (table, key columns, expression, the same in SQL)."""

from __future__ import annotations

O, L, C, E, P, D = "orders", "lineitem", "customer", "events", "part", "documents"
KEYS = {
    O: ["o_orderkey"], L: ["l_orderkey", "l_linenumber", "l_partkey"], C: ["c_custkey"], E: ["event_id"], P: ["p_partkey"], D: ["doc_id"], "embeddings": ["vec_id"],
}

_ARR = ["$o_orderkey", "$o_custkey", 5, 5]
_ARR_SQL = "[o_orderkey, o_custkey, 5, 5]"
_MOD = {"$mod": ["$o_orderkey", 7]}
#: a value that every seventh row has not
_SOME = {"$cond": [{"$eq": [_MOD, 0]}, None, "$o_custkey"]}

EXPRESSIONS: dict[str, tuple] = {
    "literal": (O, {"$literal": "$o_orderkey"}, "'$o_orderkey'"),
    # arithmetic
    "add": (L, {"$add": ["$l_quantity", "$l_tax", 1]}, "l_quantity + l_tax + 1"),
    "add_date": (O, {"$dateToString": {"date": {"$add": ["$o_orderdate", 86400000]}, "format": "%Y-%m-%d"}}, "strftime(o_orderdate + interval 1 day, '%Y-%m-%d')"),
    "subtract": (L, {"$subtract": ["$l_quantity", "$l_discount"]}, "l_quantity - l_discount"),
    "subtract_dates": (O, {"$subtract": ["$o_orderdate", {"$toDate": "1995-01-01"}]}, "epoch_ms(o_orderdate) - epoch_ms(timestamp '1995-01-01')"),
    "multiply": (L, {"$multiply": ["$l_quantity", "$l_tax"]}, "l_quantity * l_tax"),
    "divide": (L, {"$divide": ["$l_extendedprice", "$l_quantity"]}, "l_extendedprice / l_quantity"),
    "mod": (O, _MOD, "o_orderkey % 7"),
    "abs": (C, {"$abs": "$c_acctbal"}, "abs(c_acctbal)"),
    "ceil": (C, {"$ceil": "$c_acctbal"}, "ceil(c_acctbal)"),
    "floor": (C, {"$floor": "$c_acctbal"}, "floor(c_acctbal)"),
    "sqrt": (L, {"$sqrt": "$l_quantity"}, "sqrt(l_quantity)"),
    "pow": (L, {"$pow": ["$l_quantity", 2]}, "pow(l_quantity, 2)"),
    "round": (C, {"$round": ["$c_acctbal", 0]}, "round_even(c_acctbal, 0)"),
    "trunc": (C, {"$trunc": "$c_acctbal"}, "trunc(c_acctbal)"),
    "exp": (L, {"$exp": "$l_discount"}, "exp(l_discount)"),
    "ln": (L, {"$ln": "$l_quantity"}, "ln(l_quantity)"),
    "log10": (L, {"$log10": "$l_quantity"}, "log10(l_quantity)"),
    "log": (L, {"$log": ["$l_quantity", 2]}, "ln(l_quantity) / ln(2)"),
    # trigonometry
    **{n: (L, {f"${n}": "$l_discount"}, f"{n}(l_discount)") for n in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "atanh")},
    "acosh": (L, {"$acosh": {"$add": ["$l_discount", 1]}}, "acosh(l_discount + 1)"),
    "atan2": (L, {"$atan2": ["$l_discount", "$l_quantity"]}, "atan2(l_discount, l_quantity)"),
    "degreesToRadians": (L, {"$degreesToRadians": "$l_quantity"}, "radians(l_quantity)"),
    "radiansToDegrees": (L, {"$radiansToDegrees": "$l_discount"}, "degrees(l_discount)"),
    # comparison, boolean, conditional
    "cmp": (O, {"$cmp": ["$o_orderkey", "$o_custkey"]}, "sign(o_orderkey - o_custkey)::int"),
    **{n: (O, {f"${n}": ["$o_orderkey", "$o_custkey"]}, f"o_orderkey {s} o_custkey") for n, s in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<="))},
    "lt_missing": (O, {"$lt": [_SOME, 100]}, "o_orderkey % 7 = 0 or o_custkey < 100"),
    "eq_missing_null": (O, {"$eq": [_SOME, None]}, "o_orderkey % 7 = 0"),
    "and": (O, {"$and": [{"$gt": ["$o_totalprice", 100000]}, {"$eq": ["$o_orderstatus", "F"]}]}, "o_totalprice > 100000 and o_orderstatus = 'F'"),
    "or": (O, {"$or": [{"$gt": ["$o_totalprice", 100000]}, {"$eq": ["$o_orderstatus", "F"]}]}, "o_totalprice > 100000 or o_orderstatus = 'F'"),
    "not": (O, {"$not": [{"$eq": ["$o_orderstatus", "F"]}]}, "o_orderstatus <> 'F'"),
    "cond": (O, {"$cond": {"if": {"$gt": ["$o_totalprice", 100000]}, "then": "big", "else": "$o_orderstatus"}}, "case when o_totalprice > 100000 then 'big' else o_orderstatus end"),
    "ifNull": (O, {"$ifNull": ["$absent", "$o_orderkey"]}, "o_orderkey"),
    "switch": (
        O,
        {"$switch": {"branches": [{"case": {"$eq": ["$o_orderstatus", "F"]}, "then": 1}, {"case": {"$eq": ["$o_orderstatus", "O"]}, "then": 2}], "default": 3}},
        "case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end",
    ),
    "let": (L, {"$let": {"vars": {"p": "$l_extendedprice", "d": "$l_discount"}, "in": {"$multiply": ["$$p", {"$subtract": [1, "$$d"]}]}}}, "l_extendedprice * (1 - l_discount)"),
    # strings
    "concat": (C, {"$concat": ["$c_name", "/", "$c_mktsegment"]}, "c_name || '/' || c_mktsegment"),
    "toLower": (C, {"$toLower": "$c_name"}, "lower(c_name)"),
    "toUpper": (C, {"$toUpper": "$c_name"}, "upper(c_name)"),
    "strLenCP": (D, {"$strLenCP": "$text"}, "length(text)"),
    "strLenBytes": (D, {"$strLenBytes": "$text"}, "strlen(text)"),
    "binarySize": (C, {"$binarySize": "$c_name"}, "strlen(c_name)"),
    "substrCP": (D, {"$substrCP": ["$text", 2, 10]}, "substring(text, 3, 10)"),
    "substr": (C, {"$substr": ["$c_name", 1, 4]}, "substring(c_name, 2, 4)"),
    "substrBytes": (C, {"$substrBytes": ["$c_name", 3, -1]}, "substring(c_name, 4)"),
    "indexOfCP": (D, {"$indexOfCP": ["$text", "the"]}, "instr(text, 'the') - 1"),
    "indexOfBytes": (D, {"$indexOfBytes": ["$text", "en"]}, "case when instr(text, 'en') = 0 then -1 else strlen(substring(text, 1, instr(text, 'en') - 1)) end"),
    "split": (P, {"$size": {"$split": ["$p_name", " "]}}, "len(string_split(p_name, ' '))"),
    "trim": (C, {"$trim": {"input": {"$concat": [" ", "$c_name", "\t"]}}}, "c_name"),
    "ltrim": (C, {"$ltrim": {"input": "$c_name", "chars": "C"}}, "ltrim(c_name, 'C')"),
    "rtrim": (C, {"$rtrim": {"input": "$c_name", "chars": "0123456789"}}, "rtrim(c_name, '0123456789')"),
    "strcasecmp": (C, {"$strcasecmp": ["$c_mktsegment", "household"]}, "case when upper(c_mktsegment) < 'HOUSEHOLD' then -1 when upper(c_mktsegment) > 'HOUSEHOLD' then 1 else 0 end"),
    "replaceOne": (C, {"$replaceOne": {"input": "$c_mktsegment", "find": "U", "replacement": "_"}}, "regexp_replace(c_mktsegment, 'U', '_')"),
    "replaceAll": (C, {"$replaceAll": {"input": "$c_mktsegment", "find": "I", "replacement": {"$literal": "$1"}}}, "replace(c_mktsegment, 'I', '$1')"),
    "regexMatch": (D, {"$regexMatch": {"input": "$text", "regex": "th[ae]", "options": "i"}}, "regexp_matches(text, '(?i)th[ae]')"),
    "regexFind": (D, {"$getField": {"field": "match", "input": {"$regexFind": {"input": "$text", "regex": "[a-z]+tion"}}}}, "nullif(regexp_extract(text, '[a-z]+tion'), '')"),
    "regexFindAll": (D, {"$size": {"$regexFindAll": {"input": "$text", "regex": "the"}}}, "len(regexp_extract_all(text, 'the'))"),
    # arrays
    "size": (O, {"$size": [_ARR]}, f"len({_ARR_SQL})"),
    "isArray": (O, {"$isArray": [_ARR]}, "true"),
    "reverseArray": (O, {"$reverseArray": [_ARR]}, f"list_reverse({_ARR_SQL})"),
    "arrayElemAt": (O, {"$arrayElemAt": [_ARR, -3]}, "o_custkey"),
    "first": (O, {"$first": [_ARR]}, "o_orderkey"),
    "last": (O, {"$last": [_ARR]}, "5"),
    "slice": (O, {"$slice": [_ARR, -3]}, "[o_custkey, 5, 5]"),
    "slice_skip": (O, {"$slice": [_ARR, 1, 2]}, "[o_custkey, 5]"),
    "concatArrays": (O, {"$concatArrays": [_ARR, [1]]}, "[o_orderkey, o_custkey, 5, 5, 1]"),
    "in": (O, {"$in": ["$o_custkey", [1, 2, 3, 4]]}, "o_custkey in (1, 2, 3, 4)"),
    "indexOfArray": (O, {"$indexOfArray": [_ARR, 5, 1]}, "case when o_custkey = 5 then 1 else 2 end"),
    "sortArray": (O, {"$sortArray": {"input": _ARR, "sortBy": -1}}, f"list_reverse_sort({_ARR_SQL})"),
    "zip": (O, {"$size": {"$zip": {"inputs": [_ARR, [1, 2]], "useLongestLength": True, "defaults": [0, 9]}}}, "4"),
    "firstN": (O, {"$firstN": {"input": _ARR, "n": 2}}, "[o_orderkey, o_custkey]"),
    "lastN": (O, {"$lastN": {"input": _ARR, "n": 3}}, "[o_custkey, 5, 5]"),
    "maxN": (O, {"$maxN": {"input": _ARR, "n": 2}}, f"list_reverse_sort({_ARR_SQL})[1:2]"),
    "minN": (O, {"$minN": {"input": _ARR, "n": 2}}, f"list_sort({_ARR_SQL})[1:2]"),
    "range": (O, {"$range": [0, _MOD, 2]}, "range(0, o_orderkey % 7, 2)"),
    "sum": (O, {"$sum": [_ARR]}, "o_orderkey + o_custkey + 10"),
    "avg": (O, {"$avg": [_ARR]}, "(o_orderkey + o_custkey + 10) / 4.0"),
    "min": (O, {"$min": ["$o_orderkey", "$o_custkey"]}, "least(o_orderkey, o_custkey)"),
    "max": (O, {"$max": ["$o_orderkey", "$o_custkey"]}, "greatest(o_orderkey, o_custkey)"),
    "map": (O, {"$map": {"input": _ARR, "as": "x", "in": {"$multiply": ["$$x", 2]}}}, "[o_orderkey * 2, o_custkey * 2, 10, 10]"),
    "filter": (O, {"$filter": {"input": _ARR, "as": "x", "cond": {"$gt": ["$$x", 100]}, "limit": 1}}, "case when o_orderkey > 100 then [o_orderkey] when o_custkey > 100 then [o_custkey] else []::bigint[] end"),
    "reduce": (O, {"$reduce": {"input": _ARR, "initialValue": 1, "in": {"$add": ["$$value", "$$this"]}}}, "o_orderkey + o_custkey + 11"),
    # sets
    "setUnion": (O, {"$setUnion": [_ARR, [1, 5]]}, f"list_sort(list_distinct(list_concat({_ARR_SQL}, [1, 5])))"),
    "setIntersection": (O, {"$setIntersection": [_ARR, [1, 5]]}, f"list_sort(list_intersect([1, 5], {_ARR_SQL}))"),
    "setDifference": (O, {"$setDifference": [[1, 5], _ARR]}, "case when o_orderkey = 1 or o_custkey = 1 then []::bigint[] else [1] end"),
    "setEquals": (O, {"$setEquals": [_ARR, [5, "$o_custkey"]]}, "o_orderkey = 5 or o_orderkey = o_custkey"),
    "setIsSubset": (O, {"$setIsSubset": [[5, 1], _ARR]}, "o_orderkey = 1 or o_custkey = 1"),
    "allElementsTrue": (O, {"$allElementsTrue": [[_MOD, 1]]}, "o_orderkey % 7 <> 0"),
    "anyElementTrue": (O, {"$anyElementTrue": [[_MOD, 0]]}, "o_orderkey % 7 <> 0"),
    # vectors
    "similarityDotProduct": ("embeddings", {"$similarityDotProduct": ["$embedding", "$embedding"]}, "list_inner_product(embedding::double[], embedding::double[])"),
    "similarityCosine": ("embeddings", {"$similarityCosine": ["$embedding", {"$reverseArray": "$embedding"}]}, "list_cosine_similarity(embedding::double[], list_reverse(embedding)::double[])"),
    "similarityEuclidean": ("embeddings", {"$similarityEuclidean": ["$embedding", {"$reverseArray": "$embedding"}]}, "list_distance(embedding::double[], list_reverse(embedding)::double[])"),
    # objects
    "mergeObjects": (O, {"$getField": {"field": "a", "input": {"$mergeObjects": [{"a": "$o_orderkey"}, {"a": "$o_custkey", "b": 1}]}}}, "o_custkey"),
    "objectToArray": (O, {"$map": {"input": {"$objectToArray": {"x": "$o_orderkey", "y": "$o_custkey"}}, "as": "p", "in": "$$p.v"}}, "[o_orderkey, o_custkey]"),
    "arrayToObject": (O, {"$getField": {"field": "k", "input": {"$arrayToObject": [[{"k": "k", "v": "$o_orderkey"}, {"k": "k", "v": "$o_custkey"}]]}}}, "o_custkey"),
    "getField": (O, {"$getField": "o_custkey"}, "o_custkey"),
    "setField": (O, {"$getField": {"field": "n", "input": {"$setField": {"field": "n", "input": "$$ROOT", "value": {"$add": ["$o_custkey", 1]}}}}}, "o_custkey + 1"),
    "unsetField": (O, {"$type": {"$getField": {"field": "o_custkey", "input": {"$unsetField": {"field": "o_custkey", "input": "$$ROOT"}}}}}, "'missing'"),
    # dates
    "year": (O, {"$year": "$o_orderdate"}, "year(o_orderdate)"),
    "month": (O, {"$month": "$o_orderdate"}, "month(o_orderdate)"),
    "dayOfMonth": (O, {"$dayOfMonth": "$o_orderdate"}, "day(o_orderdate)"),
    "hour": (E, {"$hour": "$ts"}, "hour(ts)"),
    "minute": (E, {"$minute": "$ts"}, "minute(ts)"),
    "second": (E, {"$second": "$ts"}, "second(ts)"),
    "millisecond": (E, {"$millisecond": "$ts"}, "millisecond(ts) % 1000"),
    "dayOfWeek": (O, {"$dayOfWeek": "$o_orderdate"}, "dayofweek(o_orderdate) + 1"),
    "dayOfYear": (O, {"$dayOfYear": "$o_orderdate"}, "dayofyear(o_orderdate)"),
    "dateToString": (E, {"$dateToString": {"date": "$ts", "format": "%Y/%m/%d %H:%M:%S.%L %j %%"}}, "strftime(ts, '%Y/%m/%d %H:%M:%S.%g %j %%')"),
    # types and conversion
    "type": (O, {"$type": "$o_totalprice"}, "case when o_totalprice = floor(o_totalprice) then 'int' else 'double' end"),
    "isNumber": (O, {"$isNumber": "$o_orderstatus"}, "false"),
    "toString": (O, {"$toString": "$o_orderkey"}, "o_orderkey::varchar"),
    "toBool": (O, {"$toBool": _MOD}, "o_orderkey % 7 <> 0"),
    "toInt": (C, {"$toInt": "$c_acctbal"}, "trunc(c_acctbal)::int"),
    "toDouble": (O, {"$toDouble": "$o_orderkey"}, "o_orderkey::double"),
    "toDate": (O, {"$year": {"$toDate": {"$multiply": ["$o_orderkey", 100000000]}}}, "year(make_timestamp(o_orderkey * 100000000000))"),
    "convert": (E, {"$convert": {"input": {"$substrCP": ["$props", 6, 2]}, "to": "int", "onError": -1, "onNull": -2}}, "coalesce(try_cast(substring(props, 7, 2) as int), -1)"),
    "rand": (O, {"$and": [{"$gte": [{"$rand": {}}, 0]}, {"$lt": [{"$rand": {}}, 1]}]}, "true"),
}
