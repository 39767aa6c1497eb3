"""One query per filter operator: (table, filter document, the same WHERE in SQL)."""

from __future__ import annotations

import re

from .expression_queries import C, D, E, L, O, P

FILTERS: dict[str, tuple] = {
    "implicit_eq": (O, {"o_orderstatus": "F"}, "o_orderstatus = 'F'"),
    "eq": (O, {"o_orderkey": {"$eq": 7}}, "o_orderkey = 7"),
    "ne": (O, {"o_orderstatus": {"$ne": "F"}}, "o_orderstatus <> 'F'"),
    "gt": (O, {"o_totalprice": {"$gt": 200000}}, "o_totalprice > 200000"),
    "gte": (O, {"o_orderkey": {"$gte": 500}}, "o_orderkey >= 500"),
    "lt": (O, {"o_orderdate": {"$lt": __import__("datetime").datetime(1995, 1, 1)}}, "o_orderdate < timestamp '1995-01-01'"),
    "lte": (L, {"l_quantity": {"$lte": 10, "$gt": 5}}, "l_quantity <= 10 and l_quantity > 5"),
    "range_other_kind": (O, {"o_orderstatus": {"$gt": 5}}, "false"),
    "in": (O, {"o_orderpriority": {"$in": ["1-URGENT", "2-HIGH", None]}}, "o_orderpriority in ('1-URGENT', '2-HIGH')"),
    "in_regex": (C, {"c_mktsegment": {"$in": [re.compile("^B"), "HOUSEHOLD"]}}, "c_mktsegment like 'B%' or c_mktsegment = 'HOUSEHOLD'"),
    "in_empty": (O, {"o_orderkey": {"$in": []}}, "false"),
    "nin": (O, {"o_orderpriority": {"$nin": ["1-URGENT", "2-HIGH"]}}, "o_orderpriority not in ('1-URGENT', '2-HIGH')"),
    "and": (O, {"$and": [{"o_orderstatus": "F"}, {"o_orderkey": {"$lt": 100}}]}, "o_orderstatus = 'F' and o_orderkey < 100"),
    "or": (O, {"$or": [{"o_orderstatus": "F"}, {"o_orderkey": {"$lt": 100}}]}, "o_orderstatus = 'F' or o_orderkey < 100"),
    "nor": (O, {"$nor": [{"o_orderstatus": "F"}, {"o_orderkey": {"$lt": 100}}]}, "not (o_orderstatus = 'F' or o_orderkey < 100)"),
    "not": (O, {"o_totalprice": {"$not": {"$gt": 100000}}}, "not o_totalprice > 100000"),
    "not_regex": (C, {"c_mktsegment": {"$not": re.compile("^b", re.I)}}, "c_mktsegment not like 'B%'"),
    "type": (O, {"o_totalprice": {"$type": "int"}}, "o_totalprice = floor(o_totalprice)"),
    "regex": (P, {"p_name": {"$regex": "^[a-m].*e$", "$options": "i"}}, "regexp_matches(p_name, '(?i)^[a-m].*e$')"),
    "bare_regex": (D, {"text": re.compile("tion[a-z]+\\.")}, "regexp_matches(text, 'tion[a-z]+\\.')"),
    "mod": (O, {"o_orderkey": {"$mod": [7, 3]}}, "o_orderkey % 7 = 3"),
    "all": (O, {"o_orderstatus": {"$all": ["F"]}}, "o_orderstatus = 'F'"),
    "size_scalar": (O, {"o_orderkey": {"$size": 1}}, "false"),
    "size": ("embeddings", {"embedding": {"$size": 64}}, "len(embedding) = 64"),
    "elemMatch": ("embeddings", {"embedding": {"$elemMatch": {"$gt": 0.3, "$lt": 0.35}}}, "len([x for x in embedding if x > 0.3 and x < 0.35]) > 0"),
    "array_element": ("embeddings", {"embedding": {"$gt": 0.4}}, "list_max(embedding) > 0.4"),
    "array_index": ("embeddings", {"embedding.0": {"$gt": 0}}, "embedding[1] > 0"),
    "array_none": ("embeddings", {"embedding": {"$not": {"$gt": 0.4}}}, "not list_max(embedding) > 0.4"),
    "bitsAllSet": (O, {"o_orderkey": {"$bitsAllSet": 5}}, "o_orderkey & 5 = 5"),
    "bitsAnySet": (O, {"o_orderkey": {"$bitsAnySet": [0, 3]}}, "o_orderkey & 9 <> 0"),
    "bitsAllClear": (O, {"o_orderkey": {"$bitsAllClear": 5}}, "o_orderkey & 5 = 0"),
    "bitsAnyClear": (O, {"o_orderkey": {"$bitsAnyClear": 5}}, "o_orderkey & 5 <> 5"),
    "expr": (L, {"$expr": {"$gt": [{"$multiply": ["$l_extendedprice", "$l_discount"]}, 5000]}}, "l_extendedprice * l_discount > 5000"),
    "expr_error": (O, {"$expr": {"$gt": [{"$divide": ["$o_totalprice", {"$mod": ["$o_orderkey", 2]}]}, 1000]}}, "o_orderkey % 2 <> 0 and o_totalprice > 1000"),
    "expr_wrong_type": (O, {"$expr": {"$gt": [{"$add": ["$o_orderstatus", 1]}, 1]}}, "false"),
    "comment": (O, {"$comment": "all", "o_orderkey": {"$lt": 10}}, "o_orderkey < 10"),
    "events": (E, {"event_type": {"$in": ["click", "view"]}, "value": {"$gte": 50}}, "event_type in ('click', 'view') and value >= 50"),
}
