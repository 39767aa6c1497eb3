"""Aggregation pipelines: a list of stages becomes a chain of DataFrame operations.

Catalyst does the rest: it pushes leading filters into the scan, prunes columns, and
picks join and aggregation strategies.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError
from ..functions import Context, compile_expression
from ..functions.core import build_object
from ..plans import paths
from ..plans.values import NULLS, Value
from . import accumulators, ordering, projection
from .filters import compile_filter
from .projection import ID, LET, ORDER, fields_of, has_order, put, select_values, variables_of

_ABSENT = "$facet $bucket $bucketAuto $replaceRoot $replaceWith $out $merge $sample $graphLookup $unionWith $documents $setWindowFields $geoNear $redact".split()


@dataclass
class Scope:
    """What stages refer to besides their input."""

    collections: Mapping[str, DataFrame] | Callable[[str], DataFrame] = field(default_factory=dict)
    variables: dict[str, Value] = field(default_factory=dict)
    strict: bool = False
    depth: int = 0

    def collection(self, name: str) -> DataFrame:
        if callable(self.collections):
            return self.collections(name)
        if name not in self.collections:
            raise CompileError(f"there is no collection {name}")
        return self.collections[name]


def visible(df: DataFrame) -> T.StructType:
    hidden = {ORDER, NULLS, *variables_of(df)}
    return T.StructType([f for f in df.schema.fields if f.name not in hidden])


def context(df: DataFrame, scope: Scope) -> Context:
    return Context(visible(df), variables=scope.variables, strict=scope.strict, nulls=NULLS in df.columns)


def run_pipeline(df: DataFrame, stages: list[dict], scope: Scope | None = None) -> DataFrame:
    """All stages over ``df``; the hidden order column stays if it was there."""
    scope = scope or Scope()
    validate(stages)
    i = 0
    while i < len(stages):
        fused = _lookup_as_join(df, stages[i], stages[i + 1 :], scope)
        if fused is not None:
            df, i = fused, i + 2
            continue
        ((name, arg),) = stages[i].items()
        df = STAGES[name](df, arg, scope, stages[i + 1 :])
        i += 1
    return df


def aggregate(df: DataFrame, stages: list[dict], **scope: Any) -> DataFrame:
    """A pipeline over any DataFrame, without hidden columns in the result."""
    out = run_pipeline(df, stages, Scope(**scope))
    return out.drop(ORDER, NULLS)


def validate(stages: Any) -> None:
    if not isinstance(stages, (list, tuple)):
        raise CompileError("a pipeline is a list of stages")
    for stage in stages:
        if not isinstance(stage, dict) or len(stage) != 1:
            raise CompileError("a stage has exactly one field")
        (name,) = stage
        if name not in STAGES:
            more = " (not supported)" if name in _ABSENT else ""
            raise CompileError(f"unknown pipeline stage {name}{more}; there are {', '.join(sorted(STAGES))}")


def ordered(df: DataFrame) -> DataFrame:
    return df if has_order(df) else df.withColumn(ORDER, F.monotonically_increasing_id())


def _order_matters(rest: list[dict]) -> bool:
    """Whether a later stage depends on the order of its input."""
    for stage in rest:
        ((name, arg),) = stage.items()
        if name == "$group":
            return any(isinstance(a, dict) and set(a) & accumulators.ORDERED for a in arg.values())
        if name in ("$sort", "$count", "$sortByCount"):
            return False
    return False


#: stages between a sort and an order-aware group that need no sorted input: the group has the order in a column
_ROWWISE = frozenset(("$match", "$project", "$addFields", "$set", "$unset", "$unwind"))


def _only_grouped(rest: list[dict]) -> bool:
    """Whether a sorted frame goes, row by row, into a group."""
    for stage in rest:
        (name,) = stage
        if name == "$group":
            return True
        if name not in _ROWWISE:
            return False
    return False


# --- stages -----------------------------------------------------------------------------


def _match(df, arg, scope, rest):
    return df.where(compile_filter(context(df, scope), arg))


def _sort(df, arg, scope, rest):
    c = context(df, scope)
    own = ordering.terms(c, arg)
    last = [F.col(ORDER).asc()] if has_order(df) else []
    keyed = _order_matters(rest) or scope.depth
    # in a lookup's pipeline the order column alone counts
    sorts = (own or last) and not (scope.depth or keyed and _only_grouped(rest))
    out = df.orderBy(*ordering.columns(own), *last) if sorts else df
    if keyed:
        base = F.col(ORDER) if has_order(df) else F.monotonically_increasing_id()
        out = out.withColumn(ORDER, ordering.key(own, base))
    return out


def _count_arg(arg, name, least):
    if isinstance(arg, bool) or not isinstance(arg, (int, float)) or arg != int(arg) or arg < least:
        raise CompileError(f"{name} needs a whole number from {least}")
    return int(arg)


def _each_place(df: DataFrame, test) -> DataFrame:
    """The documents of each outer row whose place, from 1, passes a test."""
    place = F.row_number().over(Window.partitionBy(*variables_of(df)).orderBy(ORDER))
    return df.withColumn("_place", place).where(test(F.col("_place"))).drop("_place")


def _limit(df, arg, scope, rest):
    n = _count_arg(arg, "$limit", 0)
    return _each_place(df, lambda p: p <= n) if variables_of(df) else df.limit(n)


def _skip(df, arg, scope, rest):
    n = _count_arg(arg, "$skip", 0)
    return _each_place(df, lambda p: p > n) if variables_of(df) else df.offset(n)


def _count(df, arg, scope, rest):
    if not isinstance(arg, str) or not arg or "." in arg or arg.startswith("$"):
        raise CompileError("$count needs a plain field name")
    if outer := variables_of(df):
        return df.groupBy(*outer).agg(F.count(F.lit(1)).alias(arg), F.lit(0).alias(ORDER))
    return df.select(F.count(F.lit(1)).alias(arg)).where(F.col(paths.quoted(arg)) > 0)


def _group(df, arg, scope, rest):
    if not isinstance(arg, dict) or ID not in arg:
        raise CompileError("$group needs an _id")
    if any(isinstance(a, dict) and set(a) & accumulators.ORDERED for k, a in arg.items() if k != ID) or _order_matters(rest):
        df = ordered(df)
    c = context(df, scope)
    key = compile_expression(c, arg[ID])
    order = F.col(ORDER) if has_order(df) else F.lit(0)
    columns, outer = [], variables_of(df)
    within = [*outer, *([key.col] if key.kind != "null" else [])]
    ranks = _ranks(df, c, order, arg) if within else {}
    if ranks:
        df = df.withColumns({r: F.row_number().over(Window.partitionBy(*within).orderBy(*by)) for r, by, _ in ranks.values()})
        if len(ranks) == len(arg) - 1 and not (has_order(df) and (_order_matters(rest) or scope.depth)):
            # rows beyond all bounds go before they are shuffled
            df = df.where(reduce(lambda a, b: a | b, [F.col(r) <= n for r, _, n in ranks.values()]))
    for name, spec in arg.items():
        if name == ID:
            continue
        if "." in name or name.startswith("$"):
            raise CompileError(f"'{name}' is not a plain field name")
        rank = F.col(ranks[name][0]) if name in ranks else None
        columns.append(accumulators.accumulate(c, spec, order, rank).col.alias(name))
    if has_order(df) and (_order_matters(rest) or scope.depth):
        columns.append(F.min(ORDER).alias(ORDER))
    if key.kind == "null" and not outer:
        names = [k for k in arg if k != ID] + ([ORDER] if len(columns) >= len(arg) else [])
        out = df.select(F.count(F.lit(1)).alias("_n"), *columns).where("_n > 0")
        return out.select(F.lit(None).alias(ID), *[F.col(paths.quoted(n)) for n in names])
    grouped = df.groupBy(*outer, key.col.alias(ID))
    return grouped.agg(*columns) if columns else df.select(*outer, key.col.alias(ID)).distinct()


def _ranks(df, c, order, arg) -> dict[str, tuple[str, list, int]]:
    """For accumulators of at most n values: a column for the place in the group, its order, and n."""
    out = {}
    for name, spec in arg.items():
        if name != ID and isinstance(spec, dict) and len(spec) == 1 and (found := accumulators.bound(c, spec, order)):
            out[name] = (f"_rank{len(df.columns)}_{len(out)}", *found)
    return out


def _sort_by_count(df, arg, scope, rest):
    if not (isinstance(arg, str) and arg.startswith("$") or isinstance(arg, dict) and arg):
        raise CompileError("$sortByCount needs an expression")
    out = _group(df, {ID: arg, "count": {"$sum": 1}}, scope, [])
    if variables_of(df):
        return out.withColumn(ORDER, F.struct((-F.col("count")).alias("k0"), F.col(ID).alias("k1")))
    return out.orderBy(F.col("count").desc(), F.col(ID).asc())


def _project(df, arg, scope, rest):
    return projection.stage_projection(df, context(df, scope), arg)


def _add_fields(df, arg, scope, rest):
    return projection.add_fields(df, context(df, scope), arg)


def _unset(df, arg, scope, rest):
    return projection.unset(df, context(df, scope), arg)


def _unwind(df, arg, scope, rest):
    said = {"path": arg} if isinstance(arg, str) else arg
    if not isinstance(said, dict) or not str(said.get("path", "")).startswith("$") or set(said) - {"path", "preserveNullAndEmptyArrays", "includeArrayIndex"}:
        raise CompileError("$unwind needs a path that starts with $")
    path, keep, index = said["path"][1:], bool(said.get("preserveNullAndEmptyArrays")), said.get("includeArrayIndex")
    if index is not None and (not index or index.startswith("$")):
        raise CompileError("includeArrayIndex is a field name")
    c = context(df, scope)
    v = paths.plain(c.root, path, scope.strict)
    if v.kind != "array":  # a scalar is its own only element
        out = df if keep else df.where(v.col.isNotNull())
        return _set_path(out, index, Value(F.lit(None).cast("long"), T.LongType()), scope) if index else out
    explode = F.posexplode_outer if keep else F.posexplode
    out = df.select("*", explode(v.col).alias("_at", "_element"))
    if has_order(df) and (_order_matters(rest) or scope.depth):
        out = out.withColumn(ORDER, F.struct(F.col(ORDER).alias("o"), F.col("_at").alias("at")))
    fields = {n: c.root(n) for n in c.schema.names}
    _place(fields, path, Value(F.col("_element"), v.type.elementType))
    if index:
        _place(fields, index, Value(F.col("_at").cast("long"), T.LongType()))
    return select_values(out, fields)


def _place(fields: dict[str, Value], path: str, v: Value) -> None:
    first, *rest = paths.check(path)
    fields[first] = put(fields.get(first), rest, v) if rest else v


def _set_path(df, path, v, scope):
    fields = fields_of(df)
    _place(fields, path, v)
    return select_values(df, fields)


def document(df: DataFrame):
    """All visible columns of a row as one struct."""
    return F.struct(*[F.col(paths.quoted(n)) for n in visible(df).names])


def _lookup(df, arg, scope, rest):
    if not isinstance(arg, dict) or "from" not in arg or "as" not in arg:
        raise CompileError("$lookup needs from and as")
    equality = {"localField", "foreignField"} & set(arg)
    odd = set(arg) - {"from", "as", "localField", "foreignField", "let", "pipeline"}
    if odd:
        raise CompileError(f"$lookup does not know {', '.join(sorted(odd))}")
    if equality and ("pipeline" in arg or "let" in arg):
        raise CompileError("$lookup joins by fields or by a pipeline, not both")
    if equality and len(equality) < 2:
        raise CompileError("$lookup needs localField and foreignField")
    if not equality and "pipeline" not in arg:
        raise CompileError("$lookup needs a pipeline or fields")
    foreign = scope.collection(arg["from"]).drop(NULLS)
    if equality:
        return _equi_lookup(df, foreign, arg["localField"], arg["foreignField"], arg["as"], scope)
    return _pipeline_lookup(df, foreign, arg.get("let") or {}, arg["pipeline"], arg["as"], scope)


def _gathered(entries):
    """Documents of (o, d) entries in the foreign natural order."""
    return F.transform(F.array_sort(F.collect_list(entries)), lambda e: e["d"])


def _equi_lookup(df, foreign, local, other, name, scope):
    f = Scope(scope.collections, strict=scope.strict)
    fc, lc = context(foreign, f), context(df, scope)
    fk, lk = paths.plain(fc.root, other, scope.strict), paths.plain(lc.root, local, scope.strict)
    order = F.col(ORDER) if ORDER in foreign.columns else F.lit(0)
    entry = F.struct(order.alias("o"), document(foreign).alias("d"))
    empty = F.array().cast(T.ArrayType(visible(foreign)))
    if fk.kind == "array":
        keyed = foreign.select(entry.alias("_e"), F.explode_outer(F.array_distinct(fk.col)).alias("_fk"))
        fk_type = fk.type.elementType
    else:
        keyed, fk_type = foreign.select(entry.alias("_e"), fk.col.alias("_fk")), fk.type
    lk_type = lk.type.elementType if lk.kind == "array" else lk.type
    from ..plans.values import kind

    if "null" not in (kind(fk_type), kind(lk_type)) and kind(fk_type) != kind(lk_type):
        return _set_path(df, name, Value(empty, T.ArrayType(visible(foreign))), scope)
    matches = keyed.groupBy("_fk").agg(F.collect_list("_e").alias("_es"))
    if lk.kind != "array":
        left = df.withColumn("_lk", lk.col)
        joined = left.join(matches, F.col("_lk").eqNullSafe(F.col("_fk")), "left")
        found = F.transform(F.array_sort(F.col("_es")), lambda e: e["d"])
        out = joined.withColumn("_found", F.coalesce(found, empty)).drop("_lk", "_fk", "_es")
    else:
        row = F.col(ORDER) if has_order(df) else F.monotonically_increasing_id()
        left = df.withColumn("_row", F.struct(*variables_of(df), row.alias("o")))
        probes = left.select("_row", F.explode(F.array_distinct(lk.col)).alias("_lk"))
        hits = probes.join(keyed, F.col("_lk").eqNullSafe(F.col("_fk"))).select("_row", "_e").distinct()
        grouped = hits.groupBy(F.col("_row").alias("_r")).agg(_gathered(F.col("_e")).alias("_f"))
        out = left.join(grouped, F.col("_row").eqNullSafe(F.col("_r")), "left")
        out = out.withColumn("_found", F.coalesce("_f", empty)).drop("_row", "_r", "_f")
    return _with_found(out, df, name, foreign)


def _mentions(stage: dict, name: str) -> bool:
    said = json.dumps(stage, default=str)
    return "$$ROOT" in said or "$$CURRENT" in said or re.search(rf"(?<!\w){re.escape(name)}(?!\w)", said) is not None


def _lookup_as_join(df: DataFrame, stage: dict, rest: list[dict], scope: Scope) -> DataFrame | None:
    """An equality lookup with what follows as one join, or None.

    Followed by ``$unwind`` of its result it is an inner or a left join, by a test for no
    matches an anti join, and by one for some, if nothing else needs them, a semi join.
    """
    arg = stage.get("$lookup")
    if not isinstance(arg, dict) or set(arg) != {"from", "localField", "foreignField", "as"} or not rest or scope.depth:
        return None
    name, ((after, said),) = arg["as"], rest[0].items()
    path = said if isinstance(said, str) else said.get("path") if isinstance(said, dict) else None
    if after == "$unwind" and path == f"${name}" and (isinstance(said, str) or set(said) <= {"path", "preserveNullAndEmptyArrays"}):
        how = "left" if isinstance(said, dict) and said.get("preserveNullAndEmptyArrays") else "inner"
    elif after == "$match" and said in ({name: {"$size": 0}}, {name: []}, {name: {"$eq": []}}):
        how = "left_anti"
    elif after == "$match" and said in ({name: {"$ne": []}}, {f"{name}.0": {"$exists": True}}) and len(rest) > 1:
        ((then, spec),) = rest[1].items()
        drops = then in ("$group", "$count") or then == "$project" and any(v not in (0, False) for k, v in spec.items() if k != ID)
        if not drops or _mentions(rest[1], name):
            return None
        how = "left_semi"
    else:
        return None
    foreign = scope.collection(arg["from"]).drop(NULLS)
    fc, lc = context(foreign, Scope(scope.collections, strict=scope.strict)), context(df, scope)
    fk, lk = paths.plain(fc.root, arg["foreignField"], scope.strict), paths.plain(lc.root, arg["localField"], scope.strict)
    if "array" in (fk.kind, lk.kind) or "null" in (fk.kind, lk.kind) or fk.kind != lk.kind:
        return None
    # the order only where a later stage asks for it
    ranked = has_order(df) and _order_matters(rest)
    order = F.col(ORDER) if ORDER in foreign.columns else F.lit(0)
    matches = [fk.col.alias("_fk")]
    if how in ("inner", "left"):
        matches += [document(foreign).alias("_element"), *([order.alias("_fo")] if ranked else [])]
    out = df.withColumn("_lk", lk.col).join(foreign.select(*matches), F.col("_lk").eqNullSafe(F.col("_fk")), how)
    if ranked and how in ("inner", "left"):
        out = out.withColumn(ORDER, F.struct(F.col(ORDER).alias("o"), F.col("_fo").alias("at")))
    found = Value(F.col("_element"), visible(foreign)) if how in ("inner", "left") else Value(F.array().cast(T.ArrayType(visible(foreign))), T.ArrayType(visible(foreign)))
    fields = fields_of(df)
    _place(fields, name, found)
    return select_values(out, fields)


def _with_found(out, df, name, foreign):
    fields = fields_of(df)
    _place(fields, name, Value(F.col("_found"), T.ArrayType(visible(foreign))))
    return select_values(out, fields)


def _pipeline_lookup(df, foreign, let, stages, name, scope):
    """A pipeline for each row, as joins.

    The distinct values of the variables are joined with the foreign documents, on the
    first ``$match`` if there is one: its equalities are the join's keys, and what else
    it says its further condition.  The other stages run on the result with the
    variables as hidden columns, by which they group, rank and count.  What is found is
    gathered by them and joined back.
    """
    validate(stages)
    c, own, left = context(df, scope), {}, df
    for var, e in let.items():
        v = compile_expression(c, e)
        column = f"{LET}{scope.depth}_{var}"
        left = left.withColumn(column, v.col if v.kind != "null" else F.lit(None).cast("string"))
        own[var] = Value(F.col(column), v.type if v.kind != "null" else T.StringType())
    inner = replace(scope, variables={**scope.variables, **own}, depth=scope.depth + 1)
    outer, first = variables_of(left), stages[0].get("$match") if stages else None
    if not outer:
        found = run_pipeline(foreign, stages, replace(scope, depth=0))
        found = ordered(found)
        entry = F.struct(F.col(ORDER).alias("o"), document(found).alias("d"))
        kept, joined = visible(found), left.crossJoin(found.select(_gathered(entry).alias("_found")))
        return _with_lists(joined, df, name, kept)
    # without an order documents tie
    sub = foreign if has_order(foreign) else foreign.withColumn(ORDER, F.lit(0))
    domain = left.select(*outer).distinct()
    if first is None:
        sub = domain.crossJoin(sub)
    else:
        sub, stages = domain.join(sub, compile_filter(context(sub, inner), first)), stages[1:]
    sub = run_pipeline(sub, stages, inner)
    entry = F.struct(F.col(ORDER).alias("o"), document(sub).alias("d"))
    back = sub.groupBy(*[F.col(n).alias(f"_of{n}") for n in outer]).agg(_gathered(entry).alias("_found"))
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_of{n}")) for n in outer])
    joined = left.join(back, same, "left").drop(*[f"{LET}{scope.depth}_{var}" for var in let])
    return _with_lists(joined, df, name, visible(sub))


def _with_lists(joined, df, name, kept):
    kind = T.ArrayType(kept)
    fields = fields_of(df)
    _place(fields, name, Value(F.coalesce(F.col("_found"), F.array().cast(kind)), kind))
    return select_values(joined, fields)


STAGES = {
    "$match": _match, "$sort": _sort, "$limit": _limit, "$skip": _skip, "$count": _count, "$group": _group, "$sortByCount": _sort_by_count,
    "$project": _project, "$addFields": _add_fields, "$set": _add_fields, "$unset": _unset, "$unwind": _unwind, "$lookup": _lookup,
}


def describe(stages: list[dict]) -> str:
    return json.dumps(stages, default=str)


__all__ = ["aggregate", "build_object", "run_pipeline", "validate"]
