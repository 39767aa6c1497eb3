"""Accumulators of ``$group``: each one an aggregate column with its type.

``order`` is the column that arrival order follows; nothing here relies on the order in
which rows reach an aggregate.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError
from ..functions import Context, compile_expression
from ..functions.collections import sliced
from ..functions.core import build_array, constant, options
from ..plans import values as V
from ..plans.values import DOUBLE, LONG, STRING, Value
from . import ordering

ORDERED = frozenset("$first $last $push $firstN $lastN $mergeObjects $top $bottom $topN $bottomN".split())


def bound(c: Context, spec: dict, order: Column) -> tuple[list[Column], int] | None:
    """For an accumulator of at most n values: the order of a group's rows in which they come first, and n."""
    ((op, arg),) = spec.items()
    if op in ("$firstN", "$lastN", "$maxN", "$minN"):
        said = options(arg, "n input", name=op)
        v = _typed(compile_expression(c, said["input"]))
        by = {"$firstN": order.asc(), "$lastN": order.desc(), "$maxN": v.col.desc_nulls_last(), "$minN": v.col.asc_nulls_last()}[op]
        return [by], _n(said["n"], op)
    if op in ("$topN", "$bottomN"):
        said = options(arg, "sortBy output n", name=op)
        key = ordering.key(ordering.terms(c, said["sortBy"]), order)
        return [key.asc() if op == "$topN" else key.desc()], _n(said["n"], op)
    return None


def _within(entry: Column, rank: Column | None, n: int) -> Column:
    return entry if rank is None else F.when(rank <= n, entry)


def _list(order: Column, v: Value, known: bool, rank: Column | None = None, n: int = 0) -> Column:
    """Values in arrival order; ``known``: without missing ones; with a ``rank``, only of the first n rows by it."""
    entry = F.struct(order.alias("o"), v.col.alias("x"))
    rows = F.collect_list(F.when(v.col.isNotNull(), entry) if known else _within(entry, rank, n))
    return F.transform(F.array_sort(rows), lambda r: r["x"])


def _typed(v: Value) -> Value:
    return v if v.kind != "null" else Value(v.col.cast("string"), STRING)


def accumulate(c: Context, spec: Any, order: Column, rank: Column | None = None) -> Value:
    """The aggregate of an accumulator; ``rank``: a row's place in its group by the order of ``bound``."""
    if not isinstance(spec, dict) or len(spec) != 1:
        raise CompileError("a group field needs one accumulator")
    ((op, arg),) = spec.items()
    if op in _SIMPLE:
        return _SIMPLE[op](_typed(compile_expression(c, arg)), order)
    if op == "$count":
        if arg != {}:
            raise CompileError("$count takes an empty document")
        return Value(F.count(F.lit(1)), LONG)
    if op in ("$firstN", "$lastN", "$maxN", "$minN"):
        said = options(arg, "n input", name=op)
        n = _n(said["n"], op)
        v = _typed(compile_expression(c, said["input"]))
        if op in ("$maxN", "$minN"):
            rows = F.sort_array(F.collect_list(_within(v.col, rank, n)), asc=op == "$minN")
            return Value(F.slice(rows, 1, n), T.ArrayType(v.type))
        rows = _list(order, v, False, rank, n)
        out = sliced(rows, F.lit(0), F.lit(n)) if op == "$firstN" else sliced(rows, F.lit(-n), F.lit(n))
        return Value(out, T.ArrayType(v.type))
    if op in ("$top", "$bottom", "$topN", "$bottomN"):
        return _position(c, op, arg, order, rank)
    raise CompileError(f"unknown accumulator {op}")


def _n(e: Any, op: str) -> int:
    n = constant(e, op)
    if n < 1:
        raise CompileError(f"{op} needs n from 1")
    return n


def _position(c: Context, op: str, arg: Any, order: Column, rank: Column | None) -> Value:
    many = op.endswith("N")
    said = options(arg, "sortBy output n" if many else "sortBy output", name=op)
    out = said["output"]
    v = build_array([compile_expression(c, x) for x in out]) if isinstance(out, (list, tuple)) else _typed(compile_expression(c, out))
    key = ordering.key(ordering.terms(c, said["sortBy"]), order)
    if not many:
        return Value((F.min_by if op == "$top" else F.max_by)(v.col, key), v.type)
    n = _n(said["n"], op)
    rows = F.transform(F.array_sort(F.collect_list(_within(F.struct(key.alias("k"), v.col.alias("x")), rank, n))), lambda r: r["x"])
    return Value(sliced(rows, F.lit(0 if op == "$topN" else -n), F.lit(n)), T.ArrayType(v.type))


def _sum(v: Value, order: Column) -> Value:
    if v.kind != "number":
        return Value(F.coalesce(F.max(F.lit(0).cast("long")), F.lit(0).cast("long")), LONG)
    if V.is_integral(v.type):
        return Value(F.coalesce(F.sum(v.col), F.lit(0).cast("long")), LONG)
    return Value(F.coalesce(F.sum(v.col.cast("double")), F.lit(0.0)), DOUBLE)


def _numeric(f):
    def run(v: Value, order: Column) -> Value:
        return Value(f(v.col.cast("double") if v.kind == "number" else F.lit(None).cast("double")), DOUBLE)

    return run


def _merge(v: Value, order: Column) -> Value:
    if isinstance(v.type, T.MapType):
        from ..functions.collections import last_wins

        return Value(last_wins(F.flatten(F.transform(_list(order, v, True), lambda m: F.map_entries(m)))), v.type)
    if not isinstance(v.type, T.StructType):
        raise CompileError("$mergeObjects needs objects")
    fields = [F.max_by(v.col[f.name], F.when(v.col[f.name].isNotNull(), order)).alias(f.name) for f in v.type.fields]
    return Value(F.struct(*fields), v.type)


def _set(v: Value, order: Column) -> Value:
    if isinstance(v.type, T.MapType):
        raise CompileError("$addToSet cannot compare maps")
    return Value(F.sort_array(F.collect_set(v.col)), T.ArrayType(v.type))


_SIMPLE = {
    "$sum": _sum,
    "$avg": _numeric(F.avg),
    "$stdDevPop": _numeric(F.stddev_pop),
    "$stdDevSamp": _numeric(F.stddev_samp),
    "$min": lambda v, o: Value(F.min(V.sort_key(v) if isinstance(v.type, T.MapType) else v.col), v.type),
    "$max": lambda v, o: Value(F.max(V.sort_key(v) if isinstance(v.type, T.MapType) else v.col), v.type),
    "$first": lambda v, o: Value(F.min_by(v.col, o), v.type),
    "$last": lambda v, o: Value(F.max_by(v.col, o), v.type),
    "$push": lambda v, o: Value(_list(o, v, True), T.ArrayType(v.type)),
    "$addToSet": _set,
    "$mergeObjects": _merge,
}
NAMES = frozenset({*_SIMPLE, "$count", "$firstN", "$lastN", "$maxN", "$minN", "$top", "$bottom", "$topN", "$bottomN"})
