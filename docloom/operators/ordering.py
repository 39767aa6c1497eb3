"""Sort documents, and one ascending key for any mix of directions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError
from ..functions import Context
from ..plans import paths
from ..plans import values as V
from ..plans.values import Value


def terms(c: Context, spec: dict) -> list[tuple[Value, int]]:
    if not isinstance(spec, dict) or not spec:
        raise CompileError("a sort needs a document with fields")
    out = []
    for path, d in spec.items():
        if d not in (1, -1) or isinstance(d, bool):
            raise CompileError("a sort direction is 1 or -1")
        v = paths.plain(c.root, path, c.strict)
        if c.strict and v.kind in ("array", "binary"):
            raise CompileError(f"'{path}' is an array or binary, whose order is not that of its elements")
        if v.kind != "null":
            out.append((v, d))
    return out


def columns(own: list[tuple[Value, int]]) -> list[Column]:
    """Sort columns: missing first when ascending, last when descending."""
    return [V.sort_key(v).asc_nulls_first() if d == 1 else V.sort_key(v).desc_nulls_last() for v, d in own]


def _inverted(v: Value) -> Column:
    """A column that orders the other way, without nulls."""
    col = v.col
    if v.kind == "number":
        return -col.cast("double") if not V.is_integral(v.type) else F.bitwise_not(col.cast("long"))
    if v.kind == "bool":
        return ~col
    if v.kind == "date":
        return -F.unix_micros(col.cast("timestamp"))
    text = col if v.kind in ("string", "binary") else F.to_json(col)
    # the complement of the digits; the mark ranks an end above any continuation
    return F.concat(F.translate(F.hex(text), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))


def key(own: list[tuple[Value, int]], last: Column | None = None) -> Column:
    """A struct whose ascending order is that of the terms, then of ``last``."""
    parts = []
    for v, d in own:
        if d == 1:
            parts += [V.sort_key(v)]
        else:
            parts += [v.col.isNull(), _inverted(v)]
    if last is not None:
        parts.append(last)
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)]) if parts else F.lit(0)


__all__ = ["T", "columns", "key", "terms"]
