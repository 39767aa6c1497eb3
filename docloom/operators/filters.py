"""Compiler of filter documents into boolean columns.

A criterion matches a scalar or, in an array, any element; dotted paths look into the
elements of arrays on the way.  Comparisons only match values of their operand's kind.
Negations are exact complements, so they match where the field is missing.  A float
field holds 0.3 as the nearest float, so a number is compared with it as a float.

A null column means no match, as in a WHERE clause, and is only made false where it is
negated: a plain comparison stays one that Spark can push into a scan or join on.
"""

from __future__ import annotations

import re
from dataclasses import replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError
from ..functions import Context, compile_expression
from ..functions.core import OPERATORS, WrongType
from ..functions.text import from_compiled, java_pattern
from ..plans import paths
from ..plans import values as V
from ..plans.values import Value, all_of, any_of, kind, literal

_REFUSED = {"$text": "use a search index", "$where": "use $expr", "$jsonSchema": "there is no validation", "$near": "there is no geometry"}
# Codes and names of types.
_TYPE_CODES = {
    1: "double", 2: "string", 3: "object", 4: "array", 5: "binData", 6: "undefined", 7: "objectId", 8: "bool", 9: "date", 10: "null", 11: "regex",
    13: "javascript", 16: "int", 17: "timestamp", 18: "long", 19: "decimal", -1: "minKey", 127: "maxKey",
}
_UNSTORABLE = {"undefined", "objectId", "regex", "javascript", "timestamp", "long", "decimal", "minKey", "maxKey"}


def negated(c: Column) -> Column:
    return ~V.true(c)


def matches(c: Context, said: Any) -> Column:
    """A filter as a column that is never null."""
    return V.true(compile_filter(c, said))


def compile_filter(c: Context, said: Any) -> Column:
    if not isinstance(said, dict):
        raise CompileError("a filter is a document")
    parts = []
    for key, value in said.items():
        if key in ("$and", "$or", "$nor"):
            if not isinstance(value, (list, tuple)) or not value:
                raise CompileError(f"{key} needs a list of filters")
            each = [compile_filter(c, v) for v in value]
            parts.append(all_of(each) if key == "$and" else any_of(each) if key == "$or" else negated(any_of(each)))
        elif key == "$expr":
            parts.append(_expr(c, value))
        elif key == "$comment":
            continue
        elif key == "$sampleRate":
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 1:
                raise CompileError("$sampleRate is between 0 and 1")
            parts.append(F.rand() < F.lit(float(value)))
        elif key in _REFUSED:
            raise CompileError(f"{key} is not supported: {_REFUSED[key]}")
        elif key.startswith("$"):
            raise CompileError(f"unknown filter operator {key}")
        else:
            first, *rest = paths.check(key)
            parts.append(criterion(value, lambda leaf, first=first, rest=rest: paths.matched(c.root(first), rest, leaf, strict=c.strict), c))
    return all_of(parts)


def _expr(c: Context, e: Any) -> Column:
    """Truth of an expression; where it cannot be evaluated there is no match."""
    _known_operators(e)
    faults: list[Column] = []
    v = V.truthy(compile_expression(replace(c, lenient=True, faults=faults), e))
    return v & negated(any_of(faults)) if faults else v


def _known_operators(e: Any) -> None:
    if isinstance(e, dict):
        for k, x in e.items():
            if k == "$literal":
                return
            if k.startswith("$") and k not in OPERATORS:
                raise CompileError(f"unknown expression operator {k}")
            _known_operators(x)
    elif isinstance(e, (list, tuple)):
        for x in e:
            _known_operators(x)


def is_criterion(value: Any) -> bool:
    return isinstance(value, dict) and any(k.startswith("$") for k in value)


def criterion(value: Any, at, c: Context, inside: bool = False) -> Column:
    """What a field's value in a filter says; ``at(leaf)`` applies a test at the path."""
    if isinstance(value, re.Pattern):
        return at(lambda v: _elements(v, _regex(*from_compiled(value))))
    if not is_criterion(value):
        return _equal(at, value)
    if plain := [k for k in value if not k.startswith("$")]:
        raise CompileError(f"operators and the field {plain[0]} in one criterion")
    parts = []
    for op, arg in value.items():
        if op == "$options":
            if "$regex" not in value:
                raise CompileError("$options needs $regex")
            continue
        parts.append(_operator(op, arg, value, at, c, inside))
    return all_of(parts)


def _elements(v: Value, test) -> Column:
    """The test on the value itself or, in an array, on any element."""
    own = test(v)
    if v.kind != "array":
        return own
    return own | F.exists(v.col, lambda x: test(Value(x, v.type.elementType)))


def _equal(at, value: Any) -> Column:
    if value is None:
        return at(_is_null)
    if isinstance(value, re.Pattern):
        return F.lit(False)
    want = literal(value)

    def test(v: Value) -> Column:
        if v.kind == "null" or v.kind != want.kind:
            return F.lit(False)
        own = literal(value, v.type)
        if v.kind in ("object", "array"):
            return V.equals(v, own) & v.col.isNotNull()
        (a, b), _ = V.unified([v, own])
        return a == b

    return at(lambda v: _elements(v, test))


def _is_null(v: Value) -> Column:
    if v.kind == "array":
        return v.col.isNull() | F.exists(v.col, lambda x: x.isNull())
    return v.col.isNull()


def _range(op: str, value: Any):
    if isinstance(value, re.Pattern):
        raise CompileError(f"{op} takes no regular expression")
    if isinstance(value, (bytes, bytearray)):
        raise CompileError(f"{op} does not order binary values")
    want = literal(value)

    def test(v: Value) -> Column:
        if want.kind == "null":
            return v.col.isNull() if op in ("$gte", "$lte") else F.lit(False)
        if v.kind != want.kind or isinstance(want.type, T.StructType) and (not isinstance(v.type, T.StructType) or v.type.names != want.type.names):
            return F.lit(False)
        (a, b), _ = V.unified([v, literal(value, v.type)])
        return {"$gt": a > b, "$gte": a >= b, "$lt": a < b, "$lte": a <= b}[op]

    return lambda v: _elements(v, test)


def _regex(pattern: str, flags: str):
    java = java_pattern(pattern, flags)
    return lambda v: v.col.rlike(java) if v.kind == "string" else F.lit(False)


def _whole(x: Any, op: str, least: int | None = None) -> int:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or x != int(x) or least is not None and x < least:
        raise CompileError(f"{op} needs a whole number")
    return int(x)


def _mask(arg: Any, op: str) -> int:
    if isinstance(arg, (list, tuple)):
        out = 0
        for p in arg:
            if not 0 <= _whole(p, op) <= 63:
                raise CompileError(f"{op} takes positions from 0 to 63")
            out |= 1 << int(p)
        return out - (1 << 64) if out >> 63 else out
    return _whole(arg, op, 0)


def _bits(op: str, arg: Any):
    mask = _mask(arg, op)

    def test(v: Value) -> Column:
        if v.kind != "number":
            return F.lit(False)
        whole = F.lit(True) if V.is_integral(v.type) else v.col == F.floor(v.col)
        got = v.col.cast("long").bitwiseAND(F.lit(mask).cast("long"))
        hit = {"$bitsAllSet": got == mask, "$bitsAnySet": got != 0, "$bitsAllClear": got == 0, "$bitsAnyClear": got != mask}[op]
        return whole & hit

    return lambda v: _elements(v, test)


def _type_test(arg: Any, strict: bool):
    said = arg if isinstance(arg, (list, tuple)) else [arg]
    names = []
    for s in said:
        name = _TYPE_CODES.get(s) if isinstance(s, (int, float)) and not isinstance(s, bool) else s
        if name != "number" and name not in _TYPE_CODES.values():
            raise CompileError(f"unknown type {s}")
        if strict and name in _UNSTORABLE:
            raise CompileError(f"no value has the type {name}")
        names += ["int", "double"] if name == "number" else [name]
    if not names:
        raise CompileError("$type needs a type")

    def test(v: Value) -> Column:
        if v.kind == "null":
            return F.lit(False)
        return v.col.isNotNull() & V.type_alias(v).isin(names)

    def null(v: Value) -> Column:
        return F.exists(v.col, lambda x: x.isNull()) | v.stored_null if v.kind == "array" else v.stored_null

    return lambda v: _elements(v, test) | null(v) if "null" in names else _elements(v, test)


def element_test(crit: Any, c: Context):
    """A test of one array element by an ``$elemMatch`` criterion."""
    if not isinstance(crit, dict):
        raise CompileError("$elemMatch needs a document")

    def test(x: Value) -> Column:
        if not crit:
            return x.col.isNotNull() if x.kind in ("object", "array") else F.lit(False)
        parts = []
        operators = {k: v for k, v in crit.items() if k.startswith("$") and k not in ("$and", "$or", "$nor")}
        if "$expr" in operators:
            raise CompileError("$expr is not allowed in $elemMatch")
        if operators:
            parts.append(criterion(operators, lambda leaf: leaf(x), c, inside=True))
        for key, value in crit.items():
            if key in ("$and", "$or", "$nor"):
                each = [element_test(v, c)(x) for v in value]
                parts.append(all_of(each) if key == "$and" else any_of(each) if key == "$or" else negated(any_of(each)))
            elif not key.startswith("$"):
                segments = paths.check(key)
                parts.append(criterion(value, lambda leaf, s=segments: paths.matched(x, s, leaf, strict=c.strict), c))
        return all_of(parts)

    return test


def _operator(op: str, arg: Any, whole: dict, at, c: Context, inside: bool) -> Column:
    if op == "$eq":
        return _equal(at, arg)
    if op == "$ne":
        if isinstance(arg, re.Pattern):
            raise CompileError("$ne takes no regular expression")
        return negated(_equal(at, arg))
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return at(_range(op, arg))
    if op in ("$in", "$nin"):
        if not isinstance(arg, (list, tuple)):
            raise CompileError(f"{op} needs a list")
        hit = _in(at, arg)
        return hit if op == "$in" else negated(hit)
    if op == "$not":
        if not isinstance(arg, re.Pattern) and not is_criterion(arg):
            raise CompileError("$not needs operators or a regular expression")
        return negated(criterion(arg, at, c, inside))
    if op == "$exists":
        if not isinstance(arg, (bool, int)):
            raise CompileError("$exists is true or false")
        there = at(lambda v: v.present)
        return there if arg else negated(there)
    if op == "$type":
        return at(_type_test(arg, c.strict))
    if op == "$regex":
        pattern, flags = from_compiled(arg) if isinstance(arg, re.Pattern) else (arg, "")
        if not isinstance(pattern, str):
            raise CompileError("$regex needs a pattern")
        flags = whole.get("$options", flags)
        if "x" in flags:
            raise CompileError("the flag x is not supported")
        return at(lambda v: _elements(v, _regex(pattern, flags)))
    if op == "$mod":
        if not isinstance(arg, (list, tuple)) or len(arg) != 2:
            raise CompileError("$mod needs [divisor, remainder]")
        if any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in arg):
            raise CompileError("$mod needs numbers")
        d, r = int(arg[0]), int(arg[1])
        if d == 0:
            raise CompileError("$mod by zero")
        test = lambda v: v.col.try_cast("long") % d == r if v.kind == "number" else F.lit(False)
        return at(lambda v: _elements(v, test))
    if op == "$all":
        if not isinstance(arg, (list, tuple)):
            raise CompileError("$all needs a list")
        if not arg:
            return F.lit(False)
        return all_of([criterion(x, at, c) if isinstance(x, dict) and "$elemMatch" in x or isinstance(x, re.Pattern) else _equal(at, x) for x in arg])
    if op == "$elemMatch":
        test = element_test(arg, c)
        test(V.missing())  # a malformed criterion is an error whatever the field holds

        def some(v: Value) -> Column:
            return F.exists(v.col, lambda x: test(Value(x, v.type.elementType))) if v.kind == "array" else F.lit(False)

        return at(some)
    if op == "$size":
        n = _whole(arg, "$size", 0)
        return at(lambda v: F.size(v.col) == n if v.kind == "array" else F.lit(False))
    if op in ("$bitsAllSet", "$bitsAnySet", "$bitsAllClear", "$bitsAnyClear"):
        return at(_bits(op, arg))
    if op in _REFUSED or op == "$expr":
        raise CompileError(f"{op} is not allowed in a field's criterion")
    raise CompileError(f"unknown filter operator {op}")


def _in(at, members: list) -> Column:
    """Plain members of one kind become one ``IN``; others are matched one by one."""
    arms, by_kind = [], {}
    for m in members:
        if is_criterion(m):
            raise CompileError("$in takes values")
        if m is None:
            arms.append(at(_is_null))
        elif isinstance(m, re.Pattern):
            arms.append(at(lambda v, m=m: _elements(v, _regex(*from_compiled(m)))))
        elif isinstance(m, (dict, list, tuple)):
            arms.append(_equal(at, m))
        else:
            by_kind.setdefault(literal(m).kind, []).append(m)
    for k, own in by_kind.items():

        def test(v: Value, k=k, own=own) -> Column:
            if v.kind != k:
                return F.lit(False)
            if isinstance(v.type, T.FloatType):
                return v.col.isin([literal(m, v.type).col for m in own])
            return v.col.isin([bytes(m) if k == "binary" else m for m in own])

        arms.append(at(lambda v, test=test: _elements(v, test)))
    return any_of(arms)


__all__ = ["compile_filter", "criterion", "element_test", "is_criterion", "kind", "WrongType"]
