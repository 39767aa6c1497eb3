"""Update documents: each one a new value for the top-level columns of a matched row.

All operators read the document as it was.  Two operators may not touch the same path
or one inside another.  A guard is a condition under which the update is refused; the
guards of all matched rows are looked at before anything is written.
"""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError
from ..functions import Context
from ..functions.collections import ordering, sliced, sorted_array, taken
from ..plans import paths
from ..plans import values as V
from ..plans.values import Value, literal
from .filters import criterion, element_test, is_criterion, negated
from .projection import ID, _criterion_of

FIELD_OPS = ("$set", "$unset", "$inc", "$mul", "$bit", "$min", "$max", "$rename", "$currentDate", "$setOnInsert")
ARRAY_OPS = ("$push", "$addToSet", "$pop", "$pull", "$pullAll")
_STEP = re.compile(r"^\$(\[(?P<id>[A-Za-z][A-Za-z0-9]*)?\])?$")

#: What an operator returns to remove the field
GONE = object()


@dataclass
class Guard:
    fault: Column
    message: str


@dataclass
class Update:
    """New values by top-level field; ``None`` removes the field."""

    values: dict[str, Value | None]
    guards: list[Guard] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    cleared: list[str] = field(default_factory=list)  # paths whose nulls go
    nulled: list[str] = field(default_factory=list)  # paths that hold a null afterwards


@dataclass
class _Work:
    c: Context
    query: dict
    filters: dict[str, Any]
    used: set[str] = field(default_factory=set)
    guards: list[Guard] = field(default_factory=list)


def compile_update(c: Context, said: dict, query: dict | None = None, array_filters: list[dict] | None = None, *, inserting: bool = False) -> Update:
    if not isinstance(said, dict) or not said:
        raise CompileError("an update is a document of operators")
    if odd := [k for k in said if k not in FIELD_OPS + ARRAY_OPS]:
        raise CompileError(f"unknown update operator {odd[0]}" if odd[0].startswith("$") else "an update has operators only; use replace for whole documents")
    work = _Work(c, query or {}, _filters(array_filters))
    steps: list[tuple[str, Any]] = []
    now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    for op, fields in said.items():
        if not isinstance(fields, dict) or not fields:
            raise CompileError(f"{op} needs a document with fields")
        for path, arg in fields.items():
            if op == "$setOnInsert" and not inserting:
                paths.check(path)
                continue
            if op == "$rename":
                steps += _rename(work, path, arg)
            else:
                steps.append((path, _change(work, op, arg, now)))
    touched = [p for p, _ in steps]
    _no_conflicts(touched)
    if unused := set(work.filters) - work.used - {i for p in touched for i in re.findall(r"\$\[([A-Za-z]\w*)\]", p)}:
        raise CompileError(f"the array filter {', '.join(sorted(unused))} is not used")
    out: dict[str, Value | None] = {}
    for path, change in steps:
        first, *rest = paths.check(path)
        if first == ID and not inserting and change is not _same:
            work.guards.append(Guard(F.lit(True), "_id cannot change"))
        if first.startswith("$"):
            raise CompileError(f"'{path}' is not a path")
        now_value = out[first] if first in out else c.root(first)
        got = _apply(work, now_value or V.missing(), rest, change, first)
        out[first] = None if got is GONE else got
    return Update(out, work.guards, touched, *_nulls(said, inserting))


def _nulls(said: dict, inserting: bool) -> tuple[list[str], list[str]]:
    """The paths whose nulls go, and those that hold one afterwards; elements of arrays have none recorded."""
    cleared, nulled = [], []
    for op, fields in said.items():
        for path, arg in fields.items():
            if op in ("$unset", "$rename"):
                cleared += [path, arg] if op == "$rename" else [path]
            elif op == "$set" or op == "$setOnInsert" and inserting:
                cleared.append(path)
                nulled += [path] if arg is None else [f"{path}.{p}" for p in V.null_paths(arg)] if isinstance(arg, dict) else []
    return cleared, nulled


def _filters(said: list[dict] | None) -> dict[str, Any]:
    out = {}
    for f in said or []:
        names = {k.split(".")[0] for k in f}
        if len(names) != 1:
            raise CompileError("an array filter is about one identifier")
        (name,) = names
        if name in out:
            raise CompileError(f"two array filters for {name}")
        crit: dict = {}
        for k, v in f.items():
            if k == name:
                crit |= v if is_criterion(v) else {"$eq": v}
            else:
                crit[k[len(name) + 1 :]] = v
        out[name] = crit
    return out


def _no_conflicts(touched: list[str]) -> None:
    for i, a in enumerate(touched):
        for b in touched[i + 1 :]:
            if a == b or a.startswith(b + ".") or b.startswith(a + "."):
                raise CompileError(f"'{a}' and '{b}' are in conflict", 40)


def _apply(work: _Work, v: Value, way: list[str], change, done: str) -> Any:
    """``v`` with the change at the end of the way; missing parents come into being."""
    if not way:
        return change(v)
    step, rest = way[0], way[1:]
    m = _STEP.match(step)
    if m:
        return _each(work, v, m, rest, change, done)
    if v.kind == "array":
        if not step.isdigit():
            raise CompileError(f"'{done}' is an array: name elements by position, $, $[] or $[id]")
        return _element(work, v, F.lit(int(step)), rest, change, f"{done}.{step}", int(step))
    if isinstance(v.type, T.MapType):
        got = _apply(work, paths.field(v, step), rest, change, f"{done}.{step}")
        keys = F.map_filter(v.col, lambda k, _: k != step)
        if got is GONE:
            return Value(keys, v.type)
        return Value(F.map_concat(keys, F.create_map(F.lit(step), V.cast(got, v.type.valueType))), v.type)
    fields = {}
    if isinstance(v.type, T.StructType):
        fields = {f.name: Value(v.col[f.name], f.dataType) for f in v.type.fields}
    elif v.kind != "null":
        work.guards.append(Guard(v.col.isNotNull(), f"'{done}' holds a {v.kind}, not an object"))
        return v
    got = _apply(work, fields.get(step, V.missing()), rest, change, f"{done}.{step}")
    if got is GONE:
        if step not in fields:
            return v
        fields.pop(step)
        out = _struct(fields)
        return Value(F.when(v.col.isNotNull(), out.col), out.type)
    fields[step] = got
    return _struct(fields)


def _struct(fields: dict[str, Value]) -> Value:
    t = T.StructType([T.StructField(n, x.type) for n, x in fields.items()])
    return Value(F.struct(*[x.col.alias(n) for n, x in fields.items()]), t)


def _inner(work: _Work, x: Value, rest: list[str], change, done: str) -> Value:
    """An element after the change; a removed element is null."""
    before = len(work.guards)
    got = _apply(work, x, rest, change, done)
    # a guard inside an array cannot be evaluated for the row: it holds if any element is at fault
    del work.guards[before:]
    return Value(F.lit(None).cast(x.type), x.type) if got is GONE else got


def _element(work, v, at, rest, change, done, place):
    element = v.type.elementType
    probe = _inner(work, Value(F.lit(None).cast(element), element), rest, change, done)
    t = V.common([element, probe.type])

    def one(x, i):
        return F.when(i == at, V.cast(_inner(work, Value(x, element), rest, change, done), t)).otherwise(V.cast(Value(x, element), t))

    out = F.transform(v.col, one)
    if place is not None:  # a position past the end: nulls fill the gap
        size = F.coalesce(F.size(v.col), F.lit(0))
        new = V.cast(probe, t)
        more = F.concat(out, F.array_repeat(F.lit(None).cast(t), F.greatest(F.lit(place) - size, F.lit(0))), F.array(new))
        out = F.when(size > place, out).otherwise(more)
    return Value(out, T.ArrayType(t))


def _each(work, v, m, rest, change, done):
    if v.kind != "array":
        work.guards.append(Guard(F.lit(True) if v.kind == "null" else v.col.isNotNull(), f"'{done}' is not an array"))
        return v
    work.guards.append(Guard(v.col.isNull(), f"'{done}' is not an array"))
    element, said = v.type.elementType, m.group(0)
    if said == "$":
        crit = _criterion_of(work.query, done)
        if crit is None:
            raise CompileError(f"the filter asks nothing of '{done}', so $ names no element")
        test = _value_test(crit.get("$elemMatch", crit) if isinstance(crit, dict) else crit, work.c)
        hits = F.transform(v.col, lambda x, i: F.when(V.true(test(Value(x, element))), i))
        first = F.array_min(F.filter(hits, lambda i: i.isNotNull()))
        work.guards.append(Guard(first.isNull(), f"no element of '{done}' matches the filter"))
        return _element(work, v, first, rest, change, done + ".$", None)
    name = m.group("id")
    if name is None:
        test = lambda x: F.lit(True)
    else:
        if name not in work.filters:
            raise CompileError(f"there is no array filter for {name}")
        work.used.add(name)
        test = _value_test(work.filters[name], work.c)
    probe = _inner(work, Value(F.lit(None).cast(element), element), rest, change, done)
    t = V.common([element, probe.type])

    def one(x):
        changed = V.cast(_inner(work, Value(x, element), rest, change, done), t)
        return F.when(V.true(test(Value(x, element))), changed).otherwise(V.cast(Value(x, element), t))

    return Value(F.transform(v.col, one), T.ArrayType(t))


def _value_test(crit: Any, c: Context):
    """Whether an element satisfies a criterion, a document of fields, or equals a value."""
    if isinstance(crit, dict):
        return element_test(crit, c)
    return lambda x: criterion(crit, lambda leaf: leaf(x), c)


# --- changes ----------------------------------------------------------------------------


def _same(v: Value) -> Value:
    return v


def _change(work: _Work, op: str, arg: Any, now) -> Any:
    c = work.c
    if op in ("$set", "$setOnInsert"):
        return lambda v: _cast_null(literal(arg), v)
    if op == "$unset":
        return lambda v: GONE
    if op in ("$inc", "$mul"):
        if isinstance(arg, bool) or not isinstance(arg, (int, float)):
            raise CompileError(f"{op} needs a number")
        by = literal(arg)

        def arithmetic(v: Value) -> Value:
            if v.kind not in ("number", "null"):
                work.guards.append(Guard(v.col.isNotNull(), f"{op} needs a number"))
                return v
            whole = V.is_integral(by.type) and (v.kind == "null" or V.is_integral(v.type))
            t = V.LONG if whole else V.DOUBLE
            start = F.coalesce(v.col.cast(t), F.lit(0).cast(t))
            return Value(start + by.col.cast(t) if op == "$inc" else start * by.col.cast(t), t)

        return arithmetic
    if op == "$bit":
        if not isinstance(arg, dict) or not arg or set(arg) - {"and", "or", "xor"} or any(isinstance(x, bool) or not isinstance(x, int) for x in arg.values()):
            raise CompileError("$bit needs and, or, xor with whole numbers")

        def bits(v: Value) -> Value:
            if v.kind != "null" and not V.is_integral(v.type):
                work.guards.append(Guard(v.col.isNotNull(), "$bit needs a whole number"))
                return v
            out = F.coalesce(v.col.cast("long"), F.lit(0).cast("long"))
            for name, x in arg.items():
                own = F.lit(x).cast("long")
                out = {"and": out.bitwiseAND, "or": out.bitwiseOR, "xor": out.bitwiseXOR}[name](own)
            return Value(out, V.LONG)

        return bits
    if op in ("$min", "$max"):
        new = literal(arg)

        def extreme(v: Value) -> Value:
            if v.kind == "null":
                return new
            if v.kind != new.kind:
                keep = (v.rank < new.rank) == (op == "$min")
                if keep:
                    columns, t = [v.col], v.type
                    return Value(columns[0], t)
                raise CompileError(f"{op} would change the type of the field")
            (a, b), t = V.unified([v, new])
            better = b < a if op == "$min" else b > a
            return Value(F.when(a.isNull() | better, b).otherwise(a), t)

        return extreme
    if op == "$currentDate":
        if arg is not True and arg != {"$type": "date"}:
            raise CompileError("$currentDate takes true or {$type: 'date'}")
        return lambda v: literal(now)
    return _array_change(work, op, arg, c)


def _cast_null(new: Value, old: Value) -> Value:
    """A null keeps the type of the field."""
    return Value(F.lit(None).cast(old.type), old.type) if new.kind == "null" and old.kind != "null" else new


def _as_array(work: _Work, v: Value, element: T.DataType, op: str) -> Value | None:
    """The field as an array that can hold ``element``; a missing one is empty."""
    if v.kind not in ("array", "null"):
        work.guards.append(Guard(v.col.isNotNull(), f"{op} needs an array"))
        return None
    t = V.common([v.type.elementType if v.kind == "array" else V.NULL, element])
    t = t if not isinstance(t, T.NullType) else V.STRING
    kind = T.ArrayType(t)
    return Value(F.coalesce(V.cast(v, kind), F.array().cast(kind)), kind)


def _array_change(work, op, arg, c):
    if op in ("$push", "$addToSet"):
        each = arg["$each"] if isinstance(arg, dict) and "$each" in arg else [arg]
        if not isinstance(each, (list, tuple)):
            raise CompileError("$each needs a list")
        more = {k: v for k, v in arg.items() if k != "$each"} if isinstance(arg, dict) and "$each" in arg else {}
        if odd := set(more) - ({"$position", "$slice", "$sort"} if op == "$push" else set()):
            raise CompileError(f"{op} does not know {', '.join(sorted(odd))}")
        new = literal(list(each))
        element = new.type.elementType

        def add(v: Value) -> Value:
            a = _as_array(work, v, element, op)
            if a is None:
                return v
            items = V.cast(new, a.type) if each else F.array().cast(a.type)
            if op == "$addToSet":
                t = a.type.elementType
                fresh = F.filter(F.array_distinct(items), lambda x: negated(F.exists(a.col, lambda y: V.equals(Value(y, t), Value(x, t)))))
                return Value(F.concat(a.col, fresh), a.type)
            if "$position" in more:
                at = F.lit(int(more["$position"]))
                size = F.size(a.col)
                cut = F.when(at < 0, F.greatest(size + at, F.lit(0))).otherwise(F.least(at, size))
                out = F.concat(F.slice(a.col, F.lit(1), cut), items, F.slice(a.col, cut + 1, size))
            else:
                out = F.concat(a.col, items)
            if "$sort" in more:
                ordering(a.type.elementType, more["$sort"])
                out = sorted_array(Value(out, a.type), more["$sort"])
            if "$slice" in more:
                out = taken(out, F.lit(int(more["$slice"])))
            return Value(out, a.type)

        return add
    if op == "$pop":
        if arg not in (1, -1) or isinstance(arg, bool):
            raise CompileError("$pop takes 1 or -1")

        def pop(v: Value) -> Value:
            if v.kind != "array":
                if v.kind != "null":
                    work.guards.append(Guard(v.col.isNotNull(), "$pop needs an array"))
                return v if v.kind != "null" else GONE
            n = F.greatest(F.size(v.col) - 1, F.lit(0))
            return Value(sliced(v.col, F.lit(0) if arg == 1 else F.least(F.lit(1), F.size(v.col)), n), v.type)

        return pop
    if op == "$pullAll" and not isinstance(arg, (list, tuple)):
        raise CompileError("$pullAll needs a list")

    def pull(v: Value) -> Value:
        if v.kind != "array":
            if v.kind != "null":
                work.guards.append(Guard(v.col.isNotNull(), f"{op} needs an array"))
            return v if v.kind != "null" else GONE
        element = v.type.elementType
        if op == "$pullAll":
            test = lambda x: reduce(lambda a, b: a | b, [V.equals(x, literal(m, x.type)) for m in arg], F.lit(False))
        else:
            test = _value_test(arg, c)
        return Value(F.filter(v.col, lambda x: negated(test(Value(x, element)))), v.type)

    return pull


def _rename(work: _Work, old: str, new: Any) -> list[tuple[str, Any]]:
    if not isinstance(new, str) or not new or new == old:
        raise CompileError("$rename needs another field name")
    for p in (old, new):
        if any(_STEP.match(s) for s in paths.check(p)):
            raise CompileError("$rename does not go into arrays")
    source = paths.plain(work.c.root, old)

    def arrive(v: Value) -> Value:
        if source.kind == "null":
            return v if v.kind != "null" else GONE
        if v.kind == "null":
            return source
        columns, t = V.unified([source, v])
        return Value(F.coalesce(*columns), t)

    return [(old, lambda v: GONE), (new, arrive)]


# --- upserts ------------------------------------------------------------------------------


def seed(query: dict) -> dict:
    """The document that a filter's equalities describe."""
    out: dict = {}

    def put(path: str, value: Any) -> None:
        node = out
        *way, last = path.split(".")
        for p in way:
            node = node.setdefault(p, {})
        node[last] = value

    for k, v in query.items():
        if k == "$and":
            for sub in v:
                for p, x in seed(sub).items():
                    put(p, x)
        elif not k.startswith("$") and not isinstance(v, re.Pattern):
            if not is_criterion(v):
                put(k, v)
            elif "$eq" in v:
                put(k, v["$eq"])
    return out
