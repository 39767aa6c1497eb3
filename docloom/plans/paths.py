"""Dotted paths against a schema, by the rules of each language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError
from .values import NULL, Value, any_of, missing

#: Arrays that a filter path may cross
MOST_ARRAYS = 2


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def field(v: Value, name: str) -> Value:
    """A field of an object, missing if there is none."""
    if isinstance(v.type, T.StructType):
        inner = None if v.path is None else f"{v.path}.{name}"
        return Value(v.col.getField(name), v.type[name].dataType, path=inner) if name in v.type.names else missing()
    if isinstance(v.type, T.MapType) and isinstance(v.type.keyType, T.StringType):
        return Value(F.try_element_at(v.col, F.lit(name)), v.type.valueType)
    return missing()


def check(path: str) -> list[str]:
    parts = path.split(".")
    if not all(parts):
        raise CompileError(f"'{path}' is not a path")
    return parts


def plain(root: Callable[[str], Value], path: str, strict: bool = False) -> Value:
    """Expression paths, sort keys and ``distinct``: an array on the way reads as missing."""
    first, *rest = check(path)
    v = root(first)
    for name in rest:
        if v.kind == "array" and strict:
            raise CompileError(f"'{path}' goes through an array")
        v = field(v, name)
    return v


def matched(v: Value, parts: list[str], leaf: Callable[[Value], Column], *, strict: bool = False, crossed: int = 0) -> Column:
    """Filter paths: true if ``leaf`` holds at the end of the path for the value or any element on the way.

    A number also picks the element of that position.  ``leaf`` sees each end as it is,
    arrays too; it looks into those itself.  The result may be null, which is no match.
    """
    if not parts:
        return leaf(v)
    if v.kind != "array":
        return matched(field(v, parts[0]), parts[1:], leaf, strict=strict, crossed=crossed)
    arms = []
    element = v.type.elementType
    if parts[0].isdigit():
        picked = Value(F.get(v.col, F.lit(int(parts[0]))), element)
        arms.append(matched(picked, parts[1:], leaf, strict=strict, crossed=crossed))
    if crossed < MOST_ARRAYS:
        if not isinstance(element, T.ArrayType):
            arms.append(F.exists(v.col, lambda x: matched(Value(x, element), parts, leaf, strict=strict, crossed=crossed + 1)))
    elif strict:
        raise CompileError(f"a path may cross {MOST_ARRAYS} arrays")
    # no array at all: the path is missing
    arms.append(v.col.isNull() & leaf(missing()))
    return any_of(arms)


def root_of(schema: T.StructType, prefix: Column | None = None, nulls: bool = False) -> Callable[[str], Value]:
    """Top-level fields of rows with this schema; ``prefix``: of a struct column instead; ``nulls``: they are recorded."""

    def get(name: str) -> Value:
        if name not in schema.names:
            return missing()
        if prefix is not None:
            return Value(prefix.getField(name), schema[name].dataType)
        return Value(F.col(quoted(name)), schema[name].dataType, path=name if nulls else None)

    return get


def type_at(schema: T.DataType, parts: list[str]) -> T.DataType:
    """Type at a path through objects only; ``NullType`` if there is none."""
    t = schema
    for p in parts:
        if not isinstance(t, T.StructType) or p not in t.names:
            return NULL
        t = t[p].dataType
    return t
