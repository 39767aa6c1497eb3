"""Typed columns: the values that all compilers work with.

A value is a Column with its static Spark type.  SQL NULL stands for "missing"; a value
whose type is ``NullType`` is missing in every row.  Fields that hold a null are told from
missing ones by the hidden column ``NULLS``, which only collections with such fields have.
"""

from __future__ import annotations

import datetime
import decimal
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError

INT32 = (-(2**31), 2**31 - 1)
#: Least and greatest size of a number that a float holds in full precision
FLOAT32 = (2.0**-126, (2 - 2.0**-23) * 2.0**127)
NULL, BOOL, INT, LONG, FLOAT, DOUBLE, STRING, BINARY = (
    T.NullType(), T.BooleanType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.StringType(), T.BinaryType(),
)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
_DATES = (T.TimestampType, T.TimestampNTZType, T.DateType)
#: Order of the kinds of values when they are compared or sorted together
RANKS = ("null", "number", "string", "object", "array", "binary", "bool", "date")

#: Hidden column: dotted paths, through objects, of the fields of a document that hold a null
NULLS = "_nulls"


@dataclass
class Value:
    col: Column
    type: T.DataType
    sure: bool = False  # a boolean that is never null
    path: str | None = None  # where the value lies in a document whose nulls are recorded

    @property
    def stored_null(self) -> Column:
        """Whether the field is there and holds a null."""
        if self.path is None:
            return F.lit(False)
        return self.col.isNull() & true(F.array_contains(F.col(NULLS), F.lit(self.path)))

    @property
    def present(self) -> Column:
        return self.col.isNotNull() if self.path is None else self.col.isNotNull() | self.stored_null

    @property
    def kind(self) -> str:
        return kind(self.type)

    @property
    def rank(self) -> int:
        return RANKS.index(self.kind)


def kind(t: T.DataType) -> str:
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, (*_INTEGRAL, *_FRACTIONAL)):
        return "number"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, (T.StructType, T.MapType)):
        return "object"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, T.BinaryType):
        return "binary"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, _DATES):
        return "date"
    raise CompileError(f"columns of type {t.simpleString()} are not supported")


def is_integral(t: T.DataType) -> bool:
    return isinstance(t, _INTEGRAL)


def true(c: Column) -> Column:
    """Two-valued: an unknown predicate is false."""
    return F.coalesce(c, F.lit(False))


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def missing() -> Value:
    return Value(F.lit(None), NULL)


def literal_type(v: Any, like: T.DataType | None = None) -> T.DataType:
    """The type of a literal; beside a field of type ``like`` a number is a float where the field has floats."""
    if v is None:
        return NULL
    if isinstance(v, bool):
        return BOOL
    if isinstance(like, T.FloatType) and isinstance(v, (int, float, decimal.Decimal)) and (v == 0 or FLOAT32[0] <= abs(v) <= FLOAT32[1]):
        return FLOAT
    if isinstance(v, int):
        return INT if INT32[0] <= v <= INT32[1] else LONG
    if isinstance(v, (float, decimal.Decimal)):
        if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
            raise CompileError("NaN and infinity are not values")
        return DOUBLE
    if isinstance(v, str):
        return STRING
    if isinstance(v, (bytes, bytearray)):
        return BINARY
    if isinstance(v, datetime.datetime):
        return T.TimestampType() if v.tzinfo else T.TimestampNTZType()
    if isinstance(v, datetime.date):
        return T.DateType()
    if isinstance(v, (list, tuple)):
        of = like.elementType if isinstance(like, T.ArrayType) else None
        return T.ArrayType(common([literal_type(x, of) for x in v]))
    if isinstance(v, dict):
        own = {f.name: f.dataType for f in like.fields} if isinstance(like, T.StructType) else {}
        return T.StructType([T.StructField(str(k), literal_type(x, own.get(str(k)))) for k, x in v.items()])
    raise CompileError(f"a {type(v).__name__} is not a value")


def literal(v: Any, like: T.DataType | None = None) -> Value:
    t = literal_type(v, like)
    return Value(_literal(v, t), t)


def _literal(v: Any, t: T.DataType) -> Column:
    if v is None:
        return F.lit(None) if isinstance(t, T.NullType) else F.lit(None).cast(t)
    if isinstance(t, T.ArrayType):
        if not v:
            return F.array().cast(T.ArrayType(t.elementType if not isinstance(t.elementType, T.NullType) else STRING))
        return F.array(*[_literal(x, t.elementType) for x in v])
    if isinstance(t, T.StructType):
        if not t.fields:
            return F.struct()
        return F.struct(*[_literal(v.get(f.name), f.dataType).alias(f.name) for f in t.fields])
    if isinstance(t, T.BinaryType):
        return F.lit(bytes(v))
    if isinstance(v, bool) or kind(t) in ("string", "date"):
        return F.lit(v)
    return F.lit(v).cast(t)


def common(types: list[T.DataType]) -> T.DataType:
    """The type that holds values of all the types; an error if there is none."""
    own = [t for t in types if not isinstance(t, T.NullType)]
    if not own:
        return NULL
    kinds = {kind(t) for t in own}
    if len(kinds) > 1:
        raise CompileError("values of different kinds in one place: " + ", ".join(sorted(kinds)))
    if all(t == own[0] for t in own):
        return own[0]
    k = kinds.pop()
    if k == "number":
        if all(map(is_integral, own)):
            return LONG if any(isinstance(t, T.LongType) for t in own) else INT
        return DOUBLE
    if k == "array":
        return T.ArrayType(common([t.elementType for t in own]))
    if k == "object" and all(isinstance(t, T.StructType) for t in own):
        names = list(dict.fromkeys(f.name for t in own for f in t.fields))
        return T.StructType([T.StructField(n, common([t[n].dataType for t in own if n in t.names])) for n in names])
    if k == "date":
        return next((t for t in own if isinstance(t, T.TimestampType)), T.TimestampNTZType())
    return own[0]


def cast(v: Value, t: T.DataType) -> Column:
    """The column as type ``t``; structs are matched by field names."""
    if v.type == t:
        return v.col
    if isinstance(v.type, T.NullType):
        return F.lit(None).cast(t) if not isinstance(t, T.NullType) else v.col
    if isinstance(t, T.StructType) and isinstance(v.type, T.StructType):
        if [f.name for f in t.fields] == v.type.names:
            same = [cast(Value(v.col[f.name], v.type[f.name].dataType), f.dataType).alias(f.name) for f in t.fields]
        else:
            same = [
                (cast(Value(v.col[f.name], v.type[f.name].dataType), f.dataType) if f.name in v.type.names else F.lit(None).cast(f.dataType)).alias(f.name)
                for f in t.fields
            ]
        return F.when(v.col.isNotNull(), F.struct(*same))
    if isinstance(t, T.ArrayType) and isinstance(v.type, T.ArrayType):
        if isinstance(v.type.elementType, T.NullType) or isinstance(t.elementType, T.StructType):
            return F.transform(v.col, lambda x: cast(Value(x, v.type.elementType), t.elementType))
    return v.col.cast(t)


def unified(values: list[Value]) -> tuple[list[Column], T.DataType]:
    t = common([v.type for v in values])
    return [cast(v, t) for v in values], t


def truthy(v: Value) -> Column:
    """False, zero, null and missing are false; anything else is true."""
    if v.kind == "null":
        return F.lit(False)
    if v.kind == "bool":
        return v.col if v.sure else true(v.col)
    if v.kind == "number":
        return true(v.col != 0)
    return v.col.isNotNull()


def equals(a: Value, b: Value) -> Column:
    """Equality where missing equals missing only."""
    if a.kind == "null" or b.kind == "null" or a.kind != b.kind:
        return a.col.isNull() & b.col.isNull()
    x, y = _comparable(a, b)
    if x is None:
        return a.col.isNull() & b.col.isNull()
    return x.eqNullSafe(y)


def _comparable(a: Value, b: Value) -> tuple[Column, Column] | tuple[None, None]:
    """Both columns as one type that Spark compares; (None, None) if they are never equal."""
    if isinstance(a.type, T.StructType) and isinstance(b.type, T.StructType) and a.type.names != b.type.names:
        return None, None
    if isinstance(a.type, T.MapType) or isinstance(b.type, T.MapType):
        return F.to_json(a.col), F.to_json(b.col)
    try:
        (x, y), _ = unified([a, b])
    except CompileError:
        return None, None
    return x, y


def less(a: Value, b: Value) -> Column:
    """Strictly less in the order of kinds; missing is least."""
    if b.kind == "null":
        return F.lit(False)
    if a.kind == "null":
        return b.col.isNotNull()
    if a.kind != b.kind:
        low = F.lit(a.rank < b.rank)
        return F.when(a.col.isNull(), b.col.isNotNull()).when(b.col.isNull(), F.lit(False)).otherwise(low)
    x, y = _comparable(a, b)
    if x is None:
        x, y = F.to_json(a.col), F.to_json(b.col)
    return (x.isNull() & y.isNotNull()) | true(x < y)


def compare(op: str, a: Value, b: Value) -> Column:
    if op == "$eq":
        return equals(a, b)
    if op == "$ne":
        return ~equals(a, b)
    if op == "$lt":
        return less(a, b)
    if op == "$gt":
        return less(b, a)
    if op == "$lte":
        return ~less(b, a)
    if op == "$gte":
        return ~less(a, b)
    return F.when(less(a, b), F.lit(-1)).when(less(b, a), F.lit(1)).otherwise(F.lit(0))


def type_alias(v: Value) -> Column:
    """Name of a value's type; missing where there is none."""
    k = v.kind
    if k == "null":
        return F.lit("missing")
    if k == "number":
        if is_integral(v.type):
            name = F.lit("int") if not isinstance(v.type, T.LongType) else F.when(v.col.between(*INT32), "int").otherwise("double")
        else:
            name = F.when((v.col == F.floor(v.col)) & v.col.between(*INT32), "int").otherwise("double")
    else:
        name = F.lit({"binary": "binData"}.get(k, k))
    nothing = F.lit("missing") if v.path is None else F.when(v.stored_null, "null").otherwise("missing")
    return F.when(v.col.isNull(), nothing).otherwise(name)


def null_paths(doc: dict, before: str = "") -> list[str]:
    """Paths of the fields of a document, and of the objects in it, that hold a null."""
    out = []
    for k, x in doc.items():
        if x is None:
            out.append(before + k)
        elif isinstance(x, dict):
            out += null_paths(x, f"{before}{k}.")
    return out


def sort_key(v: Value) -> Column:
    """A column whose order is that of the values; arrays and maps order by their text."""
    return F.to_json(v.col) if v.kind == "array" or isinstance(v.type, T.MapType) else v.col
