"""Date, type and conversion operators; dates are read in UTC."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError
from ..plans import values as V
from ..plans.values import BOOL, DOUBLE, INT, INT32, LONG, STRING, Value
from .core import args, compile_expression, double, need, operator, options


def _date(c, arg, name):
    if isinstance(arg, dict) and "date" in arg:
        if "timezone" in arg:
            raise CompileError(f"{name} takes no timezone")
        arg = options(arg, "date", name=name)["date"]
    (v,) = args(c, arg, 1, name=name)
    v = need(c, v, "date", name)
    return v if v.kind == "date" else Value(F.lit(None).cast("timestamp_ntz"), T.TimestampNTZType())


_PARTS = {
    "$year": F.year, "$month": F.month, "$dayOfMonth": F.dayofmonth, "$hour": F.hour, "$minute": F.minute, "$second": F.second,
    "$dayOfWeek": F.dayofweek, "$dayOfYear": F.dayofyear, "$millisecond": lambda d: F.date_format(d, "SSS").cast("int"),
}


@operator(*_PARTS)
def _part(c, arg, name):
    return Value(_PARTS[name](_date(c, arg, name).col).cast("int"), INT)


# Format specifiers and what the engine writes for them.
_FORMATS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "L": "SSS", "j": "DDD"}
_DEFAULT = "%Y-%m-%dT%H:%M:%S.%LZ"


def formatted(d, said: str):
    pieces, at, text = [], 0, ""
    while at < len(said):
        ch = said[at]
        if ch != "%":
            text += ch
            at += 1
            continue
        spec = said[at + 1 : at + 2]
        at += 2
        if spec in ("%", "z", "Z"):
            text += {"%": "%", "z": "+0000", "Z": "+0"}[spec]
            continue
        pieces.append(F.lit(text))
        text = ""
        if spec == "w":
            pieces.append(F.dayofweek(d).cast("string"))
        elif spec in _FORMATS:
            pieces.append(F.date_format(d, _FORMATS[spec]))
        else:
            raise CompileError(f"unknown date format %{spec}")
    return F.concat(*pieces, F.lit(text))


@operator("$dateToString")
def _date_to_string(c, arg):
    said = options(arg, "date", "format onNull", "$dateToString")
    v = _date(c, [said["date"]], "$dateToString")
    out = formatted(v.col, said.get("format") or _DEFAULT)
    if "onNull" in said:
        other = compile_expression(c, said["onNull"])
        out = F.when(v.col.isNull(), other.col.cast("string")).otherwise(out)
    return Value(out, STRING)


@operator("$type")
def _type(c, arg):
    (v,) = args(c, arg, 1, name="$type")
    return Value(V.type_alias(v), STRING)


@operator("$isNumber")
def _is_number(c, arg):
    (v,) = args(c, arg, 1, name="$isNumber")
    return Value(v.col.isNotNull() if v.kind == "number" else F.lit(False), BOOL)


def _number_text(v: Value):
    """As the shortest decimal form: whole numbers without a fraction."""
    if V.is_integral(v.type):
        return v.col.cast("string")
    d = double(v)
    return F.when((d == F.floor(d)) & (F.abs(d) < 1e15), F.floor(d).cast("string")).otherwise(d.cast("string"))


def to_string(c, v: Value):
    if v.kind == "number":
        return _number_text(v)
    if v.kind == "date":
        return formatted(v.col, _DEFAULT)
    if v.kind in ("string", "bool", "null"):
        return v.col.cast("string")
    return None


def to_bool(c, v: Value):
    if v.kind == "bool":
        return v.col
    return F.when(v.col.isNotNull(), v.col != 0 if v.kind == "number" else F.lit(True))


def to_double(c, v: Value):
    if v.kind in ("number", "null"):
        return double(v)
    if v.kind == "bool":
        return v.col.cast("int").cast("double")
    if v.kind == "date":
        return F.unix_millis(v.col.cast("timestamp")).cast("double")
    if v.kind == "string":
        return v.col.try_cast("double")
    return None


def to_whole(c, v: Value, kind: str):
    if v.kind == "string":
        return F.when(F.trim(v.col).rlike(r"^[+-]?\d+$"), v.col.try_cast(kind))
    if v.kind == "date":
        return F.unix_millis(v.col.cast("timestamp")) if kind == "long" else None
    if v.kind in ("number", "null"):
        d = v.col if V.is_integral(v.type) or v.kind == "null" else F.when(double(v) >= 0, F.floor(double(v))).otherwise(F.ceil(double(v)))
        return d.try_cast(kind)
    return v.col.cast(kind) if v.kind == "bool" else None


def to_date(c, v: Value):
    if v.kind == "date":
        return v.col.cast("timestamp")
    if v.kind == "string":
        return F.try_to_timestamp(v.col)
    if v.kind == "number" and not isinstance(v.type, T.IntegerType):
        return F.timestamp_millis(v.col.cast("long"))
    return F.lit(None).cast("timestamp") if v.kind == "null" else None


_TARGETS = {
    "double": (to_double, DOUBLE), "int": (lambda c, v: to_whole(c, v, "int"), INT), "long": (lambda c, v: to_whole(c, v, "long"), LONG),
    "bool": (to_bool, BOOL), "string": (to_string, STRING), "date": (to_date, T.TimestampType()),
}
# Numeric codes of the conversion targets.
_CODES = {1: "double", 2: "string", 8: "bool", 9: "date", 16: "int", 18: "long"}


def _converted(c, v: Value, target: str, name: str):
    f, t = _TARGETS[target]
    out = f(c, v)
    return (F.lit(None).cast(t) if out is None else out), t, v.col.isNotNull() if out is None else v.col.isNotNull() & out.isNull()


@operator("$toString", "$toBool", "$toInt", "$toDouble", "$toDate", "$toLong")
def _to(c, arg, name):
    (v,) = args(c, arg, 1, name=name)
    out, t, fault = _converted(c, v, name[3:].lower(), name)
    return Value(c.guard(fault, f"{name} cannot convert the value", out), t)


@operator("$convert")
def _convert(c, arg):
    said = options(arg, "input to", "onError onNull", "$convert")
    target = _CODES.get(said["to"], said["to"]) if not isinstance(said["to"], dict) else None
    if target not in _TARGETS:
        raise CompileError(f"$convert cannot convert to {said['to']}")
    v = compile_expression(c, said["input"])
    out, t, fault = _converted(c, v, target, "$convert")
    if "onError" in said:
        out = F.when(fault, V.cast(compile_expression(c, said["onError"]), t)).otherwise(out)
    else:
        out = c.guard(fault, "$convert cannot convert the value", out)
    if "onNull" in said:
        out = F.when(v.col.isNull(), V.cast(compile_expression(c, said["onNull"]), t)).otherwise(out)
    return Value(out, t)


__all__ = ["INT32"]
