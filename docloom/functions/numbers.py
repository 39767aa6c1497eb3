"""Arithmetic, trigonometry, comparison, boolean and conditional operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError
from ..plans import values as V
from ..plans.values import BOOL, DOUBLE, INT, LONG, Value
from .core import MANY, all_known, args, build_object, compile_expression, double, known, literal, missing, need, number, operator, options


def _integral(values) -> bool:
    return all(V.is_integral(v.type) or v.kind == "null" for v in values)


def _millis(v: Value):
    return F.unix_millis(v.col.cast("timestamp"))


def _moved(v: Value, ms):
    """A date moved by milliseconds, of the date's own type."""
    t = v.type if not isinstance(v.type, T.DateType) else T.TimestampNTZType()
    return Value(v.col.cast(t) + F.make_dt_interval(secs=ms.cast("decimal(18,6)") / 1000), t)


@operator("$add")
def _add(c, arg):
    got = args(c, arg, 0, MANY, "$add")
    dates = [v for v in got if v.kind == "date"]
    rest = [number(c, v, "$add") for v in got if v.kind != "date"]
    if len(dates) > 1:
        raise CompileError("$add takes one date at most")
    if dates:
        return _moved(dates[0], reduce(lambda a, b: a + b, [v.col for v in rest], F.lit(0)))
    if _integral(rest):
        return Value(reduce(lambda a, b: a + b, [v.col.cast("long") for v in rest], F.lit(0).cast("long")), LONG)
    return Value(reduce(lambda a, b: a + b, map(double, rest)), DOUBLE)


@operator("$subtract")
def _subtract(c, arg):
    a, b = args(c, arg, 2, name="$subtract")
    if a.kind == "date" and b.kind == "date":
        return Value(_millis(a) - _millis(b), LONG)
    if a.kind == "date":
        return _moved(a, -number(c, b, "$subtract").col)
    a, b = number(c, a, "$subtract"), number(c, b, "$subtract")
    if _integral([a, b]):
        return Value(a.col.cast("long") - b.col.cast("long"), LONG)
    return Value(double(a) - double(b), DOUBLE)


@operator("$multiply")
def _multiply(c, arg):
    got = [number(c, v, "$multiply") for v in args(c, arg, 0, MANY, "$multiply")]
    if _integral(got):
        return Value(reduce(lambda a, b: a * b, [v.col.cast("long") for v in got], F.lit(1).cast("long")), LONG)
    return Value(reduce(lambda a, b: a * b, map(double, got)), DOUBLE)


@operator("$divide")
def _divide(c, arg):
    a, b = (number(c, v, "$divide") for v in args(c, arg, 2, name="$divide"))
    zero = (b.col == 0) & known(a)
    return Value(c.guard(zero, "$divide by zero", F.try_divide(double(a), double(b))), DOUBLE)


@operator("$mod")
def _mod(c, arg):
    a, b = (number(c, v, "$mod") for v in args(c, arg, 2, name="$mod"))
    zero = (b.col == 0) & known(a)
    t, name = (LONG, "long") if _integral([a, b]) else (DOUBLE, "double")
    return Value(c.guard(zero, "$mod by zero", F.try_mod(a.col.cast(name), b.col.cast(name))), t)


@operator("$abs", "$ceil", "$floor")
def _whole(c, arg, name):
    (v,) = args(c, arg, 1, name=name)
    v = number(c, v, name)
    f = {"$abs": F.abs, "$ceil": F.ceil, "$floor": F.floor}[name]
    return Value(f(v.col).cast(v.type), v.type)


def _domain(name, fault, f):
    @operator(name)
    def run(c, arg):
        (v,) = args(c, arg, 1, name=name)
        x = double(number(c, v, name))
        return Value(c.guard(fault(x), f"{name} is not defined there", f(x)), DOUBLE)


_domain("$sqrt", lambda x: x < 0, F.sqrt)
_domain("$exp", lambda x: F.lit(False), F.exp)
_domain("$ln", lambda x: x <= 0, F.ln)
_domain("$log10", lambda x: x <= 0, F.log10)
for _name, _f in (("sin", F.sin), ("cos", F.cos), ("tan", F.tan), ("atan", F.atan), ("sinh", F.sinh), ("cosh", F.cosh), ("tanh", F.tanh), ("asinh", F.asinh)):
    _domain(f"${_name}", lambda x: F.lit(False), _f)
_domain("$asin", lambda x: F.abs(x) > 1, F.asin)
_domain("$acos", lambda x: F.abs(x) > 1, F.acos)
_domain("$acosh", lambda x: x < 1, F.acosh)
_domain("$atanh", lambda x: F.abs(x) > 1, F.atanh)
_domain("$degreesToRadians", lambda x: F.lit(False), F.radians)
_domain("$radiansToDegrees", lambda x: F.lit(False), F.degrees)


@operator("$pow", "$atan2", "$log")
def _two(c, arg, name):
    a, b = (double(number(c, v, name)) for v in args(c, arg, 2, name=name))
    if name == "$log":
        return Value(c.guard((a <= 0) | (b <= 0) | (b == 1), "$log is not defined there", F.ln(a) / F.ln(b)), DOUBLE)
    return Value(F.pow(a, b) if name == "$pow" else F.atan2(a, b), DOUBLE)


@operator("$round", "$trunc")
def _round(c, arg, name):
    got = [number(c, v, name) for v in args(c, arg, 1, 2, name)]
    v, places = got[0], got[1].col.cast("int") if len(got) > 1 else F.lit(0)
    scale = F.pow(F.lit(10.0), places)
    x = double(v) * scale
    if name == "$trunc":
        out = F.signum(x) * F.floor(F.abs(x)) / scale
    else:  # half to even
        low = F.floor(x).cast("double")
        up = (x - low > 0.5) | ((x - low == 0.5) & (low % 2 != 0))
        out = F.when(up, low + 1).otherwise(low) / scale
    if V.is_integral(v.type) and len(got) == 1:
        return Value(v.col, v.type)
    return Value(out.cast(v.type) if V.is_integral(v.type) else out, v.type if V.is_integral(v.type) else DOUBLE)


@operator("$cmp", "$eq", "$ne", "$gt", "$gte", "$lt", "$lte")
def _compare(c, arg, name):
    a, b = args(c, arg, 2, name=name)
    return Value(V.compare(name, a, b), INT if name == "$cmp" else BOOL, sure=True)


@operator("$and", "$or")
def _logic(c, arg, name):
    got = [V.truthy(v) for v in args(c, arg, 0, MANY, name)]
    return Value(V.all_of(got) if name == "$and" else V.any_of(got), BOOL, sure=True)


@operator("$not")
def _not(c, arg):
    (v,) = args(c, arg, 1, name="$not")
    return Value(~V.truthy(v), BOOL, sure=True)


@operator("$cond")
def _cond(c, arg):
    if isinstance(arg, dict):
        arg = options(arg, "if then else", name="$cond")
        arg = [arg["if"], arg["then"], arg["else"]]
    test, yes, no = args(c, arg, 3, name="$cond")
    (a, b), t = V.unified([yes, no])
    return Value(F.when(V.truthy(test), a).otherwise(b), t)


@operator("$ifNull")
def _if_null(c, arg):
    got = args(c, arg, 2, MANY, "$ifNull")
    columns, t = V.unified(got)
    return Value(F.coalesce(*columns), t)


@operator("$switch")
def _switch(c, arg):
    said = options(arg, "branches", "default", "$switch")
    branches = [options(b, "case then", name="$switch") for b in said["branches"]]
    if not branches:
        raise CompileError("$switch needs a branch")
    tests = [V.truthy(compile_expression(c, b["case"])) for b in branches]
    values = [compile_expression(c, b["then"]) for b in branches]
    if "default" in said:
        values.append(compile_expression(c, said["default"]))
    columns, t = V.unified(values)
    out = F.when(tests[0], columns[0])
    for test, column in zip(tests[1:], columns[1:]):
        out = out.when(test, column)
    if "default" in said:
        return Value(out.otherwise(columns[-1]), t)
    if c.lenient:
        return Value(c.guard(~V.any_of(tests), "", out), t)
    return Value(out.otherwise(F.raise_error(F.lit("$switch has no branch for the value"))), t)


@operator("$literal")
def _literal(c, arg):
    return literal(arg)


@operator("$rand")
def _rand(c, arg):
    if arg not in ({}, []):
        raise CompileError("$rand takes no argument")
    return Value(F.rand(), DOUBLE)


@operator("$let")
def _let(c, arg):
    said = options(arg, "vars in", name="$let")
    own = {k: compile_expression(c, e) for k, e in said["vars"].items()}
    from dataclasses import replace

    return compile_expression(replace(c, variables={**c.variables, **own}), said["in"])


__all__ = ["all_known", "build_object", "missing", "need"]
