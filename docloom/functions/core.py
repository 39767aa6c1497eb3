"""Compiler of expression documents into typed columns.

``"$a.b"`` is a field, ``"$$name.path"`` a variable, ``{"$op": ...}`` an operator, any
other document or list builds an object or an array, everything else is a literal.
Operators register themselves in ``OPERATORS``; unknown ones are errors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError
from ..plans import paths
from ..plans.values import NULL, Value, all_of, kind, literal, missing

OPERATORS: dict[str, Callable[[Context, Any], Value]] = {}

#: What ``$$REMOVE`` stands for
REMOVE = object()


@dataclass(frozen=True)
class Context:
    """Where an expression is evaluated.

    lenient: a value of a wrong type or out of an operator's domain does not stop the
    query; its condition is collected in ``faults`` and the caller decides.
    """

    schema: T.StructType
    prefix: Column | None = None
    variables: dict[str, Value] = field(default_factory=dict)
    strict: bool = False
    lenient: bool = False
    faults: list[Column] = field(default_factory=list)
    inside: bool = False  # in a lambda, whose conditions cannot be collected
    nulls: bool = False  # the rows have the hidden column with the paths of nulls

    def root(self, name: str) -> Value:
        return paths.root_of(self.schema, self.prefix, self.nulls)(name)

    @property
    def whole(self) -> Value:
        if self.prefix is not None:
            return Value(self.prefix, self.schema)
        columns = [F.col(paths.quoted(n)) for n in self.schema.names]
        return Value(F.struct(*columns), self.schema)

    def having(self, **variables: Value) -> Context:
        return replace(self, variables={**self.variables, **variables}, inside=True)

    def guard(self, fault: Column, message: str, v: Column) -> Column:
        """``v``, but an error where ``fault`` holds; missing there in a lenient context."""
        if self.lenient:
            if not self.inside:
                self.faults.append(fault)
            return F.when(~F.coalesce(fault, F.lit(False)), v)
        return F.when(fault, F.raise_error(F.lit(message))).otherwise(v)


def operator(*names: str):
    def add(f):
        for name in names:
            OPERATORS[name] = f if len(names) == 1 else (lambda c, arg, _n=name: f(c, arg, _n))
        return f

    return add


def compile_expression(c: Context, e: Any) -> Value:
    if isinstance(e, str) and e.startswith("$$"):
        return _variable(c, e[2:])
    if isinstance(e, str) and e.startswith("$"):
        return paths.plain(c.root, e[1:], c.strict)
    if isinstance(e, dict):
        ops = [k for k in e if k.startswith("$")]
        if ops:
            if len(e) != 1:
                raise CompileError(f"an expression has exactly one operator, not {', '.join(e)}")
            if ops[0] not in OPERATORS:
                raise CompileError(f"unknown expression operator {ops[0]}")
            return OPERATORS[ops[0]](c, e[ops[0]])
        return build_object({k: compile_expression(c, v) for k, v in e.items() if v != "$$REMOVE"})
    if isinstance(e, (list, tuple)):
        return build_array([compile_expression(c, x) for x in e])
    return literal(e)


def build_object(fields: dict[str, Value]) -> Value:
    known = {k: v for k, v in fields.items() if v.kind != "null"}
    t = T.StructType([T.StructField(k, v.type) for k, v in known.items()])
    return Value(F.struct(*[v.col.alias(k) for k, v in known.items()]), t)


def build_array(values: list[Value]) -> Value:
    from ..plans.values import unified

    if not values:
        return Value(F.array().cast("array<string>"), T.ArrayType(T.StringType()))
    columns, t = unified(values)
    if isinstance(t, T.NullType):
        columns, t = [x.cast("string") for x in columns], T.StringType()
    return Value(F.array(*columns), T.ArrayType(t))


def _variable(c: Context, said: str) -> Value:
    name, _, rest = said.partition(".")
    if name in ("ROOT", "CURRENT"):
        v = c.variables.get(name, c.whole)
        if rest and name not in c.variables:
            return paths.plain(c.root, rest, c.strict)
    elif name == "REMOVE":
        return missing()
    elif name in ("NOW", "CLUSTER_TIME"):
        raise CompileError(f"$${name} is not supported")
    elif name in c.variables:
        v = c.variables[name]
    else:
        raise CompileError(f"undefined variable $${name}")
    for part in paths.check(rest) if rest else []:
        v = paths.field(v, part)
    return v


# --- arguments ----------------------------------------------------------------------


def args(c: Context, arg: Any, least: int, most: int | None = None, name: str = "") -> list[Value]:
    """``[x, …]`` or a lone ``x``; a list stands for the arguments."""
    said = list(arg) if isinstance(arg, (list, tuple)) else [arg]
    most = least if most is None else most
    if not least <= len(said) <= most:
        raise CompileError(f"{name or 'the operator'} takes {least}{f' to {most}' if most != least else ''} arguments, not {len(said)}")
    return [compile_expression(c, x) for x in said]


MANY = 1 << 30


def options(arg: Any, needed: str, allowed: str = "", name: str = "") -> dict:
    if not isinstance(arg, dict):
        raise CompileError(f"{name} takes a document")
    need, may = needed.split(), allowed.split()
    if lost := [x for x in need if x not in arg]:
        raise CompileError(f"{name} needs {', '.join(lost)}")
    if odd := [x for x in arg if x not in need + may]:
        raise CompileError(f"{name} does not know {', '.join(odd)}")
    return arg


class WrongType(CompileError):
    """A static type that an operator does not take: in a lenient context, a fault of every row with a value."""


def need(c: Context, v: Value, wanted: str, name: str) -> Value:
    """``v`` if it has the kind (or is missing)."""
    if v.kind in ("null", *wanted.split()):
        return v
    if c.lenient:
        if not c.inside:
            c.faults.append(v.col.isNotNull())
        return missing()
    raise WrongType(f"{name} needs a value of kind {wanted}, not {v.kind}")


def number(c: Context, v: Value, name: str) -> Value:
    v = need(c, v, "number", name)
    if isinstance(v.type, (T.DecimalType, T.FloatType)):
        return Value(v.col.cast("double"), T.DoubleType())
    return v if v.kind == "number" else Value(F.lit(None).cast("double"), T.DoubleType())


def string(c: Context, v: Value, name: str) -> Value:
    v = need(c, v, "string", name)
    return v if v.kind == "string" else Value(F.lit(None).cast("string"), T.StringType())


def array(c: Context, v: Value, name: str) -> Value:
    v = need(c, v, "array", name)
    return v if v.kind == "array" else Value(F.lit(None).cast("array<string>"), T.ArrayType(T.StringType()))


def double(v: Value) -> Column:
    return v.col.cast("double")


def constant(e: Any, name: str, whole: bool = True) -> Any:
    if isinstance(e, dict) and set(e) == {"$literal"}:
        e = e["$literal"]
    if isinstance(e, bool) or not isinstance(e, int if whole else (int, float)):
        raise CompileError(f"{name} needs a constant number")
    return e


def known(v: Value) -> Column:
    return v.col.isNotNull()


def all_known(values: list[Value]) -> Column:
    return all_of([known(v) for v in values])


__all__ = ["Context", "OPERATORS", "compile_expression", "operator", "NULL", "kind"]
