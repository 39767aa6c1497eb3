"""Projections: inclusion, exclusion, computed fields and array projections."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError
from ..functions import Context, compile_expression
from ..functions.collections import sliced, taken
from ..plans import paths
from ..plans.values import NULLS, Value
from .filters import element_test

ID = "_id"
#: Hidden column with the natural order of documents
ORDER = "_ord"

#: Beginning of the hidden columns that hold the variables of a lookup's pipeline
LET = "_let"


def has_order(df: DataFrame) -> bool:
    return ORDER in df.columns


def variables_of(df: DataFrame) -> list[str]:
    """Hidden columns with variables of the lookups around a pipeline."""
    return [n for n in df.columns if n.startswith(LET) and n[len(LET) : len(LET) + 1].isdigit()]


def is_flag(v: Any) -> bool:
    return isinstance(v, (bool, int, float))


def tree_of(leaves: dict[str, Any]) -> dict:
    """Dotted paths as a tree; a path may not lead through another one."""
    tree: dict = {}
    for path, leaf in leaves.items():
        node = tree
        *way, last = paths.check(path)
        for p in way:
            node = node.setdefault(p, {})
            if not isinstance(node, dict):
                raise CompileError(f"'{path}' collides with another path")
        if last in node:
            raise CompileError(f"'{path}' collides with another path")
        node[last] = leaf
    return tree


def include(v: Value, tree: dict) -> Value | None:
    """The parts of a value that a tree of paths names, in the value's own order."""
    if v.kind == "array":
        element = v.type.elementType
        if not isinstance(element, (T.StructType, T.ArrayType)):
            return Value(F.slice(v.col, 1, 0), v.type)  # elements that are no documents go
        probe = include(Value(F.lit(None).cast(element), element), tree)
        if probe is None:
            return Value(F.slice(v.col, 1, 0), v.type)
        return Value(F.transform(v.col, lambda x: include(Value(x, element), tree).col), T.ArrayType(probe.type))
    if not isinstance(v.type, T.StructType):
        return None
    fields = {}
    for f in v.type.fields:
        if f.name not in tree:
            continue
        own, leaf = Value(v.col[f.name], f.dataType), tree[f.name]
        got = include(own, leaf) if isinstance(leaf, dict) else leaf(own) if callable(leaf) else own
        if got is not None:
            fields[f.name] = got
    if not fields:
        return None
    t = T.StructType([T.StructField(n, x.type) for n, x in fields.items()])
    return Value(F.when(v.col.isNotNull(), F.struct(*[x.col.alias(n) for n, x in fields.items()])), t, path=v.path)


def exclude(v: Value, tree: dict) -> Value | None:
    """A value without the parts that a tree of paths names."""
    if v.kind == "array":
        element = v.type.elementType
        if not isinstance(element, (T.StructType, T.ArrayType)):
            return v
        probe = exclude(Value(F.lit(None).cast(element), element), tree)
        return Value(F.transform(v.col, lambda x: exclude(Value(x, element), tree).col), T.ArrayType(probe.type))
    if not isinstance(v.type, T.StructType):
        return v
    fields = {}
    for f in v.type.fields:
        own, leaf = Value(v.col[f.name], f.dataType), tree.get(f.name)
        if leaf is None:
            fields[f.name] = own
        elif isinstance(leaf, dict):
            fields[f.name] = exclude(own, leaf)
        elif callable(leaf):
            fields[f.name] = leaf(own)
    t = T.StructType([T.StructField(n, x.type) for n, x in fields.items()])
    return Value(F.when(v.col.isNotNull(), F.struct(*[x.col.alias(n) for n, x in fields.items()])), t, path=v.path)


def fields_of(df: DataFrame) -> dict[str, Value]:
    """The visible columns as values."""
    nulls = NULLS in df.columns
    hidden = {ORDER, NULLS, *variables_of(df)}
    return {f.name: Value(F.col(paths.quoted(f.name)), f.dataType, path=f.name if nulls else None) for f in df.schema.fields if f.name not in hidden}


def select_values(df: DataFrame, values: dict[str, Value]) -> DataFrame:
    """The values as columns; the hidden columns go along, with the nulls of fields that keep their place."""
    hidden = [F.col(ORDER)] if ORDER not in values and has_order(df) else []
    hidden += [F.col(n) for n in variables_of(df) if n not in values]
    kept = [n for n, v in values.items() if v.path == n]
    if kept and NULLS in df.columns:
        hidden.append(F.filter(NULLS, lambda p: F.substring_index(p, ".", 1).isin(kept)).alias(NULLS))
    return df.select(*[v.col.alias(n) for n, v in values.items()], *hidden)


def _slice(arg: Any) -> Callable[[Value], Value]:
    if isinstance(arg, (list, tuple)):
        if len(arg) != 2 or arg[1] <= 0:
            raise CompileError("$slice takes [skip, limit] with a positive limit")
        cut = lambda a: sliced(a, F.lit(int(arg[0])), F.lit(int(arg[1])))
    elif isinstance(arg, int) and not isinstance(arg, bool):
        cut = lambda a: taken(a, F.lit(arg))
    else:
        raise CompileError("$slice takes a number or [skip, limit]")
    return lambda v: Value(cut(v.col), v.type) if v.kind == "array" else v


def _first_match(test) -> Callable[[Value], Value | None]:
    def run(v: Value) -> Value | None:
        if v.kind != "array":
            return None
        hit = F.slice(F.filter(v.col, lambda x: test(Value(x, v.type.elementType))), 1, 1)
        return Value(F.when(F.size(hit) > 0, hit), v.type)

    return run


def _criterion_of(query: dict, path: str) -> Any:
    """What a filter asks of an array, through ``$and`` but not through ``$or``."""
    if path in query:
        return query[path]
    for sub in query.get("$and", ()):
        if (got := _criterion_of(sub, path)) is not None:
            return got
    own = {k[len(path) + 1 :]: v for k, v in query.items() if k.startswith(path + ".")}
    return {"$elemMatch": own} if own else None


def find_projection(df: DataFrame, c: Context, spec: dict, query: dict | None = None) -> DataFrame:
    """Projection of a ``find``: flags, ``$slice``, ``$elemMatch``, positional ``$`` and expressions."""
    leaves, computed, slices, mode, keep_id = {}, {}, {}, None, True
    positional = 0
    for path, v in spec.items():
        if path.endswith(".$"):
            positional += 1
            if positional > 1:
                raise CompileError("one positional projection at most")
            path = path[:-2]
            crit = _criterion_of(query or {}, path)
            if crit is None:
                raise CompileError(f"the filter asks nothing of '{path}'")
            crit = crit.get("$elemMatch", crit) if isinstance(crit, dict) else {"$eq": crit}
            test, mode = _first_match(element_test(crit, c)), _mode(mode, "include")
            leaves[path] = test
        elif path == ID and is_flag(v):
            keep_id = bool(v)
            if len(spec) == 1:
                mode = "include" if v else "exclude"
        elif is_flag(v):
            mode = _mode(mode, "include" if v else "exclude")
            leaves[path] = True
        elif isinstance(v, dict) and set(v) == {"$slice"}:
            slices[path] = _slice(v["$slice"])
        elif isinstance(v, dict) and set(v) == {"$elemMatch"}:
            mode = _mode(mode, "include")
            leaves[path] = _first_match(element_test(v["$elemMatch"], c))
        else:
            mode = _mode(mode, "include")
            computed[path] = v
    if mode == "include":
        return _included(df, c, leaves | slices, computed, keep_id)
    tree = tree_of(leaves | slices | ({} if keep_id else {ID: True}))
    return _top(df, c, exclude(c.whole, tree))


def _mode(now, new):
    if now not in (None, new):
        raise CompileError("a projection includes or excludes, not both")
    return new


def _top(df: DataFrame, c: Context, v: Value | None, more: dict[str, Value] | None = None) -> DataFrame:
    """Fields of an object as columns, simplified to plain column references where they are."""
    fields = {f.name: Value(v.col[f.name], f.dataType, path=f.name if c.nulls else None) for f in v.type.fields} if v else {}
    return select_values(df, fields | (more or {}))


def _included(df: DataFrame, c: Context, leaves: dict, computed: dict, keep_id: bool) -> DataFrame:
    tree_of({**leaves, **computed})  # collisions
    if keep_id:
        leaves = {ID: True, **leaves}
    tree, out = tree_of(leaves), {}
    for f in c.schema.fields:
        if f.name not in tree:
            continue
        own, leaf = c.root(f.name), tree[f.name]
        got = include(own, leaf) if isinstance(leaf, dict) else leaf(own) if callable(leaf) else own
        if got is not None:
            out[f.name] = got
    for path, e in computed.items():
        v = compile_expression(c, e)
        first, *rest = paths.check(path)
        if rest:
            out[first] = put(out.get(first), rest, v)
        elif v.kind != "null":
            out[first] = v
    return select_values(df, out)


def put(v: Value | None, way: list[str], new: Value) -> Value:
    """``v`` with the field at the end of the way set; parents come into being."""
    fields: dict[str, Value] = {}
    if v is not None and isinstance(v.type, T.StructType):
        fields = {f.name: Value(v.col[f.name], f.dataType) for f in v.type.fields}
    if len(way) == 1:
        fields.pop(way[0], None) if new.kind == "null" else fields.update({way[0]: new})
    else:
        fields[way[0]] = put(fields.get(way[0]), way[1:], new)
    t = T.StructType([T.StructField(n, x.type) for n, x in fields.items()])
    return Value(F.struct(*[x.col.alias(n) for n, x in fields.items()]), t)


def stage_projection(df: DataFrame, c: Context, spec: dict) -> DataFrame:
    """The ``$project`` stage: flags, nested documents of flags, and expressions."""
    if not isinstance(spec, dict) or not spec:
        raise CompileError("$project needs a document with fields")
    flags, computed, keep_id = {}, {}, True

    def walk(prefix: str, doc: dict):
        nonlocal keep_id
        for k, v in doc.items():
            path = f"{prefix}{k}"
            if is_flag(v):
                if path == ID:
                    keep_id = bool(v)
                else:
                    flags[path] = bool(v)
            elif isinstance(v, dict) and v and not any(x.startswith("$") for x in v) and all(is_flag(x) or isinstance(x, dict) for x in v.values()):
                walk(path + ".", v)
            else:
                computed[path] = v

    walk("", spec)
    if computed and not all(flags.values()) or len(set(flags.values())) > 1:
        raise CompileError("$project includes or excludes, not both")
    if flags and not any(flags.values()) or not flags and not computed and not keep_id:
        tree = tree_of({p: True for p in flags} | ({} if keep_id else {ID: True}))
        return _top(df, c, exclude(c.whole, tree))
    if not flags and not computed:
        flags = {ID: True}
        return _included(df, c, {}, {}, True)
    return _included(df, c, {p: True for p in flags}, computed, keep_id)


def add_fields(df: DataFrame, c: Context, spec: dict) -> DataFrame:
    """All expressions read the input; a missing result removes the field."""
    if not isinstance(spec, dict) or not spec:
        raise CompileError("$addFields needs a document with fields")
    tree_of(spec)
    out = {f.name: c.root(f.name) for f in c.schema.fields}
    for path, e in spec.items():
        v = compile_expression(c, e)
        first, *rest = paths.check(path)
        if rest:
            out[first] = put(out.get(first), rest, v)
        elif v.kind == "null":
            out.pop(first, None)
        else:
            out[first] = v
    return select_values(df, out)


def unset(df: DataFrame, c: Context, said: Any) -> DataFrame:
    names = [said] if isinstance(said, str) else said
    if not isinstance(names, (list, tuple)) or not names or not all(isinstance(n, str) for n in names):
        raise CompileError("$unset needs field names")
    if all("." not in n for n in names):
        return select_values(df, {n: c.root(n) for n in c.schema.names if n not in names})
    return _top(df, c, exclude(c.whole, tree_of({n: True for n in names})))
