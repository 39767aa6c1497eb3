"""Array, set, vector and object operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError
from ..plans import paths
from ..plans import values as V
from ..plans.values import BOOL, DOUBLE, INT, LONG, STRING, Value
from .core import MANY, all_known, args, array, build_object, compile_expression, constant, double, missing, need, number, operator, options


def _of(t, col):
    return Value(col, t)


def _element(v: Value) -> T.DataType:
    return v.type.elementType


@operator("$size")
def _size(c, arg):
    (v,) = args(c, arg, 1, name="$size")
    a = array(c, v, "$size").col
    return Value(c.guard(a.isNull(), "$size needs an array", F.size(a)), INT)


@operator("$isArray")
def _is_array(c, arg):
    (v,) = args(c, arg, 1, name="$isArray")
    return Value(v.col.isNotNull() if v.kind == "array" else F.lit(False), BOOL)


@operator("$reverseArray")
def _reverse(c, arg):
    (v,) = args(c, arg, 1, name="$reverseArray")
    v = array(c, v, "$reverseArray")
    return Value(F.reverse(v.col), v.type)


@operator("$arrayElemAt")
def _elem_at(c, arg):
    v, i = args(c, arg, 2, name="$arrayElemAt")
    v, i = array(c, v, "$arrayElemAt"), number(c, i, "$arrayElemAt").col.cast("int")
    return Value(F.try_element_at(v.col, F.when(i >= 0, i + 1).otherwise(i)), _element(v))


@operator("$first", "$last")
def _end(c, arg, name):
    (v,) = args(c, arg, 1, name=name)
    v = array(c, v, name)
    return Value(F.try_element_at(v.col, F.lit(1 if name == "$first" else -1)), _element(v))


def sliced(a, skip, n):
    """``n`` elements after ``skip``; a negative skip counts from the end and stops at the start."""
    size = F.size(a)
    start = F.when(skip < 0, F.greatest(size + skip, F.lit(0))).otherwise(F.least(skip, size))
    return F.when(a.isNotNull(), F.slice(a, start + 1, F.greatest(n, F.lit(0))))


def taken(a, n):
    """The first ``n`` elements, or the last if negative."""
    return F.when(n >= 0, sliced(a, F.lit(0), n)).otherwise(sliced(a, n, -n))


@operator("$slice")
def _slice(c, arg):
    got = args(c, arg, 2, 3, "$slice")
    v = array(c, got[0], "$slice")
    n = [number(c, x, "$slice").col.cast("int") for x in got[1:]]
    if len(n) == 1:
        return Value(taken(v.col, n[0]), v.type)
    return Value(c.guard(n[1] <= 0, "$slice needs a positive count", sliced(v.col, *n)), v.type)


@operator("$concatArrays")
def _concat_arrays(c, arg):
    got = [array(c, v, "$concatArrays") for v in args(c, arg, 0, MANY, "$concatArrays")]
    columns, t = V.unified([x if not isinstance(x.type.elementType, T.NullType) else Value(x.col, T.NullType()) for x in got])
    return Value(F.concat(*columns), t) if got else Value(F.array().cast("array<string>"), T.ArrayType(STRING))


def holds(v: Value, a: Value):
    """Whether the array has an element equal to the value."""
    return V.true(F.exists(a.col, lambda x: V.equals(Value(x, _element(a)), v)))


@operator("$in")
def _in(c, arg):
    v, a = args(c, arg, 2, name="$in")
    a = array(c, a, "$in")
    return Value(c.guard(a.col.isNull(), "$in needs an array", holds(v, a)), BOOL)


@operator("$indexOfArray")
def _index_of_array(c, arg):
    got = args(c, arg, 2, 4, "$indexOfArray")
    a = array(c, got[0], "$indexOfArray")
    at = [number(c, x, "$indexOfArray").col.cast("int") for x in got[2:]]
    start, end = at[0] if at else F.lit(0), at[1] if len(at) > 1 else F.size(a.col)
    hit = F.transform(a.col, lambda x, i: F.when(V.equals(Value(x, _element(a)), got[1]) & (i >= start) & (i < end), i))
    return Value(F.when(a.col.isNotNull(), F.coalesce(F.array_min(F.filter(hit, lambda i: i.isNotNull())), F.lit(-1))), INT)


def ordering(element: T.DataType, by) -> callable:
    """A comparator for ``array_sort``: by value (1 or -1) or by fields."""
    terms = [("", by)] if isinstance(by, int) else list(by.items())
    if any(d not in (1, -1) for _, d in terms) or not terms:
        raise CompileError("a sort direction is 1 or -1")

    def at(x, path):
        v = Value(x, element)
        for p in path.split(".") if path else []:
            v = paths.field(v, p)
        return v

    def compare(x, y):
        out = F.lit(0)
        for path, d in reversed(terms):
            a, b = at(x, path), at(y, path)
            out = F.when(V.less(a, b), -d).when(V.less(b, a), d).otherwise(out)
        return out

    return compare


def sorted_array(v: Value, by):
    """Stable sort: ties keep their places."""
    element = _element(v)
    kept = F.transform(v.col, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    inner = ordering(element, by)

    def compare(a, b):
        own = inner(a["x"], b["x"])
        return F.when(own != 0, own).otherwise(F.when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0))

    return F.transform(F.array_sort(kept, compare), lambda s: s["x"])


@operator("$sortArray")
def _sort_array(c, arg):
    said = options(arg, "input sortBy", name="$sortArray")
    v = array(c, compile_expression(c, said["input"]), "$sortArray")
    return Value(sorted_array(v, said["sortBy"]), v.type)


@operator("$zip")
def _zip(c, arg):
    said = options(arg, "inputs", "useLongestLength defaults", "$zip")
    got = [array(c, compile_expression(c, x), "$zip") for x in said["inputs"]]
    longest, defaults = bool(said.get("useLongestLength")), said.get("defaults")
    if defaults is not None and not longest:
        raise CompileError("$zip takes defaults with useLongestLength only")
    fill = [compile_expression(c, x) for x in defaults] if defaults else [missing()] * len(got)
    element = V.common([_element(v) for v in got] + [f.type for f in fill])
    sizes = [F.size(v.col) for v in got]
    n = sizes[0] if len(sizes) == 1 else (F.greatest if longest else F.least)(*sizes)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    row = lambda i: F.array(*[F.when(i < s, V.cast(Value(F.get(v.col, i), _element(v)), element)).otherwise(V.cast(f, element)) for v, s, f in zip(got, sizes, fill)])
    return Value(F.when(all_known(got), F.transform(places, row)), T.ArrayType(T.ArrayType(element)))


@operator("$firstN", "$lastN", "$maxN", "$minN")
def _n_of(c, arg, name):
    said = options(arg, "n input", name=name)
    v = array(c, compile_expression(c, said["input"]), name)
    n = number(c, compile_expression(c, said["n"]), name).col.cast("int")
    if name in ("$firstN", "$lastN"):
        out = sliced(v.col, F.lit(0), n) if name == "$firstN" else sliced(v.col, -n, n)
    else:
        out = sliced(F.sort_array(F.filter(v.col, lambda x: x.isNotNull()), asc=name == "$minN"), F.lit(0), n)
    return Value(c.guard(n < 1, f"{name} needs n from 1", out), v.type)


@operator("$range")
def _range(c, arg):
    got = [number(c, v, "$range").col.cast("int") for v in args(c, arg, 2, 3, "$range")]
    start, end, step = (*got, F.lit(1))[:3]
    last = end - F.signum(step).cast("int")
    some = F.when(step > 0, start < end).otherwise(start > end)
    safe = F.when(some & (step != 0), F.sequence(start, F.when(some, last).otherwise(start), F.when(some & (step != 0), step).otherwise(F.lit(1))))
    out = F.when(start.isNotNull() & end.isNotNull(), F.coalesce(safe, F.array().cast("array<int>")))
    return Value(c.guard(step == 0, "$range needs a step", out), T.ArrayType(INT))


@operator("$sum", "$avg", "$min", "$max")
def _fold(c, arg, name):
    """Over one array, or over several arguments; what is not a number is ignored by the first two."""
    got = args(c, arg, 0, MANY, name)
    if len(got) == 1 and got[0].kind == "array":
        v = got[0]
    else:
        if name in ("$sum", "$avg"):
            got = [x for x in got if x.kind == "number"]
        columns, t = V.unified(got) if got else ([], DOUBLE)
        v = Value(F.array(*columns) if columns else F.array().cast("array<double>"), T.ArrayType(t if not isinstance(t, T.NullType) else DOUBLE))
        if got and isinstance(t, T.NullType):
            v = Value(F.array().cast("array<double>"), T.ArrayType(DOUBLE))
    element = _element(v)
    known = F.filter(v.col, lambda x: x.isNotNull())
    if name in ("$min", "$max"):
        return Value((F.array_min if name == "$min" else F.array_max)(known), element)
    if V.kind(element) != "number":
        return Value(F.lit(0).cast("long"), LONG) if name == "$sum" else Value(F.lit(None).cast("double"), DOUBLE)
    whole = V.is_integral(element) and name == "$sum"
    t, zero = (LONG, F.lit(0).cast("long")) if whole else (DOUBLE, F.lit(0.0))
    total = F.coalesce(F.aggregate(known, zero, lambda a, x: a + x.cast(t)), zero)
    return Value(total, t) if name == "$sum" else Value(F.try_divide(total, F.size(known)), DOUBLE)


@operator("$map")
def _map(c, arg):
    said = options(arg, "input in", "as", "$map")
    v, name = array(c, compile_expression(c, said["input"]), "$map"), said.get("as", "this")
    kinds = []

    def one(x):
        got = compile_expression(c.having(**{name: Value(x, _element(v))}), said["in"])
        kinds.append(got.type)
        return got.col if got.kind != "null" else got.col.cast("string")

    out = F.transform(v.col, one)
    return Value(out, T.ArrayType(kinds[0] if not isinstance(kinds[0], T.NullType) else STRING))


@operator("$filter")
def _filter(c, arg):
    said = options(arg, "input cond", "as limit", "$filter")
    v, name = array(c, compile_expression(c, said["input"]), "$filter"), said.get("as", "this")
    out = F.filter(v.col, lambda x: V.truthy(compile_expression(c.having(**{name: Value(x, _element(v))}), said["cond"])))
    if said.get("limit") is not None:
        n = number(c, compile_expression(c, said["limit"]), "$filter").col.cast("int")
        out = c.guard(n < 1, "$filter needs a limit from 1", sliced(out, F.lit(0), n))
    return Value(out, v.type)


@operator("$reduce")
def _reduce(c, arg):
    said = options(arg, "input initialValue in", name="$reduce")
    v, start = array(c, compile_expression(c, said["input"]), "$reduce"), compile_expression(c, said["initialValue"])

    def step(t):
        kinds = []

        def one(a, x):
            got = compile_expression(c.having(this=Value(x, _element(v)), value=Value(a, t)), said["in"])
            kinds.append(got.type)
            return V.cast(got, V.common([t, got.type])) if not isinstance(got.type, T.NullType) else got.col.cast(t)

        return one, kinds

    # the accumulator has one type: widen it until the step returns what it takes
    t = start.type if not isinstance(start.type, T.NullType) else STRING
    for _ in range(4):
        one, kinds = step(t)
        F.aggregate(v.col, V.cast(start, t), one)
        wider = V.common([t, *kinds])
        if wider == t:
            break
        t = wider
    one, _ = step(t)
    return Value(F.aggregate(v.col, V.cast(start, t), one), t)


# --- sets -----------------------------------------------------------------------------


def _sets(c, arg, name, least, most=MANY):
    got = [array(c, v, name) for v in args(c, arg, least, most, name)]
    element = V.common([_element(v) for v in got]) if got else STRING
    element = STRING if isinstance(element, T.NullType) else element
    return [V.cast(v, T.ArrayType(element)) for v in got], T.ArrayType(element)


@operator("$setUnion", "$setIntersection")
def _union(c, arg, name):
    got, t = _sets(c, arg, name, 0)
    if not got:
        return Value(F.array().cast("array<string>"), t)
    f = F.array_union if name == "$setUnion" else F.array_intersect
    out = reduce(f, got[1:], F.array_distinct(got[0]))
    return Value(F.sort_array(out), t)


@operator("$setDifference")
def _difference(c, arg):
    (a, b), t = _sets(c, arg, "$setDifference", 2, 2)
    return Value(F.array_except(a, b), t)


@operator("$setEquals", "$setIsSubset")
def _relation(c, arg, name):
    got, t = _sets(c, arg, name, 2, MANY if name == "$setEquals" else 2)
    fault = V.any_of([x.isNull() for x in got])
    if name == "$setIsSubset":
        out = F.size(F.array_except(got[0], got[1])) == 0
    else:
        plain = [F.sort_array(F.array_distinct(x)) for x in got]
        out = V.all_of([plain[0].eqNullSafe(x) for x in plain[1:]])
    return Value(c.guard(fault, f"{name} needs arrays", out), BOOL)


@operator("$allElementsTrue", "$anyElementTrue")
def _elements(c, arg, name):
    (v,) = args(c, arg, 1, name=name) if not (isinstance(arg, list) and len(arg) == 1 and isinstance(arg[0], list)) else [compile_expression(c, arg[0])]
    v = array(c, v, name)
    f = F.forall if name == "$allElementsTrue" else F.exists
    out = f(v.col, lambda x: V.truthy(Value(x, _element(v))))
    return Value(c.guard(v.col.isNull(), f"{name} needs an array", out), BOOL)


# --- vectors --------------------------------------------------------------------------


@operator("$similarityDotProduct", "$similarityCosine", "$similarityEuclidean")
def _similarity(c, arg, name):
    score = False
    if isinstance(arg, dict) and "vectors" in arg:
        said = options(arg, "vectors", "score", name)
        arg, score = said["vectors"], bool(said.get("score"))
    a, b = (array(c, v, name) for v in args(c, arg, 2, name=name))
    for v in (a, b):
        if V.kind(_element(v)) not in ("number", "null", "string") or V.kind(_element(v)) == "string" and not c.lenient and v.kind == "string":
            raise CompileError(f"{name} needs vectors of numbers")
    x, y = (F.transform(v.col, lambda e: e.cast("double")) for v in (a, b))
    fault = (F.size(a.col) != F.size(b.col)) | (F.size(a.col) == 0)
    fold = lambda f: F.aggregate(F.zip_with(x, y, f), F.lit(0.0), lambda s, e: s + e)
    if name == "$similarityDotProduct":
        out = fold(lambda p, q: p * q)
        out = (out + 1) / 2 if score else out
    elif name == "$similarityEuclidean":
        out = F.sqrt(fold(lambda p, q: (p - q) * (p - q)))
        out = 1 / (1 + out) if score else out
    else:
        norm = F.sqrt(fold(lambda p, q: p * p)) * F.sqrt(fold(lambda p, q: q * q))
        out = F.when(norm == 0, 0.0).otherwise(F.try_divide(fold(lambda p, q: p * q), norm))
        out = (out + 1) / 2 if score else out
    both = a.col.isNotNull() & b.col.isNotNull()
    return Value(c.guard(both & fault, f"{name} needs two vectors of one length", F.when(both, out)), DOUBLE)


# --- objects --------------------------------------------------------------------------


@operator("$mergeObjects")
def _merge(c, arg):
    got = [need(c, v, "object array", "$mergeObjects") for v in args(c, arg, 0, MANY, "$mergeObjects")]
    if len(got) == 1 and got[0].kind == "array":
        t = _element(got[0])
        if not isinstance(t, T.StructType):
            raise CompileError("$mergeObjects needs objects")
        known = F.filter(got[0].col, lambda x: x.isNotNull())
        last = {f.name: F.try_element_at(F.filter(F.transform(known, lambda x, f=f: x[f.name]), lambda y: y.isNotNull()), F.lit(-1)) for f in t.fields}
        return build_object({f.name: Value(last[f.name], f.dataType) for f in t.fields})
    return merged([v for v in got if v.kind == "object"])


def merged(objects: list[Value]) -> Value:
    """One object; the last one that has a field decides it."""
    if any(isinstance(v.type, T.MapType) for v in objects):
        t = next(v.type for v in objects if isinstance(v.type, T.MapType))
        entries = F.flatten(F.array(*[F.map_entries(F.coalesce(as_map(v, t), F.create_map().cast(t))) for v in objects]))
        return Value(last_wins(entries), t)
    fields: dict[str, list[Value]] = {}
    for v in objects:
        for f in v.type.fields:
            fields.setdefault(f.name, []).insert(0, Value(v.col[f.name], f.dataType))
    out = {}
    for name, own in fields.items():
        columns, t = V.unified(own)
        out[name] = Value(F.coalesce(*columns), t)
    return build_object(out)


def as_map(v: Value, t: T.MapType):
    if isinstance(v.type, T.MapType):
        return v.col.cast(t)
    pairs = [x for f in v.type.fields for x in (F.lit(f.name), V.cast(Value(v.col[f.name], f.dataType), t.valueType))]
    return F.when(v.col.isNotNull(), F.map_filter(F.create_map(*pairs), lambda k, x: x.isNotNull()))


def last_wins(entries):
    """A map of (key, value) entries of which a later one replaces an earlier one with its key."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    pick = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, pick))


@operator("$objectToArray")
def _object_to_array(c, arg):
    (v,) = args(c, arg, 1, name="$objectToArray")
    v = need(c, v, "object", "$objectToArray")
    if isinstance(v.type, T.MapType):
        t = T.StructType([T.StructField("k", v.type.keyType), T.StructField("v", v.type.valueType)])
        return Value(F.transform(F.map_entries(v.col), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))), T.ArrayType(t))
    if v.kind == "null":
        return missing()
    t = V.common([f.dataType for f in v.type.fields])
    pairs = [F.struct(F.lit(f.name).alias("k"), V.cast(Value(v.col[f.name], f.dataType), t).alias("v")) for f in v.type.fields]
    kind = T.StructType([T.StructField("k", STRING), T.StructField("v", t)])
    return Value(F.when(v.col.isNotNull(), F.filter(F.array(*pairs), lambda p: p["v"].isNotNull())), T.ArrayType(kind))


@operator("$arrayToObject")
def _array_to_object(c, arg):
    if isinstance(arg, list) and len(arg) == 1:
        arg = arg[0]
    v = array(c, compile_expression(c, arg), "$arrayToObject")
    t = _element(v)
    if isinstance(t, T.StructType) and set(t.names) == {"k", "v"}:
        pair = lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value"))
        key, value = t["k"].dataType, t["v"].dataType
    elif isinstance(t, T.ArrayType):
        pair = lambda e: F.struct(F.get(e, F.lit(0)).cast("string").alias("key"), F.get(e, F.lit(1)).alias("value"))
        key, value = STRING, t.elementType
    else:
        raise CompileError("$arrayToObject needs [key, value] pairs or {k, v} objects")
    return Value(F.when(v.col.isNotNull(), last_wins(F.transform(v.col, pair))), T.MapType(key, value))


def _name(c, e, op):
    v = e["$literal"] if isinstance(e, dict) and set(e) == {"$literal"} else e
    if not isinstance(v, str) or v.startswith("$") and v is e:
        raise CompileError(f"{op} needs a constant field name")
    return v


@operator("$getField")
def _get_field(c, arg):
    if not isinstance(arg, dict) or set(arg) == {"$literal"}:
        return paths.field(c.whole, _name(c, arg, "$getField"))
    said = options(arg, "field", "input", "$getField")
    source = compile_expression(c, said["input"]) if "input" in said else c.whole
    return paths.field(source, _name(c, said["field"], "$getField"))


@operator("$setField", "$unsetField")
def _set_field(c, arg, name):
    said = options(arg, "field input value" if name == "$setField" else "field input", name=name)
    key = _name(c, said["field"], name)
    v = need(c, compile_expression(c, said["input"]), "object", name)
    if v.kind == "null":
        return missing()
    fields = {f.name: Value(v.col[f.name], f.dataType) for f in v.type.fields}
    fields.pop(key, None) if name == "$unsetField" or said["value"] == "$$REMOVE" else fields.update({key: compile_expression(c, said["value"])})
    out = build_object(fields)
    return Value(F.when(v.col.isNotNull(), out.col), out.type)


__all__ = ["constant", "double", "_of"]
