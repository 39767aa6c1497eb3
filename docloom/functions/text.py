"""String operators, regular expressions and their dialect."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError
from ..plans import values as V
from ..plans.values import BOOL, INT, STRING, Value
from .core import MANY, all_known, args, array, compile_expression, known, need, number, operator, options, string

_BLANKS = " \t\n\r\v\f"


@operator("$concat")
def _concat(c, arg):
    got = [string(c, v, "$concat") for v in args(c, arg, 0, MANY, "$concat")]
    return Value(F.concat(*[v.col for v in got]) if got else F.lit(""), STRING)


@operator("$toLower", "$toUpper")
def _case(c, arg, name):
    (v,) = args(c, arg, 1, name=name)
    s = F.coalesce(string(c, v, name).col, F.lit(""))
    return Value(F.lower(s) if name == "$toLower" else F.upper(s), STRING)


@operator("$strLenCP", "$strLenBytes")
def _length(c, arg, name):
    (v,) = args(c, arg, 1, name=name)
    s = string(c, v, name).col
    size = F.char_length(s) if name == "$strLenCP" else F.octet_length(s)
    return Value(c.guard(s.isNull(), f"{name} needs a string", size), INT)


@operator("$binarySize")
def _binary_size(c, arg):
    (v,) = args(c, arg, 1, name="$binarySize")
    v = need(c, v, "string binary", "$binarySize")
    return Value(F.octet_length(v.col), INT)


@operator("$substrCP")
def _substr_cp(c, arg):
    s, start, n = args(c, arg, 3, name="$substrCP")
    s = F.coalesce(string(c, s, "$substrCP").col, F.lit(""))
    start, n = (number(c, v, "$substrCP").col.cast("int") for v in (start, n))
    out = F.substring(s, start + 1, n)
    return Value(c.guard((start < 0) | (n < 0), "$substrCP needs counts from 0", out), STRING)


@operator("$substrBytes", "$substr")
def _substr_bytes(c, arg, name):
    s, start, n = args(c, arg, 3, name=name)
    raw = F.coalesce(string(c, s, name).col, F.lit("")).cast("binary")
    start, n = (number(c, v, name).col.cast("int") for v in (start, n))
    size = F.octet_length(raw)
    n = F.when((n < 0) | (n > size - start), F.greatest(size - start, F.lit(0))).otherwise(n)
    inside = lambda at: (at < size) & (F.hex(F.substring(raw, at + 1, F.lit(1))).rlike("^[89AB]"))
    fault = (start < 0) | inside(start) | inside(start + n)
    return Value(c.guard(fault, f"{name} cuts a character", F.substring(raw, start + 1, n).cast("string")), STRING)


@operator("$indexOfCP", "$indexOfBytes")
def _index_of(c, arg, name):
    got = args(c, arg, 2, 4, name)
    s, sub = string(c, got[0], name).col, string(c, got[1], name).col
    size = F.char_length(s)
    at = [number(c, v, name).col.cast("int") for v in got[2:]]
    if name == "$indexOfBytes":
        # bytes to characters: positions are those of the first bytes
        raw = s.cast("binary")
        at = [F.char_length(F.substring(raw, F.lit(1), x).cast("string")) for x in at]
    start = at[0] if at else F.lit(0)
    end = F.least(at[1], size) if len(at) > 1 else size
    head = F.substring(s, F.lit(1), F.greatest(end, F.lit(0)))
    found = F.when(start > end, 0).otherwise(F.position(sub, head, start + 1))
    place = found - 1
    if name == "$indexOfBytes":
        place = F.when(place < 0, -1).otherwise(F.octet_length(F.substring(s, F.lit(1), place)))
    return Value(F.when(s.isNotNull(), place), INT)


def _regex_quoted(col):
    """The text as a literal pattern."""
    return F.concat(F.lit("\\Q"), F.replace(col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


@operator("$split")
def _split(c, arg):
    s, by = (string(c, v, "$split").col for v in args(c, arg, 2, name="$split"))
    out = F.split(s, _regex_quoted(by), -1)
    return Value(c.guard(by == "", "$split needs a delimiter", out), T.ArrayType(STRING))


@operator("$trim", "$ltrim", "$rtrim")
def _trim(c, arg, name):
    said = options(arg, "input", "chars", name)
    s = string(c, compile_expression(c, said["input"]), name).col
    chars = string(c, compile_expression(c, said["chars"]), name).col if "chars" in said else F.lit(_BLANKS)
    return Value({"$trim": F.btrim, "$ltrim": F.ltrim, "$rtrim": F.rtrim}[name](s, chars), STRING)


@operator("$strcasecmp")
def _casecmp(c, arg):
    a, b = (F.upper(F.coalesce(string(c, v, "$strcasecmp").col, F.lit(""))) for v in args(c, arg, 2, name="$strcasecmp"))
    return Value(F.when(a < b, -1).when(a > b, 1).otherwise(0), INT)


@operator("$replaceOne", "$replaceAll")
def _replace(c, arg, name):
    said = options(arg, "input find replacement", name=name)
    s, find, new = (string(c, compile_expression(c, said[k]), name).col for k in ("input", "find", "replacement"))
    if name == "$replaceAll":
        out = F.when(find == "", s).otherwise(F.replace(s, find, new))
    else:
        at = F.position(find, s)
        out = F.when(at == 0, s).otherwise(F.concat(F.substring(s, F.lit(1), at - 1), new, F.substring(s, at + F.char_length(find), F.char_length(s))))
    return Value(F.when(find.isNotNull() & new.isNotNull(), out), STRING)


# --- regular expressions --------------------------------------------------------------


def java_pattern(pattern: str, flags: str = "") -> str:
    """A pattern with flags i, m and s in the engine's dialect; g and y mean nothing here."""
    odd = set(flags) - set("imsgyu")
    if odd:
        raise CompileError(f"regular expression flags {', '.join(sorted(odd))} are not supported")
    own = "".join(f for f in "ims" if f in flags)
    body = re.sub(r"\(\?<(?![=!])([A-Za-z_]\w*)>", lambda m: "(?<" + m.group(1).replace("_", "") + ">", pattern)
    return (f"(?{own}{'u' if 'i' in own else ''})" if own else "") + body


def python_pattern(pattern: str, flags: str = "") -> re.Pattern:
    java_pattern(pattern, flags)
    body = re.sub(r"\(\?<(?![=!])", "(?P<", pattern)
    return re.compile(body, sum({"i": re.I, "m": re.M, "s": re.S}.get(f, 0) for f in set(flags)))


def from_compiled(p: re.Pattern) -> tuple[str, str]:
    return p.pattern, "".join(f for f, bit in (("i", re.I), ("m", re.M), ("s", re.S)) if p.flags & bit)


def _regex_args(c, arg, name):
    said = options(arg, "input regex", "options", name)
    s = string(c, compile_expression(c, said["input"]), name).col
    regex, flags = said["regex"], said.get("options") or ""
    if isinstance(regex, re.Pattern):
        own, more = from_compiled(regex)
        regex, flags = own, flags or more
    if not isinstance(regex, str) or regex.startswith("$") and len(regex) > 1 and regex[1].isalpha():
        raise CompileError(f"{name} needs a constant regular expression")
    return s, regex, flags


@operator("$regexMatch")
def _regex_match(c, arg):
    s, regex, flags = _regex_args(c, arg, "$regexMatch")
    return Value(V.true(s.rlike(java_pattern(regex, flags))), BOOL)


_MATCH = T.StructType([T.StructField("match", STRING), T.StructField("idx", INT), T.StructField("captures", T.ArrayType(STRING))])


def _matches(regex, flags, first):
    pattern = python_pattern(regex, flags)

    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return []
            found = []
            for m in pattern.finditer(text):
                found.append({"match": m.group(), "idx": m.start(), "captures": list(m.groups())})
                if first:
                    break
            return found

        return texts.map(one, na_action=None)

    return F.pandas_udf(run, T.ArrayType(_MATCH))


@operator("$regexFind")
def _regex_find(c, arg):
    s, regex, flags = _regex_args(c, arg, "$regexFind")
    return Value(F.get(_matches(regex, flags, True)(s), F.lit(0)), _MATCH)


@operator("$regexFindAll")
def _regex_find_all(c, arg):
    s, regex, flags = _regex_args(c, arg, "$regexFindAll")
    return Value(_matches(regex, flags, False)(s), T.ArrayType(_MATCH))


__all__ = ["all_known", "array", "known"]
