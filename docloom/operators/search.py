"""Full-text search: a small query language, matched and ranked by BM25.

A query is terms, "phrases", prefixes*, field : term, AND, OR, NOT and parentheses;
terms side by side are all needed.  One pass counts documents and lengths, another one
scores; texts are never shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError
from ..functions import Context
from ..functions.stemming import porter
from ..plans import paths
from ..plans.values import Value

K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}]+"
TOKENIZERS = ("unicode61", "unicode61 remove_diacritics 0", "trigram", "porter")


def _diacritics() -> tuple[str, str]:
    """Latin letters with marks, and the letters without."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _UNMARKED = _diacritics()
_UNMARK = str.maketrans(_MARKED, _UNMARKED)
_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([()])|(:)|([^\s()":]+))')


@dataclass(frozen=True)
class Leaf:
    tokens: tuple[str, ...]
    prefix: bool = False
    field: str | None = None


@dataclass(frozen=True)
class Node:
    op: str
    parts: tuple


def tokens(text: str, tokenizer: str = "unicode61") -> list[str]:
    if tokenizer == "trigram":
        low = text.lower()
        return [low[i : i + 3] for i in range(len(low) - 2)]
    low = text.lower() if tokenizer.endswith("diacritics 0") else text.lower().translate(_UNMARK)
    found = re.findall(r"[^\W_]+", low)
    return [porter(w) for w in found] if tokenizer == "porter" else found


def parse(query: str, fields: list[str], tokenizer: str = "unicode61"):
    words, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = _LEX.match(query, at)
        if not m:
            raise CompileError(f"the query is malformed at {query[at:]!r}")
        quoted, paren, colon, word = m.groups()
        words.append(("phrase", quoted.replace('""', '"')) if quoted is not None else ("op", paren or colon) if paren or colon else ("word", word))
        at = m.end()
    pos = 0

    def peek():
        return words[pos] if pos < len(words) else ("end", "")

    def take():
        nonlocal pos
        pos += 1
        return words[pos - 1]

    def either():
        left = both()
        while peek() == ("word", "OR"):
            take()
            left = Node("or", (left, both()))
        return left

    def both():
        left = without()
        while peek()[0] in ("word", "phrase") and peek()[1] != "OR" or peek() == ("op", "("):
            if peek() == ("word", "AND"):
                take()
            left = Node("and", (left, without()))
        return left

    def without():
        left = single()
        while peek() == ("word", "NOT"):
            take()
            left = Node("not", (left, single()))
        return left

    def single():
        kind, value = peek()
        if (kind, value) == ("op", "("):
            take()
            inner = either()
            if peek() != ("op", ")"):
                raise CompileError("a parenthesis is not closed")
            take()
            return inner
        if kind not in ("word", "phrase") or kind == "word" and value in ("AND", "OR", "NOT"):
            raise CompileError("the query lacks a term")
        take()
        if peek() == ("op", ":"):
            take()
            if value not in fields:
                raise CompileError(f"the index has no field {value}")
            kind, word = peek()
            if kind not in ("word", "phrase"):
                raise CompileError("a field needs a term")
            take()
            return leaf(word, kind, value)
        return leaf(value, kind, None)

    def leaf(word, kind, field):
        prefix = word.endswith("*")
        own = tuple(tokens(word.rstrip("*"), tokenizer))
        if not own:
            raise CompileError(f"{word!r} has no token")
        return Leaf(own, prefix, field)

    if not words:
        raise CompileError("the query is empty")
    out = either()
    if pos < len(words):
        raise CompileError("the query has a part too many")
    return out


def leaves(node) -> list[Leaf]:
    if isinstance(node, Leaf):
        return [node]
    # what is excluded adds nothing to a score
    parts = node.parts[:1] if node.op == "not" else node.parts
    return [x for p in parts for x in leaves(p)]


def text_of(v: Value) -> Column:
    """A string, or the strings of an array joined by spaces; nothing else has text."""
    if v.kind == "string":
        return F.coalesce(v.col, F.lit(""))
    if v.kind == "array" and Value(v.col, v.type.elementType).kind == "string":
        return F.coalesce(F.array_join(v.col, " "), F.lit(""))
    return F.lit("")


def _tokens(text: Column, tokenizer: str) -> Column:
    low = F.lower(text)
    if tokenizer == "trigram":
        n = F.char_length(low) - 2
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(low, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    found = F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))
    if not tokenizer.endswith("diacritics 0"):
        found = F.transform(found, lambda w: F.when(F.octet_length(w) > F.char_length(w), F.translate(w, _MARKED, _UNMARKED)).otherwise(w))
    return _stems(found) if tokenizer == "porter" else found


def _stems(words: Column) -> Column:
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda own: [porter(w) for w in own])

    return F.pandas_udf(run, T.ArrayType(T.StringType()))(words)


def _frequency(c: Column, leaf: Leaf) -> Column:
    """How often a phrase occurs among the tokens."""
    n = len(leaf.tokens)

    def here(i):
        parts = [F.get(c, i + k) == t for k, t in enumerate(leaf.tokens[:-1])]
        last = F.get(c, i + (n - 1))
        parts.append(last.startswith(leaf.tokens[-1]) if leaf.prefix else last == leaf.tokens[-1])
        return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))

    return F.size(F.filter(F.transform(c, lambda x, i: here(i)), lambda hit: hit))


def _count(words: Column, leaf: Leaf) -> Column:
    """How many of the tokens are a one-token leaf."""
    (t,) = leaf.tokens
    if leaf.prefix:
        return F.size(F.filter(words, lambda x: x.startswith(t)))
    return F.size(words) - F.size(F.array_remove(words, F.lit(t)))


def search(df: DataFrame, c: Context, fields: list[str], query: str, tokenizer: str = "unicode61", *, limit: int | None = None, skip: int = 0, order: str | None = None) -> DataFrame:
    """Matching rows with ``score``, best first; ties come in the natural order."""
    tree = parse(query, fields, tokenizer)
    own = list(dict.fromkeys(leaves(tree)))
    # a table of a few large row groups would be walked over by as many tasks
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * 2 <= cores:
        df = df.repartition(cores)
    every = list(dict.fromkeys(own + _all(tree)))
    freq = {leaf: f"_f{i}" for i, leaf in enumerate(every)}
    counts = {leaf: [] for leaf in every}
    tokens = {f"w{i}": _tokens(text_of(paths.plain(c.root, f)), tokenizer) for i, f in enumerate(fields)}
    # exploding one struct keeps its evaluation to once a row: nothing is pushed below it or inlined
    once = F.explode(F.array(F.struct(*[v.alias(k) for k, v in tokens.items()])))
    base, sizes = df.select("*", once.alias("_w")), []
    for i, f in enumerate(fields):
        words = F.col("_w")[f"w{i}"]
        sizes.append(F.size(words))
        for leaf in every:
            if leaf.field in (None, f):
                counts[leaf].append(_count(words, leaf) if len(leaf.tokens) == 1 else _frequency(words, leaf))
    names = {leaf: F.coalesce(reduce(lambda a, b: a + b, own_parts), F.lit(0)) for leaf, own_parts in counts.items()}
    base = base.withColumns({freq[leaf]: n for leaf, n in names.items()})
    base = base.withColumn("_len", reduce(lambda a, b: a + b, sizes)).drop("_w")

    def holds(node) -> Column:
        if isinstance(node, Leaf):
            return F.col(freq[node]) > 0
        a, b = (holds(p) for p in node.parts)
        return {"and": a & b, "or": a | b, "not": a & ~b}[node.op]

    totals = base.agg(F.count("*").alias("n"), F.avg("_len").alias("avg"), *[F.count_if(F.col(freq[x]) > 0).alias(f"d{i}") for i, x in enumerate(own)]).first()
    score = F.lit(0.0)
    for i, leaf in enumerate(own):
        idf = F.log(F.lit((totals.n - totals[f"d{i}"] + 0.5) / (totals[f"d{i}"] + 0.5) + 1.0))
        tf = F.col(freq[leaf])
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.lit(totals.avg or 1.0)))
    out = base.where(holds(tree)).withColumn("score", score)
    out = out.drop("_len", *freq.values()).orderBy(F.col("score").desc(), *([F.col(order).asc()] if order else []))
    out = out.offset(skip) if skip else out
    return out.limit(limit) if limit else out


def _all(node) -> list[Leaf]:
    return [node] if isinstance(node, Leaf) else [x for p in node.parts for x in _all(p)]
