"""Personal data, plain and disguised, with offsets into the source text.

Plain identifiers are found by fixed rules.  For disguised ones the text goes through
a chain of transducers: homoglyphs and other scripts' digits become ASCII, invisible
characters go, spelled digits become digits, and at/dot disguises become ``@`` and
``.``.  Each transducer keeps its edits in order, so an identifier found in the output
maps back to source characters by bisection.  Only spans that the chain has changed,
and that are not plain spans of the same kind, are added; they may overlap plain ones.
All steps take linear time, and memory in proportion to the edits.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import read

KINDS = ("email", "ip", "card", "phone")

# --- plain rules -------------------------------------------------------------------

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match never starts inside a run of digits, and no shorter run helps: possessive
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """As the pattern would match from left to right, in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, leftmost and not overlapping within a kind."""
    out: dict[str, list[tuple[int, int]]] = {"email": _emails(text) if "@" in text else []}
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    out["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and _is_card(m.group())]
    out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15] if "+" in text else []
    return out


def _is_card(said: str) -> bool:
    digits = _digits(said)
    return 12 <= len(digits) <= 19 and luhn(digits)


# --- transducers -------------------------------------------------------------------

# Letters of other scripts that look like ASCII ones.
_LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "·": ".", "\xa0": " ", " ": " ", " ": " ", " ": " ",
}
# Characters without a glyph.
_INVISIBLE = "­​‌‍‎‏⁠﻿"
# Digits as words, by language; position is the digit.
_SPELLED = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
# Words for the two marks of an address.
_AT_WORDS, _DOT_WORDS = "at arroba arobase", "dot punkt punto point"

_DIGIT_WORDS = {w: str(d) for words in _SPELLED.values() for d, w in enumerate(words.split())} | {"oh": "0"}
_one = "(?:" + "|".join(sorted(map(re.escape, _DIGIT_WORDS), key=len, reverse=True)) + ")"
_SEPARATOR = r"(?:[ ]?[,-][ ]?|[ ])"
#: at least three digits spelled out one after another, possibly among written ones
_RUN = re.compile(rf"(?<!\w)(?:(?:{_one}|[0-9])(?:{_SEPARATOR})){{2,}}(?:{_one}|[0-9])(?!\w)", re.I)
_WORD = re.compile(rf"(?<!\w){_one}(?!\w)", re.I)
_SEPARATED = re.compile(_SEPARATOR)
_at, _dot = _AT_WORDS.replace(" ", "|"), _DOT_WORDS.replace(" ", "|")
_BRACKETS = re.compile(rf"\s?[\[({{<]\s?(?:(?P<at>{_at}|@)|(?P<dot>{_dot}|\.))\s?[\])}}>]\s?", re.I)
# Endings that an address with a word for a mark may have; prose has other words there.
_ENDINGS = frozenset(
    "com org net edu gov mil int info biz name pro mobi dev app io ai co xyz online site store tech cloud shop blog wiki news email museum travel jobs coop aero uk de fr es eu us ca ch nl be pt mx ar br jp cn ru kr pl cz dk fi au nz ie gr hu ro ua tr za".split()
)
# Endings of countries that are words as well; they must end a sentence or the text.
_WORD_ENDINGS = frozenset("am an as at be by do en et he hi id il im in is it la lo ma me mi mu my no of on or pa pm re se si so st su to tu un va we".split())
_LOCAL_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
_LABEL = re.compile("[A-Za-z0-9-]+")
#: the mark of an address in words, or with blanks around @
_AT_MARK = re.compile(rf"[ ](?:{_at})[ ]|[ ]@[ ]|@", re.I)
_DOT_MARK = re.compile(rf"[ ](?:{_dot})[ ]|\.", re.I)
_DOTS = tuple(f" {w} " for w in _DOT_WORDS.split())
_DIGIT_DOT = re.compile(rf"(?<=[0-9])[ ](?:{_dot})[ ](?=[0-9])", re.I)
_PLUS = re.compile(r"(?<!\w)plus[ ](?=[0-9])", re.I)
_TRIGGER_WORDS = frozenset(_DIGIT_WORDS)
_MARK = re.compile(rf"(?:[\[({{<]\s?(?:{_at}|{_dot}|@|\.)\s?[\])}}>])|[ ](?:{_dot})[ ]|[ ]@[ ]", re.I)


def _fold(c: str) -> str:
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    plain = unicodedata.normalize("NFKC", c)
    if len(plain) == 1 and plain.isascii():
        return plain
    value = unicodedata.digit(c, None)
    return c if value is None else str(value)


def _folding() -> dict[int, str]:
    """Look-alikes, full-width forms, mathematical letters and the digits of some scripts, each as one ASCII character."""
    ranges = ((0xFF01, 0xFF5E), (0x660, 0x669), (0x6F0, 0x6F9), (0x966, 0x96F), (0x1D400, 0x1D7FF))
    every = [*map(ord, _LOOKALIKES), *(c for a, b in ranges for c in range(a, b + 1))]
    return {c: f for c in every if (f := _fold(chr(c))) != chr(c)}


_FOLDED = _folding()
_NO_GLYPH = re.compile(f"[{_INVISIBLE}]+")


class Mapped:
    """A text after some edits, which lead back to the source."""

    def __init__(self, source: str, text: str):
        self.source, self.text = source, text
        #: of each transducer, its edits in order: start and end after it and before it
        self.layers: list[tuple[array, array, array, array]] = []

    def replace(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """Apply (start, end, new) edits, in order and not overlapping."""
        text, at, size, own = [], 0, 0, tuple(array("q") for _ in range(4))
        for a, b, new in edits:
            text += (self.text[at:a], new)
            size += a - at
            for column, value in zip(own, (size, size + len(new), a, b)):
                column.append(value)
            size += len(new)
            at = b
        if at:
            self.text = "".join([*text, self.text[at:]])
            self.layers.append(own)

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The source range of a range of the text."""
        for start, end, before, after in reversed(self.layers):
            i, j = bisect_right(start, a) - 1, bisect_right(start, b - 1) - 1
            a = a if i < 0 else before[i] if a < end[i] else a - end[i] + after[i]
            b = b if j < 0 else after[j] if b <= end[j] else b - end[j] + after[j]
        return a, b


def _has_digit_word(text: str) -> bool:
    """Whether a spelled digit stands between blanks and marks; a piece of the text at a time."""
    step = 1 << 20
    for at in range(0, len(text), step):
        if not _TRIGGER_WORDS.isdisjoint(re.split(r"[\s,;.-]+", text[max(0, at - 16) : at + step].lower())):
            return True
    return False


def _local_start(text: str, free: int, at: int) -> int | None:
    """Where the words and dot marks that end at ``at`` begin, not before ``free``."""
    start = at
    while True:
        word = start
        while word > free and text[word - 1] in _LOCAL_WORD:
            word -= 1
        if word == start:
            return None
        if word > free and text[word - 1] == ".":
            mark = word - 1
        else:
            mark = next((word - len(d) for d in _DOTS if word - len(d) >= free and text[word - len(d) : word].lower() == d), word)
        if mark == word or mark <= free or text[mark - 1] not in _LOCAL_WORD:
            before = text[word - 1] if word else " "
            return None if before.isalnum() or before in "_.%+-" else word
        start = mark


def _domain_end(text: str, at: int) -> int | None:
    """Where the labels and dot marks that start at ``at`` end with a known ending."""
    found, spoken, first = None, False, True
    while m := _LABEL.match(text, at):
        label, after = m.group().lower(), text[m.end() : m.end() + 1]
        if label in _AT_SET and not spoken and not first:
            break
        if not first and not (after.isalnum() or after == "_"):
            plain = label in _ENDINGS
            country = spoken and len(label) == 2 and label.isalpha()
            if plain and label not in _WORD_ENDINGS or (plain or country) and (label not in _WORD_ENDINGS or after in _STOPS):
                found = m.end()
        mark = _DOT_MARK.match(text, m.end())
        if not mark or mark.end() > mark.start() + 1 and label in _AT_SET and not first:
            break
        spoken, first, at = mark.end() > mark.start() + 1, False, mark.end()
    return found


_AT_SET = frozenset(_AT_WORDS.split())
_STOPS = ("", ".", ",", ";", ":", "!", "?", ")", "\n", '"')


def _spoken_addresses(text: str) -> list[tuple[int, int, str]]:
    """Edits that turn addresses in words, or with blanks around @, into plain ones."""
    out, free, at = [], 0, 0
    while m := _AT_MARK.search(text, at):
        at = m.start() + 1
        start = _local_start(text, free, m.start())
        free_after = m.start() + 1
        if start is not None and (end := _domain_end(text, m.end())) is not None:
            dots = [(d.start(), d.end(), ".") for part in ((start, m.start()), (m.end(), end)) for d in _DOT_MARK.finditer(text, *part) if d.group() != "."]
            if dots or m.group() == " @ ":
                out += sorted([*dots, *([(*m.span(), "@")] if m.group() != "@" else [])])
                free_after = at = end
        free = max(free, free_after)
    return out


def normalise(text: str) -> Mapped | None:
    """The text after all transducers, or None if none of them has work."""
    folded = text if text.isascii() else text.translate(_FOLDED)
    hidden = not text.isascii() and _NO_GLYPH.search(text) is not None
    if folded is text or folded == text:
        if not (hidden or _MARK.search(text) or _has_digit_word(text)):
            return None
    out = Mapped(text, folded)
    if hidden:
        out.replace((*m.span(), "") for m in _NO_GLYPH.finditer(out.text))
    edits = []
    for run in _RUN.finditer(out.text):
        words = list(_WORD.finditer(out.text, run.start(), run.end()))
        if len(words) < 3:
            continue
        # words joined to the next digit; a separator between written digits stays
        for word in words:
            stop = _SEPARATED.match(out.text, word.end(), run.end())
            edits.append((word.start(), stop.end() if stop and stop.end() < run.end() else word.end(), _DIGIT_WORDS[word.group().lower()]))
    out.replace(edits)
    out.replace([(m.start(), m.end(), "+") for m in _PLUS.finditer(out.text)])
    out.replace([(m.start(), m.end(), "@" if m.group("at") else ".") for m in _BRACKETS.finditer(out.text)])
    out.replace([(m.start(), m.end(), ".") for m in _DIGIT_DOT.finditer(out.text)])
    out.replace(_spoken_addresses(out.text))
    return out


_TOP = re.compile(r"\.[A-Za-z]{2,}$")


def find_disguised(text: str, plain: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """Spans of identifiers that only show after normalisation."""
    mapped = normalise(text)
    if mapped is None:
        return []
    taken = {(kind, *s) for kind, spans in plain.items() for s in spans}
    out = []
    for kind, spans in find(mapped.text).items():
        for a, b in spans:
            said = mapped.text[a:b]
            if kind == "email" and not _TOP.search(said):
                continue
            span = (kind, *mapped.span(a, b))
            if span not in taken and text[span[1] : span[2]] != said:
                out.append(span)
    return out


def spans_of(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Plain spans, and the added ones, each by start and then by kind."""
    plain = find(text)
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(((k, a, b) for k, spans in plain.items() for a, b in spans), key=order)
    return base, sorted(find_disguised(text, plain), key=order)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or group of overlapping spans, as the first one's kind in brackets."""
    out, at, end = [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += (text[at:a], f"[{kind.upper()}]")
        at = end = max(end, b)
    return "".join([*out, text[at:]])


_FIELDS = ", ".join(f"n_{k} long" for k in KINDS) + ", base_spans string, spans string, n_added long"


def detect(docs: DataFrame, keep: list[str], *, text: str = "text", redact: bool = False) -> DataFrame:
    """``keep`` columns, counts of plain spans by kind, base_spans, spans, n_added.

    Spans are ``kind:start:end`` in code points, end exclusive, comma-joined.  With
    ``redact`` the column ``redacted`` follows, null where the text is null.  A null
    or empty text has no spans.  Columns of ``docs`` named like a result are replaced.
    One pass without a shuffle.
    """

    def work(part: pa.RecordBatch, own: K.Text) -> dict:
        raw, bounds = own.data.tobytes(), own.offsets.tolist()
        rows = []
        for a, b in zip(bounds, bounds[1:]):
            said = raw[a:b].decode()
            base, added = spans_of(said)
            every = sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
            counts = [sum(s[0] == k for s in base) for k in KINDS]
            join = lambda x: ",".join(f"{k}:{s}:{e}" for k, s, e in x)
            rows.append((*counts, join(base), join(every), len(added), redacted(said, every) if redact else None))
        columns = list(zip(*rows))
        out = dict(zip([*(f"n_{k}" for k in KINDS), "base_spans", "spans", "n_added"], columns))
        if redact:
            here = part.column(part.schema.get_field_index(text)).is_valid().to_pylist()
            out["redacted"] = [x if ok else None for x, ok in zip(columns[-1], here)]
        return out

    return K.map_texts(docs, text, keep, _FIELDS + (", redacted string" if redact else ""), work)


def base_digest(base_spans: str) -> str:
    return hashlib.sha256(base_spans.encode()).hexdigest()


def op3(spark, sf_dir: str) -> DataFrame:
    """Digest of the contract over all ``documents``."""
    found = detect(read(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added"
    )
