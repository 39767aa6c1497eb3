"""Chat formatting by a declarative template and a finite-state machine over roles.

Rows of a conversation arrive in the order of their turns.  The machine steps once a
turn; each turn becomes an opening, a text and a closing segment, with a loss flag on
the text of the roles that are to be learnt.  Control strings cannot occur inside a
text: their first characters, and the escape character, are escaped there, so reading
the output back gives the turns as they were.

Conversations are streamed: a task holds one Arrow batch and the machine's state,
however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import read

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Control strings by role, the learnt roles, and the order of turns."""

    begin: str = "<s>"
    turns: tuple[tuple[str, str, str], ...] = (
        ("system", "[SYS]", "[/SYS]"),
        ("user", "[INST]", "[/INST]"),
        ("assistant", "[ANSWER]", "</s>"),
    )
    #: for any other role: opening, end of its name, closing
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    learnt: tuple[str, ...] = ("assistant",)
    #: (state, role) -> state; what is missing is out of order
    order: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "ready"),
        ("start", "user", "asked"),
        ("ready", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
    )
    final: tuple[str, ...] = ("answered",)

    @cached_property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, *(c for t in self.turns for c in t[1:]), *self.other)

    @cached_property
    def marks(self) -> dict[str, tuple[str, str]]:
        return {role: (opening, closing) for role, opening, closing in self.turns}

    @cached_property
    def steps(self) -> dict[tuple[str, str], str]:
        return {(state, role): to for state, role, to in self.order}

    @cached_property
    def _unsafe(self) -> re.Pattern:
        return re.compile("[" + "".join(map(re.escape, sorted({ESCAPE, *(c[0] for c in self.controls)}))) + "]")

    @cached_property
    def _token(self) -> re.Pattern:
        longest = sorted(map(re.escape, self.controls), key=len, reverse=True)
        return re.compile(rf"(?:{re.escape(ESCAPE)}.)+|({'|'.join(longest)})", re.S)

    def escape(self, text: str) -> str:
        return self._unsafe.sub(lambda m: ESCAPE + m.group(), text)

    def unescape(self, text: str) -> str:
        return re.sub(rf"{re.escape(ESCAPE)}(.)", r"\1", text, flags=re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """One turn as (segment, under loss) pairs."""
        body = (self.escape(text), role in self.learnt)
        if role in self.marks:
            opening, closing = self.marks[role]
            return [(opening, False), body, (closing, False)]
        opening, named, closing = self.other
        return [(opening + self.escape(role) + named, False), body, (closing, False)]

    def parse(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of every turn of a formatted conversation."""
        reader = Reader(self)
        yield from reader.feed(formatted)
        reader.finish()


@dataclass
class Reader:
    """Reads formatted text back, segment by segment; segments end at control strings."""

    template: Template
    held: list[str] = field(default_factory=list)
    role: str | None = None
    naming: bool = False

    def feed(self, part: str) -> Iterator[tuple[str, str]]:
        t, at = self.template, 0
        opened = {opening: role for role, (opening, _) in t.marks.items()}
        for m in t._token.finditer(part):
            control = m.group(1)
            if control is None:
                continue  # escaped characters belong to a text
            self.held.append(part[at : m.start()])
            at = m.end()
            said, self.held = "".join(self.held), []
            if control == t.begin:
                continue
            if control in opened and self.role is None:
                self.role = opened[control]
            elif control == t.other[0] and self.role is None:
                self.naming, self.role = True, ""
            elif control == t.other[1] and self.naming:
                self.naming, self.role = False, t.unescape(said)
            elif self.role is not None and control == t.marks.get(self.role, ("", t.other[2]))[1]:
                yield self.role, t.unescape(said)
                self.role = None
            else:
                raise ValueError(f"{control} is out of place")
        self.held.append(part[at:])

    def finish(self) -> None:
        if self.role is not None or "".join(self.held):
            raise ValueError("the text ends inside a turn")


_SEGMENT = "conv_id long, seq long, turn long, role string, segment string, loss boolean, in_order boolean, ended boolean, accepted boolean"


def format_conversations(
    rows: DataFrame,
    template: Template | None = None,
    *,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Segments of all conversations, each conversation's in order within one partition.

    seq counts a conversation's segments from 0.  in_order says whether the machine
    accepts the turn; once a turn is out of order the later ones are too, and all are
    formatted all the same.  ended is true on a conversation's last segment; accepted
    says there whether the machine stops in a final state, and is null before.  A null
    text is empty, a null role is the empty role, a null conv_id is one conversation of
    its own; turns with equal numbers come in the order of role and text, null
    turns first.  Rows that repeat are turns that repeat.
    """
    template = template or Template()
    source = rows.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    dealt = source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        t, current, state, seq, last = template, _NONE, "start", 0, None
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_()]
        out: list[tuple] = []
        size = 0

        def flush():
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=_NAMES)

        for conv, number, who, said in (r for b in batches for part, _ in K.slices(b, "text") for r in zip(*(c.to_pylist() for c in part.columns))):
            if conv != current:
                if last is not None:
                    out.append((*last, True, state in t.final))
                    last = None
                current, state, seq = conv, "start", 0
                pending = [(t.begin, False)]
            else:
                pending = []
            state = t.steps.get((state, who), "broken")
            for part, loss in pending + t.segments(who, said):
                if last is not None:
                    out.append((*last, False, None))
                    size += len(last[4])
                last = (conv, seq, number, who, part, loss, state != "broken")
                seq += 1
            if size > 1 << 20 or len(out) > 4096:
                yield flush()
                out, size = [], 0
        if last is not None:
            out.append((*last, True, state in t.final))
        if out:
            yield flush()

    return dealt.mapInArrow(run, _SEGMENT)


_NONE = object()
_NAMES = [x.split()[0] for x in _SEGMENT.split(", ")]
_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean, accepted boolean"


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, from parsing its segments; keeps their partitions."""
    template = template or Template()

    def run(batches):
        fresh = lambda: [Reader(template), hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
        state = fresh()
        for batch in batches:
            out = []
            names = ["conv_id", "segment", "loss", "in_order", "ended", "accepted"]
            few = (x.select(names) for x, _ in K.slices(batch, "segment"))
            for conv, part, loss, valid, ended, accepted in (r for x in few for r in zip(*(c.to_pylist() for c in x.columns))):
                reader, turns, learnt, n, chars, size, ordered = state
                for who, said in reader.feed(part):
                    turns.update(f"{who}\n{said}\n".encode())
                    n += 1
                if loss:
                    plain = template.unescape(part)
                    learnt.update(plain.encode())
                    chars += len(plain)
                state = [reader, turns, learnt, n, chars, size + len(part), ordered and valid]
                if ended:
                    reader.finish()
                    out.append((conv, state[3], turns.hexdigest(), state[4], learnt.hexdigest(), state[5], state[6], state[6] and accepted))
                    state = fresh()
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in _DIGEST.split(", ")]
                )

    return segments.mapInArrow(run, _DIGEST)


def op9(spark, sf_dir: str) -> DataFrame:
    """Digest of the contract over all ``conversations`` and conversation -7."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(more)))
