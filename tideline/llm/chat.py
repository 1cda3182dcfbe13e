"""Chat formatting by a finite-state machine over roles and a declarative template.

The template names, for each role, the marks before and after a turn and whether
its text bears loss. The machine walks a conversation's turns, says whether their
order is valid, and emits text segments, each with its loss flag. Marks inside
texts are escaped, so the output can be read back without doubt.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.storage import with_fields

ESCAPE = "\\"


@dataclass(frozen=True)
class Role:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """roles: marks by role. other: marks of a role without any of its own, whose name stands between before and named."""

    start: str = "<s>"
    roles: dict[str, Role] = field(default_factory=lambda: {"system": Role("<<SYS>>", "<</SYS>>"), "user": Role("[INST]", "[/INST]"), "assistant": Role("[ANS]", "</s>", True)})
    other: Role = Role("[ROLE]", "[/TURN]")
    named: str = "[/ROLE]"
    #: By state, where each role leads; a role not listed is out of order and leaves the state as it is.
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    final: tuple[str, ...] = ("user", "assistant")

    def marks(self) -> list[str]:
        own = [m for r in [*self.roles.values(), self.other] for m in (r.before, r.after)]
        return sorted({self.start, self.named, *own}, key=lambda m: (-len(m), m))


class Formatter:
    def __init__(self, template: Template):
        self.t = template
        marks = template.marks()
        if len({m for m in marks if m}) != len(marks) or any(ESCAPE in m for m in marks):
            raise ValueError("marks must not be empty or hold the escape")
        befores = [r.before for r in [*template.roles.values(), template.other]]
        if len(set(befores)) != len(befores):
            raise ValueError("each role needs a first mark of its own")
        any_mark = "|".join(map(re.escape, marks))
        # A mark in a text, or what with the mark after the text could be read as one.
        starts = "|".join(re.escape(m[:i]) for m in marks for i in range(len(m) - 1, 0, -1))
        self.danger = re.compile(rf"\\|(?={any_mark})|(?=(?:{starts})\Z)")
        self.scan = re.compile(rf"\\(.)|({any_mark})", re.S)
        self.by_before = {r.before: name for name, r in template.roles.items()}

    def escaped(self, text: str) -> str:
        return self.danger.sub(lambda m: ESCAPE + m.group(), text)

    def segments(self, turns: list[tuple[str | None, str]]) -> tuple[list[tuple[str, bool]], int]:
        """Segments (text, loss), and the first turn out of order (the number of turns if only the end is missing; -1 if all is well)."""
        state, bad, out = "start", -1, [(self.t.start, False)]
        for i, (role, text) in enumerate(turns):
            step = self.t.moves.get(state, {}).get(role)
            if step is None and bad < 0:
                bad = i
            state = step or state
            marks = self.t.roles.get(role)
            if marks:
                out.append((marks.before, False))
            else:
                marks = self.t.other
                out += [(marks.before, False), (self.escaped(role or ""), False), (self.t.named, False)]
            out += [(self.escaped(text), marks.loss), (marks.after, False)]
        if bad < 0 and state not in self.t.final:
            bad = len(turns)
        return out, bad

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns (role, text) of a formatted conversation."""
        parts: list[tuple[str | None, str]] = []  # (mark, "") or (None, text)
        at, held = 0, ""
        for m in self.scan.finditer(formatted):
            held += formatted[at : m.start()]
            at = m.end()
            if m[2] is None:
                held += m[1]
            else:
                parts += [(None, held), (m[2], "")]
                held = ""
        parts.append((None, held + formatted[at:]))
        turns, i = [], 0
        while i < len(parts):
            mark = parts[i][0]
            if mark in self.by_before:
                turns.append((self.by_before[mark], parts[i + 1][1]))
                i += 3
            elif mark == self.t.other.before:
                turns.append((parts[i + 1][1], parts[i + 3][1]))
                i += 5
            else:
                i += 1
        return turns

    def unescaped(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def conversations_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order. Null turn numbers come first; ties go by role, then text."""
    one = F.struct(F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))


def format_chats(rows: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, segments, first_bad_turn) of each conversation.

    segments are (start, end, loss) in code points of formatted and cover it.
    first_bad_turn is -1 if the roles are in order. Null texts are empty; a null
    role is an empty one; a role without marks is written out by name. Repeated
    rows are turns of their own. Rows with a null conv_id are one conversation. An
    empty table gives none; other columns are not looked at, whatever their names.
    A conversation is written in one task, as its output is one text.
    """
    schema = with_fields(rows.select(F.col(conv).alias("conv_id")).schema, "formatted string, segments array<struct<start:bigint,end:bigint,loss:boolean>>, first_bad_turn int")
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Formatter(template)
        for batch in batches:
            texts, spans, bads = [], [], []
            for turns in batch.column(1).to_pylist():
                made, bad = machine.segments([(t["role"], t["text"]) for t in turns])
                at, own = 0, []
                for piece, loss in made:
                    own.append({"start": at, "end": at + len(piece), "loss": loss})
                    at += len(piece)
                texts.append("".join(p for p, _ in made))
                spans.append(own)
                bads.append(bad)
            span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("loss", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, span_type), pa.array(bads, pa.int32())], names=schema.names)

    return conversations_of(rows, conv, turn, role, text).mapInArrow(run, schema)


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """What can be read back from the output of format_chats: its turns and the text under the loss flags."""
    template = template or Template()
    schema = with_fields(formatted.select("conv_id").schema, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid_order boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Formatter(template)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text, spans, bad in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                turns = machine.parse(text)
                loss = "".join(machine.unescaped(text[s["start"] : s["end"]]) for s in spans if s["loss"])
                sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8")).hexdigest()
                for column, v in zip(out, (len(turns), sha, len(loss), hashlib.sha256(loss.encode("utf-8")).hexdigest(), len(text), bad < 0), strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)]], names=schema.names)

    return formatted.select("conv_id", "formatted", "segments", "first_bad_turn").mapInArrow(run, schema)
