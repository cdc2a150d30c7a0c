r"""Chat formatting by a finite-state machine over roles and a declarative template.

The template gives, per role, the control strings around a turn and whether its
text carries loss. Control strings inside texts are escaped by a backslash
after their first character, backslashes by doubling; a backslash and any
character read back as that character, so the escape is reversible and no
control string survives inside a text.

One output row is one segment: conversation, turn number, segment number, text,
loss flag, and the machine's state. A conversation streams through its task
row by row, so its length doesn't matter for memory. Defined results: a null
text is empty, a null role is the role ``""``; roles that the template doesn't
know get its generic form; turns in an order that the machine doesn't allow are
formatted as well and marked ``valid = false`` from there on; rows of equal
turn are ordered by role and text; null conv_ids form one conversation; an
empty table gives no segments. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.llm.common import map_batches


@dataclass(frozen=True)
class Template:
    """roles: role -> (opening, closing, loss); other: the same for any other role, whose name stands between opening and its end."""

    roles: dict = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>", False), "user": ("[INST]", "[/INST]", False), "assistant": ("<s>", "</s>", True)})
    other: tuple = ("<<ROLE>>", "<</ROLE>>", "<</TURN>>", False)
    #: state -> role -> next state; a missing entry is an invalid turn
    moves: dict = field(default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})

    def controls(self) -> list[str]:
        return sorted({s for r in self.roles.values() for s in r[:2]} | set(self.other[:3]), key=lambda s: (-len(s), s))


CHAT = Template()
SEGMENTS = "conv_id long, turn_no long, segment_no long, kind string, text string, loss boolean, state string, valid boolean"


def escaper(template: Template) -> re.Pattern:
    ahead = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls())
    return re.compile(rf"\\|{ahead}")


def escape(text: str, pattern: re.Pattern) -> str:
    return pattern.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def step(template: Template, state: str, role: str) -> tuple[str, bool]:
    """The machine's move: next state, and whether the turn was allowed. After an invalid turn it goes on from that role's state."""
    if (to := template.moves.get(state, {}).get(role)) is not None:
        return to, True
    return (role if role in template.moves else state), False


def render_turn(template: Template, role: str, text: str, pattern: re.Pattern) -> list[tuple[str, str, bool]]:
    """(kind, text, loss) segments of one turn: open, text, close."""
    if role in template.roles:
        opening, closing, loss = template.roles[role]
    else:
        opening, closing, loss = template.other[0] + escape(role, pattern) + template.other[1], template.other[2], template.other[3]
    return [("open", opening, False), ("text", escape(text, pattern), loss), ("close", closing, False)]


def format_chats(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per segment (columns of SEGMENTS), in order within a partition and conversation."""
    ordered = (
        turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = escaper(template)
        now, state, valid, turn = ..., "start", True, 0
        for b in batches:
            rows = []
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != now:
                    now, state, valid, turn = conv, "start", True, 0
                state, allowed = step(template, state, role)
                valid &= allowed
                for k, (kind, part, loss) in enumerate(render_turn(template, role, text, pattern)):
                    rows.append((conv, turn, 3 * turn + k, kind, part, loss, state, valid))
                turn += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 8, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_()], strict=True)], ["conv_id", "turn_no", "segment_no", "kind", "text", "loss", "state", "valid"])

    return map_batches(ordered, run, SEGMENTS)


def role_of(template: Template, opening: str) -> str:
    """The role that an opening control string stands for."""
    for role, (own, _, _) in template.roles.items():
        if own == opening:
            return role
    return unescape(opening.removeprefix(template.other[0]).removesuffix(template.other[1]))


def digests(segments: DataFrame, template: Template = CHAT) -> DataFrame:
    """Per conversation, read back from its segments, which must come in format_chats' order and partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = ..., []
        turns = learned = None
        n = loss = total = 0
        ok = True

        def close() -> None:
            done.append((now, n, turns.hexdigest(), loss, learned.hexdigest(), total, ok))

        for b in batches:
            for conv, kind, text, flag, valid in zip(*(b.column(c).to_pylist() for c in ("conv_id", "kind", "text", "loss", "valid")), strict=True):
                if conv != now:
                    if turns is not None:
                        close()
                    now, turns, learned, n, loss, total = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                total += len(text)
                ok = valid
                if kind == "open":
                    n += 1
                    turns.update(role_of(template, text).encode() + b"\n")
                elif kind == "text":
                    plain = unescape(text)
                    turns.update(plain.encode() + b"\n")
                    if flag:
                        loss += len(plain)
                        learned.update(plain.encode())
            if len(done) >= 4096:
                yield batch(done)
                done = []
        if turns is not None:
            close()
        yield batch(done)

    def batch(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 7, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])

    return map_batches(segments, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
