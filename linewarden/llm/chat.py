"""Chat formatting with a grammar that is read back and compared.

A turn is rendered as ``### <role>: <text></turn>`` and a line end. The parser is
deterministic: a header runs to the first unescaped colon and blank, a text to the first
unescaped end mark, and no other unescaped control string may stand inside; a backslash
before a control string or before a backslash makes it plain content. Each turn is rendered without escapes first, read back, and if it does not
come back identical, rendered again with more of its content escaped:

0. nothing, 1. control strings, 2. control strings and backslashes.

The last always comes back, since every special place is then escaped. A rendered turn ends
with an unescaped end mark, so a conversation is the concatenation of its turns, and
reading that gives the turns again.

Defined results: a null text or role is an empty one; rows of a conversation are ordered
by turn, null turns first, ties by the rendered turn; repeated rows are turns of their own; null
conversation ids form one conversation; a text may be of any length; an empty table gives
no rows. Extra columns take no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewarden.llm.common import ship_package

OPEN, CLOSE, MIDDLE, ESCAPE = "### ", "</turn>", ": ", "\\"
#: Strings that the parser acts on; the last only in a header.
CONTROL = ("###", CLOSE, MIDDLE)
LEARNED = "assistant"


class Content:
    """How a role or a text is escaped, read and ended."""

    def __init__(self, control: tuple[str, ...], end: str):
        special = "|".join(map(re.escape, control))
        self.end = end
        self.escape = re.compile(rf"\\(\\|{special})")
        #: What a level escapes.
        self.levels = (None, re.compile(special), re.compile(rf"\\|{special}"))
        #: An escape, which is stepped over, or a control string.
        self.mark = re.compile(rf"\\(?:\\|{special})|({special})")

    def escaped(self, content: str, level: int) -> str:
        by = self.levels[level]
        return by.sub(lambda m: ESCAPE + m[0], content) if by else content

    def plain(self, content: str) -> str:
        return self.escape.sub(lambda m: m[1], content)

    def until(self, rendered: str, at: int) -> re.Match | None:
        """The end of the content; none if another control string stands before it."""
        found = next((m for m in self.mark.finditer(rendered, at) if m[1]), None)
        return found if found and found[1] == self.end else None


ROLE, TEXT = Content(CONTROL, MIDDLE), Content(CONTROL[:2], CLOSE)


def parse(rendered: str) -> tuple[list[tuple[str, str, int, int]], int]:
    """Turns (role, text, start and end of the raw text) and where reading stopped."""
    turns, at = [], 0
    while rendered.startswith(OPEN, at):
        header = ROLE.until(rendered, at + len(OPEN))
        body = header and TEXT.until(rendered, header.end())
        if not body or not rendered.startswith("\n", body.end()):
            break
        role = ROLE.plain(rendered[at + len(OPEN) : header.start()])
        raw = rendered[header.end() : body.start()]
        turns.append((role, TEXT.plain(raw), header.end(), body.start()))
        at = body.end() + 1
    return turns, at


def render(role: str, text: str) -> tuple[str, int]:
    """A turn with as few escapes as let it come back, and their level."""
    for level in range(3):
        out = f"{OPEN}{ROLE.escaped(role, level)}{MIDDLE}{TEXT.escaped(text, level)}{CLOSE}\n"
        turns, end = parse(out)
        if end == len(out) and [t[:2] for t in turns] == [(role, text)]:
            return out, level
    raise AssertionError("a fully escaped turn comes back")


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, turn, segment, level, loss_start, loss_end: a row for every turn.

    The formatted conversation is its segments one after the other; the loss mask covers
    [loss_start, loss_end) of a segment, nothing where both are null.
    """
    ship_package(turns.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for role, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                segment, level = render(role, text)
                _, _, start, end = parse(segment)[0][0]
                learned = role == LEARNED
                out.append((segment, level, start if learned else None, end if learned else None))
            segments, levels, starts, ends = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(segments, pa.string()),
                    pa.array(levels, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(ends, pa.int64()),
                ],
                names=["conv_id", "turn", "segment", "level", "loss_start", "loss_end"],
            )

    empty = F.lit("")
    rows = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce("role", empty).alias("role"),
        F.coalesce("text", empty).alias("text"),
    )
    return rows.mapInArrow(
        of,
        "conv_id long, turn long, segment string, level int, loss_start long, loss_end long",
    )


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of every conversation, from its segments alone.

    Segments are sorted within partitions and folded as they come, so a task holds a few
    turns at a time, however long the conversation.
    """
    ship_package(segments.sparkSession)
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def row(s: list) -> tuple:
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        for b in batches:
            done = []
            for conv, segment, start, end in zip(
                *(b.column(i).to_pylist() for i in range(4)), strict=True
            ):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(row(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns, at = parse(segment)
                if at != len(segment):
                    raise ValueError(f"conversation {conv} has a segment outside the grammar")
                for role, text, _, _ in turns:
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learned = TEXT.plain(segment[start:end])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(segment)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
                if done
                else [pa.array([], t) for t in types],
                names=names,
            )
        if state is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row(state), types, strict=True)], names=names
            )

    order = ["conv_id", "turn", "segment"]
    rows = segments.repartition("conv_id").sortWithinPartitions(*order)
    return rows.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(fold, DIGESTS)
