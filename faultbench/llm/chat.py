"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. Its text is never taken apart by
knowledge of the template: successive prefixes of a conversation are rendered, and comparing
each output with the one before locates the new turn's span. Where an output doesn't begin with
the one before, the template rewrites history and the turn is marked. Two more renderings, with
the prompt for the next turn and with an empty text, locate the text inside an assistant's span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turns and characters after which a conversation goes on in a new row of the result.
BLOCK_TURNS, BLOCK_CHARS = 64, 1 << 20


class Template(Protocol):
    """``context``: how many turns before a turn its rendering depends on; None: on all of them."""

    context: int | None

    def render(self, turns: list[tuple[str, str]], prompt: str | None = None) -> str:
        """The turns (role, text); then, if ``prompt`` is a role, what stands before its text."""


class MarkedTurns:
    r"""``### role: text</turn>`` and a line feed for each turn.

    ``\``, ``#`` and ``<`` in a text, and ``:`` too in a role, get a ``\`` before them, so neither
    mark can occur inside a text, and ``read`` gives every text back as it was.
    """

    context: int | None = 0
    _turn = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<])*)</turn>\n", re.S)

    def render(self, turns: list[tuple[str, str]], prompt: str | None = None) -> str:
        out = [f"### {self.escape(r).replace(':', chr(92) + ':')}: {self.escape(t)}</turn>\n" for r, t in turns]
        if prompt is not None:
            out.append(f"### {self.escape(prompt).replace(':', chr(92) + ':')}: ")
        return "".join(out)

    @staticmethod
    def escape(text: str) -> str:
        return re.sub(r"([\\#<])", r"\\\1", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a formatted text."""
        turns, at = [], 0
        while at < len(formatted):
            m = self._turn.match(formatted, at)
            if not m:
                raise ValueError(f"no turn at character {at}")
            turns.append((self.unescape(m[1]), self.unescape(m[2])))
            at = m.end()
        return turns


@dataclass
class Located:
    """Formatted text, and for each turn its span, the span under the loss mask (or None), and
    whether the template changed what stood before."""

    text: str
    spans: list[tuple[int, int]] = field(default_factory=list)
    loss: list[tuple[int, int] | None] = field(default_factory=list)
    rewrites: list[bool] = field(default_factory=list)


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def locate(
    template: Template, turns: list[tuple[str, str]], before: list[tuple[str, str]] = (), masked: str = "assistant"
) -> Located:
    """Render ever longer prefixes of ``turns`` (after ``before``) and compare each with the last.

    The text and all offsets begin where the rendering of ``before`` ends.
    """
    seen = list(before)
    last = template.render(seen)
    base = len(last) if before else 0
    out = Located("")
    for role, text in turns:
        now = template.render([*seen, (role, text)])
        kept = now.startswith(last)
        out.rewrites.append(not kept)
        out.spans.append(((len(last) if kept else _common(last, now)) - base, len(now) - base))
        mask = None
        if role == masked and kept:
            opened = template.render(seen, role)
            closed = len(template.render([*seen, (role, "")])) - len(opened)
            if now.startswith(opened) and closed >= 0 and len(now) - closed >= len(opened):
                mask = (len(opened) - base, len(now) - closed - base)
        out.loss.append(mask)
        seen.append((role, text))
        last = now
    out.text = last[base:]
    return out


SCHEMA = (
    "conv_id long, block long, formatted string, "
    "turns array<struct<start:int,stop:int,loss_start:int,loss_stop:int,rewrites:boolean>>"
)


def format_conversations(conversations: DataFrame, template: Template, masked: str = "assistant") -> DataFrame:
    """Rows (conv_id, block, formatted, turns): each conversation's text in one or more blocks.

    A conversation is the rows of one conv_id by turn (ties by role and text; nulls first; a
    null conv_id is a conversation like any other; repeated rows are turns of their own). Null
    roles and texts count as empty. If the template declares the context that a turn depends on,
    a long conversation is rendered in blocks, each after its context, and a task holds one
    block; otherwise prefixes reach back to the first turn, as the template asks for.

    A conversation's blocks stand in order, one after another, within one partition. Extra
    columns are ignored; an empty table gives an empty result.
    """
    rows = (
        conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, block, held, size = None, 0, [], 0
        before: list[tuple[str, str]] = []
        out: list[tuple] = []

        def close() -> None:
            nonlocal block, held, size, before
            if held:
                got = locate(template, held, before, masked)
                marks = [
                    {"start": a, "stop": b, "loss_start": m and m[0], "loss_stop": m and m[1], "rewrites": w}
                    for (a, b), m, w in zip(got.spans, got.loss, got.rewrites)
                ]
                out.append((conv, block, got.text, marks))
                before = [*before, *held][-template.context :] if template.context else []
            block, held, size = block + 1, [], 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 4
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "block", "formatted", "turns"])

        mark = [("start", pa.int32()), ("stop", pa.int32()), ("loss_start", pa.int32()), ("loss_stop", pa.int32())]
        types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([*mark, ("rewrites", pa.bool_())]))]
        fresh = True
        for batch in batches:
            for c, role, text in zip(*[batch.column(k).to_pylist() for k in ("conv_id", "role", "text")]):
                if fresh or c != conv:
                    close()
                    conv, block, before, fresh = c, 0, [], False
                elif template.context is not None and (len(held) >= BLOCK_TURNS or size >= BLOCK_CHARS):
                    close()
                held.append((role, text))
                size += len(text)
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    return rows.mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame, template: MarkedTurns) -> DataFrame:
    """Digests of what the formatted blocks hold, one row for each conversation.

    Takes the blocks as ``format_conversations`` leaves them: in order, within a partition. The
    blocks are read one after another, so memory doesn't grow with a conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        out: list[tuple] = []

        def close() -> None:
            if now:
                out.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6]))

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, types)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rewrites"]
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] == 0:
                    close()
                    now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                text = row["formatted"]
                for t in row["turns"]:
                    for role, said in template.read(text[t["start"] : t["stop"]]):
                        now[1] += 1
                        now[2].update(f"{role}\n{said}\n".encode())
                    if t["loss_start"] is not None:
                        said = template.unescape(text[t["loss_start"] : t["loss_stop"]])
                        now[3] += len(said)
                        now[4].update(said.encode())
                    now[6] += t["rewrites"]
                now[5] += len(text)
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    return formatted.mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, n_rewrites long",
    )
