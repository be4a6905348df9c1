"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns (role, text) to a string. Successive turn prefixes are rendered and
consecutive outputs compared: where output k starts with output k-1, turn k's span is what was added. Where it does not,
the template has rewritten history; a conversation's first such turn is reported and its spans are not guessed.
Inside a span, the place of the text is found by rendering the last turn twice with texts that differ in every
character: what the two outputs share at the front and at the back belongs to the template.

The default template marks turns as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside texts and roles
are escaped reversibly: every ``<``, backslashes, ``|`` gets one backslash more, so no ``<|`` of a text survives as one; in
roles line ends are escaped as well.

Rows are dealt by conversation, sorted by turn within each task and streamed: one conversation is in memory at a time.

Defined results: null role or text is empty; turns go by number, ties by role, then text; null turn numbers come first; rows
with a null conversation id form one conversation; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

CONTROL = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


class MarkedTurns:
    """The default template. It keeps the rendered turns of the last conversation it saw, so a longer prefix of it renders only what is new."""

    def __init__(self):
        self.turns: list[Turn] = []
        self.pieces: list[str] = []

    def __call__(self, turns: list[Turn]) -> str:
        same = 0
        for old, new in zip(self.turns, turns, strict=False):
            if old is not new:
                break
            same += 1
        made = [f"<|im_start|>{escape_role(role)}\n{escape(text)}<|im_end|>\n" for role, text in turns[same:]]
        self.turns, self.pieces = [*self.turns[:same], *turns[same:]], [*self.pieces[:same], *made]
        return "".join(self.pieces)


marked_turns = MarkedTurns()


def shared_front(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def format_conversation(turns: list[Turn], template: Template = marked_turns) -> tuple[str, list[dict] | None, int | None]:
    """(output, spans, first rewritten turn). A span has start, end, text_start, text_end (code points) and role."""
    spans, before = [], template([])
    for k, (role, text) in enumerate(turns):
        now = template(turns[: k + 1])
        if not now.startswith(before):
            return template(turns), None, k
        one, two = template([*turns[:k], (role, "A")]), template([*turns[:k], (role, "B")])
        kept = len(before) if one.startswith(before) and two.startswith(before) else 0
        front = kept + shared_front(one[kept:], two[kept:])
        back = len(one) - front - 1
        spans.append({"turn": k, "role": role, "start": len(before), "end": len(now), "text_start": front, "text_end": len(now) - back})
        before = now
    return before, spans, None


SCHEMA = (
    "conv_id long, n_turns long, formatted string, history_rewritten_at int, "
    "spans array<struct<turn: int, role: string, start: int, end: int, text_start: int, text_end: int, loss: boolean>>"
)

SPAN = [
    ("turn", pa.int32()), ("role", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text_start", pa.int32()), ("text_end", pa.int32()),
    ("loss", pa.bool_()),
]
ARROW = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("history_rewritten_at", pa.int32()), ("spans", pa.list_(pa.struct(SPAN)))]
)


def format_chats(rows: DataFrame, template: Template = marked_turns, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): output, spans, loss mask by span."""

    def finish(conv: object, turns: list[Turn]) -> dict:
        out, spans, rewritten = format_conversation(turns, template)
        return {
            "conv_id": conv,
            "n_turns": len(turns),
            "formatted": out,
            "history_rewritten_at": rewritten,
            "spans": None if spans is None else [s | {"loss": s["role"] in loss_roles} for s in spans],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, done, size = None, [], [], 0
        for b in batches:
            # Arrow keeps ids as they are: whole numbers or none
            for c, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if turns and c != conv:
                    done.append(finish(conv, turns))
                    size += len(done[-1]["formatted"])
                    turns = []
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(done, ARROW)
                        done, size = [], 0
                conv = c
                turns.append((role, text))
        if turns:
            done.append(finish(conv, turns))
        if done:
            yield pa.RecordBatch.from_pylist(done, ARROW)

    order = ["conv_id", "turn", "role", "text"]
    picked = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return picked.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, SCHEMA)


def piece(span: Column, start: str, end: str) -> Column:
    return F.substring(F.col("formatted"), span[start] + 1, span[end] - span[start])


def read_back(span: Column) -> Column:
    """A turn's text as the default template's output has it, unescaped."""
    return F.regexp_replace(piece(span, "text_start", "text_end"), r"<\\(\\*)\|", r"<$1|")


def read_role(span: Column) -> Column:
    """A turn's role as the default template's output has it, unescaped."""
    raw = F.regexp_extract(piece(span, "start", "text_start"), r"(?s)^<\|im_start\|>(.*)\n$", 1)
    return F.regexp_replace(F.replace(F.replace(raw, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")), r"<\\(\\*)\|", r"<$1|")


def digests(formatted: DataFrame) -> DataFrame:
    """What ``format_chats`` with the default template wrote, read back: digests of turns and of the text under the loss mask."""
    turns = F.transform("spans", lambda s: F.concat(read_role(s), F.lit("\n"), read_back(s), F.lit("\n")))
    loss = F.transform(F.filter("spans", lambda s: s["loss"]), read_back)
    return formatted.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(F.array_join(loss, "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join(loss, ""), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
