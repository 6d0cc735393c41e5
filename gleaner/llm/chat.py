"""Chat formatting by incremental black-box rendering.

A template is a function from turns to text; nothing is assumed of how it works. Successive prefixes of a conversation
are rendered and each output is compared with the one before: what is new is the span of the new turn. If an output
does not begin with the one before, the template has rewritten history, and the turn is marked. Two renderings of the
same turn that differ in one known character show where its text stands within its span.

A template that declares itself turn-local (an attribute ``turn_local`` that is true) renders each turn without a look
at turns further back than ``CONTEXT`` or at later ones. Only for such, a conversation of over ``SEGMENT`` turns is
rendered in segments that overlap by ``CONTEXT`` turns, so that work and memory stay in proportion to its length. For any
other template all prefixes are rendered whole, which takes work in proportion to the square of the length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.arrow import column, map_arrow

#: Turns that are rendered together; turns of the segment before that are rendered along.
SEGMENT, CONTEXT = 64, 2
Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """``text`` without control strings: a backslash goes between "<" and "|", behind any that stand there."""
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def chatml(turns: list[Turn]) -> str:
    """Marks the start and end of each turn; control strings within roles and texts are escaped reversibly."""
    return "".join(f"<|im_start|>{_role(role)}\n{escape(text)}<|im_end|>\n" for role, text in turns)


chatml.turn_local = True


def _role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def parse_chatml(formatted: str) -> list[Turn]:
    """The turns of a text that :func:`chatml` made; anything else in the text raises an error."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn begins at {at}")
        turns.append((unescape(m[1]).replace("%0A", "\n").replace("%25", "%"), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn begins at {at}")
    return turns


def common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:  # halves: comparisons of slices run in C
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def spans(template: Template, turns: list[Turn], context: list[Turn] = ()) -> tuple[str, list[tuple[int, int, int, int, bool]]]:
    """What ``turns`` add to the rendering of ``context``, and for each turn, within that: the start and end of its span
    and of its text in it, and whether it rewrote what came before (then its spans are empty)."""
    before = list(context)
    last = template(before)
    base = last if before else ""  # what stands before all turns is part of the text
    found = []
    for role, text in turns:
        now = template([*before, (role, text)])
        rewrote = not now.startswith(last)
        # Two texts of one character each part where the turn's text begins; they agree again where it ends.
        one, two = template([*before, (role, "a")]), template([*before, (role, "b")])
        head = common_prefix(one, two)
        tail = common_prefix(one[head:][::-1], two[head:][::-1])
        start, end = len(last) - len(base), len(now) - len(base)
        text_start, text_end = head - len(base), end - tail
        if rewrote or start < 0 or not start <= text_start <= text_end <= end:
            rewrote, start, text_start, text_end = True, end, end, end
        found.append((start, end, text_start, text_end, rewrote))
        before.append((role, text))
        last = now
    return last[len(base) :] if last.startswith(base) else last, found


SEGMENTS = "conv_id long, segment int, formatted string, roles array<string>, spans array<struct<start:int,end:int,text_start:int,text_end:int,rewrote:boolean>>"


def format_chats(conversations: DataFrame, template: Template = chatml) -> DataFrame:
    """Renders each conversation of ``conversations`` (conv_id, turn, role, text), rows in order of turn.

    One row per segment, of up to SEGMENT turns if the template is turn-local and else of the whole conversation: conv_id, segment, formatted, and for each turn its role and the spans of
    the turn and of its text in formatted, in code points; ``rewrote`` marks a turn that changed the rendering of
    earlier ones. The segments of a conversation, joined, are its formatted text, and are neighbours in one partition.
    Null texts and roles are empty, rows with one turn number go by role and text, a null turn comes first, rows without
    conv_id form a conversation of their own. Other columns are ignored; an empty table gives an empty result.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    most = SEGMENT if getattr(template, "turn_local", False) else None
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text_start", pa.int32()), ("text_end", pa.int32()), ("rewrote", pa.bool_())]))
    schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int32()), ("formatted", pa.string()), ("roles", pa.list_(pa.string())), ("spans", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, held, context = None, 0, [], []

        def segment() -> dict:
            text, found = spans(template, held, context)
            names = ("start", "end", "text_start", "text_end", "rewrote")
            return {"conv_id": at[0], "segment": number, "formatted": text, "roles": [r for r, _ in held], "spans": [dict(zip(names, x, strict=True)) for x in found]}

        for batch in batches:
            out = []
            for conv, role, text in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if at != (conv,) or len(held) == most:
                    if held:
                        out.append(segment())
                    same = at == (conv,)
                    number, context, held, at = (number + 1, held[-CONTEXT:], [], at) if same else (0, [], [], (conv,))
                held.append((role, text))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([segment()], schema)

    return map_arrow(rows, run, SEGMENTS)


def read_back(segments: DataFrame, learned: str = "assistant", parse: Callable[[str], list[Turn]] = parse_chatml, plain: Callable[[str], str] = unescape) -> DataFrame:
    """What the result of :func:`format_chats` holds, read from the formatted texts alone and from the mask.

    Per conversation: conv_id, n_turns, turns_sha256 (of role, line break, text, line break per turn), loss_chars and
    loss_sha256 (of the texts of the role ``learned``, cut out by their spans), formatted_chars, rewrites. Digests go
    on from segment to segment, so a conversation of any length takes constant memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = None, None

        def row() -> dict:
            return {"conv_id": at[0], "n_turns": n[0], "turns_sha256": n[1].hexdigest(), "loss_chars": n[2], "loss_sha256": n[3].hexdigest(), "formatted_chars": n[4], "rewrites": n[5]}

        kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.int64())])
        for batch in batches:
            out = []
            for conv, text, roles, found in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "formatted", "roles", "spans")), strict=True):
                if at != (conv,):
                    if at:
                        out.append(row())
                    at, n = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                turns = parse(text)
                for role, words in turns:
                    n[1].update(f"{role}\n{words}\n".encode())
                for role, x in zip(roles, found, strict=True):
                    n[5] += x["rewrote"]
                    if role == learned:
                        words = plain(text[x["text_start"] : x["text_end"]])
                        n[2] += len(words)
                        n[3].update(words.encode())
                n[0] += len(turns)
                n[4] += len(text)
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)
        if at:
            yield pa.RecordBatch.from_pylist([row()], kinds)

    return map_arrow(segments, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long")
