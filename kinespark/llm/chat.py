"""Conversations as training texts: turn-aligned windows of bounded length with a loss mask.

Turns stream through a task in order with the prefix sums of their tokens; a window is a span of
turns, and differences of the sums choose where it starts and ends. A window has the system
turn, a limited repeat of the turns just before, and new turns. Only assistant texts that stand
in a window for the first time are under its loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_counts import counter

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
#: Values of `turn` in one segment of a conversation.
SEGMENT = 4096


def escape(text: str) -> str:
    """text without the opening of a control string: every "<", backslashes, "|" gets one more
    backslash. unescape() takes it away again."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def written(role: str, text: str) -> str:
    """A turn as the template has it."""
    return f"{START}{_role(role)}\n{escape(text)}{END}\n"


class Turn(NamedTuple):
    role: str
    text: str
    #: Sums of the tokens of the segment's turns before this one, and with it.
    before: int
    after: int


WINDOWS = "conv_id long, segment long, window long, first_turn long, n_new long, n_repeated long, n_tokens long, text string, loss array<struct<start:long,end:long>>"


def _windows(tokenizer: str, budget: int, history: int):
    def window(key: tuple, number: int, at: int, system: list[Turn], past: list[Turn], new: list[Turn]) -> tuple:
        text, loss, end = [], [], 0
        for fresh, turn in [*((False, t) for t in [*system, *past]), *((True, t) for t in new)]:
            own = written(turn.role, turn.text)
            if fresh and turn.role == "assistant":
                start = end + own.index("\n") + 1
                loss.append({"start": start, "end": end + len(own) - len(END) - 1})
            text.append(own)
            end += len(own)
        n_tokens = sum(t.after - t.before for t in system) + new[-1].after - (past or new)[0].before
        return *key, number, at, len(new), len(system) + len(past), n_tokens, "".join(text), loss

    def windows(rows: Iterator[tuple]) -> Iterator[tuple]:
        """rows: (conv_id, segment, given, role, text) in order; `given` opens a later segment and
        has the system turn that it repeats, if any. What is held is one window and its history."""
        count = counter(tokenizer)
        key, number, at, seen, total, first = None, 0, 0, 0, 0, True
        system: list[Turn] = []
        past: list[Turn] = []
        new: list[Turn] = []
        for conv, segment, given, role, text in rows:
            if (conv, segment) != key:
                if new:
                    yield window(key, number, at, system, past, new)
                key, number, at, seen, total, first = (conv, segment), 0, 0, 0, 0, True
                system, past, new = [], [], []
            if given:
                system, first = [Turn(role, text, 0, count(written(role, text)))] if role is not None else [], False
                continue
            n = count(written(role, text))
            turn = Turn(role, text, total, total + n)
            total = turn.after
            if new and sum(t.after - t.before for t in system) + turn.after - (past or new)[0].before > budget:
                yield window(key, number, at, system, past, new)
                recent = [*past, *new]
                if first and seen == len(recent) and recent[0].role == "system":
                    system = [recent[0]]
                kept = sum(t.after - t.before for t in system)
                recent = recent[1:] if system and system[0] is recent[0] else recent
                # the longest span of latest turns within `history` that leaves room for the new turn
                past = [t for t in recent if turn.before - t.before <= history and kept + turn.after - t.before <= budget]
                number, at, new = number + 1, seen, []
            new.append(turn)
            seen += 1
        if new:
            yield window(key, number, at, system, past, new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "given", "role", "text")), strict=True)

        rows: list[tuple] = []
        held = 0
        for row in windows(turns()):
            rows.append(row)
            held += len(row[7])
            if held > 4_000_000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    names = ["conv_id", "segment", "window", "first_turn", "n_new", "n_repeated", "n_tokens", "text", "loss"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def format_windows(conversations: DataFrame, tokenizer: str, budget: int = 512, history: int = 128, segment: int = SEGMENT) -> DataFrame:
    """Rows (conv_id, segment, window, first_turn, n_new, n_repeated, n_tokens, text, loss): each
    conversation as windows of at most `budget` tokens of the tokenizer file `tokenizer`, which
    every executor must have. n_tokens is the sum of the window's turns as they are written.

    Windows end between turns. Each turn is new in exactly one window; n_repeated turns stand
    before the new ones: the conversation's first turn, if its role is system, in every later
    window and whatever its length, and the latest turns of the window before that take at most
    `history` tokens and leave room for a new turn. A turn longer than what is left has a window
    of its own, cut nowhere: only such a window, or one whose system turn alone leaves no room,
    is over the budget. loss has the code point spans in `text` of the assistants' new texts.

    Turns go by `turn`, ties by role and text, nulls first. Windows also end where `turn` reaches
    a multiple of `segment`; the segments of a conversation are formatted in different tasks,
    each streaming, so that one conversation may be any part of the table. A later segment
    repeats the system turn and no other. A null `turn` is a segment of its own, the first. A
    null text or role is empty; a null conv_id is a conversation. Repeated rows are turns of
    their own. Other columns are ignored.
    """
    empty = F.lit("")
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = conversations.select(
        "conv_id", F.floor(F.col("turn") / segment).cast("long").alias("segment"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    # the first turn of conversations with several segments goes to the later ones too
    several = turns.groupBy("conv_id", "segment").agg(F.lit(1).alias("one"))
    long = several.groupBy("conv_id").agg(F.count("*").alias("segments"), F.min(F.struct("segment")).alias("least")).where("segments > 1")
    long = long.select(F.col("conv_id").alias("long_id"), "least.segment")
    here = F.col("conv_id").eqNullSafe(F.col("long_id"))
    starts = turns.alias("t").join(long.alias("l"), here & F.col("t.segment").eqNullSafe(F.col("l.segment"))).groupBy("long_id").agg(F.min(F.struct("t.turn", "t.role", "t.text")).alias("first"))
    later = several.alias("t").join(long.alias("l"), here & ~F.col("t.segment").eqNullSafe(F.col("l.segment"))).select("conv_id", "t.segment")
    given = later.join(starts.where("first.role = 'system'"), F.col("conv_id").eqNullSafe(F.col("long_id")), "left").select(
        "conv_id", "segment", F.lit(0).alias("given"), F.lit(None).cast("long").alias("turn"), "first.role", "first.text"
    )
    rows = turns.select("conv_id", "segment", F.lit(1).alias("given"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(given)
    ordered = rows.repartition(n, "conv_id", "segment").sortWithinPartitions("conv_id", "segment", "given", "turn", "role", "text")
    return ordered.select("conv_id", "segment", (F.col("given") == 0).alias("given"), "role", "text").mapInArrow(_windows(tokenizer, budget, history), WINDOWS)


def parse_window(text: str) -> list[tuple[str, int, int]]:
    """(role, start, end) of each turn's escaped text in a formatted window."""
    return [(_unrole(m[1]), m.start(2), m.end(2)) for m in re.finditer(rf"{re.escape(START)}([^\n]*)\n(.*?){re.escape(END)}\n", text, re.DOTALL)]


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, n_turns, loss, chars, windows = object(), 0, 0, 0, 0
    turns, masked = hashlib.sha256(), hashlib.sha256()
    out: list[tuple] = []
    names = [x.split()[0] for x in READ.split(", ")]
    for batch in batches:
        for key, repeated, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_repeated", "text", "loss")), strict=True):
            if windows and key != conv:
                out.append((conv, n_turns, turns.hexdigest(), loss, masked.hexdigest(), chars, windows))
                n_turns = loss = chars = windows = 0
                turns, masked = hashlib.sha256(), hashlib.sha256()
            conv = key
            windows += 1
            chars += len(text)
            for role, start, end in parse_window(text)[repeated:]:
                turns.update(f"{role}\n{unescape(text[start:end])}\n".encode())
                n_turns += 1
            for span in spans:
                own = unescape(text[span["start"] : span["end"]])
                loss += len(own)
                masked.update(own.encode())
        if len(out) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names).cast(_READ)
            out = []
    if windows:
        out.append((conv, n_turns, turns.hexdigest(), loss, masked.hexdigest(), chars, windows))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names).cast(_READ)


_READ = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (x.split() for x in READ.split(", "))])


def read_back(windows: DataFrame) -> DataFrame:
    """One row for each conversation, parsed from its windows alone: number of turns, digest of
    role, \\n, text, \\n of every turn, length and digest of the text under the loss mask, code
    points of all windows and number of windows."""
    n = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = windows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "segment", "window")
    return ordered.select("conv_id", "n_repeated", "text", "loss").mapInArrow(_read, READ)
