"""Chat formatting in budgeted windows.

A conversation's turns are rendered by one template and laid into windows of at most `BUDGET` tokens, turn-aligned: the
running sum of the tokens of the rendered turns, template and escapes included, chooses how far a window reaches. Every
window begins with the system turn, if there is one, and repeats up to `HISTORY` tokens of the turns before it for context;
the loss mask covers the text of assistant turns that are new in the window, so a repeated target is never trained on twice.
Where the system turn and the next turn do not fit into one window together, that window goes without the system turn. Only
a turn that is longer than the budget by itself exceeds it; it has a window to itself.

The template writes `<turn role="user">`, a line feed, the text and `</turn>` with a line feed. Inside a text (and a
role) every backslash and every `<` gets a backslash before it, so no control string can appear in it and `unescape`
gives the text back.

Conversations stream through sorted partitions: a task holds one window, however many turns a conversation has.

Defined cases: a null text counts as empty, a null role as `user`, a null turn sorts first; rows of one turn go by role,
then text; repeated rows are turns of their own; a null conv_id is a conversation; only the first turn can be the system
turn kept in every window; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

BUDGET = 2048
HISTORY = 512
VOCABULARY = "word_bpe_49k.json"

_ESCAPE = re.compile(r"[\\<]")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r'<turn role="((?:[^\\"<]|\\.)*)">\n((?:[^\\<]|\\.)*)</turn>\n', re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's formatted text and where its own text begins and ends there."""
    head = f'<turn role="{escape(role).replace(chr(34), chr(92) + chr(34))}">\n'
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


@dataclass
class Window:
    """A formatted window: the loss spans are code points [start, end); `repeated` turns come first."""

    text: str
    loss: list[tuple[int, int]]
    turns: int
    repeated: int


def windows(turns: Iterator[tuple[str, str]], count, budget: int = BUDGET, history: int = HISTORY) -> Iterator[Window]:
    """The windows of one conversation's (role, text) turns; `count` gives the tokens of a rendered turn, which add up, as
    every turn ends with a line feed."""
    system: tuple[str, str, int] | None = None
    fresh: list[tuple[str, str, int]] = []
    shown: list[tuple[str, str, int]] = []  # what the window repeats: the system turn, then history
    used = 0

    def close() -> Window:
        parts, loss, at = [], [], 0
        for k, (role, text, _) in enumerate(shown + fresh):
            made, start, end = render(role, text)
            if k >= len(shown) and role == "assistant":
                loss.append((at + start, at + end))
            parts.append(made)
            at += len(made)
        return Window("".join(parts), loss, len(shown) + len(fresh), len(shown))

    for k, (role, text) in enumerate(turns):
        turn = (role, text, count(render(role, text)[0]))
        if fresh and used + turn[2] > budget:
            yield close()
            before = [t for t in shown + fresh if t is not system]
            with_system = system is not None and system[2] + turn[2] <= budget
            used = system[2] if with_system else 0
            room, repeated = min(history, budget - used - turn[2]), []
            for t in reversed(before):
                room -= t[2]
                if room < 0:
                    break
                repeated.insert(0, t)
                used += t[2]
            shown, fresh = ([system] if with_system else []) + repeated, []
        if k == 0 and role == "system":
            system = turn
        fresh.append(turn)
        used += turn[2]
    if fresh:
        yield close()


def read_back(window: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of the turns of a formatted window."""
    out, at = [], 0
    while at < len(window):
        m = _TURN.match(window, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def format_conversations(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(conv_id, window, text, loss, turns, repeated): the formatted windows of conversations in order."""
    common.arrow_batches(rows.sparkSession)
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary).encode

        def count(text: str) -> int:
            return len(encode(text)) // 4

        def turns() -> Iterator[tuple[int | None, str, str]]:
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True)

        stream = turns()
        head = next(stream, None)
        while head is not None:
            conv, following = head[0], [None]

            def own(first=head, conv=conv, following=following) -> Iterator[tuple[str, str]]:
                yield first[1], first[2]
                for t in stream:
                    if t[0] != conv:
                        following[0] = t
                        return
                    yield t[1], t[2]

            for k, w in enumerate(windows(own(), count, budget, history)):
                loss = [x for span in w.loss for x in span]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((conv, k, w.text, loss, w.turns, w.repeated), _TYPES, strict=True)], names=_NAMES)
            head = following[0]

    return dealt.mapInArrow(run, "conv_id long, window int, text string, loss array<long>, turns int, repeated int")


_NAMES = ["conv_id", "window", "text", "loss", "turns", "repeated"]
_TYPES = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.int32(), pa.int32())


def digests(formatted: DataFrame) -> DataFrame:
    """What the windows of each conversation hold, read back from the formatted text and the loss spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, started = None, None, False

        def row() -> pa.RecordBatch:
            n_turns, turns_sum, loss_chars, loss_sum, chars = state
            values = (conv, n_turns, turns_sum.hexdigest(), loss_chars, loss_sum.hexdigest(), chars)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _DIGEST_TYPES, strict=True)], names=_DIGEST_NAMES)

        for batch in batches:
            for c, text, loss, repeated in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "text", "loss", "repeated")], strict=True):
                if not started or c != conv:
                    if started:
                        yield row()
                    conv, started, state = c, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                found = read_back(text)
                spans = {(s, e) for s, e in zip(loss[::2], loss[1::2], strict=True)}
                for role, said, start, end in found[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    spans.discard((start, end)) if role == "assistant" else None
                if spans:
                    raise ValueError("a loss span is not the text of a new assistant turn")
                for start, end in zip(loss[::2], loss[1::2], strict=True):
                    said = unescape(text[start:end])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
        if started:
            yield row()

    # The windows of a conversation come out of one task in order, and stay so.
    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_DIGEST_NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
_DIGEST_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: what all formatted conversations hold, and one whose texts look like templates."""
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(rows.unionByName(more)))
