"""Chat formatting by event-sourced reconstruction.

A log holds what happened to the messages of conversations: opened, streamed in deltas, edited,
generated anew, retracted.  Logs are partitioned by conversation and sorted by sequence; a fold turns
the events of each message into its final text, and the messages in order are rendered with a
template that records which characters count for the loss.

Events are sorted message by message, so the fold holds one message at a time.  A conversation is cut into
spans of ``TURNS`` turns, each a partition key of its own, and rendered in parts of about ``PART_CHARS``
characters at most beyond a turn: a long one spreads over tasks, a common one is one part.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURNS_SHIFT = 8  # 256 turns
PART_CHARS = 1_000_000
ROWS_AT_ONCE, CHARS_AT_ONCE = 1_000, 8_000_000  # of a result batch
LEARNED = ("assistant",)

# What opens and closes a turn of each role; other roles are named in their turn.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE] ", "[/ROLE]")
CONTROLS = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]"]

# A control string in a text gets a backslash after its first character, one that has some already one more.
_REST = "|".join(re.escape(c[1:]) for c in CONTROLS)
_PLAIN, _ESCAPED = re.compile(rf"([<\[])(\\*)({_REST})"), re.compile(rf"([<\[])\\(\\*)({_REST})")

PARTS = "conv_id bigint, span bigint, part int, n_turns int, formatted string, loss array<struct<start: int, end: int>>"
FIGURES = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text starts and ends in it."""
    opening, closing = MARKS.get(role) or (f"{OTHER[0]}{escape(json.dumps(role, ensure_ascii=False))}\n", OTHER[1])
    body = escape(text)
    return opening + body + closing, len(opening), len(opening) + len(body)


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of every turn of a rendered part."""
    at = 0
    while at < len(formatted):
        for role, (opening, closing) in MARKS.items():
            if formatted.startswith(opening, at):
                start = at + len(opening)
                break
        else:
            if not formatted.startswith(OTHER[0], at):
                raise ValueError(f"no turn starts at character {at}")
            start = formatted.index("\n", at) + 1
            role, closing = json.loads(unescape(formatted[at + len(OTHER[0]) : start - 1])), OTHER[1]
        end = formatted.index(closing, start)
        yield role, unescape(formatted[start:end])
        at = end + len(closing)


class _Message:
    """The fold of one message's events."""

    def __init__(self) -> None:
        self.role, self.pieces, self.there = "", [""], True

    def take(self, kind: str | None, role: str | None, text: str | None) -> None:
        if kind == "open":
            self.role, self.pieces, self.there = role or "", [text or ""], True
        elif kind == "delta":
            self.pieces.append(text or "")
        elif kind == "edit":
            self.pieces = [text or ""]
        elif kind == "regenerate":
            self.pieces = []
        elif kind == "retract":
            self.there = False


def _messages(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(conv_id, span, role, text) of every message of sorted events."""
    now, message = None, None
    for conv, span, turn, name, kind, role, text in rows:
        if message is None or (conv, span, turn, name) != now:
            if message is not None and message.there:
                yield now[0], now[1], message.role, "".join(message.pieces)
            now, message = (conv, span, turn, name), _Message()
        message.take(kind, role, text)
    if message is not None and message.there:
        yield now[0], now[1], message.role, "".join(message.pieces)


def _parts(messages: Iterable[tuple], learned: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of ``PARTS``; a new part where the conversation or its span changes, or the part is long."""
    now, part, turns, size, loss = None, 0, [], 0, []
    for conv, span, role, text in messages:
        if turns and ((conv, span) != now or size >= PART_CHARS):
            yield *now, part, len(turns), "".join(turns), loss
            part = part + 1 if (conv, span) == now else 0
            turns, size, loss = [], 0, []
        now = conv, span
        turn, start, end = render(role, text)
        if role in learned:
            loss.append({"start": size + start, "end": size + end})
        turns.append(turn)
        size += len(turn)
    if turns:
        yield *now, part, len(turns), "".join(turns), loss


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, len(batch), ROWS_AT_ONCE):
            yield from zip(*[c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns])


_PART_TYPE = pa.schema([
    ("conv_id", pa.int64()), ("span", pa.int64()), ("part", pa.int32()), ("n_turns", pa.int32()), ("formatted", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])


def formatted(log: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """Rendered conversations in parts (``PARTS``), from a log with ``conv_id, turn, message, seq, kind, role, text``.

    A message is named by conversation, turn and ``message``; turns are in order, messages of one
    turn in the order of their names.  Its events follow ``seq``: ``open`` gives role and first text, ``delta``
    appends, ``edit`` puts a new text, ``regenerate`` drops what was streamed, ``retract`` takes the
    message away until it is opened again; any other kind changes nothing.  Events of equal ``seq`` are taken by
    kind, then text, and repeated ones each count.  Null texts and roles are empty; a null conversation, turn or name is one
    like any other and comes first.  ``loss`` has the characters of the texts of ``learned`` roles, counted
    within the part.  Parts of a conversation follow (span, part).  An empty log has no parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for row in _parts(_messages(_rows(batches)), learned):
            held.append(row)
            chars += len(row[4])
            if len(held) >= ROWS_AT_ONCE or chars >= CHARS_AT_ONCE:
                yield pa.RecordBatch.from_pylist([dict(zip(_PART_TYPE.names, r)) for r in held], _PART_TYPE)
                held, chars = [], 0
        yield pa.RecordBatch.from_pylist([dict(zip(_PART_TYPE.names, r)) for r in held], _PART_TYPE)

    events = log.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.shiftright(F.col("turn").cast("bigint"), TURNS_SHIFT).alias("span"), F.col("turn").cast("bigint").alias("turn"),
        F.col("message").cast("string").alias("message"), "kind", "role", "text", "seq",
    )
    dealt = events.repartition("conv_id", "span").sortWithinPartitions("conv_id", "span", "turn", "message", "seq", "kind", "text")
    return dealt.drop("seq").mapInArrow(run, PARTS)


def read_back(parts: DataFrame) -> DataFrame:
    """``FIGURES`` of every conversation, parsed from its rendered parts.

    ``turns_sha256`` runs over role, line end, text and line end of each turn, ``loss_sha256`` over the unescaped text under
    the loss mask.  A digest of a whole conversation is sequential, so its parts pass through one task,
    in order, one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, started = None, False
        turns, chars, learned, all_turns, all_loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        for conv, text, loss in _rows(batches):
            if started and conv != now:
                out.append((now, turns, all_turns.hexdigest(), learned, all_loss.hexdigest(), chars))
                if len(out) >= ROWS_AT_ONCE:
                    yield _figures(out)
                    out = []
                turns, chars, learned, all_turns, all_loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            now, started = conv, True
            for role, said in turns_of(text):
                turns += 1
                all_turns.update(f"{role}\n{said}\n".encode())
            for span in loss:
                said = unescape(text[span["start"] : span["end"]])
                learned += len(said)
                all_loss.update(said.encode())
            chars += len(text)
        if started:
            out.append((now, turns, all_turns.hexdigest(), learned, all_loss.hexdigest(), chars))
        yield _figures(out)

    dealt = parts.select("conv_id", "span", "part", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "span", "part")
    return dealt.select("conv_id", "formatted", "loss").mapInArrow(run, FIGURES)


def _figures(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in FIGURES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def as_log(rows: DataFrame, piece: int = 200, most_pieces: int = 64) -> DataFrame:
    """The log that ends in given rows (conv_id, turn, role, text).

    Messages of learned roles start as a wrong draft and are generated anew in deltas, others are sent with a slip and
    edited.  Rows of one turn are named, and so ordered, by role and a digest of the text; equal rows are messages of their own.
    """
    text = F.coalesce("text", F.lit(""))
    name = F.concat_ws(":", F.coalesce("role", F.lit("")), F.md5(text.cast("binary")), F.monotonically_increasing_id().cast("string"))
    size = F.greatest(F.lit(piece), F.ceil(F.length(text) / most_pieces)).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), size)
    event = lambda kind, said: F.struct(F.lit(kind).alias("kind"), F.col("role").alias("role"), said.alias("text"))
    deltas = F.transform(starts, lambda s: event("delta", F.substring(text, s + 1, size)))
    streamed = F.concat(F.array(event("open", F.reverse(F.substring(text, 1, piece))), event("regenerate", F.lit(None).cast("string"))), deltas)
    typed = F.array(event("open", F.concat(F.substring(text, 1, piece), F.lit("?"))), event("edit", text))
    events = F.when(F.col("role").isin(*LEARNED), streamed).otherwise(typed)
    named = rows.select("conv_id", "turn", "role", "text", name.alias("message"))  # before its events are rows
    return named.select("conv_id", "turn", "message", F.posexplode(events).alias("seq", "e")).select("conv_id", "turn", "message", "seq", "e.*")
