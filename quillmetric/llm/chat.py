"""Chat formatting with a grammar round trip.

Every turn is rendered by a template, parsed again by a deterministic parser, and compared with its source. Text that
the parser would misread is escaped, step by step, until the recovered turn is identical.

Grammar: a conversation is a row of turns, each of which ends itself:

    user       "[INST] " text " [/INST]"
    assistant  " " text "</s>"
    other      "[ROLE:" role "] " text " [/ROLE]"

Inside a text, a backslash before a backslash or before a control string makes the latter a part of the text; an unescaped
control string that does not end the turn is an error. In a role, backslash and "]" are escaped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmetric.llm.work import Workspace, slices

CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "[ROLE:", "[/ROLE]")
_FRAMES = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")}
_ANY_CONTROL = "|".join(map(re.escape, CONTROLS))
_CONTROL = re.compile(_ANY_CONTROL)
_ESCAPED_OR_CONTROL = re.compile(rf"\\(\\|{_ANY_CONTROL})|({_ANY_CONTROL})")
_ROLE_END = re.compile(r"(?<!\\)(?:\\\\)*\] ")

FORMATTED = "conv_id long, turn long, segment string, loss_start int, loss_end int"
PARSED = "conv_id long, turn long, role string, text string, loss_text string, n_chars long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str, level: int) -> str:
    """Level 0 leaves the text, 1 escapes control strings, 2 backslashes as well."""
    if level >= 2:
        text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: "\\" + m.group(), text) if level else text


def unescape(text: str) -> str:
    return _ESCAPED_OR_CONTROL.sub(lambda m: m.group(1) or m.group(2), text)


def frame(role: str) -> tuple[str, str]:
    if role in _FRAMES:
        return _FRAMES[role]
    return "[ROLE:" + role.replace("\\", "\\\\").replace("]", "\\]") + "] ", " [/ROLE]"


def render(role: str, text: str, level: int) -> tuple[str, int, int]:
    """The turn, and where its text begins and ends there."""
    before, after = frame(role)
    body = escape(text, level)
    return before + body + after, len(before), len(before) + len(body)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Turns ``(role, text, start, end)`` of a formatted text; start and end enclose the written text. Raises ValueError."""
    turns, at = [], 0
    while at < len(formatted):
        if formatted.startswith("[INST] ", at):
            role, end, body = "user", "[/INST]", at + 7
        elif formatted.startswith("[ROLE:", at):
            close = _ROLE_END.search(formatted, at + 6)
            if close is None:
                raise ValueError("a role without end")
            role = re.sub(r"\\(.)", r"\1", formatted[at + 6:close.end() - 2], flags=re.S)
            end, body = "[/ROLE]", close.end()
        elif formatted.startswith(" ", at):
            role, end, body = "assistant", "</s>", at + 1
        else:
            raise ValueError(f"no turn begins at {at}")
        stop = next((m for m in _ESCAPED_OR_CONTROL.finditer(formatted, body) if m.group(2)), None)
        if stop is None or stop.group(2) != end:
            raise ValueError(f"the turn at {at} does not end")
        last = stop.start() - (end != "</s>")  # the blank before a closing bracket
        if last < body or formatted[last:stop.start()].strip(" "):
            raise ValueError(f"the turn at {at} does not end")
        turns.append((role, unescape(formatted[body:last]), body, last))
        at = stop.end()
    return turns


def render_identical(role: str, text: str) -> tuple[str, int, int]:
    """The turn with as little escaping as gives back the same turn."""
    for level in range(3):
        segment, start, end = render(role, text, level)
        try:
            if parse(segment) == [(role, text, start, end)]:
                return segment, start, end
        except ValueError:
            pass
    raise ValueError("a turn cannot be formatted")


def with_sample(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose two turns consist of control strings."""
    spark = conversations.sparkSession
    sample = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", sample), (-1, 1, "assistant", sample)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(own)


def write_formatted(conversations: DataFrame, path: str) -> None:
    """Write one formatted segment per turn of ``conversations(conv_id, turn, role, text)`` with its loss mask.

    The segments of a conversation in order of turn are its formatted text. Null texts and roles are empty. The loss mask covers the
    texts of assistant turns; for others it is empty. Rows stay where they are: no conversation is gathered.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            roles, texts = ([v or "" for v in batch.column(c).to_pylist()] for c in ("role", "text"))
            made = [render_identical(r, t) for r, t in zip(roles, texts)]
            masks = [(a, b) if r == "assistant" else (0, 0) for r, (_, a, b) in zip(roles, made)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array([s for s, _, _ in made], pa.string()),
                 pa.array([a for a, _ in masks], pa.int32()), pa.array([b for _, b in masks], pa.int32())],
                ["conv_id", "turn", "segment", "loss_start", "loss_end"])

    conversations.select("conv_id", "turn", "role", "text").mapInArrow(each, FORMATTED).write.parquet(path)


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """The stored segments, parsed: role, text, the text under the loss mask (null where nothing is masked), length."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for segment, a, b in zip(*(batch.column(c).to_pylist() for c in ("segment", "loss_start", "loss_end"))):
                (role, text, _, _), = parse(segment)
                rows.append((role, text, unescape(segment[a:b]) if b else None, len(segment)))
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"),
                 *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))]],
                [f.split()[0] for f in PARSED.split(", ")])

    return spark.read.schema(FORMATTED).parquet(path).mapInArrow(each, PARSED)


class _Running:
    """What is known of a conversation whose turns arrive one after another."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str, loss: str | None, chars: int) -> None:
        self.turns += 1
        self.chars += chars
        self.all.update(f"{role}\n{text}\n".encode())
        if loss is not None:
            self.loss_chars += len(loss)
            self.loss.update(loss.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Per conversation of ``read_turns``: counts and digests over its turns in order (ties by role and text).

    A conversation is digested as it streams by in sorted order, so even a very long one takes little memory. Rows without
    a conv_id form one conversation.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done = None, []
        types = [pa.string() if f.endswith("string") else pa.int64() for f in DIGESTS.split(", ")]
        names = [f.split()[0] for f in DIGESTS.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for conv_id, *turn in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss_text", "n_chars"))):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        done.append(current.row())
                    current = _Running(conv_id)
                current.add(*turn)
            if done:
                yield batch_of(done)
                done = []
        if current is not None:
            yield batch_of([current.row()])

    return (turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(each, DIGESTS))


def format_conversations(conversations: DataFrame, work: Workspace) -> DataFrame:
    """Write, read back and digest. An empty table gives conversation -1 alone."""
    path = work.new("formatted")
    write_formatted(with_sample(conversations), path)
    return conversation_digests(read_turns(conversations.sparkSession, path))
