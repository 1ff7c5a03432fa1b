"""Chat transcripts by columnar byte assembly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
CONTROL = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")
PART_BYTES = 1 << 23  # a longer transcript is given in several parts
COPY_BYTES = 1 << 22  # bytes whose scatter indices are in memory at a time


def escape(text: str) -> str:
    """One backslash into every ``<|``, and one more where there are some already."""
    return CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role as one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


class Pieces:
    """Byte strings back to back, with their starts and sizes."""

    def __init__(self, strings: pa.Array) -> None:
        strings = strings.cast(pa.large_string())
        offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
        data = strings.buffers()[2]
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.start, self.size = offsets[:-1], np.diff(offsets)

    def take(self, rows: np.ndarray) -> Pieces:
        out = object.__new__(Pieces)
        out.data, out.start, out.size = self.data, self.start[rows], self.size[rows]
        return out


def scatter(out: np.ndarray, pieces: Pieces, to: np.ndarray) -> None:
    """Copy each piece to its place in ``out``: one index per byte, for a bounded number of bytes at a time."""
    ends = np.cumsum(pieces.size)
    row = 0
    while row < len(ends):
        done = ends[row - 1] if row else 0
        if pieces.size[row] >= COPY_BYTES:
            a, n, b = pieces.start[row], pieces.size[row], to[row]
            out[b : b + n] = pieces.data[a : a + n]
            row += 1
            continue
        last = max(row + 1, int(np.searchsorted(ends, done + COPY_BYTES, side="right")))
        size = pieces.size[row:last]
        inside = np.arange(ends[last - 1] - done) - np.repeat(ends[row:last] - size - done, size)
        out[np.repeat(to[row:last], size) + inside] = pieces.data[np.repeat(pieces.start[row:last], size) + inside]
        row = last


def assemble(table: pa.Table) -> pa.RecordBatch:
    """One row per conversation of a table sorted by conversation: transcript and loss mask."""
    table = table.combine_chunks()
    roles = _column(table, "role").fill_null("").dictionary_encode()
    heads = pa.array([f"{START}{escape_role(x)}\n" for x in roles.dictionary.to_pylist()], pa.string())
    text = _column(table, "text").fill_null("")
    touched = pc.match_substring_regex(text, r"<\\*\|")
    if pc.any(touched).as_py():
        text = pa.array([escape(x) if hit else x for x, hit in zip(text.to_pylist(), touched.to_pylist())], pa.large_string())
    kind = roles.indices.to_numpy(zero_copy_only=False)
    head, body = Pieces(heads).take(kind), Pieces(text)
    tail = Pieces(pa.array([f"{END}\n"])).take(np.zeros(len(kind), np.int64))
    size = head.size + body.size + tail.size
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    scatter(out, head, at)
    scatter(out, body, at + head.size)
    scatter(out, tail, at + head.size + body.size)

    conv = _column(table, "conv_id")
    first = np.flatnonzero(_changes(conv))
    starts = np.append(at[first], len(out)).astype(np.int64)
    learned = np.flatnonzero(kind == _index(roles.dictionary, "assistant"))
    owner = np.searchsorted(first, learned, side="right") - 1
    begin = at[learned] + head.size[learned] - starts[owner]
    spans = pa.StructArray.from_arrays([pa.array(begin), pa.array(begin + body.size[learned])], ["start", "end"])
    bounds = np.searchsorted(owner, np.arange(len(first) + 1)).astype(np.int32)
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(starts), pa.py_buffer(out))
    return pa.RecordBatch.from_arrays(
        [conv.take(first), _column(table, "turn").take(first), formatted.cast(pa.string()),
         pa.ListArray.from_arrays(pa.array(bounds), spans)],
        ["conv_id", "turn", "formatted", "loss"],
    )


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def _index(values: pa.Array, value: str) -> int:
    return pc.index(values, value).as_py()


def _changes(conv: pa.Array) -> np.ndarray:
    """True where a row's conversation differs from the row's before; nulls are one conversation."""
    value = conv.fill_null(0).to_numpy(zero_copy_only=False)
    empty = conv.is_null().to_numpy(zero_copy_only=False)
    out = np.ones(len(value), bool)
    out[1:] = (value[1:] != value[:-1]) | (empty[1:] != empty[:-1])
    return out


def transcripts(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, part, formatted, loss)``: the conversations as text, with the spans to learn.

    Turns are in order of turn, then role, then text; nulls come first, and a null text or
    role is empty.  ``loss`` holds byte spans of ``formatted`` that are assistants' texts.  A
    conversation is one row unless it is longer than ``PART_BYTES`` or lies on the border of
    two partitions: then its parts follow each other by ``turn`` (their first one) and
    ``part``.  Rows are dealt out by ranges of conversation and turn, so a conversation of very
    many turns is many tasks.  Rows with a null id are one conversation; repeated rows are
    repeated turns; an empty table gives no rows; other columns are ignored.
    """
    rows = turns.select(
        turns[conv_col].cast("long").alias("conv_id"), turns[turn_col].cast("long").alias("turn"),
        turns[role_col].cast("string").alias("role"), turns[text_col].cast("string").alias("text"),
    )
    partitions = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(partitions, "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part = 0

        def made(table: pa.Table, first_part: int) -> pa.RecordBatch:
            batch = assemble(table)
            parts = pa.array([first_part] + [0] * (batch.num_rows - 1), pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), parts, batch.column(2), batch.column(3)],
                ["conv_id", "turn", "part", "formatted", "loss"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            changes = np.flatnonzero(_changes(_column(table.select(["conv_id"]).combine_chunks(), "conv_id")))
            last = int(changes[-1])
            if last:
                yield made(table.slice(0, last), part)
                part = 0
            rest = table.slice(last)
            if rest.nbytes > PART_BYTES:
                yield made(rest, part)
                part += 1
                held = []
            else:
                held = rest.to_batches()
        # a conversation that filled parts exactly has nothing left to add
        if held:
            yield made(pa.Table.from_batches(held), part)

    schema = "conv_id long, turn long, part long, formatted string, loss array<struct<start: long, end: long>>"
    return dealt.mapInArrow(run, schema)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """``(role, text)`` of each turn of a transcript, as they were before it was formatted."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its transcript.

    Gives ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``.  The
    parts of a conversation pass through the running digests one after the other, so one part
    at a time is in memory however long the conversation is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: list | None = None
        for batch in batches:
            out = []
            for conv, text, loss in zip(batch["conv_id"], batch["formatted"], batch["loss"]):
                conv = None if pd.isna(conv) else int(conv)
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(finished(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in turns_of(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                data = text.encode()
                for span in loss:
                    said = unescape(data[span["start"] : span["end"]].decode())
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            yield frame(out)
        if state is not None:
            yield frame([finished(state)])

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def finished(state: list) -> tuple:
        return (*state[:2], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInPandas(run, schema)
