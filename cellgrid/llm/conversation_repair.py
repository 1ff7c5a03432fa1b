"""Cheapest repair of conversations: Hirschberg's divide and conquer over four states."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import SPACES, map_batches, stored
from cellgrid.operators.joins import salted_join

PART_ROWS = 4096
PART_BYTES = 1 << 20

# Costs of the edits.
RETELL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

# States: nothing kept yet, after the system's row, after a user's, after an assistant's.  A
# conversation may end in the first and the last of them.
STATES, START, ENDED = 4, 0, 0
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ROLES = {2: "user", 3: "assistant"}  # of a row inserted or renamed, by the state that it leads to
INITIALS = "sua"
# A row's mark: its initial (0 to 2, 3: any other), and bits for its faults.
OTHER, BLANK, DUPLICATE, CUT = 3, 4, 8, 16

Step = list[tuple[int, int, int, object]]  # edges (from, to, cost, order among edges from one state)


def _inserted() -> Iterator[tuple[int, int, int, str]]:
    """From, to, cost and letters of no, one or two insertions; more never pay."""
    for x in range(STATES):
        once = NEXT["u"].get(x, NEXT["a"].get(x))
        twice = NEXT["u"].get(once, NEXT["a"].get(once))
        yield from ((x, x, 0, ""), (x, once, INSERT, "I"), (x, twice, 2 * INSERT, "II"))


def _cheapest(edges: Iterator[tuple[int, int, int, str]]) -> Step:
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for x, y, cost, letters in edges:
        best[x, y] = min(best.get((x, y), (cost, letters)), (cost, letters))
    return [(x, y, cost, letters) for (x, y), (cost, letters) in sorted(best.items())]


def step_of(mark: int) -> Step:
    """Edges of one row: insertions before it, then the row's own edit."""

    def edges() -> Iterator[tuple[int, int, int, str]]:
        stays = TRUNCATED if mark & CUT else 0
        for x, y, cost, letters in _inserted():
            yield x, y, cost + DELETE, letters + "D"
            if mark & (BLANK | DUPLICATE):
                continue
            if mark & OTHER != OTHER and y in NEXT[INITIALS[mark & OTHER]]:
                yield x, NEXT[INITIALS[mark & OTHER]][y], cost + stays, letters + "K"
            for initial in "ua":
                if y in NEXT[initial]:
                    yield x, NEXT[initial][y], cost + stays + RETELL, letters + "R"

    return _cheapest(edges())


STEPS = [step_of(mark) for mark in range(32)]
END = _cheapest((x, ENDED, cost, letters) for x, y, cost, letters in _inserted() if y in (0, 3))


def forward(steps: list[Step], start: int) -> dict[int, tuple[int, int]]:
    """Cost of each state that can be reached, and its rank by the least audit that leads there.

    Audits of the same rows never begin with one another, so the order of two longer ones
    follows from the states they come from and the letters added; no audit has to be kept.
    """
    reached = {start: (0, 0)}
    for step in steps:
        best: dict[int, tuple] = {}
        for x, y, cost, order in step:
            if x in reached:
                total, rank = reached[x]
                entry = (total + cost, rank, order)
                if y not in best or entry < best[y]:
                    best[y] = entry
        ordered = sorted(best, key=lambda y: best[y][1:])
        reached = {y: (best[y][0], k) for k, y in enumerate(ordered)}
    return reached


def backward(steps: list[Step], end: int) -> dict[int, int]:
    """Cost from each state to ``end``."""
    left = {end: 0}
    for step in reversed(steps):
        best: dict[int, int] = {}
        for x, y, cost, _ in step:
            if y in left and (x not in best or cost + left[y] < best[x]):
                best[x] = cost + left[y]
        left = best
    return left


def path(steps: list[Step], start: int, end: int) -> list[int]:
    """States before, between and after the steps on the cheapest way, of several the audit-least.

    Cost vectors from both ends meet in the middle; of the states in which the cheapest ways
    cross there, the one with the least audit so far is taken, and both halves are solved alike.
    Beside the states, memory is two vectors for each level of the recursion.
    """
    states = [start] * len(steps) + [end]

    def solve(low: int, high: int) -> None:
        if high - low < 2:
            return
        middle = (low + high) // 2
        here, there = forward(steps[low:middle], states[low]), backward(steps[middle:high], states[high])
        states[middle] = min((s for s in here if s in there), key=lambda s: (here[s][0] + there[s], here[s][1]))
        solve(low, middle)
        solve(middle, high)

    solve(0, len(steps))
    return states


def edge(step: Step, x: int, y: int) -> tuple[int, object]:
    return next((cost, order) for a, b, cost, order in step if (a, b) == (x, y))


def joined(steps: list[Step]) -> Step:
    """Many steps as one: cost and rank from each state to each."""
    return [(x, y, cost, rank) for x in range(STATES) for y, (cost, rank) in forward(steps, x).items()]


def marked(role: str, text: str) -> int:
    """The mark of a row, but for repeats."""
    said = text.rstrip(SPACES)
    initial = INITIALS.find(role[:1]) if role else OTHER
    return (initial if initial >= 0 else OTHER) | (BLANK if not said else 0 if said[-1] in ".!?" else CUT)


def digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


ROWS = "conv_id long, turn long, role string, text string, here boolean"
PARTS = (
    "conv_id long, pid int, part long, closed boolean, low long, high long, turns long, marks binary, digests binary, "
    "roles array<string>, texts array<string>"
)


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows as ``ROWS``, damaged by the crc32 of ``conv_id:turn`` modulo 20; nulls are one space.

    0 drops the row (it stays, marked as not ``here``), 1 empties its text, 2 takes its
    sentence ends, 3 repeats it, 4 makes it the user's.
    """
    blank = F.lit(" ")
    conv, turn = turns[conv_col].cast("long"), turns[turn_col].cast("long")
    code = F.crc32(F.concat(F.coalesce(conv.cast("string"), blank), F.lit(":"), F.coalesce(turn.cast("string"), blank)).cast("binary")) % 20
    role, text = F.coalesce(turns[role_col].cast("string"), blank), F.coalesce(turns[text_col].cast("string"), blank)
    text = F.when(code == 1, F.lit("")).when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.array_repeat(code != 0, F.when(code == 3, 2).otherwise(1))).alias("here")
    role = F.when(code == 4, F.lit("user")).otherwise(role)
    return turns.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), copies)


def present(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows as ``ROWS``, undamaged; a null role or text is one space."""
    role, text = (F.coalesce(turns[c].cast("string"), F.lit(" ")) for c in (role_col, text_col))
    conv, turn = turns[conv_col].cast("long"), turns[turn_col].cast("long")
    return turns.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), F.lit(True).alias("here"))


def _parts(rows: DataFrame, part_rows: int, part_bytes: int) -> DataFrame:
    """Conversations in order, as rows of ``PARTS``: each whole, or cut into bounded parts.

    Rows are dealt by ranges, so a conversation lies in neighbouring partitions.  One that
    is a single part and neither the first nor the last of its partition is ``closed``:
    no other partition can hold more of it.
    """
    order = ["conv_id", "turn", "role", "text_hash", "deal"]
    rows = rows.withColumns({"text_hash": F.xxhash64("text"), "deal": F.monotonically_increasing_id()})
    number = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(number, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "here")
    names = [f.split()[0] for f in PARTS.split(", ")]
    whole = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    schema = pa.schema([*zip(names, whole), *((c, pa.list_(pa.string())) for c in names[len(whole) :])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        made, number, runs = [], 0, 0
        conv: object = ...
        held: list[tuple] = []  # (turn, role, text) of the open part
        size, cut = 0, False

        def close(closed: bool) -> None:
            nonlocal held, size, number
            seen: set = set()
            marks, digests = bytearray(), bytearray()
            for _, role, text in held:
                key = (role, text) if closed else digest(role, text)
                marks.append(marked(role, text) | (DUPLICATE if key in seen else 0))
                seen.add(key)
                if not closed:
                    digests += key
            turns = [t for t, _, _ in held if t is not None]
            values = (
                conv, pid, pid << 32 | number, closed, min(turns, default=None), max(turns, default=None), len(set(turns)),
                bytes(marks), bytes(digests), [r for _, r, _ in held], [x for _, _, x in held],
            )
            made.append(dict(zip(names, values)))
            held, size, number = [], 0, number + 1

        def given() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(made, schema=schema)
            made.clear()
            return batch

        pending = 0
        for batch in batches:
            for own, turn, role, text, here in zip(*(c.to_pylist() for c in batch.columns)):
                if own != conv or conv is ...:
                    if conv is not ...:
                        close(runs > 1 and not cut)
                    conv, cut, runs = own, False, runs + 1
                elif len(held) >= part_rows or size >= part_bytes:
                    close(False)
                    cut = True
                if here:
                    held.append((turn, role, text))
                    size += len(role) + len(text)
                    pending += len(text) + 64
                if pending >= 4 * part_bytes and made:
                    yield given()
                    pending = 0
        if conv is not ...:
            close(False)
        yield given()

    return dealt.mapInArrow(run, PARTS)


def _steps(marks: bytes) -> list[Step]:
    return [STEPS[mark] for mark in marks]


def _grouped(df: DataFrame, keys: list[str], run: Callable[[list[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``run`` on the rows of each group, as dicts; its rows as ``schema``."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    arrow = pa.schema([(n, kinds[f.split()[1]]) for n, f in zip(names, schema.split(", "))])

    def each(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(run(table.to_pylist())), schema=arrow)

    return df.groupBy(*keys).applyInArrow(each, schema)


def _flat(step: Step) -> list[int]:
    return [value for entry in step for value in entry]


def _edges(flat: list[int]) -> Step:
    return [tuple(flat[at : at + 4]) for at in range(0, len(flat), 4)]


def _borders(parts: DataFrame) -> DataFrame:
    """``(part, known, start, end, tail)`` of parts that are not closed.

    ``known`` are digests that earlier parts of the conversation hold, ``start`` and ``end`` the
    states on the best way before and after the part, ``tail`` marks the last one.  Parts
    become single steps, those of a partition again, and what is solved per conversation has a
    step per partition; then the states are handed down the same way.
    """
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")

    def spread(batch: pa.RecordBatch) -> dict[str, list]:
        found = [sorted({d[k : k + 16] for k in range(0, len(d), 16)}) for d in batch.column("digests").to_pylist()]
        at = pa.array([k for k, digests in enumerate(found) for _ in digests], pa.int64())
        return {"conv": batch.column("conv").take(at), "part": batch.column("part").take(at), "digest": [x for ds in found for x in ds]}

    digests = map_batches(parts.select(conv, "part", "digests"), spread, "conv string, part long, digest binary")
    first = digests.groupBy("conv", "digest").agg(F.min("part").alias("first"), F.count(F.lit(1)).alias("times"))
    again = salted_join(digests, first.where("times > 1"), ["conv", "digest"]).where("part > first")
    known = again.groupBy("part").agg(F.collect_list("digest").alias("known"))

    def summed(batch: pa.RecordBatch) -> dict[str, list]:
        rows = zip(*(batch.column(c).to_pylist() for c in ("marks", "digests", "known")))
        return {c: batch.column(c) for c in ("conv", "pid", "part")} | {"edges": [_flat(joined(_steps(repeated(*row)))) for row in rows]}

    narrow = parts.select(conv, "pid", "part", "marks", "digests").join(known, "part", "left")
    schema = "conv string, pid int, part long, edges array<long>"
    leaves = stored(map_batches(narrow, summed, schema), "repair")

    def climb(rows: list[dict]) -> Iterator[dict]:
        rows.sort(key=lambda r: r["part"])
        yield {"conv": rows[0]["conv"], "pid": rows[0]["pid"], "edges": _flat(joined([_edges(r["edges"]) for r in rows]))}

    def across(rows: list[dict]) -> Iterator[dict]:
        rows.sort(key=lambda r: r["pid"])
        states = path([*(_edges(r["edges"]) for r in rows), END], START, ENDED)
        for k, row in enumerate(rows):
            yield {"conv": row["conv"], "pid": row["pid"], "start": states[k], "end": states[k + 1], "tail": k == len(rows) - 1}

    def descend(rows: list[dict]) -> Iterator[dict]:
        rows.sort(key=lambda r: r["part"])
        states = path([_edges(r["edges"]) for r in rows], rows[0]["start"], rows[0]["end"])
        for k, row in enumerate(rows):
            tail = row["tail"] and k == len(rows) - 1
            yield {"part": row["part"], "start": states[k], "end": states[k + 1], "tail": tail}

    nodes = _grouped(leaves, ["conv", "pid"], climb, "conv string, pid int, edges array<long>")
    placed = _grouped(nodes, ["conv"], across, "conv string, pid int, start int, end int, tail boolean")
    below = _grouped(leaves.join(placed, ["conv", "pid"]), ["conv", "pid"], descend, "part long, start int, end int, tail boolean")
    return below.join(known, "part", "left")


def repeated(marks: bytes, digests: bytes, known: list[bytes] | None) -> bytes:
    """``marks`` with the rows that earlier parts hold marked as duplicates."""
    if not known:
        return marks
    seen = set(known)
    return bytes(m | (DUPLICATE if digests[16 * k : 16 * k + 16] in seen else 0) for k, m in enumerate(marks))


REPAIRED = (
    "conv_id long, part long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, "
    "first string, last string, cost long, audit string, roles array<string>, texts array<string>"
)


def _solved(batch: pa.RecordBatch) -> dict[str, list]:
    """Rows of ``REPAIRED`` from parts and their borders."""
    kept = ("conv_id", "part", "low", "high", "turns")
    out: dict[str, list] = {f.split()[0]: [] for f in REPAIRED.split(", ")} | {c: batch.column(c) for c in kept}
    names = ("marks", "digests", "known", "start", "end", "tail", "roles", "texts")
    for marks, digests, known, start, end, tail, roles, texts in zip(*(batch.column(c).to_pylist() for c in names)):
        marks = repeated(marks, digests, known)
        steps = _steps(marks) + ([END] if tail else [])
        states = path(steps, start, ENDED if tail else end)
        cost, audit, new_roles, new_texts = 0, [], [], []
        for k, step in enumerate(steps):
            price, letters = edge(step, states[k], states[k + 1])
            cost += price
            audit.append(letters)
            state = states[k]
            for letter in letters:
                if letter == "I":
                    state = NEXT["u"].get(state, NEXT["a"].get(state))
                    new_roles.append(ROLES[state])
                    new_texts.append("")
                elif letter != "D":
                    new_roles.append(roles[k] if letter == "K" else ROLES[states[k + 1]])
                    new_texts.append(texts[k])
        initials = [role[:1] for role in roles]
        faults = [BLANK if m & BLANK else DUPLICATE if m & DUPLICATE else m & CUT for m in marks]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        values = (
            faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, initials[0] if initials else None,
            initials[-1] if initials else None, cost, "".join(audit), new_roles, new_texts,
        )
        for name, value in zip([c for c in out if c not in kept], values):
            out[name].append(value)
    return out


def repair(rows: DataFrame, part_rows: int = PART_ROWS, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """Repaired conversations, from ``present`` or ``damaged`` rows: two tables of ``REPAIRED``.

    In the first each row is a whole conversation.  In the second a conversation is one row or
    several, in order of ``part``: one that is longer than a part, or lies at the border of a
    partition.  ``roles`` and ``texts`` are the repaired rows, ``audit`` the edits' initials.

    Rows are taken by turn (nulls first), then role, then the text's hash.  A row that is
    blank, or whose role and text came before, is deleted (2); others may be kept (0), renamed
    to user or assistant (1) or deleted, and rows without text may be inserted (5); a row
    without a sentence end that is not deleted costs 5 more.  The initials of the roles then
    read ``(s?(ua)+)?``; of equally cheap ways the one with the least audit is taken.  An
    empty role has no initial of these and is renamed or deleted.  A null conversation is one
    of its own, repeated rows are repeats, an empty table gives no rows.
    """
    parts = stored(_parts(rows, part_rows, part_bytes), "repair")
    shut = parts.where("closed").drop("closed", "pid")
    nothing = {"known": F.lit(None).cast("array<binary>"), "start": F.lit(START), "end": F.lit(ENDED), "tail": F.lit(True)}
    open_ = parts.where("not closed").drop("closed")
    bordered = open_.join(_borders(open_), "part")
    return map_batches(shut.withColumns(nothing), _solved, REPAIRED), map_batches(bordered, _solved, REPAIRED)


SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def summary(closed: DataFrame, parts: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``: faults, gaps, cost, audit, and the digest of the repaired rows.

    The parts of a conversation pass through a running digest one after the other.
    """
    names = [f.split()[0] for f in REPAIRED.split(", ")]
    counted = ("blank", "duplicate", "truncated", "illegal", "cost")
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    schema = pa.schema(list(zip([f.split()[0] for f in SUMMARY.split(", ")], kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None

        def done() -> dict:
            gaps = 0 if state["low"] is None else state["high"] - state["low"] + 1 - state["turns"]
            return {"conv_id": state["conv_id"], "gaps": gaps, **{c: state[c] for c in counted},
                    "audit": "".join(state["audit"]), "repaired_sha256": state["hash"].hexdigest()}

        for batch in batches:
            out = []
            for values in zip(*(batch.column(c).to_pylist() for c in names)):
                row = dict(zip(names, values))
                if state is None or state["conv_id"] != row["conv_id"]:
                    if state is not None:
                        out.append(done())
                    state = {"conv_id": row["conv_id"], "low": None, "high": None, "turns": 0, "last": None, "audit": [], "hash": hashlib.sha256(), "any": False}
                    state |= dict.fromkeys(counted, 0)
                for c in counted:
                    state[c] += row[c]
                if state["last"] is not None and row["first"] is not None:
                    state["illegal"] += state["last"] + row["first"] not in ("su", "ua", "au")
                state["last"] = state["last"] if row["last"] is None else row["last"]
                if row["low"] is not None:
                    state["turns"] += row["turns"] - (state["high"] == row["low"])
                    state["low"] = row["low"] if state["low"] is None else state["low"]
                    state["high"] = row["high"]
                state["audit"].append(row["audit"])
                said = "\n".join(f"{role}:{text}" for role, text in zip(row["roles"], row["texts"]))
                if row["roles"]:
                    state["hash"].update((("\n" if state["any"] else "") + said).encode("utf-8", "surrogatepass"))
                    state["any"] = True
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([done()], schema=schema)

    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return closed.mapInArrow(run, SUMMARY).union(ordered.mapInArrow(run, SUMMARY))
