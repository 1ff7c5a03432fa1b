"""Conversation repair against a search over whole audits."""

import hashlib
import random
import re
import zlib

import pytest

from cellgrid.llm import conversation_repair as cr
from cellgrid.llm.common import SPACES
from cellgrid.llm.registry import op12_conversation_repair

SF = "/root/testdata/sf0.001"


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        code = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2], shown[3]
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out[conv] += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def plain_repair(rows):
    """Faults, and the best of all (cost, audit, repaired rows), carried forward with their whole audits.

    ``rows`` are ``(turn, role, text)`` in order.
    """
    seen, faults = set(), []
    for _, role, text in rows:
        said = text.strip(SPACES)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    found = {"": {(0, "", ())}}  # by the initials kept so far: beginning, s, u or a

    def inserted(state):
        for _ in range(2):
            for initials, ways in list(state.items()):
                role = "assistant" if initials == "u" else "user"
                state.setdefault(role[0], set()).update((c + 5, a + "I", r + ((role, ""),)) for c, a, r in ways if not a.endswith("II"))
        return state

    allowed = {"s": ("",), "u": ("", "s", "a"), "a": ("u",)}
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for initials, ways in inserted({k: set(v) for k, v in found.items()}).items():
            for cost, audit, kept in ways:
                new.setdefault(initials, set()).add((cost + 2, audit + "D", kept))
                if fault in ("blank", "duplicate"):
                    continue
                extra = 5 if fault == "truncated" else 0
                for name, price, letter in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                    if name[:1] in allowed and initials in allowed[name[:1]]:
                        new.setdefault(name[:1], set()).add((cost + extra + price, audit + letter, kept + ((name, text),)))
        # all ways within the cheapest cost of their state, so that audits are compared whole at the end
        found = {k: {w for w in ways if w[0] == min(ways)[0]} for k, ways in new.items()}
    last = inserted(found)
    cost, audit, kept = min(w for k in ("", "a") for w in last.get(k, ()))
    initials = [r[:1] for _, r, _ in rows]
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def summaries(rows, **sizes):
    made = cr.summary(*cr.repair(rows, **sizes)).collect()
    assert len({r.conv_id for r in made}) == len(made)
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in made}


def some_rows(rng, convs, longest):
    rows = []
    for conv in convs:
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "sys", ""])
            text = rng.choice(["Yes.", "Yes.", "No", "", " \t\n", "a.b", "Ünï!", "x? \n", f"{rng.random()}.", f"{rng.random()}"])
            rows.append((conv, turn * 2 if rng.random() < 0.2 else turn, role, text))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"part_rows": 3}, {"part_bytes": 1}])
def test_repairs_match_a_search_over_audits(spark, sizes):
    rng = random.Random(3)
    rows = some_rows(rng, [*range(60), None], 12) + some_rows(rng, [99], 120)
    # one text per (conversation, turn, role), so that the order is defined
    rows = list({(c, t, r): (c, t, r, x) for c, t, r, x in rows}.values())
    want = {}
    for conv in {r[0] for r in rows}:
        want[conv] = plain_repair(in_order([r[1:] for r in rows if r[0] == conv]))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert summaries(cr.present(df), **sizes) == want


def test_whole_query_matches_brute_force(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in turns.orderBy("conv_id", "turn").collect()]
    want = {conv: plain_repair(kept) for conv, kept in plain_damage(rows).items()}
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in op12_conversation_repair(spark, SF).collect()}
    assert got == want and any(r[5] for r in got.values())


def test_damaged_rows_with_nulls_and_clashing_names(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["Hi.", None, "ok", "x!y?"])) for c in (1, 2, None) for t in [None, *range(40)]]
    df = spark.createDataFrame([(*r, "a", 1, True) for r in rows], "conv_id long, turn long, role string, text string, deal string, part int, here boolean")
    want = {c: plain_repair(in_order(kept)) for c, kept in plain_damage(rows).items()}
    assert summaries(cr.damaged(df)) == want
    assert cr.summary(*cr.repair(cr.damaged(df.limit(0)))).count() == 0


def test_conversation_of_dropped_rows_only(spark):
    conv, turn = next((c, t) for c in range(100) for t in range(100) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, turn, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    assert summaries(cr.damaged(df)) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_crossings_agree_with_the_single_pass():
    """Halving gives the states of the cheapest, audit-least way that whole audits give."""
    rng = random.Random(7)
    for _ in range(300):
        marks = [rng.choice([0, 1, 2, 3, 17, 18, 4]) for _ in range(rng.randrange(0, 9))]
        steps = [*(cr.STEPS[m] for m in marks), cr.END]
        ways = {cr.START: {(0, "")}}
        for step in steps:
            new = {}
            for x, y, cost, letters in step:
                new.setdefault(y, set()).update((c + cost, a + letters) for c, a in ways.get(x, ()))
            ways = new
        states = cr.path(steps, cr.START, cr.ENDED)
        edges = [cr.edge(s, a, b) for s, a, b in zip(steps, states, states[1:])]
        assert (sum(c for c, _ in edges), "".join(a for _, a in edges)) == min(ways[cr.ENDED])


def test_one_very_long_conversation(spark):
    df = spark.range(50_000).selectExpr("1L as conv_id", "id as turn", "if(id % 3 = 0, 'assistant', 'user') as role", "concat('t', id % 40000, '.') as text")
    closed, parts = cr.repair(cr.present(df), part_rows=1000)
    assert closed.count() == 0 and parts.count() >= 50
    row = cr.summary(closed, parts).first()
    assert (row.gaps, row.blank, row.truncated) == (0, 0, 0) and len(row.audit) >= 50_000
    seen, repeats = set(), 0
    for i in range(50_000):
        key = (i % 3 == 0, i % 40_000)
        repeats += key in seen
        seen.add(key)
    assert row.duplicate == repeats
