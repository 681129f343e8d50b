"""Conversation repair against a plain dynamic program."""

import hashlib
import random

import pytest

from docmill.llm import conversations as C

BLANKS = " \t\n\x0b\x0c\r"


def plain(rows):
    """Counts, least cost, letters and hash of one conversation, row by row with whole strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(BLANKS)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    follow = {0: "su", 1: "u", 2: "a", 3: "u"}
    state_of = {"s": 1, "u": 2, "a": 3}
    full = {"u": "user", "a": "assistant"}
    best = {0: (0, "", ())}

    def inserts(best):
        for _ in range(2):
            for q, (cost, letters, out) in list(best.items()):
                for x in set(follow[q]) - {"s"}:
                    new = (cost + 2, letters + "I", (*out, full[x] + ":"))
                    best[state_of[x]] = min(best.get(state_of[x], new), new)
        return best

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for q, (cost, letters, out) in inserts(dict(best)).items():
            options = [(q, (cost + 3, letters + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] and role[:1] in follow[q]:
                    options.append((state_of[role[0]], (cost + more, letters + "K", (*out, f"{role}:{text}"))))
                for x in set(follow[q]) - {"s"}:
                    options.append((state_of[x], (cost + 2 + more, letters + "R", (*out, f"{full[x]}:{text}"))))
            for to, new in options:
                after[to] = min(after.get(to, new), new)
        best = after
    cost, letters, out = min(v for q, v in inserts(best).items() if q in (0, 3))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    n = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *n, illegal, cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest())


def texts(rng):
    return rng.choice(["", " \t", "Yes.", "No?", "and then", f"row {rng.random()}.", f"row {rng.random()}", "é! \n"])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    found = []
    for conv in [None, *range(60)]:
        for turn in range(rng.choice([1, 2, 7, 12])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "Unknown", "us"])
            row = (conv, rng.choice([turn, turn, turn, None]), role, texts(rng))
            found += [row] * rng.choice([1, 1, 1, 2, 3])
    for turn in range(1500):  # one long conversation, in several partitions, with long runs
        role = ["user", "assistant"][turn % 2] if turn < 500 else rng.choice(["user", "assistant"]) if turn < 1000 else "user"
        found.append((77, turn, role, f"t {turn}." if turn % 9 else "t"))
    rng.shuffle(found)
    return found


def test_report_like_the_plain_program(spark, rows):
    full = [(*r, "x", 1, 2, "y") for r in rows]
    kinds = "conv_id long, turn long, role string, text string, conv string, part int, at int, fault string"
    df = spark.createDataFrame(full, kinds).repartition(5)
    ids = spark.createDataFrame([(c,) for c in {r[0] for r in rows} | {999}], "conv_id long")
    got = {r.conv_id: tuple(r)[1:] for r in C.report(ids, df).collect()}
    for conv in {r[0] for r in rows}:
        assert got[conv] == plain([r[1:] for r in rows if r[0] == conv]), conv
    assert got[999] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_edits_are_rows_to_read(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "And?"), (1, 2, None, None)], "conv_id long, turn long, role string, text string")
    edits = C.repair(df).edits.orderBy("part", "at", "step").collect()
    assert [(e.edit, e.role, e.text) for e in edits] == [("K", "user", "Hi."), ("R", "assistant", "And?"), ("D", None, None)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.report(df, C.damaged(df)).collect() == []


def test_powers_are_steps():
    for sym in range(9):
        rest = C.ENDING
        for _ in range(37):
            rest = C.advance(sym, 1, rest)
        assert rest == C.advance(sym, 37, C.ENDING)


def test_segments_chain():
    rng = random.Random(1)
    runs = [(rng.randrange(9), rng.choice([1, 2, 5, 3000])) for _ in range(12)]
    whole, end = C.unroll(runs, C.ENDING, 0, True)
    assert end in (0, 3)
    m = C.matrix(runs[6:])
    middle = tuple(min(x + y for x, y in zip(line, C.ENDING)) for line in m)
    head, state = C.unroll(runs[:6], middle, 0, False)
    assert head + C.unroll(runs[6:], C.ENDING, state, True)[0] == whole
