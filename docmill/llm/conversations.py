"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

A conversation is its rows by turn, nulls first, ties by role and text. Every row is one symbol:
the initial of its role and its first fault. A symbol's effect on the costs of four states is a
min-plus matrix, so runs of equal symbols advance by cached binary powers of it, and the rows of
a long conversation are split over tasks: matrices of its segments are chained, and each segment
is then unrolled on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docmill.llm.shared import settled

#: What was written last: nothing, system, user, assistant. A conversation may end in the first
#: and in the last of these states.
STATES = range(4)
#: The state after an inserted or rewritten row, and the role that such a row gets.
AFTER = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
#: For the initials s, u, a: states in which such a row may stay, and the state after it.
KEEPS = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
INITIALS = "sua"
DELETE, INSERT, REROLE, CUT_SHORT = 3, 2, 2, 1
#: Costs of ending from each state: what is missing is inserted.
ENDING = (0, 2 * INSERT, INSERT, 0)
#: Steps of a run that are unrolled at once.
STRIDE = 1024
FAR = 1 << 60

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def symbol(initial: str, fault: str) -> int:
    """0: a row that must go. Else the initial's number and whether the row is cut short."""
    if fault in ("blank", "duplicate"):
        return 0
    kind = INITIALS.find(initial) if initial else -1
    return 1 + 2 * (kind if kind >= 0 else 3) + (fault == "truncated")


@cache
def moves(sym: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """What may be done with a row in a state: letter, cost and next state, letters ascending."""
    found = [("D", DELETE, state)]
    if sym:
        kind, short = divmod(sym - 1, 2)
        if state in KEEPS[kind]:
            found.append(("K", short * CUT_SHORT, KEEPS[kind][state]))
        found.append(("R", REROLE + short * CUT_SHORT, AFTER[state]))
    return tuple(found)


def chained(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product."""
    return tuple(tuple(min(x + row[j] for x, row in zip(line, b)) for j in STATES) for line in a)


@cache
def power(sym: int, k: int) -> Matrix:
    """The costs of 2**k rows of one symbol, from each state to each state, with rows inserted
    before them."""
    if k:
        return chained(power(sym, k - 1), power(sym, k - 1))
    rows = []
    for start in STATES:
        costs, state = [FAR] * 4, start
        for inserted in range(3):
            for _, cost, after in moves(sym, state):
                costs[after] = min(costs[after], inserted * INSERT + cost)
            state = AFTER[state]
        rows.append(tuple(costs))
    return tuple(rows)


def advance(sym: int, n: int, rest: Vector) -> Vector:
    """Costs before n rows of one symbol, of the costs after them."""
    k = 0
    while n:
        if n & 1:
            rest = tuple(min(x + y for x, y in zip(line, rest)) for line in power(sym, k))
        n, k = n >> 1, k + 1
    return rest


def matrix(runs: list[tuple[int, int]]) -> Matrix:
    """The costs of a segment from each state to each state."""
    columns = []
    for j in STATES:
        rest = tuple(0 if i == j else FAR for i in STATES)
        for sym, n in reversed(runs):
            rest = advance(sym, n, rest)
        columns.append(rest)
    return tuple(tuple(min(c[i], FAR) for c in columns) for i in STATES)


def unroll(runs: list[tuple[int, int]], rest: Vector, state: int, last: bool) -> tuple[str, int]:
    """The least letters among the cheapest edits of a segment that begins in a state, given the
    costs after it; and the state after them. The last segment also ends the conversation."""
    after = [rest]
    for sym, n in reversed(runs):
        after.append(advance(sym, n, after[-1]))
    after.pop()
    letters: list[str] = []
    for sym, n in runs:
        beyond = after.pop()
        for left in range(n, 0, -STRIDE):
            here = min(left, STRIDE)
            costs = [advance(sym, left - here, beyond)]
            for _ in range(here):
                costs.append(advance(sym, 1, costs[-1]))
            for k in range(here, 0, -1):
                letter = "I"
                while letter == "I":
                    best = costs[k][state]
                    options = [*moves(sym, state), ("I", INSERT, AFTER[state])]
                    letter, state = min(
                        (name, to) for name, cost, to in options if cost + costs[k - (name != "I")][to] == best
                    )
                    letters.append(letter)
    while last and ENDING[state]:
        letters.append("I")
        state = AFTER[state]
    return "".join(letters), state


def streamed(
    df: DataFrame, schema: T.StructType, work: Callable[[Iterator[dict]], Iterable[dict]], at_once: int = 4096
) -> DataFrame:
    """Rows of each partition in their order, as dictionaries, through a generator."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in work(x for batch in batches for x in batch.to_pylist()):
            held.append(row)
            size += 100 + len(row.get("text") or "")
            if len(held) >= at_once or size > 4 << 20:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return df.mapInArrow(run, schema)


def ordered(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The rows with their place in one order of all conversations, their digest and the faults
    that a row shows by itself. A long conversation lies in several partitions."""
    rows = df.select(
        F.col(f"`{conv}`").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"),
    )
    rows = rows.withColumn("blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("short", ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"))
    rows = rows.withColumn("digest", F.sha2(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")), 256))
    rows = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64))
    rows = rows.sortWithinPartitions("conv", "turn", "role", "text")
    return settled(rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))


def symbols(rows: DataFrame) -> DataFrame:
    """Place, initial and first fault of each row, without texts. Repeated rows are found by
    their first place, which is aggregated before it is shuffled."""
    slim = rows.select("conv", "part", "at", F.substring("role", 1, 1).alias("initial"), "blank", "short", "digest")
    first = slim.groupBy("conv", "digest").agg(F.min("at").alias("first"))
    both = slim.alias("a").join(
        first.alias("b"),
        F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.digest") == F.col("b.digest")),
    )
    fault = (
        F.when(F.col("blank"), "blank").when(F.col("at") > F.col("first"), "duplicate").when(F.col("short"), "truncated")
    )
    return both.select("a.conv", "part", "at", "initial", F.coalesce(fault, F.lit("")).alias("fault"))


def keyed(row: dict) -> tuple:
    return (row["conv"],)


def segments_of(rows: Iterator[dict]) -> Iterator[dict]:
    """One row per conversation and partition: its runs, its matrix, counts of its faults."""
    for (conv, part), own in groupby(rows, lambda r: (r["conv"], r["part"])):
        runs: list[list[int]] = []
        found = {"conv": conv, "part": part, "rows": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        before = None
        for row in own:
            if before is None:
                found |= {"start": row["at"], "opens": row["initial"]}
            elif before + row["initial"] not in ("su", "ua", "au"):
                found["illegal"] += 1
            before = row["initial"]
            found["rows"] += 1
            if row["fault"]:
                found[row["fault"]] += 1
            sym = symbol(row["initial"], row["fault"])
            if runs and runs[-1][0] == sym:
                runs[-1][1] += 1
            else:
                runs.append([sym, 1])
        whole = matrix(runs)
        yield found | {
            "closes": before,
            "syms": [r[0] for r in runs],
            "lengths": [r[1] for r in runs],
            "matrix": [x for line in whole for x in line],
        }


def rests_of(rows: Iterator[dict]) -> Iterator[dict]:
    """The costs after each segment, from the matrices of the segments behind it. A conversation
    has at most one segment per partition."""
    for (conv,), own in groupby(rows, keyed):
        segments = list(own)
        rest, out = ENDING, []
        for k in range(len(segments) - 1, -1, -1):
            out.append({"conv": conv, "part": segments[k]["part"], "rest": list(rest), "first": k == 0, "last": rest is ENDING})
            m = segments[k]["matrix"]
            rest = tuple(min(m[4 * i + j] + rest[j] for j in STATES) for i in STATES)
        out[-1]["cost"] = rest[0]
        yield from reversed(out)


def unrolled(rows: Iterator[dict]) -> Iterator[dict]:
    """The letters of a segment for each state that it may begin in."""
    for row in rows:
        runs = list(zip(row["syms"], row["lengths"]))
        found = [unroll(runs, tuple(row["rest"]), s, row["last"]) for s in (STATES if not row["first"] else (0,))]
        yield {"conv": row["conv"], "part": row["part"], "ways": [x[0] for x in found], "ends": [x[1] for x in found]}


def entered(rows: Iterator[dict]) -> Iterator[dict]:
    """The state in which each segment begins."""
    for (conv,), own in groupby(rows, keyed):
        state = 0
        for row in own:
            yield {"conv": conv, "part": row["part"], "way": state}
            state = row["ends"][state]


def edits_of(rows: Iterator[dict]) -> Iterator[dict]:
    """Letters dealt to rows. A segment's letters come before its rows."""
    for _, own in groupby(rows, lambda r: (r["conv"], r["part"])):
        head = next(own)
        letters, left, state, k = head["letters"], head["n"], head["way"], 0
        for row in own:
            left, step, place = left - 1, 0, {"conv": row["conv"], "part": row["part"], "at": row["at"]}
            while k < len(letters):
                letter, k = letters[k], k + 1
                if letter == "I":
                    done = (ROLE[state], "")
                elif letter == "D":
                    done = (None, None)
                else:
                    done = (ROLE[state] if letter == "R" else row["role"], row["text"])
                yield {**place, "step": step, "edit": letter, "role": done[0], "text": done[1]}
                if letter == "K":
                    state = KEEPS[INITIALS.index(row["role"][0])][state]
                elif letter != "D":
                    state = AFTER[state]
                step += 1
                if letter != "I" and left:
                    break


def digests_of(rows: Iterator[dict]) -> Iterator[dict]:
    """Letters of all edits and the hash of what is left, one row at a time."""
    for (conv,), own in groupby(rows, keyed):
        letters, told, first = bytearray(), hashlib.sha256(), True
        for row in own:
            letters += row["edit"].encode()
            if row["role"] is not None:
                told.update(("" if first else "\n").encode() + f"{row['role']}:{row['text']}".encode())
                first = False
        yield {"conv": conv, "audit": letters.decode(), "repaired_sha256": told.hexdigest()}


def schema(df: DataFrame, **fields: str) -> T.StructType:
    """Fields by their types, after the conversation's id as it is."""
    own = T.StructField("conv", df.schema["conv"].dataType)
    return T.StructType([own, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in fields.items())])


class Repaired:
    """``edits``: one row per edit in the order of ``part``, ``at`` and ``step``, with the letter
    of Keep, Rerole, Delete or Insert and the role and text that it leaves (null: none).
    ``segments``: counts of faults. ``costs``: the cost of each conversation."""

    def __init__(self, edits: DataFrame, segments: DataFrame, costs: DataFrame):
        self.edits, self.segments, self.costs = edits, segments, costs


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """The cheapest edits that make the role initials of each conversation ``(s?(ua)+)?``.

    Keep costs 0, a new role 2, Delete 3, Insert of an empty user or assistant row 2; rows that
    are blank or repeat an earlier row of the same role and text must go, and a row that does
    not end in ``.``, ``!`` or ``?`` costs 1 more unless it goes. Of equally cheap edits those
    whose letters come first are taken.

    A null role or text counts as one space, a null turn comes first, rows of a null id are one
    conversation. Roles that begin with none of s, u and a, empty ones too, can only be rewritten
    or deleted. Rows of the same turn are taken by role and text; a repeated row stays once. An
    empty table has no edits. Columns other than the four are not read, whatever their names.
    """
    rows = ordered(df, conv, turn, role, text)
    syms = symbols(rows).repartition("part").sortWithinPartitions("part", "at")
    kinds = schema(
        rows, part="int", start="long", rows="long", blank="long", duplicate="long", truncated="long", illegal="long",
        opens="string", closes="string", syms="array<int>", lengths="array<long>", matrix="array<long>",
    )
    segments = settled(streamed(syms, kinds, segments_of, 256))
    chains = segments.select("conv", "part", "matrix").repartition("conv").sortWithinPartitions("conv", "part")
    kinds = schema(rows, part="int", rest="array<long>", first="boolean", last="boolean", cost="long")
    rests = settled(streamed(chains, kinds, rests_of))

    def of_segment(other: DataFrame) -> DataFrame:
        """Joined by partition and conversation, null ids too."""
        same = F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.part") == F.col("b.part"))
        return segments.alias("a").join(other.alias("b"), same)

    open_ = of_segment(rests).select("a.conv", "a.part", "syms", "lengths", "rest", "first", "last")
    kinds = schema(rows, part="int", ways="array<string>", ends="array<int>")
    ways = settled(streamed(open_, kinds, unrolled, 256))
    chains = ways.select("conv", "part", "ends").repartition("conv").sortWithinPartitions("conv", "part")
    starts = streamed(chains, schema(rows, part="int", way="int"), entered)
    same = F.col("w.conv").eqNullSafe(F.col("s.conv")) & (F.col("w.part") == F.col("s.part"))
    chosen = ways.alias("w").join(starts.alias("s"), same)
    chosen = chosen.select("w.conv", "w.part", "way", F.get("ways", F.col("way")).alias("letters"))
    heads = of_segment(chosen).select(
        "a.conv", "a.part", F.col("start").alias("at"), F.lit(0).alias("kind"), F.col("a.rows").alias("n"), "way", "letters"
    )
    both = heads.unionByName(
        rows.select("conv", "part", "at", F.lit(1).alias("kind"), "role", "text"), allowMissingColumns=True
    )
    both = both.repartition("part").sortWithinPartitions("part", "conv", "at", "kind")
    kinds = schema(rows, part="int", at="long", step="int", edit="string", role="string", text="string")
    return Repaired(settled(streamed(both, kinds, edits_of)), segments, rests.where("first").select("conv", "cost"))


def report(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Faults, edits and the hash of the repaired rows for each ``conv_id`` of ``df``, of which
    ``rows`` are to be repaired. The hash needs a conversation's texts one after another, so one
    task reads them, and holds one row at a time."""
    found = repair(rows)
    told = found.edits.repartition("conv").sortWithinPartitions("conv", "part", "at", "step")
    told = streamed(told, schema(found.edits, audit="string", repaired_sha256="string"), digests_of)
    parts = found.segments
    inside = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    seams = F.array_sort(F.collect_list(F.struct("part", "opens", "closes")))
    counts = parts.groupBy("conv").agg(*inside, seams.alias("seams"))
    broken = F.expr(
        "size(filter(sequence(1, size(seams)), i -> i < size(seams) and"
        " concat(seams[i - 1].closes, seams[i].opens) not in ('su', 'ua', 'au')))"
    )
    counts = counts.withColumn("illegal", F.col("illegal") + broken).drop("seams")
    turns = rows.groupBy(F.col("conv_id").alias("conv")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    out = df.select(F.col("conv_id").alias("id__")).distinct()
    for other in (turns, counts, found.costs, told):
        out = out.join(other.withColumnRenamed("conv", "c__"), F.col("id__").eqNullSafe(F.col("c__")), "left").drop("c__")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        F.col("id__").alias("conv_id"),
        *numbers,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def damaged(df: DataFrame) -> DataFrame:
    """The rows with faults put in by the hash of id and turn; nulls are one space."""
    space = F.lit(" ")

    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), space)

    lot = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(lot == 1, "").when(lot == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    times = F.when(lot == 0, 0).when(lot == 3, 2).otherwise(1)
    return df.select(
        "conv_id",
        "turn",
        F.when(lot == 4, "user").otherwise(known("role")).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(1), times)).alias("copy"),
    ).drop("copy")
