"""Mixing sources to target weights: exact block quotas, split over shards by a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.shared import n_words, settled

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Words that a block and an output shard have on average.
BLOCK_WORDS = 50_000
SHARD_WORDS = 5_000_000
#: One row per source is held by the driver and by every task, so there may be only so many.
MAX_SOURCES = 100_000
PLAN = (
    "source string, source_size long, target double, number int, blocks long, full int,"
    " rest double, held long, edge_order long, edge_roll long"
)


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def bounded(rows: DataFrame) -> list:
    got = rows.limit(MAX_SOURCES + 1).collect()
    if len(got) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return got


def fill(size: np.ndarray, weight: np.ndarray, share: float, most: float) -> np.ndarray:
    """Shares of ``share`` times all sizes by weight; none above ``most`` times its size, the
    excess goes to the others by weight."""
    cap, left = most * size, share * size.sum()
    target, held = np.zeros(len(size)), size == 0
    while not held.all():
        rate = (left - target[held].sum()) / weight[~held].sum()
        over = ~held & (rate * weight > cap)
        if not over.any():
            target[~held] = rate * weight[~held]
            break
        target[over] = cap[over]
        held |= over
    return target


def roll_of(keep: tuple, text: str, seed: int) -> Column:
    same = [F.coalesce(column(c).cast("string"), F.lit("")) for c in (*keep, text)]
    return F.xxhash64(F.lit(seed), *same)


def dealt(df: DataFrame, keep: tuple, text: str, source: str, seed: int) -> DataFrame:
    """Rows with their source, size and roll, a hash of what they hold."""
    return df.select(
        *[column(c).alias(f"keep_{i}") for i, c in enumerate(keep)],
        column(source).cast("string").alias("source"),
        n_words(column(text)).alias("size"),
        roll_of(keep, text, seed).alias("roll"),
    )


def with_block(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Rows with the plan of their source, their block and the block's permuted place."""
    chosen = plan.withColumnRenamed("source", "plan_source")
    joined = rows.join(F.broadcast(chosen), F.col("source").eqNullSafe(F.col("plan_source")))
    joined = joined.withColumn("block", F.pmod(F.xxhash64("roll", F.lit("block")), "blocks"))
    return joined.withColumn("order", F.xxhash64(F.lit(seed), "number", "block")).drop("plan_source")


def with_times(rows: DataFrame) -> DataFrame:
    """How often the mix takes a row: whole rounds, and once more up to the edge."""
    more = (F.col("order") < F.col("edge_order")) | (
        (F.col("order") == F.col("edge_order")) & (F.col("roll") <= F.col("edge_roll"))
    )
    return rows.withColumn("times", F.col("full") + F.coalesce(more, F.lit(False)).cast("int"))


def permuted(rows: DataFrame) -> DataFrame:
    """Blocks in permuted order with the words and blocks before them: first within runs of
    blocks, then over the runs, so that no window holds all blocks of a large source."""
    blocks = rows.groupBy("number", "block", "order", "full", "rest").agg(F.sum("size").alias("words"))
    blocks = settled(blocks.withColumn("run", F.shiftright("order", 54)))
    runs = blocks.groupBy("number", "run").agg(
        F.sum("words").alias("run_words"), F.count("*").alias("run_blocks")
    )
    ahead = Window.partitionBy("number").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        "number",
        "run",
        F.coalesce(F.sum("run_words").over(ahead), F.lit(0)).alias("words_ahead"),
        F.coalesce(F.sum("run_blocks").over(ahead), F.lit(0)).alias("blocks_ahead"),
    )
    inside = Window.partitionBy("number", "run").orderBy("order", "block")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.join(starts, ["number", "run"]).select(
        "number",
        "block",
        "order",
        "words",
        "full",
        "rest",
        (F.col("words_ahead") + F.sum("words").over(upto) - F.col("words")).alias("before"),
        (F.col("blocks_ahead") + F.row_number().over(inside) - 1).alias("position"),
    )


def make_plan(
    rows: DataFrame,
    weights: tuple[float, ...],
    share: float,
    most: float,
    seed: int,
    block_words: int,
) -> DataFrame:
    """One row per source: target, whole rounds, and the edge up to which documents are taken
    once more. ``rows`` come from ``dealt`` and are read several times."""
    spark = rows.sparkSession
    sources = bounded(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources.sort(key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    size = np.array([r["source_size"] for r in sources], float)
    weight = np.array([weights[i % len(weights)] for i in range(len(sources))])
    target = fill(size, weight, share, most)
    first = []
    for i, (r, n, t) in enumerate(zip(sources, size, target)):
        full = int(t // n) if n else 0
        blocks = max(1, -(-int(n) // block_words))
        first.append(
            (r["source"], int(n), float(t), i, blocks, full, float(t - full * n), 0, None, None)
        )
    placed = with_block(rows, spark.createDataFrame(first, PLAN), seed)
    blocks = settled(permuted(placed))
    # The block of each source in which the rest is reached, if it is.
    edges = blocks.where(
        (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))
    ).select("number", "block", "before")
    upto = (
        Window.partitionBy("number", "block")
        .orderBy("roll")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    reached = F.col("before") + F.sum("size").over(upto)
    near = (
        placed.join(F.broadcast(edges), ["number", "block"])
        .withColumn("near", reached - F.col("size") / 2 <= F.col("rest"))
        .where("near")
        .groupBy("number")
        .agg(F.max("roll").alias("edge_roll"))
    )
    order = blocks.join(F.broadcast(edges.select("number", "block")), ["number", "block"], "left_semi")
    known = (
        blocks.groupBy("number")
        .agg(F.count("*").alias("held"), F.max("order").alias("last"))
        .join(order.select("number", F.col("order").alias("edge_order")), "number", "left")
        .join(near, "number", "left")
    )
    found = {r["number"]: r for r in bounded(known)}
    final = []
    for row in first:
        got, rest = found.get(row[3]), row[6]
        if got is None:
            final.append(row)
            continue
        edge, roll = got["edge_order"], got["edge_roll"]
        if edge is None:  # the rest is all of the source, or nothing
            edge, roll = (got["last"], 2**63 - 1) if rest >= row[1] > 0 else (-(2**63), None)
        elif roll is None:
            roll = -(2**63)
        final.append((*row[:7], got["held"], edge, roll))
    return spark.createDataFrame(final, PLAN)


def shard_quotas(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple:
    """Blocks of every source that one shard gets, and how many the shards before it get.

    The tree halves the shards. Each node splits its quotas by a multivariate hypergeometric
    draw with a seed of its own, so every shard walks down to its leaf alone."""
    low, high, before = 0, shards, np.zeros_like(quotas)
    while high - low > 1:
        middle = (low + high) // 2
        drawn = int(quotas.sum()) * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(quotas, drawn, method="marginals")
        if shard < middle:
            quotas, high = left, middle
        else:
            quotas, before, low = quotas - left, before + left, middle
    return quotas, before


def shard_places(taken: DataFrame, blocks: DataFrame, words: int, seed: int) -> DataFrame:
    """(number, place, shard): the runs of permuted blocks that make up the shards."""
    spark = taken.sparkSession
    per_block = taken.groupBy("number", "block").agg(
        F.max("times").alias("times"), F.sum(F.col("times") * F.col("size")).alias("words")
    )
    totals = bounded(
        per_block.groupBy("number").agg(F.sum("times").alias("quota"), F.sum("words").alias("words"))
    )
    quotas = np.zeros(max([r["number"] for r in totals], default=-1) + 1, np.int64)
    for r in totals:
        quotas[r["number"]] = r["quota"]
    shards = max(1, round(sum(r["words"] for r in totals) / words))

    def leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                own, before = shard_quotas(quotas, shards, int(shard), seed)
                yield pd.DataFrame(
                    {"number": np.arange(len(own)), "shard": shard, "before": before, "quota": own}
                )

    runs = spark.range(shards).mapInPandas(leaves, "number int, shard long, before long, quota long")
    runs = runs.where("quota > 0")
    return runs.select(
        "number", "shard", F.explode(F.expr("sequence(before, before + quota - 1)")).alias("place")
    )


def mix(
    df: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = 7,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    source: str = "source",
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """Documents with how often the mix takes them, and the mix itself.

    Every source is dealt into blocks of about ``block_words`` words by a hash of its rows. The
    mix takes the blocks of a source in permuted order, round after round, until the words
    reach the source's target; in the last block it takes documents in permuted order while
    that brings it nearer. A tree of multivariate hypergeometric draws splits the block quotas
    of all sources among output shards; each shard gets its own run of the permuted blocks and
    its documents in a shuffled order.

    Returned are ``keep`` with size, source_size, target, times and taken for every row, and
    ``keep`` with shard, shuffle and copy for every copy in the mix. A null text has size 0. A
    null source is a source of its own, the last. Rows that repeat each other are taken alike.
    A source without words has target 0. An empty table gives empty results. Other columns are
    not read, so their names cannot clash. All follows from the rows and ``seed``.
    """
    rows = settled(dealt(df, keep, text, source, seed))
    plan = make_plan(rows, weights, share, most, seed, block_words)
    taken = with_times(with_block(rows, plan, seed))
    names = [F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)]
    copies = mixed_copies(taken, seed, shard_words)
    counted = copies.groupBy("number", "roll").agg(F.max("copy").alias("last"))
    # Rows with one roll repeat each other, so each has the copies that one of them has.
    per_row = taken.join(counted, ["number", "roll"], "left").select(
        *names,
        "size",
        "source_size",
        "target",
        F.coalesce(F.col("last") + 1, F.lit(0)).alias("times"),
        (F.coalesce(F.col("last") + 1, F.lit(0)) * F.col("size")).cast("long").alias("taken"),
    )
    return per_row, copies.select(*names, "shard", "shuffle", "copy")


def mixed_copies(taken: DataFrame, seed: int, shard_words: int) -> DataFrame:
    """Every copy of every taken row with its shard and its place in the shuffled shard."""
    blocks = settled(permuted(taken).select("number", "block", "position"))
    places = settled(shard_places(taken, blocks, shard_words, seed))
    copies = taken.where("times > 0").withColumn("copy", F.explode(F.expr("sequence(0, times - 1)")))
    copies = copies.join(blocks, ["number", "block"])
    copies = copies.withColumn("place", F.col("copy") * F.col("held") + F.col("position"))
    shuffle = F.xxhash64(F.lit(seed), "shard", "roll", "copy")
    return copies.join(places, ["number", "place"]).withColumn("shuffle", shuffle)


def mixed_documents(
    df: DataFrame, text: str = "text", source: str = "source", seed: int = 7, **options
) -> DataFrame:
    """The mix as documents: every row as often as the mix takes it, shard by shard, in the
    shuffled order of its shard, with the columns of ``df``. See ``mix``."""
    shard_words = options.pop("shard_words", SHARD_WORDS)
    given = {"weights": WEIGHTS, "share": SHARE, "most": MOST, "block_words": BLOCK_WORDS} | options
    keys = tuple(c for c in df.columns if c not in (text, source))
    rows = settled(dealt(df, keys, text, source, seed).select("source", "size", "roll"))
    plan = make_plan(rows, seed=seed, **given)
    # A row's roll leaves out its source: what two sources hold alike is taken for each of them.
    taken = with_times(with_block(rows, plan, seed)).dropDuplicates(["number", "roll"])
    places = settled(mixed_copies(taken, seed, shard_words).select("source", "roll", "shard", "shuffle"))
    whole = F.struct(*[column(c) for c in df.columns]).alias("whole")
    own = df.select(whole, roll_of(keys, text, seed).alias("own_roll"), column(source).cast("string").alias("own_source"))
    same = (F.col("own_roll") == F.col("roll")) & F.col("own_source").eqNullSafe(F.col("source"))
    out = own.join(places.hint("merge"), same)
    out = out.repartition("shard").sortWithinPartitions("shard", "shuffle", "roll")
    return out.select("whole.*")
