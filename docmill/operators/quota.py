"""Request quotas: per client and minute, and overall per day.

A request is a candidate if it is among the first ``per_minute`` of its client
and minute; a day accepts its first ``per_day`` candidates. Rejected requests
use nothing up, and minutes nest in days, so this equals a check of request
after request.

Both limits become a cutoff, the position of the last request that still fits.
Finding the k-th row of a group needs no sort of the whole group: for small k
Spark keeps k rows per group and map task before the shuffle, for large k the
group is narrowed down by counts per second, then per microsecond of one second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.settings import Settings

# Spark prunes row_number() <= k ahead of the shuffle up to this k.
RANK_LIMIT = 1000


def _second(at: Column | str) -> Column:
    """Epoch second of an ``_at``."""
    at = F.col(at) if isinstance(at, str) else at
    return F.floor(at["us"] / 1_000_000)


def with_slots(requests: DataFrame, ts: str, seq: str) -> DataFrame:
    """Add the order ``_at`` of a request and the epoch ``_minute`` and ``_day``."""
    stamp = F.unix_micros(F.col(ts).cast("timestamp"))
    at = F.struct(stamp.alias("us"), F.col(seq).alias("seq"))
    return requests.withColumns(
        {"_minute": F.floor(_second(at) / 60), "_day": F.floor(_second(at) / 86400), "_at": at}
    )


def _minus_used(df: DataFrame, group: list[str], used: DataFrame | None, cap: int) -> DataFrame:
    """Add ``_cap``, what is left of the cap after earlier use of the group."""
    if used is None:
        return df.withColumn("_cap", F.lit(cap).cast("bigint"))
    left = F.lit(cap) - F.coalesce(F.col("_used"), F.lit(0))
    return df.join(used, group, "left").withColumn("_cap", left).drop("_used")


def _first_rows(
    df: DataFrame, group: list[str], cap: int, used: DataFrame | None = None
) -> DataFrame:
    """The rows of each group that fit into its cap, in ``_at`` order."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("_at"))
    ranked = df.withColumn("_rank", rank).where(F.col("_rank") <= cap)
    return _minus_used(ranked, group, used, cap).where(F.col("_rank") <= F.col("_cap"))


def _exhausted(used: DataFrame | None, group: list[str], cap: int) -> DataFrame | None:
    """A cutoff before any request for groups that have nothing left."""
    if used is None:
        return None
    lowest = F.lit(-(2**62)).cast("bigint")
    return used.where(F.col("_used") >= cap).select(
        *group, F.struct(lowest.alias("us"), lowest.alias("seq")).alias("_cutoff")
    )


def _crossing(df: DataFrame, group: list[str], slot: str, with_cap) -> DataFrame:
    """The rows of each group in the slot in which its cap is reached, with what is ``_left`` of
    the cap there. Rows are counted per slot before they are ordered."""
    held = [F.first("_cap").alias("_cap")] if "_cap" in df.columns else []
    counts = with_cap(df.groupBy(*group, slot).agg(F.count("*").alias("_n"), *held))
    upto = F.sum("_n").over(
        Window.partitionBy(*group).orderBy(slot).rowsBetween(Window.unboundedPreceding, 0)
    )
    counts = counts.withColumn("_upto", upto)
    before = F.col("_upto") - F.col("_n")
    reached = (F.col("_upto") >= F.col("_cap")) & (before < F.col("_cap"))
    crossing = counts.where(reached).select(*group, slot, (F.col("_cap") - before).alias("_left"))
    return df.drop("_cap").join(crossing, [*group, slot])


def cutoffs(
    df: DataFrame, group: list[str], cap: int, used: DataFrame | None = None
) -> DataFrame:
    """Per group that reaches its cap, the ``_at`` of the last row that fits."""
    if cap <= RANK_LIMIT:
        last = _first_rows(df, group, cap, used).where(F.col("_rank") == F.col("_cap"))
    else:
        # The second in which the cap is reached, then the microsecond: a window task gets one
        # row per second of a minute or day, per microsecond of a second, and last the requests
        # of one microsecond.
        rows = df.select(*group, "_at", _second("_at").alias("_second"))
        rows = _crossing(rows, group, "_second", lambda n: _minus_used(n, group, used, cap))
        rows = rows.withColumn("_us", F.col("_at.us"))
        rows = _crossing(rows.withColumnRenamed("_left", "_cap"), group, "_us", lambda n: n)
        rank = F.row_number().over(Window.partitionBy(*group).orderBy("_at"))
        last = rows.withColumn("_rank", rank).where(F.col("_rank") == F.col("_left"))
    last = last.select(*group, F.col("_at").alias("_cutoff"))
    spent = _exhausted(used, group, cap)
    return last if spent is None else last.unionByName(spent)


def _retry_after(seconds: Column, window: int) -> Column:
    return (F.lit(window) - seconds % window).cast("int")


def decide(
    requests: DataFrame,
    settings: Settings,
    client: str = "client_id",
    ts: str = "ts",
    seq: str = "event_id",
    used_minute: DataFrame | None = None,
    used_day: DataFrame | None = None,
) -> DataFrame:
    """Add ``decision``, ``reason`` and ``retry_after`` to each request.

    The day's limit is tested first. A limit of zero means none. The ``used_``
    tables hold what earlier batches accepted: ``(client, _minute, _used)`` and
    ``(_day, _used)``.
    """
    kept = requests.columns
    if not settings.quota_enabled:
        return requests.select(
            *kept,
            F.lit("accept").alias("decision"),
            F.lit(None).cast("string").alias("reason"),
            F.lit(None).cast("int").alias("retry_after"),
        )
    df = with_slots(requests, ts, seq)
    minute_group = [client, "_minute"]
    # Day and second are read off ``_at`` later on, so that both uses of the ranked requests
    # need the same columns and share one scan and shuffle.
    keys = df.select(client, "_minute", "_at")
    over_minute = over_day = F.lit(False)
    candidates = keys
    if settings.quota_per_minute:
        cap = settings.quota_per_minute
        limits = cutoffs(keys, minute_group, cap, used_minute).withColumnRenamed(
            "_cutoff", "_minute_cutoff"
        )
        over_minute = F.coalesce(F.col("_at") > F.col("_minute_cutoff"), F.lit(False))
        # Null-safe, as a client may be null; it also keeps both uses of the ranks alike.
        limits = limits.select(
            F.col(client).alias("_client"), F.col("_minute").alias("_of"), "_minute_cutoff"
        )
        same = F.col(client).eqNullSafe(F.col("_client")) & F.col("_minute").eqNullSafe(F.col("_of"))
        df = df.join(limits, same, "left")
        candidates = (
            _first_rows(keys, minute_group, cap, used_minute)
            if cap <= RANK_LIMIT
            else keys.join(limits, same, "left").where(~over_minute)
        )
    if settings.quota_per_day:
        limits = cutoffs(
            candidates.select(F.floor(_second("_at") / 86400).alias("_day"), "_at"),
            ["_day"],
            settings.quota_per_day,
            used_day,
        ).withColumnRenamed("_cutoff", "_day_cutoff")
        # At most one row per calendar day.
        df = df.join(F.broadcast(limits), ["_day"], "left")
        over_day = F.coalesce(F.col("_at") > F.col("_day_cutoff"), F.lit(False))
    return df.select(
        *kept,
        F.when(over_day | over_minute, F.lit("reject")).otherwise(F.lit("accept")).alias("decision"),
        F.when(over_day, F.lit("day")).when(over_minute, F.lit("minute")).alias("reason"),
        F.when(over_day, _retry_after(_second("_at"), 86400))
        .when(over_minute, _retry_after(_second("_at"), 60))
        .alias("retry_after"),
    )
