"""Quota decisions over a stream of requests.

Counters of what was accepted travel from batch to batch as two small tables,
written under the batch id. Only windows still open at the end of a batch are
carried on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docmill.operators.quota import decide, with_slots
from docmill.settings import Settings


def _open_counts(
    accepted: DataFrame, group: list[str], slot: str, used: DataFrame | None, last: DataFrame
) -> DataFrame:
    """Accepted requests per group, earlier ones included, in windows not yet over.

    ``last`` has one row with the latest slot of the batch.
    """
    counts = accepted.groupBy(*group).agg(F.count("*").alias("_used"))
    if used is not None:
        both = counts.unionByName(used)
        counts = both.groupBy(*group).agg(F.sum("_used").alias("_used"))
    # One row, so the comparison needs no shuffle of the counts.
    return counts.join(F.broadcast(last), F.col(slot) >= F.coalesce("_last", F.lit(0))).drop("_last")


def start_quota(
    requests: DataFrame,
    folder: str,
    settings: Settings,
    client: str = "client_id",
    ts: str = "ts",
    seq: str = "event_id",
) -> StreamingQuery:
    """Decide requests that arrive in time order, batch by batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def carried(name: str) -> DataFrame | None:
            if batch_id == 0:
                return None
            return spark.read.parquet(f"{folder}/{name}/batch_id={batch_id - 1}")

        used_minute, used_day = carried("minute"), carried("day")
        path = f"{folder}/decisions/batch_id={batch_id}"
        decide(batch, settings, client, ts, seq, used_minute, used_day).write.mode(
            "overwrite"
        ).parquet(path)
        decided = with_slots(spark.read.parquet(path), ts, seq)
        taken = decided.where(F.col("decision") == "accept")
        for name, group, slot, used in (
            ("minute", [client, "_minute"], "_minute", used_minute),
            ("day", ["_day"], "_day", used_day),
        ):
            last = decided.agg(F.max(slot).alias("_last"))
            _open_counts(taken, group, slot, used, last).write.mode("overwrite").parquet(
                f"{folder}/{name}/batch_id={batch_id}"
            )

    return (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
