"""Intake of uploads: request quota, then the input gate, then a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.operators.gate import with_gate
from docmill.operators.quota import decide
from docmill.settings import Settings

# What a client is told when a limit is reached.
DAY_LIMIT = "Daily processing limit reached. Try again tomorrow."
MINUTE_LIMIT = "Too many requests; please slow down."


def intake(
    uploads: DataFrame,
    settings: Settings,
    client: str = "client_id",
    ts: str = "ts",
    seq: str = "event_id",
    used_minute: DataFrame | None = None,
    used_day: DataFrame | None = None,
) -> DataFrame:
    """Uploads with ``answer`` (queued, limited or rejected), ``message`` and ``retry_after``.

    Every request counts against the quota, whatever the gate says of its file;
    a request beyond the quota is not looked at any further.
    """
    kept = uploads.columns
    df = decide(uploads, settings, client, ts, seq, used_minute, used_day)
    df = with_gate(df, settings)
    limited = F.col("decision") == "reject"
    return df.select(
        *kept,
        F.when(limited, F.lit("limited"))
        .when(F.col("reject_reason").isNotNull(), F.lit("rejected"))
        .otherwise(F.lit("queued"))
        .alias("answer"),
        F.when(F.col("reason") == "day", F.lit(DAY_LIMIT))
        .when(F.col("reason") == "minute", F.lit(MINUTE_LIMIT))
        .otherwise(F.col("reject_reason"))
        .alias("message"),
        "retry_after",
        F.when(~limited, F.col("mime_suspicious")).alias("mime_suspicious"),
    )


def queued_jobs(answered: DataFrame, job_id: str = "job_id", ts: str = "ts") -> DataFrame:
    """The first transition of every accepted upload."""
    rows = answered.where(F.col("answer") == "queued")
    return rows.select(
        F.col(job_id).alias("job_id"),
        F.col("path").alias("filename"),
        F.lit("queued").alias("status"),
        F.lit(0).alias("seq"),
        F.col(ts).cast("timestamp").alias("updated_at"),
        F.lit(None).cast("string").alias("result"),
    )
