"""Retry passes, routing and result assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.columns import settle
from docmill.functions.text import float_repr
from docmill.schemas import build_fields, empty_findings, empty_issues
from docmill.settings import Rules, Settings


def passes(confidence: Column, settings: Settings) -> Column:
    """How often a document is extracted when every attempt gives the same.

    Attempts count as retries, so the budget bounds the total number of passes.
    """
    return F.when(
        F.coalesce(confidence, F.lit(1.0)) < settings.min_confidence,
        F.lit(max(1, settings.max_retries)),
    ).otherwise(F.lit(1))


def _messages(items: Column, with_field: bool) -> Column:
    def text(item: Column) -> Column:
        if with_field:
            return F.concat(item["field"], F.lit(": "), item["message"])
        return item["message"]

    return F.array_join(F.transform(items, text), "; ")


def route(df: DataFrame, rules: Rules, settings: Settings) -> DataFrame:
    """Add ``route`` and ``route_reason``; the first condition that holds decides.

    Needs ``document_type``, ``classification_confidence``, ``fields``,
    ``validation_issues``, ``security_findings`` and ``error``.
    """
    kept = df.columns
    issues, found = F.col("validation_issues"), F.col("security_findings")
    df = df.withColumns(
        {
            "_errors": F.filter(issues, lambda i: i["severity"] == "error"),
            "_warnings": F.filter(issues, lambda i: i["severity"] == "warning"),
            "_injection": F.filter(
                found, lambda s: (s["severity"] == "error") & (s["category"] == "injection")
            ),
            "_security": F.filter(found, lambda s: s["severity"] == "error"),
            "_review": F.filter(
                found, lambda s: (s["severity"] == "warning") & (s["category"] != "pii")
            ),
        }
    )
    total = F.col("fields.total_amount")
    cap = rules.invoice_cap

    def any_of(name: str) -> Column:
        return F.size(name) > 0

    arms = [
        (
            F.coalesce(F.col("error"), F.lit("")) != "",
            "reject",
            F.concat(F.lit("Pipeline error: "), F.col("error")),
        ),
        (
            F.col("document_type") == "unknown",
            "reject",
            F.lit("Document type could not be determined."),
        ),
        (
            any_of("_injection"),
            "reject",
            F.concat(F.lit("Security: "), _messages(F.col("_injection"), False)),
        ),
        (
            any_of("_security"),
            "reject",
            F.concat(F.lit("Security errors: "), _messages(F.col("_security"), False)),
        ),
        (
            any_of("_errors"),
            "reject",
            F.concat(F.lit("Validation errors: "), _messages(F.col("_errors"), True)),
        ),
    ]
    if cap is not None:
        arms.append(
            (
                (F.col("document_type") == "invoice") & (total > cap),
                "flag_for_review",
                F.concat(
                    F.lit("Invoice total "),
                    float_repr(total),
                    F.lit(f" exceeds auto-approve cap {cap!r}."),
                ),
            )
        )
    arms += [
        (
            any_of("_review"),
            "flag_for_review",
            F.concat(F.lit("Security review required: "), _messages(F.col("_review"), False)),
        ),
        (
            any_of("_warnings"),
            "flag_for_review",
            F.concat(F.lit("Warnings require review: "), _messages(F.col("_warnings"), True)),
        ),
        (
            F.coalesce(F.col("classification_confidence"), F.lit(1.0)) < settings.min_confidence,
            "flag_for_review",
            F.lit("Classification confidence below threshold; manual confirmation advised."),
        ),
    ]

    def decision(name: str, reason: Column) -> Column:
        return F.struct(F.lit(name).alias("route"), reason.alias("reason"))

    cascade = None
    for condition, name, reason in arms:
        chosen = decision(name, reason)
        cascade = (
            F.when(condition, chosen) if cascade is None else cascade.when(condition, chosen)
        )
    cascade = cascade.otherwise(decision("auto_approve", F.lit("All checks passed.")))
    df = settle(df, kept, {"_decision": cascade})
    return df.select(*kept, "_decision.route", F.col("_decision.reason").alias("route_reason"))


def assemble_result(df: DataFrame, processed_at: Column, crashed: Column | None = None) -> DataFrame:
    """Project to the result record.

    ``crashed`` marks documents whose processing broke off: they keep the error
    and lose everything else.
    """
    crashed = F.lit(False) if crashed is None else crashed

    def unless_crashed(value: Column, default: Column) -> Column:
        return F.when(crashed, default).otherwise(value)

    null_text = F.lit(None).cast("string")
    confidence = F.coalesce(F.col("extraction_confidence"), F.lit(0.0))
    return df.select(
        "job_id",
        F.when(F.coalesce(F.col("error"), F.lit("")) != "", F.lit("failed"))
        .otherwise(F.lit("completed"))
        .alias("status"),
        unless_crashed(F.col("document_type"), F.lit("unknown")).alias("document_type"),
        unless_crashed(
            F.coalesce(F.col("classification_confidence"), F.lit(0.0)), F.lit(0.0)
        ).alias("classification_confidence"),
        unless_crashed(confidence, F.lit(0.0)).alias("extraction_confidence"),
        unless_crashed(F.col("fields"), build_fields({})).alias("fields"),
        unless_crashed(F.col("validation_issues"), empty_issues()).alias("validation_issues"),
        unless_crashed(F.col("security_findings"), empty_findings()).alias("security_findings"),
        unless_crashed(F.col("route"), null_text).alias("route"),
        unless_crashed(F.col("route_reason"), F.lit("")).alias("route_reason"),
        unless_crashed(F.col("retries"), F.lit(0)).cast("int").alias("retries"),
        F.col("error"),
        processed_at.alias("created_at"),
        processed_at.alias("updated_at"),
    )
