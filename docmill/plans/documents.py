"""The document plan: scan, classify, extract, validate, route.

All steps are projections, so Spark runs the whole chain as one stage without
a shuffle. Only a whitelist that is a table adds joins: its vendors are looked up
by name, and records without their texts meet the names that were found.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.operators.classify import classify
from docmill.operators.extract import extract
from docmill.operators.route import assemble_result, passes, route
from docmill.operators.scan import entry_findings, field_findings
from docmill.operators.validate import names_on_list, validate
from docmill.settings import Rules, Settings


def repeated(items: str, times: Column) -> Column:
    return F.flatten(F.array_repeat(F.col(items), times))


def decide(
    df: DataFrame,
    rules: Rules,
    settings: Settings,
    as_of: Column,
    from_text: str = "scan_text",
    listed: Column | None = None,
) -> DataFrame:
    """From extracted fields to a route.

    Needs ``entry_findings``, ``document_type``, ``classification_confidence``,
    ``fields``, ``extraction_confidence``, ``passes`` and ``error``. With ``listed``
    (see ``validate``) ``field_findings`` are there already, and no text is needed.
    """
    df = validate(df, rules, as_of, listed=listed)
    if settings.guardrails and listed is None:
        df = field_findings(df, text=from_text)
    if settings.guardrails:
        found = F.concat(F.col("entry_findings"), repeated("field_findings", F.col("passes")))
    else:
        found = F.col("entry_findings")
    df = df.withColumn("security_findings", found)
    return route(df, rules, settings)


def vendor_names(documents: DataFrame) -> DataFrame:
    """The distinct vendors of the invoices among documents, as ``_vendor``. Nothing but their
    type and fields is computed for it."""
    df = classify(documents.select("job_id", "body")).where(F.col("document_type") == "invoice")
    return extract(df).select(F.col("fields.vendor_name").alias("_vendor")).dropna().distinct()


def analyse(
    documents: DataFrame,
    rules: Rules,
    settings: Settings | None = None,
    as_of: dt.date | None = None,
    whitelist: DataFrame | None = None,
) -> DataFrame:
    """All intermediate and final columns for documents with text columns.

    ``documents`` has ``job_id``, ``scan_text`` and ``body`` (see
    ``operators.source_text``). ``as_of`` is the day used for expiry checks.
    ``whitelist`` is a table of vendors (column ``entry``) besides those of the
    rules; with it the texts are read twice and left out of the result, so that
    they are not shuffled.
    """
    settings = settings or Settings()
    day = F.lit(as_of) if as_of else F.current_date()
    df = entry_findings(documents, enabled=settings.guardrails)
    df = classify(df)
    df = extract(df)
    df = df.withColumns(
        {
            "passes": passes(F.col("extraction_confidence"), settings),
            "error": F.col("extraction_error"),
        }
    )
    if whitelist is None:
        return decide(df, rules, settings, day)
    if settings.guardrails:
        df = field_findings(df)
    known = names_on_list(vendor_names(documents), whitelist, "_vendor", "entry")
    df = df.drop("scan_text", "body").join(known, F.lower("fields.vendor_name") == F.col("_name"), "left")
    return decide(df, rules, settings, day, listed=F.col("_name").isNotNull()).drop("_name")


def process_documents(
    documents: DataFrame,
    rules: Rules,
    settings: Settings | None = None,
    as_of: dt.date | None = None,
    processed_at: dt.datetime | None = None,
    whitelist: DataFrame | None = None,
) -> DataFrame:
    """One result record per document."""
    df = analyse(documents, rules, settings, as_of, whitelist)
    stamp = F.lit(processed_at) if processed_at else F.current_timestamp()
    df = df.withColumn("retries", F.col("passes"))
    return assemble_result(df, stamp, crashed=F.col("extraction_error").isNotNull())
