"""Guardrail scans: text and fields to findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.columns import settle, settle_present
from docmill.functions.patterns import INJECTION, PII
from docmill.functions.pii import pii_count
from docmill.functions.text import (
    blank_to_null,
    collapse_spaces,
    float_repr,
    format2,
    has_odd_letter,
    java_regex,
)
from docmill.schemas import FINDING, SENSITIVE_FIELDS, empty_findings, finding

GROUNDED_TEXT = ("vendor_name", "invoice_number", "candidate_name", "id_number")
GROUNDED_NUMBERS = ("total_amount", "contract_value")


def injection_findings(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add one error finding per injection label found, first match each.

    The patterns run only on texts that hold the literal every match needs; the
    byte search for it is far cheaper than the pattern.
    """
    kept = df.columns
    df = df.withColumns({"_lower": F.lower(text), "_odd": has_odd_letter(F.col(text))})
    df = df.withColumns(
        {
            f"_inj{i}": F.when(
                F.col("_odd") | F.contains(F.col("_lower"), F.lit(literal)),
                F.regexp_extract(text, java_regex(pattern, ignore_case=True), 0),
            )
            for i, (pattern, _, literal) in enumerate(INJECTION)
        }
    )
    matches: dict[str, list[Column]] = {}
    for i, (_, label, _) in enumerate(INJECTION):
        matches.setdefault(label, []).append(blank_to_null(F.col(f"_inj{i}")))
    items = []
    for label, found in matches.items():
        first = F.coalesce(*found)
        items.append(
            F.when(
                first.isNotNull(),
                finding(
                    "injection",
                    f"Possible prompt injection ({label}).",
                    "error",
                    F.concat(F.lit("Matched: '"), F.left(first, F.lit(80)), F.lit("'")),
                ),
            )
        )
    return settle_present(df, kept, out, items, FINDING)


def pii_counts(df: DataFrame, text: str) -> DataFrame:
    """Add one ``n_<kind>`` column per kind of personal data."""
    counts = {f"n_{label}": pii_count(F.col(text), label) for label, _, _ in PII}
    return settle(df, df.columns, counts)


def pii_findings(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add one warning per kind of personal data; values are never repeated."""
    kept = df.columns
    items = []
    for label, _, _ in PII:
        n = F.col(f"n_{label}")
        message = F.concat(F.lit("Detected "), n.cast("string"), F.lit(f" {label} value(s)."))
        items.append(F.when(n > 0, finding("pii", message, "warning", f"category={label}")))
    return settle_present(pii_counts(df, text), kept, out, items, FINDING)


def entry_findings(df: DataFrame, text: str = "scan_text", enabled: bool = True) -> DataFrame:
    """Add ``entry_findings``: injection first, personal data second."""
    if not enabled:
        return df.withColumn("entry_findings", empty_findings())
    kept = df.columns
    df = injection_findings(df, text, "_injection")
    df = pii_findings(df, text, "_pii")
    return settle(df, kept, {"entry_findings": F.concat("_injection", "_pii")})


def sensitive_findings(fields: Column) -> list[Column]:
    """Warnings for populated sensitive fields, in name order; null where absent."""
    return [
        F.when(
            fields[name] != "",
            finding(
                "pii",
                f"Sensitive field '{name}' is present and must be handled securely.",
                "warning",
                f"field={name}",
            ),
        )
        for name in SENSITIVE_FIELDS
    ]


def normal_form(text: Column) -> Column:
    return F.lower(collapse_spaces(text))


def number_digits(value: Column) -> Column:
    """The digits of a number with two decimals, without leading zeros."""
    digits = F.regexp_replace(format2(value), r"[^0-9]", "")
    return F.coalesce(blank_to_null(F.ltrim(digits, F.lit("0"))), F.lit("0"))


def grounding_findings(fields: Column, haystack: Column, digits: Column) -> list[Column]:
    """Warnings for values that the source does not contain; null where it does."""
    items = []
    for name in GROUNDED_TEXT:
        value = fields[name]
        items.append(
            F.when(
                (value != "") & ~F.contains(haystack, normal_form(value)),
                finding(
                    "grounding",
                    f"Extracted '{name}' not found verbatim in source.",
                    "warning",
                    F.concat(F.lit(f"{name}="), value),
                ),
            )
        )
    for name in GROUNDED_NUMBERS:
        value = fields[name]
        items.append(
            F.when(
                value.isNotNull() & ~F.contains(digits, number_digits(value)),
                finding(
                    "grounding",
                    f"Extracted '{name}' value not found in source.",
                    "warning",
                    F.concat(F.lit(f"{name}="), float_repr(value)),
                ),
            )
        )
    return items


def field_findings(
    df: DataFrame, text: str = "scan_text", fields: str = "fields", out: str = "field_findings"
) -> DataFrame:
    """Add grounding warnings followed by sensitive-field warnings.

    The normalised source and its digits are built only for documents that have
    a value to look up, and not at all for empty sources.
    """
    kept = [c for c in df.columns if c != out]
    record = F.col(fields)
    has_text = F.coalesce(*[blank_to_null(record[n]) for n in GROUNDED_TEXT]).isNotNull()
    has_number = F.coalesce(*[record[n] for n in GROUNDED_NUMBERS]).isNotNull()
    usable = F.col(text) != ""
    df = df.withColumn(
        "_haystack", F.when(usable & (has_text | has_number), normal_form(F.col(text)))
    )
    df = df.withColumn(
        "_digits",
        F.when(has_number, F.regexp_replace("_haystack", java_regex(r"[^\d]"), "")),
    )
    items = grounding_findings(record, F.col("_haystack"), F.col("_digits"))
    items += sensitive_findings(record)
    return settle_present(df, kept, out, items, FINDING)

