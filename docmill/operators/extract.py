"""Rule-based field extraction.

Each operator works in two projections. The first runs every pattern once into
a flat column ('' where nothing matched: all groups match at least one
character). The second builds the record from those columns, so that no pattern
is evaluated again when a field is used several times downstream.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import patterns as P
from docmill.functions.columns import settle
from docmill.functions.text import blank_to_null, has_odd_letter, java_regex, strip, to_float
from docmill.schemas import FIELD_TYPES, FIELDS, LINE_ITEM, build_fields, default_value

# Patterns that are the whole match rather than its first group.
_WHOLE_MATCH = {"email", "phone"}

_LABELLED = {
    "invoice": P.INVOICE,
    "contract": P.CONTRACT,
    "resume": P.RESUME,
    "id_document": P.ID_DOCUMENT,
}

_BAD_NUMBER = "could not convert string to float: "


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a pattern, case ignored; '' if there is none."""
    return F.regexp_extract(text, java_regex(pattern, ignore_case=True), group)


def line_item_matches(body: Column) -> Column:
    """All ``qty x description @ $unit = $amount`` spans of a text."""
    pattern = F.lit(java_regex(P.LINE_ITEM, ignore_case=True))
    return F.when(
        F.contains(body, F.lit("@")), F.regexp_extract_all(body, pattern, F.lit(0))
    ).otherwise(F.array().cast("array<string>"))


def line_item_parts(matches: Column) -> Column:
    """The four parts of each span. A span matches itself, so the long text is
    searched once and not once per part."""
    return F.transform(
        matches,
        lambda m: F.struct(
            *[
                first_match(m, P.LINE_ITEM, i).alias(name)
                for i, name in enumerate(["qty", "description", "unit", "amount"], start=1)
            ]
        ),
    )


def build_line_items(parts: Column) -> Column:
    """Line items from their parts; bad numbers become null."""

    def item(part: Column) -> Column:
        amount = part["amount"].try_cast("double")
        values = {
            "description": strip(part["description"]),
            "quantity": part["qty"].try_cast("double"),
            "unit_price": part["unit"].try_cast("double"),
            "amount": amount,
            "line_total": amount,
        }
        return F.struct(
            *[
                values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
                for f in LINE_ITEM.fields
            ]
        )

    return F.transform(parts, item)


def line_item_error(parts: Column) -> Column:
    """Message for the first number in the line items that is none, else null.

    The pattern admits digits and dots in any order, such as ``1.2.3``; one such
    number fails the document.
    """
    numbers = F.flatten(F.transform(parts, lambda p: F.array(p["unit"], p["amount"])))
    bad = F.filter(numbers, lambda x: x.try_cast("double").isNull())
    return F.when(
        F.size(bad) > 0, F.concat(F.lit(_BAD_NUMBER + "'"), F.get(bad, F.lit(0)), F.lit("'"))
    )


def extract(
    df: DataFrame,
    body: str = "body",
    document_type: str = "document_type",
    only: str | None = None,
) -> DataFrame:
    """Add ``fields``, ``extraction_confidence`` and ``extraction_error``.

    Patterns run only on documents of the type they belong to. ``only`` builds
    the plan for a table known to hold a single type.
    """
    kept = df.columns
    types = [only] if only else list(_LABELLED)

    def when_type(name: str, value: Column) -> Column:
        return value if only else F.when(F.col(document_type) == name, value)

    text = F.col(body)
    df = df.withColumns({"_lower": F.lower(text), "_odd": has_odd_letter(text)})
    raw: dict[str, Column] = {}
    for name in types:
        if name not in _LABELLED:
            continue
        for field, pattern in _LABELLED[name].items():
            group = 0 if field in _WHOLE_MATCH else 1
            match = first_match(text, pattern, group)
            if field in P.LITERALS.get(name, {}):
                held = [F.contains(F.col("_lower"), F.lit(x)) for x in P.LITERALS[name][field]]
                match = F.when(reduce(lambda a, b: a | b, held, F.col("_odd")), match)
                match = match.otherwise(F.when(text.isNotNull(), F.lit("")))
            raw[f"_{name}_{field}"] = when_type(name, match)
    if "invoice" in types:
        raw["_lines"] = when_type("invoice", line_item_matches(text))
    if "contract" in types:
        for group in (1, 2):
            raw[f"_party{group}"] = when_type(
                "contract", first_match(text, P.PARTIES, group)
            )
        raw["_signed"] = when_type(
            "contract", text.rlike(java_regex(P.SIGNED, ignore_case=True))
        )
    if "resume" in types:
        raw["_links"] = when_type(
            "resume", F.regexp_extract_all(text, F.lit(java_regex(P.LINKS)), F.lit(0))
        )
    df = df.withColumns(raw)
    if "invoice" in types:
        df = df.withColumn("_parts", line_item_parts(F.col("_lines")))

    def found(name: str, field: str) -> Column:
        return strip(blank_to_null(F.col(f"_{name}_{field}")))

    options: dict[str, list[Column]] = {}

    def offer(field: str, value: Column) -> None:
        options.setdefault(field, []).append(value)

    error = F.lit(None).cast("string")
    if "invoice" in types:
        for field in P.INVOICE:
            value = found("invoice", field)
            number = field in ("total_amount", "subtotal", "tax_amount")
            offer(field, to_float(value) if number else value)
        offer("grand_total", to_float(found("invoice", "total_amount")))
        offer("currency", when_type("invoice", F.lit("USD")))
        offer("line_items", build_line_items(F.col("_parts")))
        error = line_item_error(F.col("_parts"))
    if "contract" in types:
        for field in P.CONTRACT:
            offer(field, found("contract", field))
        parties = F.when(F.col("_party1") != "", F.array(strip("_party1"), strip("_party2")))
        offer("parties", parties)
        offer("party_names", parties)
        offer("signatures_present", F.col("_signed"))
    if "resume" in types:
        for field in ("candidate_name", "email", "phone", "location"):
            offer(field, found("resume", field))
        offer("full_name", found("resume", "candidate_name"))
        offer("links", F.col("_links"))
        skills = F.transform(F.split(found("resume", "skills"), "[,;]"), strip)
        offer("skills", F.filter(skills, lambda s: s != ""))
    if "id_document" in types:
        for field in P.ID_DOCUMENT:
            offer(field, found("id_document", field))

    values = {
        field: F.coalesce(*candidates, default_value(FIELD_TYPES[field]))
        for field, candidates in options.items()
    }
    anchors = {
        "invoice": (to_float(found("invoice", "total_amount")).isNotNull(), 0.85)
        if "invoice" in types
        else None,
        "contract": (F.col("_party1") != "", 0.8) if "contract" in types else None,
        "resume": (F.coalesce(F.col("_resume_email"), F.lit("")) != "", 0.8)
        if "resume" in types
        else None,
        "id_document": (F.coalesce(found("id_document", "id_number"), F.lit("")) != "", 0.8)
        if "id_document" in types
        else None,
    }
    confidence = F.lit(0.6)
    if only:
        if anchors.get(only):
            anchor, high = anchors[only]
            confidence = F.when(anchor, F.lit(high)).otherwise(F.lit(0.5))
    else:
        branch = None
        for name in types:
            anchor, high = anchors[name]
            value = F.when(anchor, F.lit(high)).otherwise(F.lit(0.5))
            is_type = F.col(document_type) == name
            branch = F.when(is_type, value) if branch is None else branch.when(is_type, value)
        confidence = branch.otherwise(F.lit(0.6))
    return settle(
        df,
        kept,
        {
            "fields": build_fields(values),
            "extraction_confidence": confidence,
            "extraction_error": error,
        },
    )


def sync_aliases(fields: Column) -> Column:
    """Mirror each field and its alias onto the other where one is missing."""

    def pair(a: str, b: str) -> dict[str, Column]:
        return {
            a: F.coalesce(fields[a], fields[b]),
            b: F.coalesce(fields[b], fields[a]),
        }

    values = {f.name: fields[f.name] for f in FIELDS.fields}
    values |= pair("grand_total", "total_amount")
    values |= pair("total_years_experience", "years_experience")
    for a, b in (("party_names", "parties"), ("parties", "party_names")):
        values[a] = F.when(F.size(fields[a]) > 0, fields[a]).otherwise(fields[b])
    return F.struct(*[values[f.name].alias(f.name) for f in FIELDS.fields])
