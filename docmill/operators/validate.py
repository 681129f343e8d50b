"""Business rules: fields to validation issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.columns import settle_present
from docmill.functions.text import float_repr, java_regex, parse_iso_date, round2, strip
from docmill.schemas import FIELD_TYPES, ISSUE, issue
from docmill.settings import Rules

DATE_FIELDS = (
    "invoice_date",
    "due_date",
    "effective_date",
    "expiration_date",
    "date_of_birth",
    "expiry_date",
)


def is_empty(value: Column, dtype: T.DataType) -> Column:
    """Null, blank text or an empty collection; zero and false are values."""
    if isinstance(dtype, T.StringType):
        return value.isNull() | (strip(value) == "")
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return value.isNull() | (F.size(value) == 0)
    return value.isNull()


def filled(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def config_regex(pattern: str) -> str:
    """A configured pattern, matched at the start of the value."""
    return rf"\A(?:{java_regex(pattern).removeprefix('(?d)')})"


def required_field_issues(fields: Column, names: list[str]) -> list[Column]:
    items = []
    for name in names:
        dtype = FIELD_TYPES.get(name)
        missing = F.lit(True) if dtype is None else is_empty(fields[name], dtype)
        items.append(F.when(missing, issue(name, f"Required field '{name}' is missing.")))
    return items


def parsed_dates(fields: Column) -> dict[str, Column]:
    """One ``_day_<field>`` column per date field, null where it is no date."""
    return {f"_day_{name}": parse_iso_date(fields[name]) for name in DATE_FIELDS}


def day(name: str) -> Column:
    return F.col(f"_day_{name}")


def date_issues(fields: Column) -> list[Column]:
    items = []
    for name in DATE_FIELDS:
        value = fields[name]
        message = F.concat(
            F.lit(f"Field '{name}' value '"), value, F.lit("' is not a valid ISO date.")
        )
        items.append(
            F.when(filled(value) & day(name).isNull(), issue(name, message))
        )
    return items


def line_total(item: Column) -> Column:
    return F.coalesce(item["line_total"], item["amount"])


def sum_lines(items: Column) -> Column:
    """Sum of line totals with a running compensation for lost low-order bits."""
    zero = F.lit(0.0)

    def add(acc: Column, item: Column) -> Column:
        x, total = line_total(item), acc["total"] + line_total(item)
        lost = F.when(
            F.abs(acc["total"]) >= F.abs(x), (acc["total"] - total) + x
        ).otherwise((x - total) + acc["total"])
        return F.struct(total.alias("total"), (acc["lost"] + lost).alias("lost"))

    return F.aggregate(
        items,
        F.struct(zero.alias("total"), zero.alias("lost")),
        add,
        lambda acc: acc["total"] + acc["lost"],
    )


def effective_total(fields: Column) -> Column:
    return F.coalesce(fields["grand_total"], fields["total_amount"])


def total_candidates(fields: Column) -> Column:
    """Totals that the parts of an invoice add up to, under three readings.

    Subtotal with tax; lines with tax; lines that already include tax. Shipping
    is added and discount taken off in each.
    """

    def amount(name: str) -> Column:
        return F.coalesce(fields[name], F.lit(0.0))

    lines = round2(sum_lines(fields["line_items"]))
    tax, shipping, discount = amount("tax_amount"), amount("shipping"), amount("discount")
    has_lines = F.size(fields["line_items"]) > 0
    return F.array_compact(
        F.array(
            F.when(
                fields["subtotal"].isNotNull(),
                round2(fields["subtotal"] + tax + shipping - discount),
            ),
            F.when(has_lines, round2(lines + tax + shipping - discount)),
            F.when(has_lines, round2(lines + shipping - discount)),
        )
    )


def total_issue(fields: Column, candidates: Column, tolerance: float) -> Column:
    """Error if no reading of the invoice gives its stated total."""
    total = effective_total(fields)
    off = ~F.exists(candidates, lambda c: F.abs(c - total) <= F.lit(float(tolerance)))
    shown = F.array_join(
        F.transform(F.array_sort(F.array_distinct(candidates)), float_repr), ", "
    )
    message = F.concat(
        F.lit("Grand total "),
        float_repr(total),
        F.lit(" does not reconcile with components (candidates ["),
        shown,
        F.lit(f"], tolerance {tolerance!r})."),
    )
    return F.when(
        total.isNotNull() & (F.size(candidates) > 0) & off, issue("grand_total", message)
    )


def date_order_issue(fields: Column) -> Column:
    late = day("due_date") < day("invoice_date")
    message = F.concat(
        F.lit("due_date "),
        fields["due_date"],
        F.lit(" precedes invoice_date "),
        fields["invoice_date"],
        F.lit("."),
    )
    return F.when(late, issue("due_date", message))


def tax_id_issue(fields: Column, rules: Rules) -> Column:
    tax_id = fields["vendor_tax_id"]
    patterns = list(rules.tax_id_formats.values())
    if not patterns:
        return F.lit(None).cast(ISSUE)
    compact = F.upper(F.replace(tax_id, F.lit(" "), F.lit("")))
    known = reduce(lambda a, b: a | b, [compact.rlike(config_regex(p)) for p in patterns])
    message = F.concat(
        F.lit("Tax id '"), tax_id, F.lit("' does not match a known GSTIN/PAN/VAT/EIN format.")
    )
    return F.when(filled(tax_id) & ~known, issue("vendor_tax_id", message, "warning"))


def is_whitelisted(vendor: Column, rules: Rules) -> Column:
    """Whether the vendor's name contains a listed name, case ignored."""
    name = F.lower(vendor)
    return reduce(
        lambda a, b: a | b,
        [F.contains(name, F.lit(entry.lower())) for entry in rules.vendor_whitelist],
        F.lit(False),
    )


def whitelist_issue(fields: Column, rules: Rules, listed: Column | None = None) -> Column:
    """A vendor that neither the rules nor, as ``listed`` says, a table has."""
    vendor = fields["vendor_name"]
    message = F.concat(F.lit("Vendor '"), vendor, F.lit("' is not in the whitelist."))
    known = is_whitelisted(vendor, rules)
    return F.when(
        filled(vendor) & ~(known if listed is None else known | listed),
        issue("vendor_name", message, "warning"),
    )


def invoice_issues(
    fields: Column, candidates: Column, rules: Rules, listed: Column | None = None
) -> list[Column]:
    return [
        total_issue(fields, candidates, rules.total_tolerance),
        date_order_issue(fields),
        tax_id_issue(fields, rules),
        whitelist_issue(fields, rules, listed),
    ]


def effective_parties(fields: Column) -> Column:
    return F.when(F.size(fields["party_names"]) > 0, fields["party_names"]).otherwise(
        fields["parties"]
    )


def contract_issues(fields: Column) -> list[Column]:
    ends_early = day("expiration_date") <= day("effective_date")
    dates = F.concat(
        F.lit("expiration_date "),
        fields["expiration_date"],
        F.lit(" is not after effective_date "),
        fields["effective_date"],
        F.lit("."),
    )
    return [
        F.when(ends_early, issue("expiration_date", dates)),
        F.when(
            F.size(effective_parties(fields)) < 2,
            issue("party_names", "A contract must name at least two parties."),
        ),
        F.when(
            fields["signatures_present"] == F.lit(False),
            issue("signatures_present", "No signatures detected on the contract.", "warning"),
        ),
    ]


def id_issues(fields: Column, rules: Rules, as_of: Column) -> list[Column]:
    expired = day("expiry_date") < as_of
    items = [
        F.when(
            expired,
            issue(
                "expiry_date",
                F.concat(F.lit("ID expired on "), fields["expiry_date"], F.lit(".")),
            ),
        )
    ]
    kind, number = F.lower(fields["id_type"]), F.upper(strip(fields["id_number"]))
    malformed = F.lit(False)
    for name, pattern in rules.id_number_formats.items():
        if pattern:
            malformed = malformed | ((kind == name) & ~number.rlike(config_regex(pattern)))
    message = F.concat(
        F.lit("ID number does not match the expected format for "), fields["id_type"], F.lit(".")
    )
    items.append(
        F.when(
            filled(fields["id_type"]) & filled(fields["id_number"]) & malformed,
            issue("id_number", message, "warning"),
        )
    )
    return items


def validate(
    df: DataFrame,
    rules: Rules,
    as_of: Column,
    document_type: str = "document_type",
    fields: str = "fields",
    out: str = "validation_issues",
    listed: Column | None = None,
) -> DataFrame:
    """Add all issues: required fields, then dates, then checks of the type. ``listed`` says
    whether a whitelist table has the vendor (see ``names_on_list``)."""
    kept = [c for c in df.columns if c != out]
    record, kind = F.col(fields), F.col(document_type)
    is_invoice = kind == "invoice"
    df = df.withColumns(
        {"_candidates": F.when(is_invoice, total_candidates(record)), **parsed_dates(record)}
    )
    per_type = {
        "invoice": invoice_issues(record, F.col("_candidates"), rules, listed),
        "contract": contract_issues(record),
        "id_document": id_issues(record, rules, as_of),
    }
    names = sorted({*per_type, *rules.document_types})
    required = [
        F.when(kind == name, item)
        for name in names
        for item in required_field_issues(record, rules.required_fields(name))
    ]
    specific = [F.when(kind == name, item) for name in names for item in per_type.get(name, [])]
    return settle_present(df, kept, out, [*required, *date_issues(record), *specific], ISSUE)


#: Characters of the piece by which a list's entry is looked up in names.
GRAM = 5


def _pieces(text: Column, size: int | Column) -> Column:
    """The substrings of one length."""
    length = F.length(text)
    starts = F.when(length >= size, F.sequence(F.lit(1), length - size + 1))
    starts = F.coalesce(starts, F.array().cast("array<int>"))
    return F.transform(starts, lambda start: F.substring(text, start, F.lit(size) if isinstance(size, int) else size))


def names_on_list(names: DataFrame, whitelist: DataFrame, name: str, entry: str) -> DataFrame:
    """The distinct lower-case names, as ``_name``, that contain an entry of a whitelist table.

    Each entry is looked up by one piece of it: of its substrings of ``GRAM`` characters the one
    that the fewest entries have, so that no piece that is common among them brings many entries
    together. Names are joined by equality on their pieces of that length, and whole entries are
    compared only behind an equal piece. Entries shorter than a piece are looked up whole, in
    pieces of the lengths that occur. An empty entry is contained in every name.
    """
    listed = whitelist.select(F.lower(entry).alias("_entry")).dropna().distinct()
    size = F.length("_entry")
    grams = listed.where(size >= GRAM).select("_entry", F.explode(F.array_distinct(_pieces(F.col("_entry"), GRAM))).alias("_piece"))
    rarity = grams.groupBy("_piece").agg(F.count("*").alias("_n"))
    rarest = F.min_by("_piece", F.struct("_n", "_piece")).alias("_piece")
    keyed = grams.join(rarity, "_piece").groupBy("_entry").agg(rarest)
    short = listed.where(size < GRAM)
    keyed = keyed.unionByName(short.select("_entry", F.col("_entry").alias("_piece")))
    # At most as many numbers as a piece has characters.
    lengths = short.agg(F.collect_set(F.length("_entry")).alias("_lengths")).scalar()
    own = names.select(F.lower(name).alias("_name")).dropna().distinct().withColumn("_lengths", lengths)
    short_pieces = F.flatten(
        F.transform("_lengths", lambda n: F.when(n == 0, F.array(F.lit(""))).otherwise(_pieces(F.col("_name"), n)))
    )
    pieces = F.array_distinct(F.concat(_pieces(F.col("_name"), GRAM), short_pieces))
    hits = own.select("_name", F.explode(pieces).alias("_piece")).join(keyed, "_piece")
    return hits.where(F.contains("_name", F.col("_entry"))).select("_name").distinct()


def vendors_off_list(vendors: DataFrame, whitelist: DataFrame, vendor: str, entry: str) -> DataFrame:
    """Vendors whose name contains no entry of a whitelist table, case ignored. The tables are
    joined by equality whatever their sizes."""
    hits = names_on_list(vendors, whitelist, vendor, entry)
    return vendors.join(hits, F.lower(vendor) == F.col("_name"), "left_anti")
