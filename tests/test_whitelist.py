"""A whitelist that is a table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docmill.operators import validate
from docmill.operators.source_text import from_text
from docmill.plans.documents import process_documents
from docmill.settings import DEFAULT_RULES, Rules

DAY, STAMP = dt.date(2026, 6, 1), dt.datetime(2026, 6, 1)


def names(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    parts = ["Acme", "acme corp", "Ltd", "GmbH", "Ü-Werk", "x", "North", "of", "7", "  ", "İz"]
    return [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)] + ["", None]


@pytest.mark.parametrize("few", [True, False])
def test_names_like_contains(spark, few):
    vendors, entries = names(1, 300), names(2, 6 if few else 60)
    if few:
        entries = [e for e in entries if e]  # an empty entry is in every name
    table = spark.createDataFrame([(e,) for e in entries], "entry string")
    found = validate.names_on_list(spark.createDataFrame([(v,) for v in vendors], "v string"), table, "v", "entry")
    lower = [r[0] for r in spark.createDataFrame([(v,) for v in vendors if v is not None], "v string").select(F.lower("v")).distinct().collect()]
    listed = [r[0] for r in table.dropna().select(F.lower("entry")).distinct().collect()]
    assert sorted(r[0] for r in found.collect()) == sorted(v for v in lower if any(e in v for e in listed))


def invoice(vendor: str, number: int) -> str:
    return f"INVOICE\nVendor: {vendor}\nInvoice #: {number}\nDate: 2026-01-15\n1 x A @ $5.00 = $5.00\nTotal: $5.00\n"


def test_the_plan_takes_a_large_table(spark, capsys):
    """100 000 entries give what the same names as literals give, and no nested loop."""
    sold = [f"Vendor No {i} of {i * 7919 % 1000003:06d}" for i in range(100_000)]
    listed = spark.createDataFrame([(s,) for s in sold], "entry string")
    vendors = [sold[5] + " Branch", sold[99_999].upper(), "Nobody Inc", "Globex", "vendor no", None, sold[7][:-1]]
    texts = [(f"d{i}", invoice(v, i) if v else "Just a note.") for i, v in enumerate(vendors * 3)]
    texts.append(("resume", "RESUME\nName: Jane\nEmail: j@x.org\nExperience\nSkills: a, b\n"))
    docs = from_text(spark.createDataFrame(texts, "job_id string, text string"))
    with_table = process_documents(docs, DEFAULT_RULES, as_of=DAY, processed_at=STAMP, whitelist=listed)
    chosen = [sold[5], sold[99_999]]
    rules = Rules(
        DEFAULT_RULES.thresholds, (*DEFAULT_RULES.vendor_whitelist, *chosen), DEFAULT_RULES.tax_id_formats,
        DEFAULT_RULES.id_number_formats, DEFAULT_RULES.document_types,
    )
    literal = process_documents(docs, rules, as_of=DAY, processed_at=STAMP)
    assert sorted(map(str, with_table.collect())) == sorted(map(str, literal.collect()))
    with_table.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_an_empty_table(spark):
    docs = from_text(spark.createDataFrame([("a", invoice("Globex", 1)), ("b", invoice("Other", 2))], "job_id string, text string"))
    none = spark.createDataFrame([], "entry string")
    got = process_documents(docs, DEFAULT_RULES, as_of=DAY, processed_at=STAMP, whitelist=none)
    want = process_documents(docs, DEFAULT_RULES, as_of=DAY, processed_at=STAMP)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
