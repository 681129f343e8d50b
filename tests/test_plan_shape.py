import random
import re
import string

from pyspark.sql import functions as F

from docmill.functions import patterns as P
from docmill.functions.columns import settle, settle_present
from docmill.functions.pii import redact_pii
from docmill.operators.extract import extract
from docmill.schemas import ISSUE, issue
from docmill.sources import golden


def _executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _generators(df):
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in x]


def test_golden_lines_are_parsed_where_they_are_dealt_to(spark):
    """Conditions on what lines hold are not checked below the exchange that deals them out."""
    lines = spark.range(8).select(
        F.concat(F.lit('{"name": "n'), "id", F.lit('", "file": "f", "expected_type": "invoice"}')).alias("value")
    )
    plan = _executed(golden.parse_golden(lines.repartition(4)))
    below = plan[plan.index("Exchange") :]
    assert re.search(r"(?i)parse_?json", plan) and not re.search(r"(?i)parse_?json|variant_get", below), plan


def test_generators_hold_columns_only(spark):
    """What a generator would interpret is computed by a projection below it."""
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, t string")
    odd = F.when(F.col("t") == "a", F.regexp_replace("t", "a", "b")).otherwise(F.lit("c"))
    settled = settle(df, ["k"], {"x": odd})
    assert all("CASE" not in g and "regexp" not in g for g in _generators(settled))
    assert [tuple(r) for r in settled.orderBy("k").collect()] == [(1, "b"), (2, "c")]
    items = [F.when(F.col("t") == "a", issue("x", "one")), F.when(F.col("k") > 0, issue("y", odd))]
    found = settle_present(df, ["k"], "issues", items, ISSUE)
    assert all("CASE" not in g for g in _generators(found))
    assert [[i.message for i in r.issues] for r in found.orderBy("k").collect()] == [["one", "b"], ["c"]]
    assert settle_present(df, ["k"], "issues", [], ISSUE).first().issues == []


def test_texts_without_the_sign_of_an_address_are_not_searched_for_one(spark):
    df = spark.createDataFrame([("a.b@c.de 123-45-6789",), ("123-45-6789 and 415-555-0100",), (None,)], "t string")
    clean = df.select(redact_pii(F.col("t")).alias("t"))
    plan = clean._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN Contains(t" in plan
    assert [r.t for r in clean.collect()] == ["[EMAIL] [SSN]", "[SSN] and [PHONE]", None]


def test_literals_are_parts_of_matches(spark):
    """Fields of texts put together from the patterns' words, odd letters among them, are those that the patterns find."""
    rng = random.Random(5)
    pieces = [*"Vendor from Invoice # DATE due date: 2026-01-02 PO p.o. Total subtotal 12.5 tax gstin VAT ein tax id".split(), "terms:", "effective date:", "expiry", "end date:", "governing law:", "name:", "a@b.cd", "location:", "skills:", "ID", "passport", "driver's license", "aadhaar", "PAN", "dob:", "date of birth:", "\n", " ", ": ", "- ", "subtotaı", "ſkills:", "skİlls:", "sKills:", "taK"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    texts += ["".join(rng.choice(string.ascii_letters + " :#") for _ in range(30)) for _ in range(50)] + ["", None]
    for kind in P.LITERALS:
        assert set(P.LITERALS[kind]) <= set({"invoice": P.INVOICE, "contract": P.CONTRACT, "resume": P.RESUME, "id_document": P.ID_DOCUMENT}[kind])
    df = spark.createDataFrame(list(enumerate(texts)), "k int, body string")
    plan = extract(df, only="invoice").select("fields")._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(_lower" in plan
    for kind, patterns in (("contract", P.CONTRACT), ("id_document", P.ID_DOCUMENT)):
        rows = extract(df, only=kind).select("k", "body", "fields").collect()
        assert len(rows) == len(texts)
        for r in rows:
            for field, pattern in patterns.items():
                own = re.search(pattern, r.body or "", re.I)
                assert (r.fields[field] or "") == (own.group(1).strip() if own else ""), (field, r.body)
