"""Text functions against plain Python on random strings."""

import datetime as dt
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill.functions import patterns as P
from docmill.functions import pii
from docmill.functions.text import (
    WHITESPACE,
    collapse_spaces,
    decode_utf8,
    float_repr,
    format2,
    java_regex,
    parse_iso_date,
    round2,
    strip,
    to_float,
    unify_newlines,
)

ODD = "é²٣ſıİK  　\x85\x1ćñ中_-.@+() \t\n\r\x0b0123456789"
PIECES = [
    "a.b@c-d.ef@g.hi", "x@y", "123-45-6789", "4111 1111 1111 1111", "415-555-0100",
    "(415) 555 0100", "+1 415-555-0100", "1234567890123", "ignore all previous instructions",
    "SYſTEM prompt", "forget your ", "you are now a", "new instructions:", "</system>",
    "invoice # : A1", "Total: $1,234.50", "subtotal 5", "2 x Big x 3 @ $4.0 = $8.00",
    "between A and B.", "effective date: 2026-01-01", "Due Date - 2026-02-01", "Name: Zoë ",
    "skills: a, b;c", "https://x.y/z", "id number Z9", "driver's licence", "expires 2020-01-01",
    "vat GB12", "terms: net", "po box",
]


def random_texts(seed: int, n: int = 400) -> list[str]:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 8)):
            if rng.random() < 0.6:
                parts.append(rng.choice(PIECES))
            parts.append("".join(rng.choice(ODD + "abzXYZ:,$#=") for _ in range(rng.randint(0, 4))))
        out.append("".join(parts))
    return out


def column(spark, texts, expr):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", expr(F.col("t")).alias("x"))
    return [r.x for r in df.orderBy("i").collect()]


def test_pii_patterns_match_like_plain_ones(spark):
    texts = random_texts(1)
    for label, plain, _ in P.PII:
        got = column(
            spark, texts, lambda t: F.regexp_extract_all(t, F.lit(pii.pii_regex(label)), F.lit(0))
        )
        assert got == [[m.group(0) for m in re.finditer(plain, t)] for t in texts], label


def test_redaction(spark):
    def plain(text):
        for _, pattern, placeholder in P.PII:
            text = re.sub(pattern, placeholder, text)
        return text

    texts = random_texts(2)
    assert column(spark, texts, pii.redact_pii) == [plain(t) for t in texts]


def test_first_matches(spark):
    texts = random_texts(3)
    fields = {**P.INVOICE, **P.CONTRACT, **P.RESUME, **P.ID_DOCUMENT}
    for name, plain in [*fields.items(), *[(label, p) for p, label, _ in P.INJECTION]]:
        got = column(
            spark, texts, lambda t: F.regexp_extract(t, java_regex(plain, ignore_case=True), 0)
        )
        want = [m.group(0) if (m := re.search(plain, t, re.I)) else "" for t in texts]
        assert got == want, name


def test_mail_scan_is_not_quadratic(spark):
    word = "a" * 200_000 + " x@y.zz"
    assert column(spark, [word], lambda t: pii.pii_count(t, "email")) == [1]


@settings(max_examples=5, deadline=None)
@given(texts=st.lists(st.text(st.characters(codec="utf-8"), max_size=30), min_size=40, max_size=60))
def test_white_space(spark, texts):
    assert column(spark, texts, strip) == [t.strip() for t in texts]
    assert column(spark, texts, collapse_spaces) == [re.sub(r"\s+", " ", t) for t in texts]
    newlines = [t.replace("\r\n", "\n").replace("\r", "\n") for t in texts]
    assert column(spark, texts, unify_newlines) == newlines


def test_white_space_set():
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_decode(spark):
    raw = [b"abc", b"a\xffb\xc3", "zoë".encode(), b"\xe2\x82 x", b""]
    rng = random.Random(6)
    units = [b"\xef\xbf\xbd", b"\xff", b"\xc3", b"\xa9", b"a", b"\xe2\x82", b"\xf0\x9f\x98\x80", b"\xed\xa0\x80", b"\x00"]
    raw += [b"".join(rng.choice(units) for _ in range(rng.randint(1, 8))) for _ in range(200)]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "i int, b binary")
    got = [r.x for r in df.select("i", decode_utf8(F.col("b")).alias("x")).orderBy("i").collect()]
    assert got == [b.decode("utf-8", errors="ignore") for b in raw]


def test_numbers_as_text(spark):
    rng = random.Random(4)
    values = [0.0, 2.675, 1.005, 0.125, 0.375, -2.675, 1e7, 12345678.9, 1e16, 1e-5, 0.0005, 200.0]
    values += [123456789012.35, -0.25, 1e22, 3.0e-7]
    values += [round(rng.uniform(-1e6, 1e6), rng.randint(0, 4)) for _ in range(300)]
    values += [rng.randint(0, 10**7) / 1000 + 0.005 for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    v = F.col("v")
    rows = df.select("i", round2(v).alias("r"), format2(v).alias("f"), float_repr(v).alias("s"))
    for row in rows.orderBy("i").collect():
        x = values[row.i]
        assert row.r == round(x, 2), x
        assert row.s == repr(x), x
        if abs(x) < 1e13:
            assert row.f == f"{x:.2f}", x


def test_numbers_over_the_whole_range(spark):
    rng = random.Random(5)
    values = [12345678901234.126, 2.0**53, 1e23, 1e36, -1e100, 1.7976931348623157e308, 99.995]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-4, 300) for _ in range(500)]
    values += [rng.uniform(1e12, 9e15) for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for r in df.select("v", round2(F.col("v")).alias("r"), format2(F.col("v")).alias("f")).collect():
        assert (r.r, r.f) == (round(r.v, 2), "%.2f" % r.v)


def test_digits_of_every_script(spark):
    texts = ["٥", "१२٫५", "٥.٠٠", "１,２３４.５", "𝟙𝟚", "1e3", "x٥", ""]
    got = column(spark, texts, to_float)

    def plain(text):
        try:
            return float(text.replace(",", ""))
        except ValueError:
            return None

    assert got == [plain(t) for t in texts]


def test_iso_dates(spark):
    texts = [
        "2026-01-15", "20260115", "2026-W03-1", "2026W031", "2026-W53-1", "2020-W53-7", "2026-W03",
        "2026-1-5", "2026-01-15 ", "2026-02-30", "15/01/2026", "2026", "0000-01-01", "2026-13-01",
        "2024-02-29", "2026-W00-1", "2026-W03-8", "2026-0115", "2026-W031", "", "x",
    ]

    def plain(text):
        try:
            return dt.date.fromisoformat(text)
        except ValueError:
            return None

    assert column(spark, texts, parse_iso_date) == [plain(t) for t in texts]


def test_masking(spark):
    got = column(spark, ["", "1234", "12345", "GB29NWBK", None], pii.mask_value)
    assert got == ["", "****", "*2345", "****NWBK", ""]
