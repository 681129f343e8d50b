"""Text functions with Unicode-aware, whole-string semantics.

Patterns are written in their plain form (``\\w``, ``\\d``, ``\\s``, ``\\b``
over Unicode, ``.`` stopping at line feed only). ``java_regex`` spells those
classes out, because the JVM's own shorthand classes are ASCII unless a flag
widens them to a slightly different set.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as white space.
WHITESPACE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680]
        + [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)

# Decimal digits of all scripts but ASCII, and the ASCII digits they stand for.
_DIGITS = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Nd"]
OTHER_DIGITS = "".join(_DIGITS)
AS_ASCII = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)

# The same set: control characters, next line, and the separator category.
_SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
# The leading ASCII class only makes the common case cheaper.
_WORD = r"[a-zA-Z0-9_\p{L}\p{N}]"
_BOUNDARY = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def java_regex(plain: str, ignore_case: bool = False) -> str:
    """Spell a plain pattern for the JVM regex engine."""
    spelled = (
        plain.replace(r"\w", _WORD)
        .replace(r"\d", r"\p{Nd}")
        .replace(r"\s", f"[{_SPACE}]")
        .replace(r"\S", f"[^{_SPACE}]")
        .replace(r"\b", _BOUNDARY)
    )
    return ("(?diu)" if ignore_case else "(?d)") + spelled


# Letters that equal an ASCII letter when case is ignored but do not lower to it.
_ODD_LETTERS = [chr(0x130), chr(0x131), chr(0x17F)]


def has_odd_letter(text: Column) -> Column:
    """Whether a text may match a pattern that ignores case without its lower-case form holding
    the pattern's literals."""
    odd = F.lit(False)
    for letter in _ODD_LETTERS:
        odd = odd | F.contains(text, F.lit(letter))
    return odd


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def collapse_spaces(text: Column) -> Column:
    """Every run of white space as one space; single spaces are left untouched."""
    return F.regexp_replace(text, rf" [{_SPACE}]+|[{_SPACE}&&[^ ]][{_SPACE}]*", " ")


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def to_float(text: Column) -> Column:
    """Number in the digits of any script, with optional thousands separators; null if it is
    none."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    ascii_only = plain.rlike(r"\A[\x00-\x7f]*\z")
    return F.when(ascii_only, plain).otherwise(
        F.translate(plain, OTHER_DIGITS, AS_ASCII)
    ).try_cast("double")


# A run of valid UTF-8, on bytes read as one character each.
_VALID_BYTES = (
    r"(?:[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]"
    r"|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    r"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})"
)


def decode_utf8(content: Column) -> Column:
    """Bytes as text, dropping whatever is not valid UTF-8 and nothing else.

    Only content with an invalid byte is searched: read as Latin-1, runs of valid
    sequences stay and other bytes go."""
    text = content.cast("string")
    bytes_ = F.decode(content, "ISO-8859-1")
    rest = F.regexp_replace(bytes_, rf"({_VALID_BYTES}++)|[\x80-\xff]", "$1")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.encode(rest, "ISO-8859-1").cast("string"))


def unify_newlines(text: Column) -> Column:
    return F.when(
        F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")
    ).otherwise(text)


def has_nul(text: Column) -> Column:
    return F.contains(text, F.lit("\x00"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- Numbers as text -------------------------------------------------------

_SPLITTER = 134217729.0  # 2**27 + 1
# Below the first limit 100 * x is a whole number that a double holds; from the second on every
# double is a whole number.
_PRODUCT_LIMIT = 1e13
_WHOLE_LIMIT = 2.0**53


def _cents(x: Column) -> Column:
    """The integer nearest to 100*x, judged on the exact binary value of x.

    The product's rounding error is recovered with a split multiplication, so a
    product that merely rounds to a half is not taken for a tie. True ties go
    to the even neighbour.
    """
    product = x * 100.0
    high = x * _SPLITTER - (x * _SPLITTER - x)
    error = (high * 100.0 - product) + (x - high) * 100.0
    floor = F.floor(product)
    rest = product - floor
    up = (rest > 0.5) | (
        (rest == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(floor, F.lit(2)) == 1)))
    )
    return floor + F.when(up, F.lit(1)).otherwise(F.lit(0))


def _whole_and_cents(x: Column, body) -> Column:
    """``body`` of the whole part and the hundredths of a non-negative number below 2**53. The
    part behind the point of a large number has few bits, so both are exact."""

    def parts(whole: Column) -> Column:
        return let(
            _cents(x - whole.cast("double")),
            lambda cents: F.when(cents >= 100, body(whole + 1, cents - 100)).otherwise(
                body(whole, cents)
            ),
        )

    return let(F.floor(x), parts)


def round2(value: Column) -> Column:
    """Round a double to two decimals. From 2**53 on doubles are whole numbers."""

    def large(x: Column) -> Column:
        size = _whole_and_cents(F.abs(x), lambda whole, cents: whole + cents / 100.0)
        return F.when(x < 0, -size).otherwise(size)

    return let(
        value,
        lambda x: F.when(F.abs(x) < _PRODUCT_LIMIT, _cents(x) / 100.0)
        .when(F.abs(x) < _WHOLE_LIMIT, large(x))
        .otherwise(x),
    )


def _whole_digits(x: Column) -> Column:
    """All digits of a whole double, as exact as the double: its 53 bits as limbs of nine
    digits, doubled as often as its exponent says, 29 times in one step."""
    base = 10**9

    def quotient(value: Column, by: int) -> Column:
        return F.call_function("div", value, F.lit(by).cast("bigint"))

    def times(limbs: Column, factor: Column) -> Column:
        start = F.struct(
            F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("carry")
        )

        def step(acc: Column, limb: Column) -> Column:
            value = limb * factor + acc["carry"]
            return F.struct(
                F.concat(acc["out"], F.array(F.pmod(value, F.lit(base)))).alias("out"),
                quotient(value, base).alias("carry"),
            )

        return F.aggregate(limbs, start, step, lambda acc: F.concat(acc["out"], F.array(acc["carry"])))

    def digits(power: Column) -> Column:
        bits = (x / F.pow(F.lit(2.0), power)).cast("bigint")
        limbs = let(
            bits,
            lambda b: F.array(
                F.pmod(b, F.lit(base)),
                F.pmod(quotient(b, base), F.lit(base)),
                quotient(b, base**2),
            ),
        )
        first = times(limbs, F.pow(F.lit(2), F.pmod(power, F.lit(29))).cast("bigint"))
        rounds = F.floor(power / 29).cast("int")
        whole = F.aggregate(
            F.array_repeat(F.lit(1 << 29).cast("bigint"), rounds), first, lambda acc, f: times(acc, f)
        )
        shown = F.transform(F.reverse(whole), lambda limb: F.lpad(limb.cast("string"), 9, "0"))
        return F.ltrim(F.array_join(shown, ""), F.lit("0"))

    exponent = F.greatest(F.floor(F.log2(x)) - 53, F.lit(0)).cast("int")
    return let(exponent, digits)


def format2(value: Column) -> Column:
    """A double with two decimals, as ``%.2f`` prints it."""

    def body(x: Column) -> Column:
        sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
        small = _whole_and_cents(
            F.abs(x),
            lambda whole, cents: F.concat(
                whole.cast("string"), F.lit("."), F.lpad(cents.cast("string"), 2, "0")
            ),
        )
        return (
            F.when(F.isnan(x), F.lit("nan"))
            .when(x == float("inf"), F.lit("inf"))
            .when(x == float("-inf"), F.lit("-inf"))
            .when(F.abs(x) < _WHOLE_LIMIT, F.concat(sign, small))
            .otherwise(F.concat(sign, _whole_digits(F.abs(x)), F.lit(".00")))
        )

    return F.when(value.isNotNull(), let(value, body))


def float_repr(value: Column) -> Column:
    """The shortest decimal form: plain between 1e-4 and 1e16, else ``1e+16``."""

    def body(x: Column) -> Column:
        size = F.abs(x)
        text = x.cast("string")
        digits = text.try_cast("decimal(38,20)").cast("string")
        plain = F.regexp_replace(F.regexp_replace(digits, r"0+$", ""), r"\.$", ".0")
        mantissa = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.0$", "")
        power = F.split_part(text, F.lit("E"), F.lit(2))
        sign = F.when(F.startswith(power, F.lit("-")), F.lit("-")).otherwise(F.lit("+"))
        exponent = F.replace(power, F.lit("-"), F.lit(""))
        two_digits = F.when(F.length(exponent) < 2, F.lpad(exponent, 2, "0")).otherwise(exponent)
        return (
            F.when(F.isnan(x), F.lit("nan"))
            .when(x == float("inf"), F.lit("inf"))
            .when(x == float("-inf"), F.lit("-inf"))
            .when((size == 0) | ((size >= 1e-3) & (size < 1e7)), text)
            .when((size >= 1e-4) & (size < 1e16), plain)
            .otherwise(F.concat(mantissa, F.lit("e"), sign, two_digits))
        )

    return F.when(value.isNotNull(), let(value, body))


# --- Dates -----------------------------------------------------------------


def _monday_of_week_one(year: Column) -> Column:
    return let(
        F.make_date(year, F.lit(1), F.lit(4)), lambda jan4: F.date_sub(jan4, F.weekday(jan4))
    )


def _week_date(compact: Column) -> Column:
    """``YYYYWww`` or ``YYYYWwwD`` as a date, Monday if there is no day."""
    year = F.substring(compact, 1, 4).cast("int")
    week = F.substring(compact, 6, 2).cast("int")
    day = F.coalesce(F.substring(compact, 8, 1).try_cast("int"), F.lit(1))
    year_start = _monday_of_week_one(year)
    weeks = F.datediff(_monday_of_week_one(year + 1), year_start) / 7
    return F.when(
        (week >= 1) & (week <= weeks) & (day >= 1) & (day <= 7),
        F.date_add(year_start, (week - 1) * 7 + day - 1),
    )


def parse_iso_date(text: Column) -> Column:
    """A calendar or week date in ISO form, null for anything else."""

    def body(x: Column) -> Column:
        compact = F.replace(x, F.lit("-"), F.lit(""))
        return F.when(
            x.rlike(r"\A(?!0000)[0-9]{4}(?:-[0-9]{2}-[0-9]{2}|[0-9]{4})\z"),
            F.try_to_date(compact, "yyyyMMdd"),
        ).when(
            x.rlike(r"\A(?!0000)[0-9]{4}(?:-W[0-9]{2}(?:-[0-9])?|W[0-9]{2}[0-9]?)\z"),
            _week_date(compact),
        )

    return F.when(text != "", let(text, body))
