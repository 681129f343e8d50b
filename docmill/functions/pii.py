"""Personal data: counting, redaction, masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.patterns import PII
from docmill.functions.text import java_regex
from docmill.schemas import SENSITIVE_FIELDS

_LOCAL_PART = java_regex(r"[\w.\-]").removeprefix("(?d)")

# Same matches as the plain patterns, found faster. The e-mail pattern backs up
# over the whole word at each of its letters; starting only where a word (or the
# rest of one, after a match) begins keeps the scan linear on very long tokens.
# The number patterns look at the first character before testing boundaries.
_TUNED = {
    "email": rf"(?d)(?:(?<!{_LOCAL_PART})|\G){_LOCAL_PART}++@"
    + java_regex(r"[\w.\-]+\.\w+").removeprefix("(?d)"),
    "ssn": java_regex(r"(?=\d)\b\d{3}-\d{2}-\d{4}\b"),
    "credit_card": java_regex(r"(?=\d)" + PII[2][1]),
    "phone": java_regex(r"(?=[+(\d])" + PII[3][1]),
}


def pii_regex(label: str) -> str:
    return _TUNED[label]


def _may_match(text: Column, label: str) -> Column:
    if label == "email":
        return F.contains(text, F.lit("@"))
    if label == "ssn":
        return F.contains(text, F.lit("-"))
    return F.lit(True)


def pii_count(text: Column, label: str) -> Column:
    """Number of values of one kind."""
    return F.when(
        _may_match(text, label), F.regexp_count(text, F.lit(_TUNED[label]))
    ).otherwise(F.lit(0))


def redact_pii(text: Column) -> Column:
    """Text with every value replaced by the placeholder of its kind, kind by kind."""
    for label, _, placeholder in PII:
        text = _replaced(text, label, placeholder)
    return text


def _replaced(text: Column, label: str, placeholder: str) -> Column:
    replaced = F.regexp_replace(text, _TUNED[label], placeholder)
    if label != "email":
        return replaced
    # A text without the sign that each address has is left as it is.
    return F.when(_may_match(text, label), replaced).otherwise(text)


def mask_value(value: Column) -> Column:
    """All but the last four characters as stars; '' for null."""
    length = F.length(value)
    hidden = F.when(length <= 4, length).otherwise(length - 4)
    return F.coalesce(
        F.concat(
            F.repeat(F.lit("*"), hidden),
            F.when(length <= 4, F.lit("")).otherwise(F.right(value, F.lit(4))),
        ),
        F.lit(""),
    )


def redact_value(value: Column, dtype: T.DataType, name: str = "") -> Column:
    """Redact a nested value for display.

    Strings below a sensitive name are masked, all others are scrubbed; other
    types pass. Keys of maps count as names.
    """
    if isinstance(dtype, T.StructType):
        parts = [
            redact_value(value[f.name], f.dataType, f.name).alias(f.name) for f in dtype.fields
        ]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: redact_value(x, dtype.elementType, name))
    if isinstance(dtype, T.MapType):

        def by_key(key: Column, item: Column) -> Column:
            open_value = redact_value(item, dtype.valueType)
            if not isinstance(dtype.valueType, T.StringType):
                return open_value
            return F.when(key.isin(*SENSITIVE_FIELDS), mask_value(item)).otherwise(open_value)

        return F.transform_values(value, by_key)
    if isinstance(dtype, T.StringType):
        if name in SENSITIVE_FIELDS:
            return F.when(value.isNotNull(), mask_value(value))
        return redact_pii(value)
    return value
