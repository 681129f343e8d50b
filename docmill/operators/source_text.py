"""Document text as the scans and the extractor see it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import decode_utf8, has_nul, unify_newlines


def scan_text(content: Column) -> Column:
    """Text for scans and grounding: '' for binary or absent content."""
    is_binary = F.position(F.lit(b"\x00"), content) > 0
    return F.coalesce(F.when(~is_binary, decode_utf8(content)), F.lit(""))


def body_text(content: Column) -> Column:
    """Text for classification and extraction, with line ends unified."""
    return F.coalesce(unify_newlines(decode_utf8(content)), F.lit(""))


def from_content(
    documents: DataFrame, column: str = "content", keep_content: bool = False
) -> DataFrame:
    """Replace the bytes by ``scan_text`` and ``body``; the bytes go no further unless a model
    is to read them."""
    documents = documents.withColumns(
        {"scan_text": scan_text(F.col(column)), "body": body_text(F.col(column))}
    )
    return documents if keep_content else documents.drop(column)


def from_text(documents: DataFrame, column: str = "text") -> DataFrame:
    """The same two columns from documents that are already text."""
    text = F.coalesce(F.col(column), F.lit(""))
    return documents.withColumns(
        {
            "scan_text": F.when(has_nul(text), F.lit("")).otherwise(text),
            "body": unify_newlines(text),
        }
    )
