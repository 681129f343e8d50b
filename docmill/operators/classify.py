"""Keyword classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.columns import settle
from docmill.functions.patterns import KEYWORDS


def keyword_scores(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``score_<type>``: how many of the type's keywords the text contains."""
    kept = df.columns
    df = df.withColumn("_lower", F.lower(body))
    scores = [
        reduce(
            lambda a, b: a + b,
            [F.contains(F.col("_lower"), F.lit(word)).cast("int") for word in words],
        ).alias(f"score_{name}")
        for name, words in KEYWORDS.items()
    ]
    return df.select(*kept, *scores)


def classify(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``document_type``, ``classification_confidence`` and ``reasoning``.

    The highest score wins; ties go to the type that is declared first.
    """
    kept = df.columns
    df = keyword_scores(df, body)
    scores = {name: F.col(f"score_{name}") for name in KEYWORDS}
    df = df.withColumn("_hits", F.greatest(*scores.values()))
    best = F.when(F.col("_hits") == 0, F.lit("unknown"))
    for name, score in scores.items():
        best = best.when(score == F.col("_hits"), F.lit(name))
    df = df.withColumn("document_type", best)
    hits = F.col("_hits")
    # 0.5 + 0.15 per keyword, at most 0.99; written as the four values it takes.
    confidence = (
        F.when(hits == 0, F.lit(0.3))
        .when(hits == 1, F.lit(0.65))
        .when(hits == 2, F.lit(0.8))
        .when(hits == 3, F.lit(0.95))
        .otherwise(F.lit(0.99))
    )
    reasoning = F.when(hits == 0, F.lit("No recognisable keywords found.")).otherwise(
        F.concat(
            F.lit("Matched "),
            hits.cast("string"),
            F.lit(" keyword(s) for "),
            F.col("document_type"),
            F.lit("."),
        )
    )
    return settle(
        df,
        kept,
        {
            "document_type": F.col("document_type"),
            "classification_confidence": confidence,
            "reasoning": reasoning,
        },
    )
