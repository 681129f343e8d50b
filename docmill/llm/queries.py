"""The driver's queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import conversations, hard_negatives, html_text, language, lm, mixing, near_dups, neighbours, packing
from docmill.llm import passages, quality, sql, token_counts, toxicity
from docmill.llm.shared import learn_fold, settled

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {
    "op6_nearest_neighbours": sql.NEAREST,
    "op11_hard_negatives": sql.NEGATIVES,
    "op12_conversation_repair": sql.REPAIR,
}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(table(spark, sf, "documents"))


@query
def op2_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pieces_of(table(spark, sf, "documents"), path)
    return packing.pack(pieces, settled).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bins", "bound"
    )


@query
def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = learn_fold("doc_id", 4) == 2
    found = language.identify(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(table(spark, sf, "documents"), path)


@query
def op6_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = mixing.mix(table(spark, sf, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = learn_fold("doc_id", 5) == 0
    index = toxicity.fit(docs, table(spark, sf, "labels"), ~held_out)
    return toxicity.predict(docs, index).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted", "neighbours", "terms"
    )


@query
def op9_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf, "documents"), shingle_words=2)


@query
def op10_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(table(spark, sf, "pages"))


@query
def op4_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = learn_fold("doc_id", 7) == 2
    found = lm.score(docs, ~held_out)
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
        "bits_per_byte",
    )


@query
def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    return conversations.report(rows, conversations.damaged(rows))


@query
def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


@query
def op13_repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf, "documents"))
