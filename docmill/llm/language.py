"""Language identification: sparse multinomial logistic regression on character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.shared import per_text, slices

UNKNOWN = "und"
#: N-grams of one to three characters are hashed to so many features.
FEATURES = 1 << 16
#: At most so many languages are told apart, and the classifier is fitted on so many documents.
MOST_LANGUAGES = 200
SAMPLE_ROWS = 8000
SAMPLE_PER_LANGUAGE = 1000
#: Besides its whole text each sampled document gives a snippet of so many characters.
SNIPPET = 40
#: Follow the regularised leader: learning rate, its offset, and the elastic net. The lasso is
#: the strongest of several whose held-back loss is at most so much above the least.
RATE, OFFSET, RIDGE = 0.5, 1.0, 1e-4
LASSOS = (1.0, 0.3, 0.03)
WORSE_BY, WORSE_PLUS = 1.02, 1e-4
EPOCHS = 3
FIELDS = T.StructType(
    [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
)


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


def letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def features(text: str | None, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams of the lower-cased text and their counts; None if it has no letter.

    Whatever is not a letter counts as a blank, and runs of blanks as one."""
    if not text:
        return None
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    low = chars < len(letters)
    known = letters[np.where(low, chars, 0)]
    if not low.all():
        known = known | ~low & np.array([chr(c).isalpha() for c in chars])
    if not known.any():
        return None
    chars = np.where(known, chars, 32).astype(np.uint64)
    chars = np.concatenate([[32], chars, [32]]).astype(np.uint64)
    chars = chars[np.concatenate([[True], (chars[1:] != 32) | (chars[:-1] != 32)])]
    grams, hashed = chars, []
    for n in range(3):
        if n:
            grams = grams[:-1] * np.uint64(0x9E3779B97F4A7C15) + chars[n:]
        mixed = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        hashed.append((mixed >> np.uint64(48)).astype(np.int64))
    counts = np.bincount(np.concatenate(hashed), minlength=FEATURES)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weighted(found: tuple, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of length 1."""
    at, counts = found
    x = (1 + np.log(counts)) * idf[at]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


def document_frequencies(df: DataFrame, text: str) -> np.ndarray:
    """In how many texts each feature occurs, over all rows; the last entry counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total = letter_table(), np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for t in part.column("text").to_pylist():
                    found = features(t, letters)
                    if found:
                        total[found[0]] += 1
                        total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    found = df.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "at long, n long")
    rows = found.groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most FEATURES + 1
    out = np.zeros(FEATURES + 1, np.int64)
    out[rows["at"].to_numpy(int)] = rows["n"].to_numpy(int)
    return out


def sample_features(df: DataFrame, text: str, lang: str, n: int, seed: int) -> pd.DataFrame:
    """Features of ``n`` documents of each language, chosen by a hash of the text, and of a
    snippet of each."""
    rows = df.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    rows = rows.where(F.col("text").isNotNull())
    # The hash is ranked without the text; the window limit works before the shuffle.
    rolls = rows.select("lang", F.xxhash64(F.lit(seed), "text").alias("roll")).distinct()
    last = Window.partitionBy("lang").orderBy("roll")
    cut = (
        rolls.withColumn("place", F.row_number().over(last))
        .where(F.col("place") <= n)
        .groupBy("lang")
        .agg(F.max("roll").alias("cut"))
    )
    rows = rows.withColumn("roll", F.xxhash64(F.lit(seed), "text"))
    rows = rows.join(F.broadcast(cut), "lang").where(F.col("roll") <= F.col("cut"))
    rows = rows.dropDuplicates(["lang", "roll"])
    schema = "lang string, roll long, part int, at array<int>, n array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for lang, roll, t in zip(*(part.column(c).to_pylist() for c in ("lang", "roll", "text"))):
                    start = abs(roll) % max(1, len(t) - SNIPPET)
                    for k, piece in enumerate((t, t[start : start + SNIPPET])):
                        found = features(piece, letters)
                        if found:
                            out.append((lang, roll, k, found[0].astype(np.int32), found[1].astype(np.int32)))
                cols = list(zip(*out)) if out else [[]] * 5
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                arrays = [pa.array(list(c), kind) for c, kind in zip(cols, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "roll", "part", "at", "n"])

    return rows.select("lang", "roll", "text").mapInArrow(run, schema).toPandas()


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow_the_leader(
    rows: list[tuple], labels: np.ndarray, classes: int, seed: int, lasso: float
) -> np.ndarray:
    """Weights by per-coordinate FTRL: sums of gradients and their squares; a weight is zero
    until its sum exceeds the lasso penalty."""
    sums, squares = np.zeros((FEATURES, classes)), np.zeros((FEATURES, classes))

    def weights(at):
        z, n = sums[at], squares[at]
        w = -(z - np.sign(z) * lasso) / ((OFFSET + np.sqrt(n)) / RATE + RIDGE)
        return np.where(np.abs(z) > lasso, w, 0)

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            p = softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p[None, :]
            n = squares[at]
            squares[at] = n + g * g
            sums[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / RATE * w
    return weights(np.arange(FEATURES))


def likelihood_loss(logits: np.ndarray, labels: np.ndarray) -> float:
    p = softmax(logits)[np.arange(len(labels)), labels]
    return float(-np.log(np.maximum(p, 1e-12)).mean())


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature at which held-back rows are likeliest."""
    if not len(labels):
        return 1.0
    best = (np.inf, 1.0)
    for t in np.exp(np.linspace(np.log(0.02), np.log(20), 200)):
        best = min(best, (likelihood_loss(logits / t, labels), t))
    return float(best[1])


def fit(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    seed: int = 7,
) -> Model:
    """A model from the rows with a language: frequencies over all their texts, weights from at
    most ``sample_rows`` documents. A fifth of those is not used for weights: one half of it
    chooses the lasso, the other the temperature."""
    df = df.where(F.col(f"`{lang}`").isNotNull())
    names = df.select(F.col(f"`{lang}`").alias("lang")).distinct().limit(MOST_LANGUAGES + 1)
    languages = sorted(r["lang"] for r in names.collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not languages:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES, 0)), 1.0)
    counted = document_frequencies(df, text)
    idf = np.log((1 + counted[-1]) / (1 + counted[:-1])) + 1
    each = min(SAMPLE_PER_LANGUAGE, max(1, sample_rows // len(languages)))
    sample = sample_features(df, text, lang, each, seed).sort_values(["lang", "roll", "part"])
    rows = [(at, weighted((at, n), idf)) for at, n in zip(sample["at"], sample["n"])]
    labels = np.array([languages.index(x) for x in sample["lang"]], int)
    fold = sample["roll"].to_numpy(np.int64) % 10 if len(sample) else np.zeros(0, int)
    if np.isin(fold, (0, 5)).all():
        fold[:] = 1
    learn, choose, rest = (np.flatnonzero(np.isin(fold, x)) for x in ((1, 2, 3, 4, 6, 7, 8, 9), 0, 5))

    def logits(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.array([rows[i][1] @ weights[rows[i][0]] for i in at])

    tried = []
    for lasso in LASSOS if len(choose) else LASSOS[-1:]:
        own = [rows[i] for i in learn]
        weights = follow_the_leader(own, labels[learn], len(languages), seed, lasso)
        guess = logits(weights, choose)
        loss = 0.0
        if len(choose):
            loss = likelihood_loss(guess / fit_temperature(guess, labels[choose]), labels[choose])
        tried.append((loss, weights))
    limit = min(loss for loss, _ in tried) * WORSE_BY + WORSE_PLUS
    weights = next(weights for loss, weights in tried if loss <= limit)
    return Model(languages, idf, weights, fit_temperature(logits(weights, rest), labels[rest]))


def predict(
    df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keep`` with ``lang_pred`` and ``score``, the calibrated probability of that language.

    The whole text is read. Null texts and texts without a letter are ``und`` with score 0, and
    so is every text if the model has learned no language. Equal probabilities go to the first
    language by name. Repeated rows stay; an empty table gives an empty result; columns other
    than ``keep`` are not read."""
    # FEATURES x languages, bounded; a plain tuple, as workers may not have this module.
    shared = df.sparkSession.sparkContext.broadcast(tuple(model))

    def start():
        letters = letter_table()
        languages, idf, weights, temperature = shared.value

        def work(texts: list) -> dict:
            names, scores = [], []
            for t in texts:
                found = features(t, letters) if languages else None
                if found is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = softmax(weighted(found, idf) @ weights[found[0]] / temperature)
                names.append(languages[int(p.argmax())])
                scores.append(float(p.max()))
            return {"lang_pred": names, "score": scores}

        return work

    return per_text(df, text, list(keep), FIELDS, start)


def identify(
    df: DataFrame,
    learn: Column,
    text: str = "text",
    lang: str = "lang",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Languages of all rows by a model of the rows that ``learn`` holds for."""
    return predict(df, fit(df.where(learn), text, lang), text, keep)
