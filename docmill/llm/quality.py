"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates.

Everything here is DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.columns import settle
from docmill.llm.shared import settled

SYMBOLS = "[#*$%&|<>]"
#: The transformed statistics, each with the deviation below which it is never told from
#: noise. It is added to the estimated spread, so that a statistic which is the same in all
#: clean documents of a group cannot make an outlier of a trace.
FLOORS = {"length_": 0.1, "symbols_": 0.5, "lines_": 0.15, "repeats_": 0.1}
NAMES = tuple(FLOORS)
#: Share of rows that each estimate rests on, and steps that concentrate it.
HALF = 0.5
STEPS = 4
#: Groups with fewer rows use the estimate of their language, or else of all rows.
LEAST_ROWS = 30
#: A clean row of a normal group is rejected with this probability.
REJECTED = 2e-4


def chi2_tail(x: float, p: int) -> float:
    """Probability that a chi-squared variable with an even ``p`` exceeds ``x``."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def chi2_cut(tail: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_tail(middle, p) > tail else (low, middle)
    return high


def base_columns(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Counts of words, symbols, repeated lines and repeated windows of three words.

    Windows are compared by 64-bit hashes. Texts without a repeated hash skip the search for
    the places of repeats."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(F.translate(body, "\t\n\x0b\f\r", "     "), " "), "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    first = {
        "words": words,
        "lines": lines,
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
    }
    df = settle(df, keep, first)
    n = F.size("words")
    zipped = F.arrays_zip(
        F.col("words"), F.slice("words", F.lit(2), n).alias("b"), F.slice("words", F.lit(3), n).alias("c")
    )
    second = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "hashes": F.transform(
            F.slice(zipped, F.lit(1), F.greatest(n - 2, F.lit(0))),
            lambda x: F.xxhash64(x["words"], x["b"], x["c"]),
        ),
    }
    df = settle(df, [*keep, "n_symbols"], second)
    placed = F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = settle(
        df,
        [*keep, "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"],
        {
            "ordered": F.when(
                F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(placed)
            )
        },
    )
    pairs = F.arrays_zip(F.col("ordered"), F.slice("ordered", F.lit(2), F.size("ordered")).alias("b"))
    equal = F.filter(pairs, lambda x: x["ordered"]["h"] == x["b"]["h"])
    covered = F.flatten(
        F.transform(
            equal,
            lambda x: F.array(*[x[s]["i"] + k for s in ("ordered", "b") for k in range(3)]),
        )
    )
    df = settle(
        df,
        [*keep, "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"],
        {
            "n_repeat_words": F.coalesce(
                F.when(F.col("ordered").isNotNull(), F.size(F.array_distinct(covered))), F.lit(0)
            ).cast("long")
        },
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def with_vector(df: DataFrame) -> DataFrame:
    """The transformed statistics, none of which grows with the length of the text."""
    words = F.greatest("n_words", F.lit(1))
    chars = F.greatest("word_chars", F.lit(1))
    return df.withColumns(
        {
            "length_": F.log(chars / words),
            "symbols_": F.asinh(100 * F.col("n_symbols") / chars),
            "lines_": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
            "repeats_": F.col("n_repeat_words") / words,
        }
    )


def quantile(rows: DataFrame, binned: Column, fraction: float, name: str) -> DataFrame:
    """Per group the first bin up to which ``fraction`` of the rows lie: counts, so the result
    does not depend on the order of rows, and a large group is counted before it is shuffled."""
    counts = rows.groupBy("group", binned.alias("bin")).agg(F.count("*").alias("n"))
    group = Window.partitionBy("group")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.select(
        "group", "bin", F.sum("n").over(upto).alias("upto"), F.sum("n").over(group).alias("all")
    )
    reached = placed.where(F.col("upto") >= fraction * F.col("all"))
    return reached.groupBy("group").agg(F.min("bin").alias(name))


def with_inverse(groups: DataFrame) -> DataFrame:
    """From means and covariances per group to the inverse of the Cholesky factor. Columns are
    added one by one, so that no expression is repeated inside another."""
    p = len(NAMES)
    for i in range(p):
        for j in range(i + 1):
            value = F.col(f"c{i}{j}")
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"l{j}{j}")
            groups = groups.withColumn(f"l{i}{j}", value)
    for i in range(p):
        for j in range(i + 1):
            if i == j:
                value = 1 / F.col(f"l{i}{i}")
            else:
                total = F.col(f"l{i}{j}") * F.col(f"v{j}{j}")
                for k in range(j + 1, i):
                    total = total + F.col(f"l{i}{k}") * F.col(f"v{k}{j}")
                value = -total / F.col(f"l{i}{i}")
            groups = groups.withColumn(f"v{i}{j}", value)
    means = [f"m{i}" for i in range(p)]
    factors = [f"v{i}{j}" for i in range(p) for j in range(i + 1)]
    return settled(groups.select("group", "n", *means, *factors))


def distance() -> Column:
    """Squared Mahalanobis distance of a row from its group."""
    p = len(NAMES)
    total = F.lit(0.0)
    for i in range(p):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col(f"v{i}{j}") * (F.col(NAMES[j]) - F.col(f"m{j}"))
        total = total + part * part
    return total


def moments(rows: DataFrame, factor: float) -> DataFrame:
    """Means and covariances per group; covariances times ``factor``, with the floors added."""
    p = len(NAMES)
    sums = [F.avg(x).alias(f"m{i}") for i, x in enumerate(NAMES)]
    sums += [
        F.covar_pop(NAMES[i], NAMES[j]).alias(f"s{i}{j}") for i in range(p) for j in range(i + 1)
    ]
    found = rows.groupBy("group").agg(F.count("*").alias("n"), *sums)
    cov = {
        f"c{i}{j}": F.col(f"s{i}{j}") * factor + (FLOORS[NAMES[i]] ** 2 if i == j else 0)
        for i in range(p)
        for j in range(i + 1)
    }
    return found.withColumns(cov)


def estimate(rows: DataFrame) -> DataFrame:
    """Location and scatter per group from the half of its rows that lies closest together.

    The start is the median and the median deviation of each statistic. Each step then takes
    the half of the rows with the smallest distances and estimates from them anew, which never
    raises the determinant; the last step uses all rows that a normal group would hold."""
    p = len(NAMES)
    middle = None
    for i, x in enumerate(NAMES):
        found = quantile(rows, F.floor(F.col(x) * 1000), 0.5, f"bin{i}")
        middle = found if middle is None else middle.join(found, "group")
    middle = settled(middle.select("group", *[((F.col(f"bin{i}") + 0.5) / 1000).alias(f"m{i}") for i in range(p)]))
    spread = middle
    around = rows.join(middle, "group")
    for i, x in enumerate(NAMES):
        away = F.floor(F.abs(F.col(x) - F.col(f"m{i}")) * 1000)
        spread = spread.join(quantile(around, away, 0.5, f"bin{i}"), "group")
    start = spread.withColumn("n", F.lit(0).cast("long"))
    for i, x in enumerate(NAMES):
        for j in range(i):
            start = start.withColumn(f"c{i}{j}", F.lit(0.0))
        wide = 1.4826 * (F.col(f"bin{i}") + 0.5) / 1000
        start = start.withColumn(f"c{i}{i}", wide * wide + FLOORS[x] ** 2)
    groups = with_inverse(start)
    inner = chi2_cut(1 - HALF, p)
    factor = HALF / (1 - chi2_tail(inner, p + 2))
    for _ in range(STEPS):
        measured = rows.join(groups, "group").select("group", *NAMES, distance().alias("d"))
        scale = F.floor(F.log(F.col("d") + 1e-6) * 64)
        cut = settled(quantile(measured, scale, HALF, "bin"))  # one row per group
        near = measured.join(cut, "group").where(scale <= F.col("bin"))
        groups = with_inverse(moments(near, factor))
    wide = chi2_cut(0.025, p)
    measured = rows.join(groups, "group").select("group", *NAMES, distance().alias("d"))
    near = measured.where(F.col("d") <= wide)
    return with_inverse(moments(near, 0.975 / (1 - chi2_tail(wide, p + 2))))


def label(level: int, *values: Column) -> Column:
    parts = [v.cast("string").alias(f"v{i}") for i, v in enumerate(values)]
    return F.to_json(F.struct(F.lit(level).alias("level"), *parts))


def judge(
    df: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least_rows: int = LEAST_ROWS,
    rejected: float = REJECTED,
) -> DataFrame:
    """Base counts, robust distance and verdict for every row.

    ``keep`` is returned with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, distance and kept. Estimates are made per language and source from the rows
    that pass the base rules; a group with fewer than ``least_rows`` such rows uses its
    language's estimate, or else that of all rows. A null language or source is a value of its
    own. Null and empty texts have no words and fail. Repeated rows stay and count as often as
    they occur. A group whose rows are all alike rejects only what lies beyond the floors. An
    empty table gives an empty result. Columns not named are not read.
    """
    names = [f"keep_{i}" for i in range(len(keep))]
    chosen = df.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)],
        F.col(f"`{text}`").alias("body_"),
        F.col(f"`{lang}`").cast("string").alias("lang_"),
        F.col(f"`{source}`").cast("string").alias("source_"),
    )
    rows = with_vector(base_columns(chosen, [*names, "lang_", "source_"], "body_"))
    own, wider = label(0, F.col("lang_"), F.col("source_")), label(1, F.col("lang_"))
    rows = settled(rows.withColumn("own", own))
    passed = rows.where(~F.col("base_failed"))
    levels = F.explode(F.array("own", wider, label(2))).alias("group")
    estimates = estimate(passed.select(levels, *NAMES))
    sizes = passed.groupBy("own", "lang_").agg(F.count("*").alias("n"))
    around = Window.partitionBy("lang_")
    use = (
        F.when(F.col("n") >= least_rows, F.col("own"))
        .when(F.sum("n").over(around) >= least_rows, wider)
        .otherwise(label(2))
    )
    used = sizes.select("own", use.alias("group")).join(estimates.drop("n"), "group")
    out = rows.join(settled(used), "own", "left").withColumn("distance", distance())
    limit = chi2_cut(rejected, len(NAMES))
    kept = ~F.col("base_failed") & (F.col("distance") <= limit)
    return out.select(
        *[F.col(n).alias(c) for c, n in zip(keep, names)],
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.coalesce(kept, F.lit(False)).alias("kept"),
        "distance",
    )
