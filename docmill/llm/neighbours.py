"""Approximate nearest neighbours: balanced posting lists behind a graph of centroids."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.shared import settled

#: Vectors per posting list, at most so many lists, and the numbers that the sample for their
#: centroids may hold. Lists beyond ``MOST_LISTS`` grow longer and are scanned in chunks.
LIST_VECTORS = 256
MOST_LISTS = 16_384
SAMPLE_NUMBERS = 4_000_000
#: A vector is copied to at most so many lists whose centroids are nearly as near as its first.
COPIES = 6
COPY_RATIO = 1.10
#: A query scans lists whose centroid is at most so many times as far as the nearest. How many
#: times is measured: so many queries are answered by brute force over all rows, and this share
#: of their nearest rows has to lie in the lists. At least ``LEAST_LISTS`` are scanned.
PROBES = 256
FOUND = 0.975
LEAST_LISTS = 8
#: Centroids that a search holds at least; neighbours of a centroid in the graph.
BEAM = 64
DEGREE = 24
#: Row pairs scored in double precision at once.
PAIRS = 1 << 16
#: Rows of one list, and queries, that meet in one task.
CHUNK = 4096
NEAREST = 5


class Graph(NamedTuple):
    """Centroids with their neighbours, and those at which a search starts."""

    centroids: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray


def halves(x: np.ndarray, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Two-means with equal sizes: rows are cut at the median of how much nearer the one
    centre is than the other."""
    axis = x[rng.integers(len(x))] - x[rng.integers(len(x))]
    if not axis.any():
        axis = rng.standard_normal(x.shape[1])
    order = np.argsort(x @ axis, kind="stable")
    for _ in range(rounds):
        side = order[: len(x) // 2]
        centre = x[side].mean(0)
        other = x[order[len(x) // 2 :]].mean(0)
        fresh = np.argsort(x @ (other - centre), kind="stable")
        if np.array_equal(fresh, order):
            break
        order = fresh
    return order


def balanced_centroids(x: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Means of a sample halved again and again, so that all lists have equally many rows."""
    rng = np.random.default_rng(seed)
    parts, done = [(x, lists)], []
    while parts:
        rows, n = parts.pop()
        if n <= 1 or len(rows) < 2:
            done.append(rows.mean(0))
            continue
        order = halves(rows, rng)
        left = n // 2
        at = len(rows) * left // n
        parts += [(rows[order[:at]], left), (rows[order[at:]], n - left)]
    return np.array(done, np.float32)


def make_graph(centroids: np.ndarray, seed: int) -> Graph:
    """Every centroid linked to near ones of different directions, and to a few far ones."""
    n = len(centroids)
    rng = np.random.default_rng(seed)
    squares = (centroids**2).sum(1)
    links = np.zeros((n, DEGREE), np.int32)
    for at in range(0, n, 512):
        rows = centroids[at : at + 512]
        far = squares[None, :] - 2 * rows @ centroids.T
        width = min(n, 4 * DEGREE)
        near = np.argpartition(far, width - 1, axis=1)[:, :width]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1), 1)
        for i, candidates in enumerate(near):
            own, chosen = at + i, []
            candidates = candidates[candidates != own]
            apart = ((centroids[candidates] - centroids[own]) ** 2).sum(1)
            for c, d in zip(candidates, apart):
                if len(chosen) >= DEGREE - 4:
                    break
                if not chosen or (((centroids[chosen] - centroids[c]) ** 2).sum(1) > d).all():
                    chosen.append(c)
            for c in candidates:
                if len(chosen) >= DEGREE - 4:
                    break
                if c not in chosen:
                    chosen.append(c)
            more = rng.integers(n, size=DEGREE - len(chosen))
            links[own] = np.concatenate([np.array(chosen, np.int64), more])
    entries = rng.permutation(n)[: max(BEAM, int(math.sqrt(n)))].astype(np.int32)
    return Graph(centroids, links, entries)


def search(graph: Graph, x: np.ndarray, beam: int = BEAM, hops: int = 12) -> tuple:
    """The centroids nearest to each row: ids and distances, nearest first.

    All rows walk the graph together; in each hop a row looks at the neighbours of the
    nearest centroids that it has not looked at yet. A search for more than an eighth of the
    centroids compares with all of them, which is then the shorter way."""
    squares = (graph.centroids**2).sum(1)
    own = (x**2).sum(1)
    beam = min(beam, len(graph.centroids))
    if beam * 8 > len(graph.centroids):
        far = squares[None, :] - 2 * x @ graph.centroids.T
        ids = np.argsort(far, axis=1, kind="stable")[:, :beam]
        return ids, np.sqrt(np.maximum(np.take_along_axis(far, ids, 1) + own[:, None], 0))
    hops = max(hops, math.ceil(beam / 6))
    ids = np.broadcast_to(graph.entries, (len(x), len(graph.entries)))
    far = squares[graph.entries][None, :] - 2 * x @ graph.centroids[graph.entries].T
    seen = np.zeros(ids.shape, bool)

    def best(ids, far, seen):
        # The same centroid may come several times; the one already looked at stays.
        order = np.lexsort((~seen, ids), axis=1)
        ids, far, seen = (np.take_along_axis(a, order, 1) for a in (ids, far, seen))
        again = np.zeros(ids.shape, bool)
        again[:, 1:] = ids[:, 1:] == ids[:, :-1]
        far = np.where(again, np.inf, far)
        order = np.argsort(far, axis=1, kind="stable")[:, :beam]
        return tuple(np.take_along_axis(a, order, 1) for a in (ids, far, seen))

    ids, far, seen = best(ids, far, seen)
    for _ in range(hops):
        waiting = np.where(seen | np.isinf(far), np.inf, far)
        if np.isinf(waiting).all():
            break
        take = np.argsort(waiting, axis=1, kind="stable")[:, : min(8, ids.shape[1])]
        np.put_along_axis(seen, take, True, 1)
        fresh = graph.neighbours[np.take_along_axis(ids, take, 1)].reshape(len(x), -1)
        away = squares[fresh] - 2 * np.einsum("nd,nkd->nk", x, graph.centroids[fresh])
        ids, far, seen = best(
            np.concatenate([ids, fresh], 1),
            np.concatenate([far, away], 1),
            np.concatenate([seen, np.zeros(fresh.shape, bool)], 1),
        )
    return ids, np.sqrt(np.maximum(far + own[:, None], 0))


def lists_of(graph: Graph, x: np.ndarray) -> np.ndarray:
    """Lists of each row (-1 where there are fewer): the nearest centroid's, and those of
    centroids nearly as near unless one already chosen is nearer to that centroid."""
    ids, far = search(graph, x, beam=16, hops=6)
    chosen = np.full((len(x), COPIES), -1, np.int64)
    chosen[:, 0] = ids[:, 0]
    count = np.ones(len(x), int)
    for j in range(1, ids.shape[1]):
        near = (far[:, j] <= COPY_RATIO * far[:, 0] + 1e-6) & (count < COPIES)
        for k in range(COPIES):
            held = chosen[:, k] >= 0
            apart = graph.centroids[chosen[:, k]] - graph.centroids[ids[:, j]]
            near &= ~held | (np.sqrt((apart**2).sum(1)) > far[:, j] * 0.5)
        at = np.flatnonzero(near)
        chosen[at, count[at]] = ids[at, j]
        count[at] += 1
    return chosen


def unit(vectors: pd.Series) -> np.ndarray:
    """Rows of length 1; a power of two first, so that no square over- or underflows."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x = x / np.exp2(np.floor(np.log2(np.abs(x).max(1, keepdims=True))))
    return (x / np.sqrt((x**2).sum(1, keepdims=True))).astype(np.float32)


def usable(vector: Column) -> Column:
    """Vectors that take part: not null or empty, all numbers finite, not all zero."""
    sound = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (F.size(vector) > 0) & F.coalesce(sound, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosine of row pairs in double precision, summed in a fixed order."""
    q, v = queries.astype(np.float64), vectors.astype(np.float64)
    return (q * v).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1)))


def nearest(
    df: DataFrame,
    queries: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = NEAREST,
    seed: int = 7,
    found_share: float = FOUND,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``queries`` holds for, the ``k``
    nearest other rows by cosine that its lists hold, ties to the smaller key.

    Centroids come from a bounded sample, halved into equal parts; all vectors are indexed.
    Vectors near a boundary are copied to several lists. A query finds its centroids on the
    graph and scans the lists up to a ratio of distances, which is measured: ``PROBES`` of the
    queries meet all rows, and the ratio and the number of lists are such that ``found_share``
    of their nearest rows lie in the lists scanned. Every row of those lists that can be among
    the nearest is scored in double precision. Rows that repeat a vector are one
    entry with their ``k`` + 1 smallest keys, which is all that a result can show. Long lists
    are scanned in chunks, and so are many queries of one list.

    Rows with a null key, and null, empty, zero or non-finite vectors take no part; vectors of
    another size than most are compared with their like only. With fewer than ``k`` candidates
    there are fewer rows. An empty table gives an empty result. Rows that repeat key and vector
    count once. Other columns are not read.
    """
    spark = df.sparkSession
    asked = F.coalesce(queries, F.lit(False))
    held = df.schema[vector].dataType
    single = isinstance(getattr(held, "elementType", None), T.FloatType)
    kind = "array<float>" if single else "array<double>"
    rows = df.select(
        F.col(f"`{key}`").cast("long").alias("vec_id"),
        F.col(f"`{vector}`").cast(kind).alias("vector"),
        asked.alias("asked"),
    )
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).distinct()
    rows = settled(rows)
    first = Window.partitionBy("vector").orderBy("vec_id")
    # The limit works before the shuffle, so a vector with very many rows sends only a few.
    entries = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    entries = settled(
        entries.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )
    sizes = [r["size"] for r in entries.groupBy(F.size("vector").alias("size")).count().collect()]
    found = None
    for size in sorted(sizes):
        own = F.size("vector") == size
        part = _nearest(spark, entries.where(own), rows.where(own & F.col("asked")), size, k, seed, found_share)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def probe_truth(entries: DataFrame, probes: np.ndarray, k: int) -> list:
    """(probe, vector) of the ``k`` rows nearest to each probe among all, the probe's own vector
    left out. Each task keeps the best of what it read, so it sends probes times ``k`` rows."""

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sims = np.full((len(probes), k), -np.inf, np.float32)
        kept = np.zeros((len(probes), k, probes.shape[1]), np.float32)
        for frame in frames:
            for at in range(0, len(frame), 4096):
                x = unit(frame["vector"].iloc[at : at + 4096])
                got = probes @ x.T
                got[got > 1 - 1e-6] = -np.inf
                place = np.argpartition(-got, min(k, len(x)) - 1, axis=1)[:, :k]
                sims = np.concatenate([sims, np.take_along_axis(got, place, 1)], 1)
                kept = np.concatenate([kept, x[place]], 1)
                place = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                sims = np.take_along_axis(sims, place, 1)
                kept = np.take_along_axis(kept, place[:, :, None], 1)
        probe, place = np.nonzero(np.isfinite(sims))
        yield pd.DataFrame({"probe": probe, "sim": sims[probe, place], "vector": list(kept[probe, place])})

    near = entries.select("vector").mapInPandas(best, "probe long, sim float, vector array<float>")
    order = Window.partitionBy("probe").orderBy(F.desc("sim"), "vector")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return near.select("probe", "vector").collect()  # at most PROBES * k rows


def reach(graph: Graph, probes: np.ndarray, truth: list, found_share: float) -> tuple[float, int]:
    """The ratio of distances up to which lists are scanned, and the most lists that lie within
    it, so that ``found_share`` of the true nearest rows are in lists scanned."""
    far = (graph.centroids**2).sum(1)[None, :] - 2 * probes @ graph.centroids.T
    far = np.sqrt(np.maximum(far + (probes**2).sum(1)[:, None], 0))
    ratio = far / np.maximum(far.min(1, keepdims=True), 1e-6)
    if not truth:
        return 1.0, LEAST_LISTS
    probe = np.array([r["probe"] for r in truth])
    own = lists_of(graph, np.array([r["vector"] for r in truth], np.float32))
    need = np.where(own >= 0, ratio[probe[:, None], own], np.inf).min(1)
    limit = float(np.quantile(need, found_share, method="higher"))
    lists = int((ratio <= limit * (1 + 1e-5)).sum(1).max())
    return limit * (1 + 1e-5), max(LEAST_LISTS, lists)


def _nearest(spark, entries, queries, size, k, seed, found_share) -> DataFrame:
    total = entries.count()
    most = max(1, SAMPLE_NUMBERS // size)
    roll = F.xxhash64(F.lit(seed), "vector")
    # Few more rows than the sample needs leave their tasks.
    some = F.pmod(roll, F.lit(1 << 40)) <= int(min(1.0, (1.2 * most + 1000) / max(1, total)) * (1 << 40))
    sample = entries.select("vector").where(some).orderBy(roll).limit(most)
    x = unit(sample.toPandas()["vector"])
    lists = max(1, min(MOST_LISTS, len(x), round(total / LIST_VECTORS)))
    graph = make_graph(balanced_centroids(x, lists, seed), seed)
    scan_ratio, beam = 1.0, LEAST_LISTS
    if lists > LEAST_LISTS:
        asked = queries.select("vector").orderBy(F.xxhash64(F.lit(seed + 1), "vec_id")).limit(PROBES)
        asked = asked.toPandas()["vector"]
        if len(asked):
            probes = unit(asked)
            scan_ratio, beam = reach(graph, probes, probe_truth(entries, probes, k), found_share)
    # At most MOST_LISTS rows; a plain tuple, as workers may not have this module.
    shared = spark.sparkContext.broadcast(tuple(graph))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Graph(*shared.value)
        for frame in frames:
            for at in range(0, len(frame), 1024):
                part = frame.iloc[at : at + 1024]
                own = lists_of(index, unit(part["vector"]))
                row, place = np.nonzero(own >= 0)
                yield part.iloc[row].assign(list=own[row, place])

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Graph(*shared.value)
        for frame in frames:
            for at in range(0, len(frame), 128):
                part = frame.iloc[at : at + 128]
                ids, far = search(index, unit(part["vector"]), max(beam, BEAM))
                near = far <= scan_ratio * far[:, :1] + 1e-6
                near[:, :LEAST_LISTS] = True
                row, place = np.nonzero(near & np.isfinite(far))
                yield part.iloc[row].assign(list=ids[row, place].astype(np.int64))

    kind = entries.schema["vector"].dataType.simpleString()
    posted = settled(entries.mapInPandas(assign, f"vector {kind}, ids array<long>, list long"))
    asked = queries.select(F.col("vec_id").alias("query_id"), "vector")
    asked = settled(asked.mapInPandas(scan, f"query_id long, vector {kind}, list long"))
    chunks = posted.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).alias("blocks"))
    cut = settled(chunks.join(blocks, "list"))  # at most MOST_LISTS rows

    def spread(rows: DataFrame, own: str, other: str) -> DataFrame:
        parts = cut.select(
            F.col("list").alias("of"), F.col(f"{own}s").alias("own"), F.col(f"{other}s").alias("other")
        )
        salt = F.xxhash64(*[c for c in rows.columns if c in ("ids", "query_id")])
        rows = rows.join(parts, rows["list"] == parts["of"]).withColumn(own, F.pmod(salt, "own"))
        rows = rows.withColumn(other, F.explode(F.expr("sequence(0L, other - 1)")))
        return rows.drop("of", "own", "other")

    keys = ["list", "chunk", "block"]

    def meet(asked: pd.DataFrame, posted: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if not len(asked) or not len(posted):
            return empty.astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        raw_q, raw_v = np.stack(asked["vector"].to_numpy()), np.stack(posted["vector"].to_numpy())
        unit_q, unit_v = unit(asked["vector"]), unit(posted["vector"])
        held = posted["ids"].to_numpy()
        width = min(len(raw_v), k + 1)  # the query's own vector may be one of them
        # Twice what single precision can be off by, for two products of vectors of length 1.
        slack = np.float32(4 * (size + 8) * 2.0**-24)
        out = []
        for at in range(0, len(raw_q), 128):
            near = unit_q[at : at + 128] @ unit_v.T
            least = np.partition(near, -width, axis=1)[:, -width, None]
            q, v = np.nonzero(near >= least - slack)
            q += at
            exact = [scores(raw_q[q[i : i + PAIRS]], raw_v[v[i : i + PAIRS]]) for i in range(0, len(q), PAIRS)]
            times = np.array([len(held[i]) for i in v])
            part = pd.DataFrame(
                {
                    "query_id": np.repeat(asked["query_id"].to_numpy()[q], times),
                    "vec_id": np.concatenate([held[i] for i in v]).astype(np.int64),
                    "score": np.repeat(np.concatenate(exact), times),
                }
            )
            part = part[part["vec_id"] != part["query_id"]]
            part = part.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            out.append(part.groupby("query_id").head(k))
        return pd.concat(out)

    met = (
        spread(asked, "block", "chunk")
        .groupBy(*keys)
        .cogroup(spread(posted, "chunk", "block").groupBy(*keys))
    )
    return met.applyInPandas(lambda a, b: meet(a, b), "query_id long, vec_id long, score double")
