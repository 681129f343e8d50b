import numpy as np
from pyspark.sql import functions as F

from docmill.llm import neighbours


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double")


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 24))
    x = (centres[rng.integers(12, size=3000)] + rng.standard_normal((3000, 24))).astype(np.float32)
    x[100:400] = x[50]  # a vector that a tenth of the rows share
    rows = [(i, v.tolist(), 0, 1.0) for i, v in enumerate(x)]
    got = neighbours.nearest(table(spark, rows), F.col("vec_id") % 50 == 0).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 50):
        sims = unit @ unit[q]
        sims[q] = -9
        best = set(np.argsort(-sims, kind="stable")[:5])
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - sims[r.vec_id]) < 1e-12 for r in own)
        assert own == sorted(own, key=lambda r: (-r.score, r.vec_id))
        hit += len(best & {r.vec_id for r in own})
    assert hit >= 0.95 * 300
    ties = [r.vec_id for r in sorted((r for r in got if r.query_id == 150), key=lambda r: r.rank)]
    assert ties == [50, 100, 101, 102, 103]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 0, 1.0), (1, [1.0, 0.1], 0, 1.0), (2, [0.0, 0.0], 0, 1.0), (3, None, 0, 1.0),
        (4, [1.0, nan], 0, 1.0), (5, [inf, 1.0], 0, 1.0), (6, [1.0, None], 0, 1.0), (7, [], 0, 1.0),
        (None, [1.0, 0.0], 0, 1.0), (8, [1e-30, 1e-30], 0, 1.0), (8, [1e-30, 1e-30], 0, 1.0),
        (50, [1.0, 0.0, 0.0], 0, 1.0),
    ]
    got = neighbours.nearest(table(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got)] == [(0, 1, 1), (0, 2, 8)]
    assert neighbours.nearest(table(spark, []), F.lit(True)).collect() == []


def test_graph_search_finds_the_nearest():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 16)).astype(np.float32)
    centroids = neighbours.balanced_centroids(x, 300, 1)
    assert len(centroids) == 300
    graph = neighbours.make_graph(centroids, 1)
    ids, far = neighbours.search(graph, x[:500])
    exact = ((x[:500, None] - centroids[None]) ** 2).sum(2)
    assert (ids[:, 0] == exact.argmin(1)).mean() > 0.98
    assert np.allclose(far[:, 0] ** 2, exact.min(1), atol=1e-3) or (ids[:, 0] != exact.argmin(1)).any()


def test_equal_cosines_go_to_the_smaller_ids(spark):
    base = np.random.default_rng(3).standard_normal(8).astype(np.float32)
    rows = [(0, base.tolist(), 0, 1.0)]
    rows += [(i, (base * np.float32(2.0 ** (i * 7 % 31 - 15))).tolist(), 0, 1.0) for i in range(1, 90)]
    got = neighbours.nearest(table(spark, rows), F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [1, 2, 3, 4, 5]


def test_doubles_keep_their_digits(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1e-9]), (2, [1.0, 2e-5]), (3, [1.0, 1e-5]), (4, [1.0, 3e-5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [1, 3, 2, 4]


def test_recall_without_clusters_beyond_the_beam(spark, monkeypatch):
    # Directions without clusters, in many lists, some of them cut into chunks.
    monkeypatch.setattr(neighbours, "LIST_VECTORS", 32)
    monkeypatch.setattr(neighbours, "CHUNK", 100)
    cols = [F.randn(i).cast("float") for i in range(24)]
    df = spark.range(0, 6000, 1, 4).select(F.col("id").alias("vec_id"), F.array(*cols).alias("embedding"))
    x = np.stack(df.orderBy("vec_id").toPandas()["embedding"].to_numpy()).astype(float)
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).toPandas()
    by = got.groupby("query_id")["vec_id"].apply(set)
    unit, hit = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for q in range(0, 6000, 20):
        sims = unit @ unit[q]
        sims[q] = -9
        hit += len(by[q] & set(np.argsort(-sims)[:5].tolist()))
    assert hit >= 0.94 * 1500
