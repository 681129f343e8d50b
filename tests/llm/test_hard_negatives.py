"""Hard negatives against all inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm import hard_negatives as H


def plain(rows, k=5, n=3, low=50, high=95):
    """rows: (id, label, vector); alike rows once, every anchor against every row."""
    good = {
        (i, la, tuple(math.floor(256 * x) for x in v))
        for i, la, v in rows
        if i is not None and la is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for a in good:
        if a[0] % 5:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in good if b != a and len(a[2]) == len(b[2])]
        scored.sort()
        for ps, p, _ in [s for s in scored if s[2] == a[1]][:k]:
            rest = [s for s in scored if s[2] != a[1] and low * -ps <= 100 * -s[0] <= high * -ps]
            out += [(a[0], p, r, s[1], -ps, -s[0]) for r, s in enumerate(rest[:n], 1)]
    return sorted(out)


def clustered(rng, n, dim=6, spread=0.05):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(9)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, rng.choice([1, 1, 2, 3]), [x + rng.gauss(0, spread) for x in c]))
    return rows


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 700)
    monkeypatch.setattr(H, "ANCHORS", 30)


SCHEMA = "vec_id long, label int, embedding array<double>, block int, own long, chunk string"


def mined(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % 5 == 0).collect())


def test_like_all_products(spark, small_blocks):
    rng = random.Random(3)
    rows = clustered(rng, 500)
    rows += [(1000 + i, 1, [0.5] * 6) for i in range(120)]  # copies of one vector
    rows += [(2000 + i, 1 + i % 2, [1.0 + 0.01 * (i % 5)] + [0.0] * 5) for i in range(60)]  # ties
    rows += rows[:20]  # repeated rows
    rows += [(None, 1, [1.0] * 6), (3, None, [1.0] * 6), (5, 1, None), (10, 1, [1.0, None] + [0.0] * 4),
             (15, 2, [math.nan] * 6), (20, 2, [math.inf] * 6), (25, 1, []), (30, 2, []), (35, 1, []), (40, 2, [2.0]), (45, 2, [3.0]),
             (50, 1, [-1.0] * 6), (3000, 2, [0.0] * 6)]
    want = plain(rows)
    assert mined(spark, rows) == want and len(want) > 500


def test_one_row_and_none(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0])]) == []


def test_large_components_stay_exact(spark):
    big = 2.0**40
    rows = [(0, 1, [big, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [0.9, 3.0]), (3, 2, [0.9, 4.0]), (5, 1, [1e300, 0.0])]
    got = {r[:4]: r[4:] for r in mined(spark, rows)}
    assert got[(0, 1, 1, 3)] == (256 * 256 * 2**40 + 256 * 256, 230 * 256 * 2**40 + 1024 * 256)


def test_tree_covers_and_bounds():
    rng = np.random.default_rng(4)
    v = np.concatenate([c + rng.integers(-9, 9, (300, 5)) for c in rng.integers(-2000, 2000, (12, 5))])

    class Fixed(H.Points):
        def __init__(self):
            self.ids = self.own = np.arange(len(v))
            self.kind, self.v, self.near = np.arange(len(v)) % 3, v, v.astype(float)
            self.dim, self.most = 5, 3000

    points = Fixed()
    root = H.cover_tree(points)
    assert len(root.children) > 1
    x, seen = H.augmented(points.near), []

    def below(node):
        own = node.members if node.members is not None else np.concatenate([below(c) for c in node.children])
        assert np.sqrt(((x[own] - x[node.at]) ** 2).sum(1)).max() <= node.radius + 1e-6
        seen.extend(node.members if node.members is not None else [])
        return own

    below(root)
    assert sorted(seen) == list(range(len(v)))
    read = []
    best = H.Best(points, 5, H.LEAST, H.MOST)
    H.descend(points, root, v[0], 0, True, lambda at: (read.extend(at), at == 0)[1], [best])
    assert len(read) < len(v) / 3
    assert list(best.scores) == sorted((int(v[0] @ v[i]) for i in range(3, len(v), 3)), reverse=True)[:5]
