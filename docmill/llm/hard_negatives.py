"""Hard negatives: high inner products with an anchor, inside a window below its positives'.

Candidates are split over blocks of bounded bytes. In each block a cover tree over the vectors,
augmented to equal norms, bounds the inner products of its nodes by their covering radii;
best-first descent leaves nodes outside all windows alone and verifies what is left exactly.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from docmill.llm.shared import settled

#: Components in a block of candidates, anchors that meet a block at once.
BLOCK = 1 << 19
ANCHORS = 2048
#: Points that a leaf may have, centres tried at a time, and the share of a node's points that
#: these must cover for it to be split.
LEAF, TRIED, COVERED = 64, 64, 0.25
#: Whole numbers up to this are exact in double precision.
EXACT = 1 << 53
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Points:
    """Vectors of whole numbers, with ids, labels and numbers that tell rows of one id apart."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.ids = table.column("id").to_numpy()
        self.own = table.column("own").to_numpy()
        self.kind = table.column("kind").to_numpy()
        flat = table.column("v").combine_chunks().flatten().to_numpy()
        self.v = flat.reshape(len(self.ids), -1) if len(self.ids) else flat.reshape(0, 0)
        most = int(max(abs(int(flat.max())), abs(int(flat.min())))) if len(flat) else 0
        self.dim, self.most = self.v.shape[1] if len(self.ids) else 0, most
        self.near = self.v.astype(np.float64)

    def scores(self, at: np.ndarray, q: np.ndarray, q_most: int) -> np.ndarray:
        """Exact inner products; beyond the range of a long, its end."""
        if self.dim * self.most * q_most < EXACT:
            return (self.near[at] @ q.astype(np.float64)).astype(np.int64)
        big = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in self.v[at]]
        return np.array([min(max(x, LEAST), MOST) for x in big], np.int64)


class Node:
    """A centre, the largest distance of a member from it, the members' labels, and children or
    members."""

    __slots__ = ("at", "radius", "least", "most", "members", "children")

    def __init__(self, at: int, radius: float, kinds: np.ndarray):
        self.at, self.radius = at, radius
        self.least, self.most = kinds.min(), kinds.max()
        self.members: np.ndarray | None = None
        self.children: list[Node] = []


def augmented(v: np.ndarray) -> np.ndarray:
    """The vectors with a component that makes all norms equal."""
    norms = (v * v).sum(1)
    rest = np.sqrt(np.maximum((norms.max() if len(v) else 0) - norms, 0))
    return np.concatenate([v, rest[:, None]], 1)


def cover_tree(points: Points) -> Node | None:
    """Levels of half the covering radius each; centres of a level are farther apart than it. A
    node whose points no level groups stays a leaf, whatever its size."""
    if not len(points.ids):
        return None
    x = augmented(points.near)

    def distances(members: np.ndarray, centres: np.ndarray) -> np.ndarray:
        a, b = x[members], x[centres]
        squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
        return np.sqrt(np.maximum(squares, 0))

    def node(at: int, members: np.ndarray, scale: float) -> Node:
        far = np.sqrt(((x[members] - x[at]) ** 2).sum(1))
        made = Node(at, float(far.max()), points.kind[members])
        groups = split(at, members, min(scale, made.radius) / 2) if len(members) > LEAF and made.radius > 0 else None
        if groups is None:
            made.members = members
        else:
            made.children = [node(c, own, scale / 2) for c, own in groups]
        return made

    def split(at: int, members: np.ndarray, radius: float) -> list[tuple[int, np.ndarray]] | None:
        groups: list[tuple[int, np.ndarray]] = []
        rest = members
        while len(rest):
            some = rest[:: -(-len(rest) // TRIED)]
            if not groups:
                some = np.concatenate([[at], some[some != at]])
            apart = distances(some, some)
            centres: list[int] = []
            for i in range(len(some)):
                if all(apart[i, j] > radius for j in centres):
                    centres.append(i)
            chosen = some[centres]
            far = distances(rest, chosen)
            nearest, reach = far.argmin(1), far.min(1) <= radius
            reach |= np.isin(rest, chosen)
            for j, c in enumerate(chosen):
                groups.append((int(c), rest[reach & (nearest == j)]))
            if reach.sum() < COVERED * len(rest) and len(rest) > TRIED:
                return None
            rest = rest[~reach]
        return groups if len(groups) > 1 else None

    return node(0, np.arange(len(points.ids)), math.inf)


def first(points: Points, at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: the higher score, then the smaller id."""
    if len(scores) > k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= limit)
    else:
        keep = np.arange(len(scores))
    order = np.lexsort((points.own[at[keep]], points.ids[at[keep]], ~scores[keep]))
    return keep[order[:k]]


class Best:
    """The best of a window so far."""

    def __init__(self, points: Points, k: int, low: int, high: int):
        self.points, self.k, self.low, self.high = points, k, low, high
        self.at, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def wants(self, lower: float, upper: float) -> bool:
        least = self.scores[-1] if len(self.scores) == self.k else self.low
        return upper >= max(least, self.low) and lower <= self.high

    def add(self, at: np.ndarray, scores: np.ndarray) -> None:
        inside = (scores >= self.low) & (scores <= self.high)
        if len(self.scores) == self.k:
            inside &= scores >= self.scores[-1]
        if inside.any():
            at = np.concatenate([self.at, at[inside]])
            scores = np.concatenate([self.scores, scores[inside]])
            keep = first(self.points, at, scores, self.k)
            self.at, self.scores = at[keep], scores[keep]


def descend(
    points: Points, root: Node, q: np.ndarray, kind: int, same: bool, skip: Callable, windows: list[Best]
) -> None:
    """Fill the windows from the nodes that may hold something for them, most promising first."""
    q_most = int(max(abs(int(q.max())), abs(int(q.min())))) if len(q) else 0
    q_near = q.astype(np.float64)
    reach = math.sqrt(float(q_near @ q_near))
    queue: list[tuple[float, int, Node, float]] = []

    def offer(node: Node) -> None:
        if (same and not node.least <= kind <= node.most) or (not same and node.least == node.most == kind):
            return
        middle = float(points.near[node.at] @ q_near)
        spread = node.radius * reach * (1 + 1e-9) + 1e-9 * abs(middle) + 1
        if any(w.wants(middle - spread, middle + spread) for w in windows):
            heapq.heappush(queue, (-(middle + spread), node.at, id(node), node, middle - spread))

    offer(root)
    while queue:
        upper, _, _, node, lower = heapq.heappop(queue)
        wanting = [w for w in windows if w.wants(lower, -upper)]
        if not wanting:
            continue
        for child in node.children:
            offer(child)
        if node.members is not None:
            at = node.members[(points.kind[node.members] == kind) == same]
            at = at[~skip(at)]
            if len(at):
                scores = points.scores(at, q, q_most)
                for w in wanting:
                    w.add(at, scores)


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole numbers n with low * score <= 100 * n <= high * score."""
    return -(-low * score // 100), high * score // 100


def rows_of(df: DataFrame, row_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """Usable rows as whole numbers; rows alike in id, label and vector once."""
    x = F.col(f"`{vector}`")
    good = df.where(
        F.col(f"`{label}`").isNotNull() & x.isNotNull()
        & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < math.inf))
    )
    rows = good.select(
        F.col(f"`{row_id}`").alias("id"),
        F.xxhash64(F.col(f"`{label}`")).alias("kind"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"),
    )
    rows = rows.where("id is not null").withColumn("own", F.xxhash64("kind", "v"))
    return rows.groupBy("id", "own").agg(F.first("kind").alias("kind"), F.first("v").alias("v"))


def met(points: DataFrame, anchors: DataFrame, work: Callable, schema: str, blocks: int, chunks: int) -> DataFrame:
    """Every anchor with every block of points of its dimension, a bounded number of anchors at
    a time: the given anchors against all rows, in blocks."""
    numbers = F.sequence(F.lit(0), F.lit(chunks - 1))
    left = points.withColumn("chunk", F.explode(numbers))
    right = anchors.withColumn("chunk", F.pmod("own", F.lit(chunks)).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(some: pa.Table, asking: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if some.num_rows and asking.num_rows:
            here = Points(some)
            root = cover_tree(here)
            for who in asking.drop_columns(["chunk", "block", "dim"]).to_batches(256):
                for row in who.to_pylist():
                    found += work(here, root, row)
        columns = list(zip(*found)) if found else [[] for _ in names]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds.types)], names=names)

    kinds = to_arrow_schema(_parse_datatype_string(schema))
    keys = ("dim", "block", "chunk")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def mine(
    df: DataFrame, anchors: Column, row_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """For each anchor its best rows of the same label, and for each of these the best rows of
    other labels whose score is between ``low`` and ``high`` percent of its own.

    Components become floor(scale * x); a score is the inner product of whole numbers, exactly,
    and beyond the range of a long that range's end. Equal scores come by smaller id. Rows with
    a null id, label, vector or component, or one that is not finite, take no part. Rows alike in
    id, label and vector are one; other rows of the same id are rows of their own. Vectors meet
    those of their own length only, empty ones with score 0. A window below a negative score is
    empty. An empty table has no result, and columns that are not named are not read.
    """
    asked = df.withColumn("asked__", anchors)
    rows = settled(rows_of(asked, row_id, vector, label, scale).withColumn("dim", F.size("v")))
    size = rows.agg(F.coalesce(F.sum(F.greatest("dim", F.lit(1))), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK))
    points = rows.withColumn("block", F.pmod(F.xxhash64("id", "own", F.lit(11)), F.lit(blocks)).cast("int"))
    ids = asked.where("asked__").select(F.col(f"`{row_id}`").alias("id")).distinct()
    wanted = settled(rows.join(ids, "id", "left_semi"))
    chunks = max(1, -(-wanted.count() // ANCHORS))
    kind = df.schema[row_id].dataType.simpleString()
    who = f"anchor_id {kind}, anchor_own bigint"

    def near(here: Points, root: Node, row: dict) -> Iterator[tuple]:
        best = Best(here, positives, LEAST, MOST)
        own, itself = np.int64(row["own"]), row["id"]
        skip = lambda at: (here.own[at] == own) & (here.ids[at] == itself)
        descend(here, root, np.array(row["v"], np.int64), row["kind"], True, skip, [best])
        for at, score in zip(best.at, best.scores):
            yield itself, row["own"], here.ids[at].item(), here.own[at].item(), int(score)

    found = met(points, wanted, near, f"{who}, positive_id {kind}, positive_own bigint, positive_score bigint", blocks, chunks)
    per = Window.partitionBy("anchor_id", "anchor_own").orderBy(F.desc("positive_score"), "positive_id", "positive_own")
    found = settled(found.withColumn("n", F.row_number().over(per)).where(F.col("n") <= positives).drop("n"))
    pairs = F.array_sort(F.collect_list(F.struct("positive_id", "positive_own", "positive_score"))).alias("pairs")
    asking = wanted.withColumnsRenamed({"id": "anchor_id", "own": "anchor_own"})
    asking = asking.join(found.groupBy("anchor_id", "anchor_own").agg(pairs), ["anchor_id", "anchor_own"])
    asking = asking.withColumnsRenamed({"anchor_id": "id", "anchor_own": "own"})

    def below(here: Points, root: Node, row: dict) -> Iterator[tuple]:
        windows = [Best(here, negatives, *window_of(p["positive_score"], low, high)) for p in row["pairs"]]
        skip = lambda at: np.zeros(len(at), bool)
        descend(here, root, np.array(row["v"], np.int64), row["kind"], False, skip, windows)
        for p, best in zip(row["pairs"], windows):
            for at, score in zip(best.at, best.scores):
                yield (
                    row["id"], row["own"], p["positive_id"], p["positive_own"],
                    here.ids[at].item(), here.own[at].item(), p["positive_score"], int(score),
                )

    schema = f"{who}, positive_id {kind}, positive_own bigint, negative_id {kind}, negative_own bigint, positive_score bigint, negative_score bigint"
    worse = met(points, asking, below, schema, blocks, chunks)
    per = Window.partitionBy("anchor_id", "anchor_own", "positive_id", "positive_own")
    per = per.orderBy(F.desc("negative_score"), "negative_id", "negative_own")
    worse = worse.withColumn("rank", F.row_number().over(per)).where(F.col("rank") <= negatives)
    return worse.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
