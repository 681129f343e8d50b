"""Near duplicates: SetSketch registers, banded, estimated by likelihood and verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from docmill.llm.shared import settled, slices

#: Words in a shingle, and the similarity in percent from which two documents are linked.
SHINGLE_WORDS = 5
LEAST_PERCENT = 80
#: Registers: minima of exponential variables of this rate, on a scale of powers of the base,
#: truncated to two bytes. Bands of six registers: two sets of similarity 0.8 share none of
#: the 42 bands in 3 of a million cases.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
BAND, BANDS = 6, 42
REGISTERS = BAND * BANDS
#: Estimates so far below the limit are not verified: four standard deviations at 0.8.
SLACK = 0.1
#: Rounds in which each set is compared with one central set of its buckets, before whatever
#: is still open is compared block by block.
HUB_ROUNDS = 2
#: Members of a bucket, and partners of a hub, that meet in one task, and bytes of their sets.
BLOCK = 1024
BLOCK_BYTES = 16 << 20
#: A task forgets the words it has seen beyond so many.
SEEN_WORDS = 2_000_000


def parameters() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    a = rng.integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, REGISTERS, np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case; bytes split at exactly the blanks of a word."""
    return text.encode().lower().split() if text else []


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > SEEN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """The set of shingles as sorted 64-bit hashes; fewer words than ``size`` are one shingle."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out = np.zeros(max(1, len(h) - size + 1), np.uint64)
    for k in range(min(size, len(h))):
        out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(min(len(h), size)))


def registers(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set: per register the smallest exponential variable of its
    items, as a truncated power of the base. The larger register of two sets is their union's."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 1024):
        part = items[at : at + 1024, None]
        least = np.minimum(least, (part * a + b).min(axis=0))
    share = (least.astype(np.float64) + 1) / 2.0**64
    smallest = -np.log1p(-np.minimum(share, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, TOP).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    bands = regs.reshape(len(regs), BANDS, BAND).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for k in range(BAND):
        key = (key ^ bands[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return (key * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


#: Similarities at which the likelihood of register pairs is looked up.
GRID = np.linspace(0, 1, 51)


def estimate(regs: np.ndarray, sizes: np.ndarray, own: np.ndarray, size: int) -> np.ndarray:
    """Likeliest similarity of each row's set with one set, from how many registers are larger,
    smaller and equal, given the sizes of the sets."""
    larger = (regs > own).sum(1)[:, None]
    smaller = (regs < own).sum(1)[:, None]
    u = (sizes / (sizes + size))[:, None]
    v = 1 - u
    most = np.minimum(u, v) / np.maximum(u, v)
    grid = np.minimum(GRID[None, :], most)

    def differ(x):
        return -np.log(1 - np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    p, q = differ(u - v * grid), differ(v - u * grid)
    equal = np.maximum(1 - p - q, 1e-12)
    like = larger * np.log(np.maximum(p, 1e-12)) + smaller * np.log(np.maximum(q, 1e-12))
    like = like + (regs.shape[1] - larger - smaller) * np.log(equal)
    return np.take_along_axis(grid, like.argmax(1)[:, None], 1)[:, 0]


def near(regs: np.ndarray, sizes: np.ndarray, own: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Which rows may be linked with one set. Rows with far too few equal registers for that are
    told without their likelihood."""
    limit = percent / 100 - SLACK
    out = (regs == own).sum(1) >= (limit - SLACK) * regs.shape[1]
    at = np.flatnonzero(out)
    if len(at):
        out[at] = estimate(regs[at], sizes[at], own, size) >= limit
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity, on all their shingles."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketched(df: DataFrame, keep: list[str], text: str, size: int) -> DataFrame:
    """Rows with the size of the set, its 128-bit fingerprint and its registers."""
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, (a, b) = WordHashes(), parameters()
        for batch in batches:
            for part in slices(batch, "text__"):
                sets = [shingles(t, size, hashes) for t in part.column("text__").to_pylist()]
                arrays = [part.column(i) for i in range(len(keep))] + [
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([registers(s, a, b).tobytes() for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "n", "fp", "regs"])

    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("text__"))
    return rows.mapInArrow(run, f"{kept}, n long, fp binary, regs binary")


def banded(reps: DataFrame) -> DataFrame:
    """(bucket, rep): the rows of the buckets that hold several sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16)
            keys = band_keys(regs.reshape(-1, REGISTERS))
            reps = np.repeat(batch.column("rep").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(reps)], names=["bucket", "rep"]
            )

    rows = settled(reps.where("n > 0").select("rep", "regs").mapInArrow(run, "bucket long, rep long"))
    several = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    return rows.join(several, "bucket")


def sets_of(docs: DataFrame, reps: DataFrame, wanted: DataFrame, text: str, size: int) -> DataFrame:
    """(rep, n, regs, items) of the wanted sets, read again from the texts of one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, "text__"):
                sets = [shingles(t, size, hashes).tobytes() for t in part.column("text__").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep"), part.column("n"), part.column("regs"), pa.array(sets, pa.binary())],
                    names=["rep", "n", "regs", "items"],
                )

    # Joined by key and text, so that only one of many copies finds its partner.
    first = reps.join(wanted, "rep", "left_semi")
    first = first.select("rep", "n", "regs", F.col("pick.key").alias("one"), F.col("pick.roll").alias("roll"))
    texts = docs.select("key", "roll", F.col(text).alias("text__"))
    same = texts["key"].eqNullSafe(first["one"]) & (texts["roll"] == first["roll"])
    rows = texts.join(first, same).dropDuplicates(["rep"])
    return rows.select("rep", "n", "regs", "text__").mapInArrow(
        run, "rep long, n long, regs binary, items binary"
    )


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, rep) whose sets are linked: estimated first, then checked in full. A hub
    with many partners is copied to several tasks."""
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    parts = settled(parts)
    salt = F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part")
    left = pairs.join(parts, "hub").select("hub", "rep", salt).join(sets, "rep")
    right = parts.select("hub", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
    whole = sets.select(*[F.col(a).alias(b) for a, b in (("rep", "hub"), ("n", "own_n"), ("regs", "own_regs"), ("items", "own"))])
    right = right.join(whole, "hub")

    def meet(rows: pd.DataFrame, hub: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(hub):
            return pd.DataFrame({"hub": [], "rep": []}).astype("int64")
        one = hub.iloc[0]
        regs = np.stack([np.frombuffer(r, np.uint16) for r in rows["regs"]])
        mine, items = np.frombuffer(one["own_regs"], np.uint16), np.frombuffer(one["own"], np.uint64)
        rows = rows[near(regs, rows["n"].to_numpy(float), mine, one["own_n"], percent)]
        good = [linked(np.frombuffer(s, np.uint64), items, percent) for s in rows["items"]]
        return rows.loc[np.array(good, bool), ["hub", "rep"]] if len(rows) else rows[["hub", "rep"]]

    right = right.select(F.col("hub").alias("of"), F.col("part").alias("of_part"), "own_n", "own_regs", "own")
    met = left.groupBy("hub", "part").cogroup(right.groupBy("of", "of_part"))
    return met.applyInPandas(lambda a, b: meet(a, b), "hub long, rep long")


def components(edges: DataFrame) -> DataFrame:
    """(rep, comp): the smallest reachable vertex of every vertex with an edge.

    Every vertex takes the smallest label among itself and its neighbours, then the label of
    that label, until nothing changes. Labels are aggregated before they are shuffled."""
    both = edges.select(F.col("hub").alias("u"), F.col("rep").alias("v"))
    both = settled(both.union(both.select("v", "u")).distinct())
    labels = settled(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")))
    while True:
        known = labels.select(F.col("u").alias("v"), "l")
        offered = both.join(known, "v").groupBy("u").agg(F.min("l").alias("m"))
        fresh = labels.join(offered, "u").select("u", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        jump = labels.select(F.col("u").alias("l"), F.col("l").alias("far"))
        fresh = fresh.join(jump, "l").select("u", "old", F.least("l", "far").alias("l"))
        fresh = settled(fresh)
        labels = fresh.select("u", "l")
        if fresh.where("l <> old").isEmpty():
            return labels.select(F.col("u").alias("rep"), F.col("l").alias("comp"))


def named(rows: DataFrame, comps: DataFrame | None, rep: str = "rep", comp: str = "comp") -> DataFrame:
    """Rows with the component of a vertex, which is the vertex itself if it has no link."""
    if comps is None:
        return rows.withColumn(comp, F.col(rep))
    known = comps.select(F.col("rep").alias("of"), F.col("comp").alias("found"))
    rows = rows.join(known, rows[rep] == known["of"], "left")
    return rows.withColumn(comp, F.coalesce("found", rep)).drop("of", "found")


def joined(comps: DataFrame | None, edges: DataFrame) -> DataFrame | None:
    """Components after further links: whole components are the vertices that these connect."""
    ends = named(named(edges, comps, "hub", "a"), comps, "rep", "b")
    ends = settled(ends.where("a <> b").select(F.col("a").alias("hub"), F.col("b").alias("rep")).distinct())
    if ends.isEmpty():
        return comps
    fresh = components(ends)
    if comps is None:
        return settled(fresh)
    root = fresh.select(F.col("rep").alias("comp"), F.col("comp").alias("root"))
    moved = comps.join(root, "comp", "left").select("rep", F.coalesce("root", "comp").alias("comp"))
    return settled(moved.union(fresh.join(comps, "rep", "left_anti").select("rep", "comp")))


def open_buckets(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    """(bucket, rep, central, comp) of the buckets that hold several components."""
    rows = named(members, comps)
    several = rows.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    return settled(rows.join(several.where("low <> high").select("bucket"), "bucket"))


def hub_pairs(rows: DataFrame, tested: DataFrame | None) -> DataFrame:
    """For each set the most central one that shares a bucket with it and is most central there:
    one pair per set, so that a large group costs no more than its members."""
    hubs = rows.groupBy("bucket").agg(F.max(F.struct("central", "rep", "comp")).alias("top"))
    pairs = rows.join(hubs, "bucket").where(F.col("comp") != F.col("top.comp"))
    pairs = pairs.select("rep", F.col("top.rep").alias("hub"), F.col("top.central").alias("rank"))
    if tested is not None:
        pairs = pairs.join(tested, ["hub", "rep"], "left_anti")
    best = pairs.groupBy("rep").agg(F.max(F.struct("rank", "hub")).alias("best"))
    return settled(best.select(F.col("best.hub").alias("hub"), "rep"))


def meetings(rows: DataFrame) -> PandasCogroupedOps:
    """Cogroups of two blocks of one bucket: members outside its largest component (left) meet
    all members (right). ``weight`` says which share of a block a member takes."""
    sizes = rows.groupBy("bucket", "comp").agg(F.sum("weight").alias("size"))
    largest = sizes.groupBy("bucket").agg(
        F.max(F.struct("size", "comp")).alias("top"), F.sum("size").alias("all")
    )
    largest = settled(
        largest.select(
            "bucket",
            F.col("top.comp").alias("major"),
            F.greatest(F.ceil(F.col("all") - F.col("top.size")), F.lit(1)).alias("lefts"),
            F.ceil("all").alias("rights"),
        )
    )
    dealt = rows.drop("weight").join(largest, "bucket")
    dealt = settled(dealt.withColumn("minor", F.col("comp") != F.col("major")).drop("major"))
    every = [c for c in dealt.columns if c not in ("lefts", "rights")]
    left = dealt.where("minor").select(
        *every,
        F.pmod(F.xxhash64("rep"), "lefts").alias("left"),
        F.explode(F.expr("sequence(0L, rights - 1)")).alias("right"),
    )
    right = dealt.select(
        *[F.col(c).alias(f"r_{c}") for c in every],
        F.pmod(F.xxhash64("rep"), "rights").alias("r_right"),
        F.explode(F.expr("sequence(0L, lefts - 1)")).alias("r_left"),
    )
    met = left.groupBy("bucket", "left", "right")
    return met.cogroup(right.groupBy("r_bucket", "r_left", "r_right"))


def partners(own: pd.DataFrame, others: pd.DataFrame, percent: int) -> Iterator[tuple]:
    """For each row of one block its possible links in the other: those of another component
    whose estimate reaches the limit. A pair that shares several buckets is one of the first."""
    if not len(own) or not len(others):
        return
    regs = np.stack([np.frombuffer(r, np.uint16) for r in others["r_regs"]])
    n, comp = others["r_n"].to_numpy(float), others["r_comp"].to_numpy()
    rep, minor = others["r_rep"].to_numpy(), others["r_minor"].to_numpy(bool)
    bands = regs.reshape(len(regs), BANDS, BAND)
    for place, one in enumerate(own.itertuples()):
        ratio = np.minimum(one.n, n) / np.maximum(one.n, n)
        # Two members outside the largest component meet twice; one meeting counts.
        rest = np.flatnonzero((comp != one.comp) & (100 * ratio >= percent) & (~minor | (rep < one.rep)))
        if len(rest):
            mine = np.frombuffer(one.regs, np.uint16)
            shared = (bands[rest] == mine.reshape(BANDS, BAND)).all(2)
            first = band_keys(mine[None, :])[0][shared.argmax(1)]
            rest = rest[first == one.bucket]
        if len(rest):
            yield place, rest[near(regs[rest], n[rest], mine, one.n, percent)]


def block_links(rows: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (hub, rep) that connect whatever components of a bucket are linked.

    Blocks of sketches first tell which members have a possible link at all. Blocks of these,
    with their sets, verify the possible links in full, and pass over pairs that links found
    before them connect. So no task gives more rows than it read."""
    known = rows.select("bucket", "rep", "comp").join(reps.select("rep", "n", "regs"), "rep")

    def tell(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        here, there = np.zeros(len(own), bool), np.zeros(len(others), bool)
        for place, rest in partners(own, others, percent):
            here[place] |= len(rest) > 0
            there[rest] = True
        ids = np.concatenate([own["rep"].to_numpy(np.int64)[here], others["r_rep"].to_numpy(np.int64)[there]])
        ids = np.unique(ids)
        bucket = own["bucket"].iloc[0] if len(ids) else 0
        return pd.DataFrame({"bucket": np.full(len(ids), bucket, np.int64), "rep": ids})

    told = meetings(known.withColumn("weight", F.lit(1 / BLOCK)))
    told = told.applyInPandas(lambda a, b: tell(a, b), "bucket long, rep long").distinct()
    whole = rows.select("bucket", "rep", "comp").join(told, ["bucket", "rep"]).join(sets, "rep")
    whole = settled(whole)

    def link(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        comps, ids, items = (others[c].to_numpy() for c in ("r_comp", "r_rep", "r_items"))
        for place, rest in partners(own, others, percent):
            one = own.iloc[place]
            mine = np.frombuffer(one["items"], np.uint64)
            for at in rest:
                a, b = find(int(one["comp"])), find(int(comps[at]))
                if a != b and linked(np.frombuffer(items[at], np.uint64), mine, percent):
                    root[a] = b
                    out.append((int(one["rep"]), int(ids[at])))
        return pd.DataFrame(out, columns=["hub", "rep"], dtype="int64")

    share = F.greatest(F.lit(1 / BLOCK), F.length("items") / BLOCK_BYTES)
    met = meetings(whole.withColumn("weight", share))
    return settled(met.applyInPandas(lambda a, b: link(a, b), "hub long, rep long"))


def near_duplicates(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    percent: int = LEAST_PERCENT,
) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row.

    Documents are linked if the sets of their ``shingle_words``-word shingles reach the
    similarity ``percent``; a component is what links connect. Rows with equal sets are one set.
    Sets are sketched into registers, and registers banded; sets that share a band are compared
    unless they are known to be in one component: first every set with the most central one of
    its buckets, and what is then in buckets of several components block by block. Pairs pass an estimate by likelihood and are verified on the full sets.

    Null texts and texts without words have the empty set and are alone. A text with fewer
    words than a shingle is one shingle. ``component_id`` is the smallest non-null key of the
    component (null if it has none), ``kept`` whether the row's key is that. Rows that repeat a
    key and text are all kept or all not. An empty table gives an empty result. Other columns
    are not read.
    """
    docs = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    docs = docs.withColumn("roll", F.xxhash64("text"))
    rows = settled(sketched(docs, ["key", "roll"], "text", shingle_words))
    reps = rows.where("n > 0").groupBy("fp").agg(
        F.min("key").alias("least"),
        F.min(F.struct(F.col("key").isNull().alias("none"), "key", "roll")).alias("pick"),
        F.first("n").alias("n"),
        F.first("regs").alias("regs"),
    )
    reps = settled(reps.withColumn("rep", F.monotonically_increasing_id()))
    members = settled(banded(reps))
    central = members.groupBy("rep").agg(F.sum("size").alias("central"))
    members = settled(members.select("bucket", "rep").join(central, "rep"))
    sets = settled(sets_of(docs, reps, central.select("rep"), "text", shingle_words))
    comps = tested = None
    for turn in range(HUB_ROUNDS + 1):
        waiting = open_buckets(members, comps)
        if waiting.isEmpty():
            break
        if turn < HUB_ROUNDS:
            pairs = hub_pairs(waiting, tested)
            tested = pairs if tested is None else tested.union(pairs)
            links = settled(verified(pairs, sets, percent))
        else:
            links = block_links(waiting, reps, sets, percent)
        comps = joined(comps, links)
    named_reps = named(reps.select("fp", "rep", "least"), comps)
    least = named_reps.groupBy("comp").agg(F.min("least").alias("component_id"))
    classes = settled(named_reps.join(least, "comp").select("fp", "component_id"))
    out = rows.select("key", "n", "fp").join(classes, "fp", "left")
    component = F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("component_id"))
    return out.select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("key").eqNullSafe(component).alias("kept"),
    )
