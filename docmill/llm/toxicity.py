"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over all words of the
examples, on block-max indexes."""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.shared import per_text, settled, slices

#: Letters and digits in a row; besides the word, its beginnings of these lengths are terms.
TOKEN = re.compile(r"[^\W_]+")
BEGINNINGS = (4, 5, 6)
#: Bytes of UTF-8 with A-Z as a-z; what else in ASCII is no letter or digit is a blank.
PLAIN = bytes(ord(chr(b).lower()) if b > 127 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
#: Labelled documents that serve as examples, of each label.
EXAMPLES = 8000
#: The terms in most examples, whose weights are columns of a matrix in place of posting lists.
COMMON = 1024
#: Examples in a block, and neighbours that vote.
BLOCK = 128
NEIGHBOURS = 32
#: Blocks scored before the bounds of the others are compared with the last neighbour found,
#: and texts scored together.
AT_ONCE = 6
QUERIES = 128
SHOWN = 3
#: A vote weighs the similarity to this power; the base rate weighs as one close vote.
POWER = 4
PRIOR = 0.5
#: A task forgets the words it has seen beyond so many.
SEEN_WORDS = 200_000
#: Terms whose counts are one row while they are summed.
CHUNK = 1 << 16
FIELDS = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
        T.StructField("neighbours", T.ArrayType(T.LongType())),
        T.StructField("terms", T.ArrayType(T.StringType())),
    ]
)


def terms_of(token: str) -> list[str]:
    return [token, *[token[:n] + "*" for n in BEGINNINGS if len(token) >= n]]


class Known(dict):
    """Numbers of the index terms that a piece of a text has, looked up once per piece. Pieces are
    what ASCII separates, in UTF-8; other characters may separate words in a piece."""

    def __init__(self, numbers: dict[str, int]) -> None:
        self.numbers = numbers

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) > SEEN_WORDS:
            self.clear()
        tokens = TOKEN.findall(piece.decode("utf-8", "surrogatepass").lower())
        terms = [self.numbers[t] for token in tokens for t in terms_of(token) if t in self.numbers]
        found = self[piece] = array("i", terms).tobytes()
        return found


def pieces_of(text: str) -> list[bytes]:
    """A text's pieces. Lower case is told from a piece alone, but for the capital sigma, whose
    lower case depends on what surrounds it."""
    if "\u03a3" in text:
        text = text.lower()
    return text.encode("utf-8", "surrogatepass").translate(PLAIN).split()


def counts_of(text: str | None, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """The index terms of the whole text, ascending, and how often each occurs."""
    words = Counter(pieces_of(text)) if text else Counter()
    found = [known[w] for w in words]
    at = np.frombuffer(b"".join(found), np.int32).astype(np.int64)
    if not len(at):
        return at, at
    sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
    times = np.repeat(np.fromiter(words.values(), np.int64, len(found)), sizes)
    both = np.sort(at << 32 | times)
    at = both >> 32
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return at[first], np.add.reduceat(both & 0xFFFFFFFF, first)


def packed(at: np.ndarray, times: np.ndarray) -> bytes:
    """Terms, ascending, and their numbers of occurrences, made small."""
    return zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes() + times.astype("<u4").tobytes(), 1)


def unpacked(counts: dict[int, int] | bytes) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(counts, bytes):
        deltas, times = np.frombuffer(zlib.decompress(counts), "<u4").reshape(2, -1).astype(np.int64)
        return np.cumsum(deltas), times
    at = np.array(sorted(counts), np.int64)
    return at, np.array([counts[t] for t in at], np.int64)


def labelled(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, label) of the rows to learn from; a document with several labels is toxic if
    one says so."""
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id")
    known = known.agg(F.max(F.col("toxic").cast("int")).alias("label"))
    rows = docs.where(learn & F.col("text").isNotNull()).select("doc_id")
    # Labels grow with the documents, so they are never broadcast, not even few.
    return rows.join(known.hint("merge"), "doc_id")


def all_terms(sample: DataFrame) -> list[str]:
    """Every term of the examples, whose number is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                tokens = set()
                for text in part.column("text").to_pylist():
                    tokens.update(TOKEN.findall(text.lower()))
                terms = list({t for token in tokens for t in terms_of(token)})
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string())], names=["term"])

    return sorted(sample.select("text").mapInArrow(run, "term string").distinct().toArrow()["term"].to_pylist())


def joined(terms: list[str]) -> bytes:
    return zlib.compress("\n".join(terms).encode(), 1)


def numbered(terms: bytes) -> dict[str, int]:
    """Numbers of the joined terms."""
    return {t: i for i, t in enumerate(zlib.decompress(terms).decode().split("\n")) if t}


def document_frequencies(docs: DataFrame, terms: list[str]) -> tuple[np.ndarray, int]:
    """In how many of all documents each index term occurs, and how many there are.
    Tasks sum first; their sums are added up chunk by chunk."""
    shared = docs.sparkSession.sparkContext.broadcast(joined(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(numbered(shared.value))
        total = np.zeros(len(known.numbers) + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    total[-1] += 1
                    total[counts_of(text, known)[0]] += 1
        for at in range(0, len(total), CHUNK):
            if total[at : at + CHUNK].any():
                yield row(at // CHUNK, total[at : at + CHUNK])

    def row(chunk: int, counts: np.ndarray) -> pa.RecordBatch:
        payload = zlib.compress(counts.astype("<i8").tobytes(), 1)
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int32()), pa.array([payload], pa.binary())], names=["chunk", "counts"]
        )

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, payload in zip(*(batch.column(i).to_pylist() for i in range(2))):
                counts = np.frombuffer(zlib.decompress(payload), "<i8")
                held[chunk] = held[chunk] + counts if chunk in held else counts
        for chunk, counts in held.items():
            yield row(chunk, counts)

    kind = "chunk int, counts binary"
    chunks = len(terms) // CHUNK + 1
    found = docs.select("text").mapInArrow(run, kind).repartition(min(chunks, 64), "chunk").mapInArrow(sums, kind)
    out = np.zeros(len(terms) + 1, np.int64)
    for own in found.collect():  # one row per chunk
        counts = np.frombuffer(zlib.decompress(own["counts"]), "<i8")
        out[own["chunk"] * CHUNK :][: len(counts)] = counts
    return out[:-1], int(out[-1])


def occurrences(texts: list, terms: int) -> np.ndarray:
    """In how many of these texts, lists of their terms, each term occurs."""
    total = np.zeros(terms, np.int64)
    for counts in texts:
        total[unpacked(counts)[0]] += 1
    return total


def evidence(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> np.ndarray:
    """By how much a term's weight grows for telling the labels apart: the root of the chi-squared
    statistic with Yates' correction, one at least, so that no term is left out."""
    n = n_a + n_b
    if not n_a * n_b:
        return np.ones(len(a))
    a, b = a.astype(np.float64), b.astype(np.float64)
    apart = np.maximum(np.abs(a * n_b - b * n_a) - n / 2, 0)
    return np.maximum(1, apart * np.sqrt(n / np.maximum((a + b) * (n - a - b) * n_a * n_b, 1)))


class Index:
    """Examples in blocks: their rare terms in posting lists, the common ones in a matrix, with
    the largest weight that a common term has in each block."""

    def __init__(self, terms: list[str], idf: np.ndarray, examples: list[tuple]) -> None:
        """``examples``: (doc_id, label, counts by term or packed, the label's weight in the
        votes)."""
        self.terms, self.idf = terms, idf
        rows, held = [], np.zeros(len(terms), np.int64)
        blank = [0.0, 0.0]
        for doc_id, label, counts, weight in examples:
            if len(at := unpacked(counts)[0]):
                held[at] += 1
                rows.append((counts, doc_id, label, weight))
            else:
                blank[label] += weight
        # Places of the common terms among the columns, the one in most examples first.
        common = np.argsort(-held, kind="stable")[:COMMON]
        self.column = np.full(len(terms), -1, np.int64)
        self.column[common] = np.arange(len(common))
        blocks = max(1, -(-len(rows) // BLOCK))
        self.dense = np.zeros((len(rows), len(common)), np.float32)
        self.most = np.zeros((blocks, len(common)), np.float32)
        self.sizes = np.where(self.column < 0, held, 0)
        starts = np.concatenate([[0], np.cumsum(self.sizes)])
        places, free = np.zeros(starts[-1], np.int32), starts[:-1].copy()
        # A posting is a place for the terms that an example holds equally often: there they weigh
        # the same but for the term's own weight. An example's first place is its row, the others
        # follow behind the rows.
        shares, more, owners, leading = np.zeros(len(rows)), [], [], []
        for i, (counts, *_) in enumerate(rows):
            at, times = unpacked(counts)
            values, length = self.weighed(at, times)
            column = self.column[at]
            own = column >= 0
            self.dense[i, column[own]] = values[own] / length
            leading.append(np.sort(column[own])[:8].tolist())
            at, times = at[~own], times[~own]
            if not len(at):
                continue
            often = np.sort(times)
            often = often[np.flatnonzero(np.diff(often, prepend=0))]
            which = np.searchsorted(often, times)
            place = free[at]
            places[place] = np.where(which, len(rows) + len(more) - 1 + which, i)
            free[at] = place + 1
            found = ((1 + np.log(often)) / length).tolist()
            shares[i] = found[0]
            more += found[1:]
            owners += [i] * (len(found) - 1)
        # Examples with the same commonest terms share blocks, which keeps the bounds tight.
        order = np.array(sorted(range(len(rows)), key=lambda i: (leading[i], rows[i][1])), np.int64)
        moved = np.empty(len(rows) + len(more), np.int32)
        moved[order] = np.arange(len(rows))
        moved[len(rows) :] = np.arange(len(rows), len(moved))
        rows = [rows[i] for i in order]
        self.counts = [r[0] for r in rows]
        self.ids = np.array([r[1] for r in rows], np.int64)
        self.labels = np.array([r[2] for r in rows], np.float64)
        self.weights = np.array([r[3] for r in rows], np.float64)
        self.dense = self.dense[order]
        self.shares, self.owners = np.concatenate([shares[order], more]), moved[np.array(owners, np.int64)].astype(np.int64)
        places = moved[places].tobytes()
        self.rows = [places[4 * low : 4 * high] for low, high in zip(starts.tolist(), starts[1:].tolist())]
        for k in range(0, len(self.ids), BLOCK):
            self.most[k // BLOCK] = self.dense[k : k + BLOCK].max(0)
        #: How far a product of rows in single precision may be from the exact one.
        self.margin = (len(common) + 4) * 2.0**-23
        total = self.weights.sum() + sum(blank)
        toxic = (self.weights * self.labels).sum() + blank[1]
        self.base = (toxic + 0.5) / (total + 1) if total else 0.0  # nothing labelled, nothing toxic
        self.blank = (blank[1] + self.base) / (sum(blank) + 1)
        self.slope, self.shift = 1.0, 0.0

    def weighed(self, at: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights of terms, and the length of the vector they make."""
        values = (1 + np.log(times)) * self.idf[at]
        return values, np.sqrt((values * values).sum())

    def vector(self, counts: dict[int, int] | bytes | tuple) -> tuple[np.ndarray, np.ndarray]:
        """Terms, ascending, and weights of length 1."""
        at, times = counts if isinstance(counts, tuple) else unpacked(counts)
        values, length = self.weighed(at, times)
        return at, values / length

    @cached_property
    def known(self) -> Known:
        return Known({t: i for i, t in enumerate(self.terms)})

    def nearest(self, at: np.ndarray, values: np.ndarray, without: int = -1) -> tuple:
        return self.nearest_of([(at, values)], [without])[0]

    def nearest_of(self, queries: list[tuple], without: list[int]) -> list[tuple]:
        """The examples with the largest cosine to each query. Rare terms are summed over their
        postings; the common ones are added in the blocks with the largest bounds, and then only
        in those whose bound reaches the last neighbour found. Products in single precision
        choose; whatever they leave within their error is computed in double precision."""
        n, blocks = len(self.ids), len(self.most)
        if not n or not queries:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        rare = np.zeros((len(queries), n))
        common = np.zeros((len(queries), self.dense.shape[1]))
        for i, (at, values) in enumerate(queries):
            column = self.column[at]
            own = column >= 0
            common[i, column[own]] = values[own]
            at, values = at[~own], values[~own]
            hits = np.frombuffer(b"".join([self.rows[t] for t in at.tolist()]), np.int32)
            if len(hits):
                sums = np.bincount(hits, np.repeat(values * self.idf[at], self.sizes[at]), len(self.shares))
                sums *= self.shares
                rare[i] = sums[:n] + np.bincount(self.owners, sums[n:], n)
        for i, row in enumerate(without):
            if row >= 0:
                rare[i, row] = -np.inf
        single = common.astype(np.float32)
        bounds = np.maximum.reduceat(rare, np.arange(0, n, BLOCK), 1) + single @ self.most.T + self.margin
        about = np.full((len(queries), blocks * BLOCK), -np.inf)

        def add(chosen: np.ndarray) -> None:
            for k in np.flatnonzero(chosen.any(0)):
                own, part = np.flatnonzero(chosen[:, k]), slice(k * BLOCK, min((k + 1) * BLOCK, n))
                about[own, part] = rare[own, part] + single[own] @ self.dense[part].T

        def last(scored: np.ndarray) -> np.ndarray:
            """The last neighbour's similarity among these, by query."""
            if n <= NEIGHBOURS or scored.shape[-1] < NEIGHBOURS:
                return np.zeros(scored.shape[:-1])
            at = scored.shape[-1] - NEIGHBOURS
            return np.maximum(np.partition(scored, at, -1)[..., at], 0)

        first = np.zeros(bounds.shape, bool)
        best = np.argsort(-bounds, axis=1, kind="stable")[:, :AT_ONCE]
        np.put_along_axis(first, best, True, 1)
        add(first)
        scored = np.take_along_axis(about.reshape(len(queries), blocks, BLOCK), best[:, :, None], 1)
        limits = last(scored.reshape(len(queries), -1))
        if blocks > AT_ONCE:
            add(~first & (bounds >= limits[:, None] - self.margin))
        out = []
        for i, limit in enumerate(limits):
            ids = np.flatnonzero(about[i] >= limit - 2 * self.margin)
            ids = ids[about[i, ids] >= last(about[i, ids]) - 2 * self.margin]
            sims = rare[i, ids] + (self.dense[ids] * common[i]).sum(1)
            ids, sims = ids[sims > 0], sims[sims > 0]
            best = np.lexsort((ids, -sims))[:NEIGHBOURS]
            out.append((ids[best], sims[best]))
        return out

    def vote(self, ids: np.ndarray, sims: np.ndarray) -> float:
        if not len(ids):
            return self.blank
        weight = self.weights[ids] * sims**POWER
        prior = PRIOR * self.base
        return float(((weight * self.labels[ids]).sum() + prior) / (weight.sum() + PRIOR))

    def votes(self, some: np.ndarray) -> list[float]:
        """The votes that these examples get from the others."""
        raw = []
        for at in range(0, len(some), QUERIES):
            part = some[at : at + QUERIES].tolist()
            raw += [self.vote(*found) for found in self.nearest_of([self.vector(self.counts[i]) for i in part], part)]
        return raw

    def score(self, texts: list[tuple]) -> list[tuple[float, list[int], list[str]]]:
        """Score, nearest examples and the terms that weigh most, of each text's counts."""
        out = [(min(self.blank, 1.0), [], [])] * len(texts)
        some = [i for i, (at, _) in enumerate(texts) if len(at)]
        queries = [self.vector(texts[i]) for i in some]
        found = self.nearest_of(queries, [-1] * len(some))
        for i, (at, values), (ids, sims) in zip(some, queries, found):
            raw = min(max(self.vote(ids, sims), 1e-4), 1 - 1e-4)
            if len(ids):
                raw = 1 / (1 + math.exp(-self.slope * math.log(raw / (1 - raw)) - self.shift))
            strong = at[np.argsort(-values, kind="stable")[:SHOWN]]
            out[i] = (raw, self.ids[ids[:SHOWN]].tolist(), [self.terms[t] for t in strong])
        return out


class Fitted:
    """What an index is made from, which is much smaller than the index. Tasks make the index from
    it, once per worker; the driver holds none."""

    def __init__(self, terms: list[str], idf: np.ndarray, examples: list[tuple], slope: float = 1.0, shift: float = 0.0) -> None:
        self.words, self.idf, self.examples, self.slope, self.shift = joined(terms), idf, examples, slope, shift

    @property
    def terms(self) -> list[str]:
        return list(numbered(self.words))

    def index(self) -> Index:
        if "made" not in self.__dict__:
            self.made = Index(self.terms, self.idf, self.examples)
        return self.made

    def __getstate__(self) -> dict:
        return {name: value for name, value in self.__dict__.items() if name not in ("made", "sent")}

    def shared(self, spark: SparkSession) -> Broadcast:
        """Sent once, so that a worker that made the index for the curve has it for the scores."""
        if "sent" not in self.__dict__:
            self.sent = spark.sparkContext.broadcast(self)
        return self.sent


def calibrate(spark: SparkSession, fitted: Fitted, most: int = 4000, tasks: int = 8) -> None:
    """A logistic curve over the votes that examples get from the others; tasks count the votes."""
    rows = sum(len(unpacked(counts)[0]) > 0 for _, _, counts, _ in fitted.examples)
    step = max(1, rows // most)
    shared = fitted.shared(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = np.array([i for batch in batches for i in batch.column(0).to_pylist()], np.int64)
        if not len(some):
            return
        own = shared.value.index()
        columns = [some, np.array(own.votes(some), np.float64), own.labels[some], own.weights[some]]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["place", "raw", "label", "weight"])

    places = spark.range(0, rows, step, tasks)
    found = places.mapInArrow(run, "place long, raw double, label double, weight double").collect()
    found.sort()
    raw, label, weight = (np.array([r[k] for r in found], np.float64) for k in (1, 2, 3))
    if len(set(label)) < 2:
        return
    x = np.log(np.clip(raw, 1e-4, 1 - 1e-4) / (1 - np.clip(raw, 1e-4, 1 - 1e-4)))
    y, w = label, weight
    features = np.stack([x, np.ones_like(x)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-features @ beta))
        g = features.T @ (w * (p - y)) + 0.01 * (beta - [1, 0])
        h = (features * (w * p * (1 - p))[:, None]).T @ features + 0.01 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(h, g), -2, 2)
    if beta[0] > 0:
        fitted.slope, fitted.shift = float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, seed: int = 7) -> Fitted:
    """What the index is made from: examples a bounded sample of the labelled rows, as many of each label, weighed
    by how many rows they stand for; all their terms, with document frequencies from all rows.
    A term's inverse frequency is multiplied by the evidence it gives of a label."""
    rows = settled(labelled(docs, labels, learn))
    roll = F.xxhash64(F.lit(seed), "doc_id")
    first = Window.partitionBy("label").orderBy(roll, "doc_id")
    picked = rows.distinct().withColumn("place", F.row_number().over(first))
    picked = settled(picked.where(F.col("place") <= EXAMPLES).select("doc_id", "label"))  # bounded
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    # A document whose row repeats counts once, if its text is the same.
    sample = docs.where(learn & F.col("text").isNotNull()).select("doc_id", "text")
    sample = settled(sample.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id", "text"]))
    spark = docs.sparkSession
    terms = all_terms(sample)
    shared = spark.sparkContext.broadcast(joined(terms))
    frequencies, total = document_frequencies(docs, terms)
    idf = np.log((1 + total) / (1 + frequencies)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(numbered(shared.value))
        for batch in batches:
            for part in slices(batch, "text"):
                found = [packed(*counts_of(t, known)) for t in part.column("text").to_pylist()]
                arrays = [part.column("doc_id"), part.column("label"), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "label", "counts"])

    schema = "doc_id long, label int, counts binary"
    sample = sample.select(F.col("doc_id").cast("long"), "label", "text").mapInArrow(run, schema)
    sample = sample.toArrow().sort_by("doc_id")
    ids, marks, texts = (sample[c].to_pylist() for c in ("doc_id", "label", "counts"))
    held = Counter(marks)
    toxic = occurrences([t for t, y in zip(texts, marks) if y == 1], len(terms))
    other = occurrences([t for t, y in zip(texts, marks) if y != 1], len(terms))
    idf *= evidence(toxic, held[1], other, len(marks) - held[1])
    examples = [(i, int(y == 1), t, sizes[y] / held[y]) for i, y, t in zip(ids, marks, texts)]
    fitted = Fitted(terms, idf, examples)
    calibrate(spark, fitted)
    return fitted


def predict(
    df: DataFrame, index: Fitted, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keep`` with score, predicted, the nearest examples and the terms that weigh most.

    The whole text is read. Texts without a word of any example, null and empty ones included,
    get the share of toxic examples among those without a word. Without any labelled row all
    scores are 0, so nothing is predicted toxic. Examples equally near are taken in the order of the index. Repeated
    rows stay; an empty table gives an empty result; columns other than ``keep`` are not read."""
    shared = index.shared(df.sparkSession)  # bounded by the examples
    curve = index.slope, index.shift

    def start():
        own = shared.value.index()
        own.slope, own.shift = curve
        seen: dict[bytes, tuple] = {}

        def work(texts: list) -> dict:
            keys = [blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            if len(seen) > 200_000:
                seen.clear()
            fresh = list({k: t for k, t in zip(keys, texts) if k not in seen}.items())
            for at in range(0, len(fresh), QUERIES):
                part = fresh[at : at + QUERIES]
                found = own.score([counts_of(t, own.known) for _, t in part])
                seen.update(zip([k for k, _ in part], found))
            found = [seen[k] for k in keys]
            return {
                "score": [s for s, _, _ in found],
                "predicted": [int(s >= 0.5) for s, _, _ in found],
                "neighbours": [ids for _, ids, _ in found],
                "terms": [terms for _, _, terms in found],
            }

        return work

    return per_text(df, text, list(keep), FIELDS, start)
