"""Substring deduplication: words that a repeated passage covers, by automata of its phrases.

A passage repeats if some window of it does. Each window is known by its phrase, the eight words
of least hash in it, so equal windows have equal phrases at equal places. Phrases seen twice are
followed up: each stretch of windows around one is counted, stretches that differ are compared
window by window, and windows seen twice are confirmed. Each text then gets the confirmed
stretches that it may hold, in the words of the one text that stands for all that have them; a
few texts at a time compile Aho-Corasick automata of these phrases and are streamed through
them. Words are compared as they are there, hashes only choose what is compared.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docmill.llm.near_dups import WordHashes
from docmill.llm.shared import per_text, settled, shared_folder, slices

#: Consecutive words of a window, and of the phrase that it is known by.
WINDOW, PHRASE = 35, 8
#: Bytes of text that share automata; a longer text is alone.
BATCH_BYTES = 4 << 20
#: Different stretches of one phrase that meet in one row, which has about a megabyte then;
#: beyond, their windows are dealt out.
STRETCHES = 4096
#: Distinct words of one automaton, each of which is one character of its alphabet.
ALPHABET = 1_000_000


def words_of(text: str | None) -> list[bytes]:
    """Runs without blanks; bytes split at exactly the blanks that end a word."""
    return text.encode().split() if text else []


def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + y * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` elements, from runs of powers of two."""
    count = max(0, len(h) - size + 1)
    power, width, out, done = h, 1, None, 0
    while done < size:
        if size & width:
            part = power[done : done + count]
            out = part if out is None else mixed(out, part)
            done += width
        if done < size:
            power = mixed(power[:-width], power[width:]) if len(power) > width else power[:0]
            width *= 2
    return out[:count]


def least_places(g: np.ndarray, wide: int) -> np.ndarray:
    """For each run of ``wide`` numbers the place of its least one, the leftmost of equal ones."""
    value, place, width = g, np.arange(len(g)), 1
    while width < wide:
        step = min(width, wide - width)
        right = value[step:] < value[:-step]
        place = np.where(right, place[step:], place[:-step])
        value = np.where(right, value[step:], value[:-step])
        width += step
    return place


def phrases(
    h: np.ndarray, window: int, phrase: int, ends: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the phrases of texts that lie one after another, and for each stretch of windows
    with one phrase: the phrase's place, the first window, the number of windows. No window
    reaches beyond the end of a text."""
    g = grams(h, phrase)
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return g, none, none, none
    place = least_places(g, window - phrase + 1)
    new = np.concatenate([[True], place[1:] != place[:-1]])
    if ends is not None:
        inside = np.ones(len(place) + window, bool)
        for back in range(1, window):
            inside[ends[ends >= back] - back] = False
        new[ends[ends < len(place)]] = True
        inside = inside[: len(place)]
        new[1:] |= inside[1:] != inside[:-1]
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(place)))
    if ends is not None:
        starts, size = starts[inside[starts]], size[inside[starts]]
    return g, place[starts], starts, size


def hashed(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def scan(window: int, phrase: int) -> Callable[[], Callable[[list], dict]]:
    """Per text: its number of words, the hash of all its words, and its phrases with how often
    each occurs."""

    def start() -> Callable[[list], dict]:
        known = WordHashes()

        def work(texts: list) -> dict:
            split = [words_of(t) for t in texts]
            ends = np.cumsum([len(w) for w in split])
            g, place, first, _ = phrases(hashed(list(chain.from_iterable(split)), known), window, phrase, ends)
            owner, key = np.searchsorted(ends, first, "right"), g[place]
            order = np.lexsort((key, owner))
            owner, key = owner[order], key[order]
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])[: len(key)])
            times = np.minimum(np.diff(np.append(new, len(key))), 2).astype(np.int8)
            offsets = np.searchsorted(owner[new], np.arange(len(texts) + 1)).astype(np.int32)
            return {
                "n_words": [len(w) for w in split],
                "whole": [hashlib.sha256(b" ".join(w)).hexdigest() for w in split],
                "phrases": pa.ListArray.from_arrays(offsets, pa.array(key[new].view(np.int64))),
                "times": pa.ListArray.from_arrays(offsets, pa.array(times)),
            }

        return work

    return start


def by_text(df: DataFrame, schema: str, work: Callable[[dict, WordHashes], Iterator[tuple]]) -> DataFrame:
    """Rows that one row with a text makes, a bounded number of bytes of text at a time."""
    kinds = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in chain.from_iterable(slices(b, "text", 1 << 20) for b in batches):
            rows = [x for row in part.to_pylist() for x in work(row, known)]
            for at in range(0, len(rows), 16384):
                columns = list(zip(*rows[at : at + 16384]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.types)], schema=kinds)

    return df.mapInArrow(run, schema)


def stretches(window: int, phrase: int) -> Callable[[dict, WordHashes], Iterator[tuple]]:
    """Stretches of a text whose phrase is repeated, alike ones once with their number."""

    def work(row: dict, known: WordHashes) -> Iterator[tuple]:
        h = hashed(words_of(row["text"]), known)
        g, place, first, size = phrases(h, window, phrase)
        wanted = np.isin(g[place].view(np.int64), np.array(row["repeated"], np.int64))
        found: dict[tuple[int, int], list[int]] = {}
        for p, a, n in zip(place[wanted].tolist(), first[wanted].tolist(), size[wanted].tolist()):
            around = xxhash.xxh3_64_intdigest(h[a : a + n + window - 1].tobytes(), seed=p - a)
            found.setdefault((int(g[p].view(np.int64)), around - (1 << 63)), [0, a, n, p - a])[0] += 1
        for (key, around), (times, a, n, at) in found.items():
            yield key, around, times * row["copies"], row["digest"], a, n, at

    return work


def worded(window: int) -> Callable[[dict, WordHashes], Iterator[tuple]]:
    """Chosen stretches with a hash for each window, and their words if other texts have them."""

    def work(row: dict, known: WordHashes) -> Iterator[tuple]:
        words = words_of(row["text"])
        all_windows = grams(hashed(words, known), window).view(np.int64)
        for s in row["chosen"]:
            a, n = s["first"], s["size"]
            text = b" ".join(words[a : a + n + window - 1]).decode() if s["shared"] else None
            yield s["phrase"], s["around"], s["times"], row["digest"], text, all_windows[a : a + n]

    return work


class Automaton:
    """Phrases over an alphabet of words, and the windows that each occurrence is held against."""

    def __init__(self, window: int, phrase: int):
        self.window, self.phrase = window, phrase
        self.letters: dict[bytes, str] = {}
        self.windows: set[str] = set()
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)

    def letter(self, word: bytes) -> str:
        known = self.letters.get(word)
        if known is None:
            code = len(self.letters) + 1
            known = self.letters[word] = chr(code + 0x800 if code >= 0xD800 else code)  # no surrogates
        return known

    def add(self, words: list[bytes], at: int, starts: list[int]) -> None:
        line = "".join(map(self.letter, words))
        self.trie.add_word(line[at : at + self.phrase])
        self.windows.update(line[s : s + self.window] for s in starts)

    def full(self) -> bool:
        return len(self.letters) > ALPHABET

    def find(self, words: list[bytes]) -> list[int]:
        """Starts of all confirmed windows in a text."""
        line = "".join([self.letters.get(w, "\0") for w in words])
        found, tried, last = [], 0, len(line) - self.window
        for end, _ in self.trie.iter(line):
            p = end - self.phrase + 1
            for s in range(max(tried, end + 1 - self.window), min(p, last) + 1):
                if line[s : s + self.window] in self.windows:
                    found.append(s)
            tried = max(tried, p + 1)
        return found


def covered(starts: list[int], window: int) -> list[dict]:
    """Spans of words under windows, joined where they meet."""
    spans: list[dict] = []
    for s in sorted(starts):
        if spans and s <= spans[-1]["start"] + spans[-1]["length"]:
            spans[-1]["length"] = s + window - spans[-1]["start"]
        else:
            spans.append({"start": s, "length": window})
    return spans


SPANS = "array<struct<start: bigint, length: bigint>>"


def twice_in(rows: Iterator[dict]) -> Iterator[tuple]:
    """Windows of the stretches of one phrase that occur twice at least."""
    for row in rows:
        seen: dict[int, int] = {}
        for s in row["kinds"]:
            for w in s["windows"]:
                seen[w] = seen.get(w, 0) + s["times"]
        for s in row["kinds"]:
            starts = [i for i, w in enumerate(s["windows"]) if seen[w] > 1]
            if starts:
                yield row["phrase"], s["around"], starts


def located(window: int, phrase: int, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spans of texts, by automata of the stretches that a bounded number of them may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chain.from_iterable(slices(b, "text", limit) for b in batches):
            split = [words_of(t) for t in part.column("text").to_pylist()]
            automata = [Automaton(window, phrase)]
            done: set[tuple[int, int]] = set()
            for words, stretches_ in zip(split, part.column("passages").to_pylist()):
                for s in stretches_:
                    if (s["phrase"], s["around"]) in done:
                        continue
                    done.add((s["phrase"], s["around"]))
                    if automata[-1].full():
                        automata.append(Automaton(window, phrase))
                    line = words[s["first"] : s["first"] + s["size"] + window - 1]
                    automata[-1].add(line if s["words"] is None else s["words"].encode().split(), s["at"], s["starts"])
            for a in automata:
                a.trie.make_automaton()
            out: dict[str, list] = {"spans": [], "n_removed": [], "kept_sha256": []}
            for words in split:
                spans = covered(list(chain.from_iterable(a.find(words) for a in automata)), window)
                ends = [0, *(s["start"] + s["length"] for s in spans)]
                starts = [*(s["start"] for s in spans), len(words)]
                kept = chain.from_iterable(words[a:b] for a, b in zip(ends, starts))
                out["spans"].append(spans)
                out["n_removed"].append(sum(s["length"] for s in spans))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
            span = pa.struct([("start", pa.int64()), ("length", pa.int64())])
            kinds = {"spans": pa.list_(span), "n_removed": pa.int64(), "kept_sha256": pa.string()}
            columns = [pa.array(out[k], t) for k, t in kinds.items()]
            yield pa.RecordBatch.from_arrays([part.column("digest"), *columns], names=["digest", *kinds])

    return run


def as_buckets(df: DataFrame, key: str) -> DataFrame:
    """The rows as a table in buckets of a key in the shared folder, so that joins on it move the
    other side only."""
    spark, name = df.sparkSession, f"docmill_llm_{uuid.uuid4().hex}"
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.bucketBy(number, key).sortBy(key).option("path", f"{shared_folder(spark)}/{name}")
    writer.saveAsTable(name)
    return spark.table(name)


def repeated_passages(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, phrase: int = PHRASE
) -> DataFrame:
    """Per row: its id, ``n_words``, ``n_removed``, ``kept_sha256`` and the ``spans`` of words
    (start and length) that lie under a window of words that starts anywhere else too.

    All texts are read whole. Null, empty and blank texts have no words and no spans, and so has
    a text shorter than a window. Texts that are alike are handled once and counted as often as
    they occur, so every copy of a long enough text goes, as windows are judged on the input. A
    text that repeats itself loses those words. Rows with null or repeated ids are rows of their
    own. An empty table gives an empty result; columns that are not named are not read.
    """
    digest = F.unhex(F.md5(F.col(f"`{text}`").cast("binary"))).alias("digest")
    docs = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), digest)
    fields = T._parse_datatype_string("n_words bigint, whole string, phrases array<bigint>, times array<tinyint>")
    seen = per_text(docs, "text", ["id", "digest"], fields, scan(window, phrase))
    seen = settled(seen.withColumn("row", F.monotonically_increasing_id()))

    pairs = F.explode(F.arrays_zip("phrases", "times")).alias("x")
    often = seen.select(pairs).groupBy(F.col("x.phrases").alias("phrase")).agg(F.sum("x.times").alias("n"))
    often = often.where("n > 1").select("phrase")
    mine = seen.select("row", F.explode("phrases").alias("phrase")).join(often, "phrase", "left_semi")
    mine = mine.join(seen.where("digest is not null").select("row", "digest"), "row")
    lists = mine.groupBy("digest").agg(F.collect_set("phrase").alias("repeated"))
    texts = docs.where("digest is not null").groupBy("digest")
    texts = texts.agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    texts = as_buckets(texts.join(lists, "digest"), "digest")

    fields = "phrase bigint, around bigint, times bigint, digest binary, first bigint, size bigint, at bigint"
    parts = settled(by_text(texts, fields, stretches(window, phrase)))
    one = F.min(F.struct("digest", "first", "size")).alias("one")
    shared = (F.min("digest") != F.max("digest")).alias("shared")
    kinds = parts.groupBy("phrase", "around").agg(F.sum("times").alias("times"), one, shared)
    chosen = F.collect_list(F.struct("phrase", "around", "times", "one.first", "one.size", "shared")).alias("chosen")
    kinds = texts.select("digest", "text").join(kinds.groupBy("one.digest").agg(chosen), "digest")
    fields = "phrase bigint, around bigint, times bigint, digest binary, words string, windows array<bigint>"
    kinds = settled(by_text(kinds, fields, worded(window)))

    starts = confirmed(kinds)
    found = kinds.select("phrase", "around", F.col("digest").alias("from"), "words").join(starts, ["phrase", "around"])
    found = parts.join(found, ["phrase", "around"])
    words = F.when(F.col("digest") != F.col("from"), F.col("words")).alias("words")
    found = found.groupBy("digest").agg(
        F.collect_list(F.struct("phrase", "around", "first", "size", "at", words, "starts")).alias("passages")
    )
    found = texts.select("digest", "text").join(found, "digest")
    fields = f"digest binary, spans {SPANS}, n_removed bigint, kept_sha256 string"
    found = found.mapInArrow(located(window, phrase, BATCH_BYTES), fields)
    out = seen.select("id", "digest", "n_words", "whole").join(found, "digest", "left")
    return out.select(
        F.col("id").alias(doc_id),
        "n_words",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
        F.coalesce("spans", F.array().cast(SPANS)).alias("spans"),
    )


def confirmed(kinds: DataFrame) -> DataFrame:
    """``phrase, around, starts``: the windows of each stretch that occur twice at least. Phrases
    of few different stretches are counted as one row each; those of many, whatever their number,
    window by window."""
    slim = kinds.select("phrase", "around", "times", "windows")
    many = slim.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > STRETCHES).select("phrase")
    few = slim.join(many, "phrase", "left_anti").groupBy("phrase")
    few = few.agg(F.collect_list(F.struct("around", "times", "windows")).alias("kinds"))
    schema = "phrase bigint, around bigint, starts array<int>"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = list(twice_in(batch.slice(at, 1024).to_pylist()))
                columns = list(zip(*rows)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)

    windows = slim.join(many, "phrase", "left_semi")
    windows = windows.select("phrase", "around", "times", F.posexplode("windows").alias("start", "window"))
    twice = windows.groupBy("phrase", "window").agg(F.sum("times").alias("n")).where("n > 1").drop("n")
    starts = windows.join(twice, ["phrase", "window"]).groupBy("phrase", "around")
    return few.mapInArrow(run, schema).unionByName(starts.agg(F.collect_list("start").alias("starts")))
