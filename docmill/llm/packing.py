"""Best-fit packing, certified by lower bounds and repacked where they leave a gap."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docmill.llm.shared import slices

CAPACITY = 2048
END_ID = 0
#: Tokens that one partition packs; about 2000 sequences of 2048 tokens.
PARTITION_TOKENS = 4_000_000
#: For every sequence above its bound, a partition gives up so many of its emptiest ones.
RELEASED = 8
ROUNDS = 4
#: A task forgets the words it has seen beyond so many.
SEEN_WORDS = 1_000_000
#: Marks that end a run of letters and are a token of their own behind one.
MARKS = ".,!?;:"


class WordIds(dict):
    """Ids of words, as bytes, for a tokenizer that drops white space and cuts words where
    letters end. Words are encoded once; white space bounds what can influence a word."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.as_bytes = [i.to_bytes(4, "little") for i in range(size)]
        self.is_end = np.zeros(size, bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.marks = {m: self.whole([m])[0] for m in MARKS}
        self.marks[""] = b""

    def learn(self, words: set[str]) -> None:
        """Encode words; one mark behind a letter is a token of its own."""
        if len(self) + len(words) > SEEN_WORDS:
            self.clear()
        plain: dict[str, list] = {}
        stems: dict[str, list] = {}
        rest = []
        for word in words:
            stem, mark = (word[:-1], word[-1]) if word[-1:] in self.marks else (word, "")
            low = stem.lower()
            if not stem.isalpha() or not low.isalpha():  # a capital can lose its mark
                rest.append(word)
            elif stem.isascii():
                plain.setdefault(low, []).append((word, mark))
            else:
                stems.setdefault(stem, []).append((word, mark))
        as_bytes = self.as_bytes
        for low, forms in plain.items():
            ids = b"".join([as_bytes[t.id] for t in self.model.tokenize(low)])
            for word, mark in forms:
                self[word] = ids + self.marks[mark]
        for stem, ids in zip(stems, self.letters(list(stems))):
            for word, mark in stems[stem]:
                self[word] = ids + self.marks[mark]
        self.update(zip(rest, self.whole(rest)))

    def whole(self, words: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(words), 4096):
            encoded = self.tokenizer.encode_batch_fast(words[at : at + 4096], add_special_tokens=False)
            out += [np.array(e.ids, "<u4").tobytes() for e in encoded]
        return out

    def letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only, many in one call: the last token of each is marked as
        the end of a word. Where a word gives several ends, its group is encoded word by word."""
        groups = [words[at : at + 256] for at in range(0, len(words), 256)]
        encoded = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        out: list[bytes] = []
        for group, found in zip(groups, encoded):
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(group):
                out += self.whole(group)
            else:
                out += [part.tobytes() for part in np.split(ids, ends[:-1])]
        return out


def cut(text: str | None) -> list[str]:
    """Words between white space that every tokenizer takes for white space."""
    if not text:
        return []
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def pieces_of(
    df: DataFrame,
    path: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Documents as pieces of at most ``capacity`` tokens, each document closed by ``end_id``.

    Null and empty texts are the end token alone. Repeated rows give repeated pieces."""
    kept = [df.schema[c] for c in keep]
    new = [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    if with_ids:
        new.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(kept + new)
    arrow = to_arrow_schema(schema)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds(path)
        for batch in batches:
            for part in slices(batch, "text__"):
                words = [cut(t) for t in part.column("text__").to_pylist()]
                missing = set().union(*words).difference(known)
                missing.discard("")
                if len(known) + len(missing) > SEEN_WORDS:
                    missing = set().union(*words) - {""}
                known.learn(missing)
                known[""] = b""
                row, cols = [], {f.name: [] for f in new}
                for i, chunk in enumerate(words):
                    ids = b"".join(map(known.__getitem__, chunk)) + end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        row.append(i)
                        cols["piece"].append(n)
                        cols["start"].append(at // 4)
                        cols["length"].append(len(piece) // 4)
                        cols["ids_crc32"].append(zlib.crc32(piece))
                        if with_ids:
                            cols["ids"].append(np.frombuffer(piece, "<u4").astype(np.int32))
                at = pa.array(row, pa.int64())
                arrays = [part.column(i).take(at) for i in range(len(kept))]
                arrays += [pa.array(cols[f.name], arrow.field(f.name).type) for f in new]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    chosen = [F.col(f"`{c}`") for c in keep] + [F.col(f"`{text}`").alias("text__")]
    return df.select(*chosen).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: bin and place of every item, and the number of bins.

    Open bins are stacked by the room they have left; a bit per room tells which stacks have
    any, so the tightest bin that fits is found at once."""
    order = np.argsort(-lengths, kind="stable")
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, n = 0, 0
    for item, length in zip(order.tolist(), lengths[order].tolist()):
        fits = open_rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            own = stacks[room].pop()
            if not stacks[room]:
                open_rooms ^= 1 << room
        else:
            room, own, n = capacity, n, n + 1
        bins[item], places[item] = own, capacity - room
        left = room - length
        if left:
            if not stacks[left]:
                open_rooms |= 1 << left
            stacks[left].append(own)
    return bins, places, n


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual-feasible functions on the counts of lengths.

    One family drops small items and rounds large ones up to a whole bin, the other rounds
    sizes down to multiples of 1/k; all sums are whole numbers."""
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    total = int((sizes * counts).sum())
    best = -(-total // capacity)
    for least in sizes[2 * sizes <= capacity].tolist():
        large, middle = sizes > capacity - least, (sizes >= least) & (sizes <= capacity - least)
        value = capacity * int(counts[large].sum()) + int((sizes * counts)[middle].sum())
        best = max(best, -(-value // capacity))
    for k in range(1, 101):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, k * sizes, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def pack_once(pieces: DataFrame, capacity: int, turn: int) -> DataFrame:
    """Each partition packed by itself, with its number of bins and its bound. A partition
    releases its emptiest bin, and with a gap several."""
    extra = "sequence_id long, offset long, bins long, bound long, released boolean"
    names = pieces.columns
    schema = T.StructType(pieces.schema.fields + T._parse_datatype_string(extra).fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        lengths = table.column("length").to_numpy()
        own, places, n = best_fit(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        fill = np.bincount(own, weights=lengths, minlength=n)
        given = np.zeros(n, bool)
        given[np.argsort(fill, kind="stable")[: max(1, RELEASED * (n - bound))]] = True
        first = (turn << 52) | (TaskContext.get().partitionId() << 28)
        arrays = [table.column(c).combine_chunks() for c in names] + [
            pa.array(first + own, pa.int64()),
            pa.array(places, pa.int64()),
            pa.array(np.full(len(own), n), pa.int64()),
            pa.array(np.full(len(own), bound), pa.int64()),
            pa.array(given[own], pa.bool_()),
        ]
        for batch in pa.Table.from_arrays(arrays, schema=arrow).to_batches(10_000):
            yield batch

    return pieces.mapInArrow(run, schema)


def pack(
    pieces: DataFrame,
    settle,
    capacity: int = CAPACITY,
    partition_tokens: int = PARTITION_TOKENS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Pieces with ``sequence_id``, ``offset`` and the certificate of the partition that packed
    them (``bins`` used, ``bound`` that any packing of its pieces needs).

    Pieces are dealt evenly to partitions, whatever their keys. Partitions release their
    emptiest bin, and several for each bin above their bound; the released pieces are dealt anew, to
    partitions twice as large in each round, and packed again. A round is kept if it needs fewer bins than were released. ``settle`` stores a
    DataFrame that is read more than once."""
    columns = pieces.columns
    work, done, held = settle(pieces), [], None
    for turn in range(rounds):
        tokens = work.agg(F.sum("length")).first()[0] or 0
        parts = max(1, -(-tokens // (partition_tokens << turn)))
        packed = settle(pack_once(work.repartition(int(parts)), capacity, turn))
        used, free = packed.agg(
            F.countDistinct("sequence_id"), F.countDistinct(F.expr("if(released, sequence_id, null)"))
        ).first()
        if held is not None and used >= held[1]:
            packed, free = held[0], 0  # the exchange gained nothing: the packing before stays
            done.append(packed)
            break
        if turn == rounds - 1 or parts == 1 or not free:
            done.append(packed)
            break
        done.append(packed.where(~F.col("released")))
        held = (packed.where("released"), free)
        work = held[0].select(*columns)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("released")
