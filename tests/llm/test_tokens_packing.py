import random
import zlib

import numpy as np
import public_tokenizers
from conftest_llm import ODD, prose, vocabulary
from tokenizers import Tokenizer

from docmill.llm import packing, token_counts
from docmill.llm.shared import settled

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SPECIAL = [
    "a <|endoftext|> b<|endoftext|>c",
    "it's we'll DON'T x's. 'tis,",
    "  two  spaces\n\n\tand tabs \r\n end  ",
    "İstanbul ẞ ﬁ é Ωι 中文字 हिन्दी ١٢ Ⅷ ² ½",
    "word.word,word!? ... a.b.c 3.14 1,000",
    "nbsp here   line 　 wide \x85 next \x1f unit",
]


def random_texts(seed):
    rng = random.Random(seed)
    letters = "ab éÉß.,!?;:'\" 019\n\t İǅ中<|>"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(150)]


def test_token_counts_as_the_library_gives_them(make_docs):
    rng = random.Random(3)
    texts = ODD + SPECIAL + random_texts(3) + [prose(rng, 30_000, vocabulary(3))]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(None, "a b", None, None)]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(make_docs(rows), BYTES).collect()}
    library = Tokenizer.from_file(BYTES)
    for i, t, _, _ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes) == (n, len((t or "").encode())), (i, t)
        assert got[i].over_limit == (n > 512)
    assert token_counts.count_tokens(make_docs([]), BYTES).collect() == []


def test_pieces_hold_the_library_ids(make_docs):
    rng = random.Random(4)
    texts = ODD + SPECIAL + random_texts(4) + [prose(rng, 6000, vocabulary(4))]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    pieces = packing.pieces_of(make_docs(rows), WORDS, with_ids=True).collect()
    library = Tokenizer.from_file(WORDS)
    for i, t, _, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.piece)
        assert [x for p in own for x in p.ids] == ids.tolist(), (i, t)
        assert [p.start for p in own] == list(range(0, len(ids), 2048))
        for p in own:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + 2048].tobytes())


def test_best_fit_and_bounds():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = rng.integers(1, 21, rng.integers(1, 9))
        bins, places, n = packing.best_fit(lengths, 20)
        fill = np.bincount(bins, lengths, n)
        assert fill.max() <= 20 and len(fill) == n
        for b in range(n):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(places[own])]
            assert places[own].tolist() == (np.cumsum(lengths[own]) - lengths[own]).tolist()
        least = exact(sorted(lengths.tolist(), reverse=True), 20)
        assert packing.lower_bound(lengths, 20) <= least <= n
    assert packing.lower_bound(np.array([11, 11, 11]), 20) == 3  # rounding beats the total


def exact(items, capacity, rooms=()):
    if not items:
        return len(rooms)
    best = len(rooms) + len(items)
    for k in {r: i for i, r in enumerate(rooms) if r >= items[0]}.values():
        best = min(best, exact(items[1:], capacity, (*rooms[:k], rooms[k] - items[0], *rooms[k + 1 :])))
    return min(best, exact(items[1:], capacity, (*rooms, capacity - items[0])))


def test_pack_loses_nothing(spark, make_docs):
    rng = random.Random(6)
    words = vocabulary(6)
    texts = [prose(rng, rng.randint(1, 900), words) for _ in range(300)] + ["copy of it"] * 200
    pieces = packing.pieces_of(make_docs([(i, t, None, None) for i, t in enumerate(texts)]), WORDS)
    packed = packing.pack(pieces, settled, partition_tokens=20_000).collect()
    want = sorted((p.doc_id, p.piece, p.length) for p in pieces.collect())
    assert sorted((p.doc_id, p.piece, p.length) for p in packed) == want
    bins = {}
    for p in packed:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in bins.values():
        own.sort()
        ends = np.cumsum([n for _, n in own])
        assert [o for o, _ in own] == (ends - [n for _, n in own]).tolist() and ends[-1] <= 2048
    bound = packing.lower_bound(np.array([p.length for p in packed]), 2048)
    alone = packing.pack(pieces, settled, partition_tokens=20_000, rounds=1)
    assert bound <= len(bins) < alone.select("sequence_id").distinct().count()
    assert len(bins) <= 1.08 * bound
    whole = packing.pack(pieces, settled).collect()
    assert len({p.sequence_id for p in whole}) <= bound + 2
    assert packing.pack(packing.pieces_of(make_docs([]), WORDS), settled).collect() == []


def test_batches_are_balanced_by_bytes():
    pieces = [" " + "é" * n for n in range(1, 60)] + [" " + "a" * n for n in range(1, 60)] + [" " + "x" * 900]
    found = token_counts.batches(pieces, 400)
    assert sorted(p for b in found for p in b) == sorted(pieces)
    assert all(sum(len(p.encode()) for p in b) <= 400 or len(b) == 1 for b in found)
