"""Repeated passages against all windows as tuples of words."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from conftest_llm import ODD, prose, vocabulary
from docmill.llm import passages as P


def plain(texts, window=P.WINDOW):
    docs = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(d[s : s + window]) for d in docs for s in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = set()
        for s in range(len(d) - window + 1):
            if seen[tuple(d[s : s + window])] > 1:
                gone.update(range(s, s + window))
        kept = [w for i, w in enumerate(d) if i not in gone]
        out.append((len(d), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = vocabulary(3)
    shared = [prose(rng, n, words) for n in (34, 35, 36, 60, 200)]
    out = []
    for _ in range(150):
        parts = [prose(rng, rng.randint(0, 80), words)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared).split()
            a = rng.randint(0, 10)
            parts += ["\n".join(p[a : len(p) - rng.randint(0, 10)]), prose(rng, rng.choice([0, 5, 50]), words)]
        out.append("  ".join(parts))
    near = out[7].split() + prose(rng, 200, words).split()
    for k in range(8):  # near copies
        out.append(" ".join(near[: 20 + 9 * k] + ["changed"] + near[21 + 9 * k :]))
    out += [out[3]] * 40 + [shared[4]] * 3  # copies
    out += ["w " * 500, "w " * 34, "w " * 35, "w " * 36 + "end", "a b " * 90, "Case " * 20 + "case " * 20]
    out += [prose(rng, 40_000, words) + " " + shared[3] + " " + prose(rng, 5_000, words)]
    return out + ODD + ODD


@pytest.mark.parametrize("few", [500, 2])
def test_like_all_windows(spark, make_docs, texts, monkeypatch, few):
    monkeypatch.setattr(P, "BATCH_BYTES", 60_000)
    monkeypatch.setattr(P, "ALPHABET", 150)
    monkeypatch.setattr(P, "STRETCHES", few)
    rows = [(i if i % 50 else None, t, "en", "s") for i, t in enumerate(texts)]
    got = P.repeated_passages(make_docs(rows).repartition(5)).collect()
    want = Counter((r[0], *p) for r, p in zip(rows, plain(texts)))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert all(r.n_removed == sum(s.length for s in r.spans) for r in got)


def test_empty_table(make_docs):
    assert P.repeated_passages(make_docs([])).collect() == []


def test_registered_query(spark):
    import pandas as pd

    from docmill.llm.queries import QUERIES

    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    got = QUERIES["op13_repeated_passages"](spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")
    for i, p in zip(docs.doc_id, plain(docs.text)):
        assert (got.n_words[i], got.n_removed[i], got.kept_sha256[i]) == p


def test_equal_windows_have_equal_phrases():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 40, 5000).astype(np.uint64)
    for window, phrase in ((35, 8), (9, 4), (5, 5), (12, 1)):
        g, place, first, size = P.phrases(h, window, phrase)
        all_windows, at = P.grams(h, window), np.repeat(place, size)
        assert len(at) == len(all_windows) == size.sum()
        for s in range(0, len(at), 7):
            inside = g[s : s + window - phrase + 1]
            assert at[s] == s + inside.argmin() and (first <= s).sum() == np.searchsorted(np.cumsum(size), s, "right") + 1
        assert len(np.unique(all_windows)) == len({tuple(h[i : i + window]) for i in range(len(all_windows))})


def test_texts_side_by_side_are_texts_alone():
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 9, n).astype(np.uint64) for n in (0, 40, 3, 35, 34, 0, 200, 36, 0)]
    ends = np.cumsum([len(t) for t in texts])
    g, place, first, size = P.phrases(np.concatenate(texts), 35, 8, ends)
    got = [(int(p), int(f), int(n)) for p, f, n in zip(place, first, size)]
    want = []
    for t, end in zip(texts, ends):
        at = end - len(t)
        _, p, f, n = P.phrases(t, 35, 8)
        want += [(int(a + at), int(b + at), int(c)) for a, b, c in zip(p, f, n)]
    assert got == want
