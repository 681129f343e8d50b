import random

import numpy as np
from conftest_llm import ODD, prose, vocabulary

from docmill.llm import near_dups


def sets_of(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def plain(rows, size, percent=80):
    """Components by comparing all pairs."""
    sets = [sets_of(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    members = {}
    for i, (key, _) in enumerate(rows):
        members.setdefault(find(i), []).append(key)
    least = {k: min((x for x in m if x is not None), default=None) for k, m in members.items()}
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]


def changed(rng, text, share):
    words = text.split()
    return " ".join(w if rng.random() > share else w + "x" for w in words)


def test_components_as_all_pairs_give(make_docs):
    rng = random.Random(1)
    words = vocabulary(21)
    passage = prose(rng, 60, words)
    texts = list(ODD)
    for _ in range(25):  # chains of copies, each a little further from the first
        text = prose(rng, rng.randint(3, 150), words)
        texts.append(text)
        for _ in range(rng.randint(0, 8)):
            text = changed(rng, text, 0.04)
            texts.append(text)
    texts += [passage + " " + prose(rng, rng.randint(20, 60), words) for _ in range(60)]
    texts += [changed(rng, passage, 0.07) for _ in range(60)]  # most are close to the limit
    texts += ["Same Text here"] * 40 + ["same text HERE\n"] * 3
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[12]), (None, "nobody else has this"), (14, texts[14])]
    for size in (2, 5):
        want = plain(rows, size)
        found = near_dups.near_duplicates(make_docs([(i, t, None, None) for i, t in rows]), shingle_words=size)
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in found.collect())
        expected = sorted((i is None, i or 0, n, -1 if c is None else c, i == c) for (i, _), (n, c) in zip(rows, want))
        assert got == [tuple(x) for x in expected]


def test_empty_table(make_docs):
    assert near_dups.near_duplicates(make_docs([])).collect() == []


def test_blocks_alone_find_all_links(make_docs, monkeypatch):
    """Without any round of hubs the blocks have to find every link."""
    monkeypatch.setattr(near_dups, "HUB_ROUNDS", 0)
    monkeypatch.setattr(near_dups, "BLOCK", 8)
    rng = random.Random(2)
    base = prose(rng, 80, vocabulary(22))
    rows = [(i, changed(rng, base, 0.03)) for i in range(60)]
    want = plain(rows, 2)
    found = near_dups.near_duplicates(make_docs([(i, t, None, None) for i, t in rows]), shingle_words=2).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: c for (i, _), (_, c) in zip(rows, want)}


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = near_dups.parameters()
    errors = []
    for share in (0.2, 0.5, 0.8, 0.95):
        for _ in range(10):
            n = 400
            both = int(2 * n * share / (1 + share))
            items = rng.integers(0, 1 << 63, 2 * n - both, np.uint64)
            x, y = items[:n], items[n - both :]
            rx, ry = near_dups.registers(x, a, b), near_dups.registers(y, a, b)
            assert (near_dups.registers(items, a, b) == np.maximum(rx, ry)).all()
            errors.append(near_dups.estimate(rx[None], np.array([n]), ry, n)[0] - both / len(items))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.04
