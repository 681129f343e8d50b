import random
from collections import Counter, defaultdict

import numpy as np
from conftest_llm import prose

from docmill.llm import mixing


def plain_targets(sizes, weights, share=1.5, most=2.0):
    """Water-filling by bisection, apart from the loop of the operator."""
    low, high = 0.0, 1e9
    for _ in range(300):
        rate = (low + high) / 2
        got = sum(min(most * s, rate * w) for s, w in zip(sizes, weights))
        low, high = (rate, high) if got < share * sum(sizes) else (low, rate)
    return [min(most * s, low * w) for s, w in zip(sizes, weights)]


def docs_of(seed, n=400):
    rng = random.Random(seed)
    rows = [
        (i, prose(rng, rng.randint(1, 200)), None, rng.choice(["b", "a", "a", "a", "Z", None, "é"]))
        for i in range(n)
    ]
    rows += [(n, None, None, "a"), (n + 1, "", None, "empty"), (None, "x y", None, "a")]
    return rows + [(n + 5, "twice the same", None, "b")] * 2


def test_targets_and_taken(make_docs):
    rows = docs_of(1)
    first, copies = mixing.mix(make_docs(rows), block_words=500, shard_words=4000)
    got = first.collect()
    again = mixing.mix(make_docs(rows[::-1]), block_words=500, shard_words=4000)[0].collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.taken)
    assert sorted(got, key=key) == sorted(again, key=key) and len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = [(5, 2, 1)[i % 3] for i in range(len(order))]
    want = dict(zip(order, plain_targets([sizes[s] for s in order], weights)))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= 200, (s, taken[s], want[s])
    assert copies.select("doc_id", "copy", "shard").distinct().count() <= copies.count()
    per_shard = Counter(r.shard for r in copies.collect())
    assert len(per_shard) > 3


def test_tree_splits_exactly():
    quotas = np.array([17, 0, 230, 4])
    starts = np.zeros(4, int)
    for shard in range(13):
        own, before = mixing.shard_quotas(quotas, 13, shard, 3)
        assert (before == starts).all() and (own >= 0).all()
        assert abs(own.sum() - 251 / 13) < 2
        starts = starts + own
    assert (starts == quotas).all()


def test_mixed_documents_and_empty(make_docs):
    rows = docs_of(2, 100)
    df = make_docs(rows)
    out = mixing.mixed_documents(df, block_words=300, shard_words=2000)
    assert out.columns == df.columns
    words = sum(len((r.text or "").split()) for r in out.collect())
    total = sum(len((r[1] or "").split()) for r in rows)
    assert abs(words - 1.5 * total) < 0.1 * total
    assert mixing.mix(make_docs([]))[0].collect() == []
    assert mixing.mixed_documents(make_docs([])).collect() == []


def test_what_two_sources_hold_alike_is_taken_for_each(make_docs):
    """The same ids and texts in a source that is taken once and in one that is taken twice."""
    rng = random.Random(2)
    alike = [(i, prose(rng, 20), None) for i in range(30)]
    rows = [(*r, s) for r in alike for s in ("a", "b")]
    rows += [(100 + i, prose(rng, 20), None, "a") for i in range(300)]
    out = mixing.mixed_documents(make_docs(rows), weights=(1, 1), block_words=100, shard_words=900)
    got = Counter((r.doc_id, r.source) for r in out.collect())
    assert all(got[(i, "b")] == 2 for i in range(30))
    taken = [got[(r[0], "a")] for r in rows if r[3] == "a"]
    assert min(taken[:30]) == 1 and max(taken) <= 2
    assert abs(20 * sum(taken) - (1.5 * 20 * len(rows) - 2 * 20 * 30)) <= 20
