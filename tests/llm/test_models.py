import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
from conftest_llm import ODD, prose, vocabulary
from pyspark.sql import functions as F

from docmill.llm import language, lm, toxicity
from docmill.llm.shared import learn_fold

SETS = {"xx": vocabulary(11), "yy": [w[::-1] + "o" for w in vocabulary(12)], "zz": [f"ñ{w}é" for w in vocabulary(13)]}


def fold(i, parts):
    return zlib.crc32(("" if i is None else str(i)).encode()) % parts


def test_language_held_out(make_docs):
    rng = random.Random(1)
    names = list(SETS)
    rows = [
        (i, prose(rng, rng.randint(1, 60), SETS[names[i % 3]]), names[i % 3] if i % 7 else None, "s")
        for i in range(400)
    ]
    rows += [(1000 + i, t, "xx" if i % 2 else None, None) for i, t in enumerate(ODD)]
    rows += [(None, rows[0][1], "xx", None)] * 2
    df = make_docs(rows)
    held_out = learn_fold("doc_id", 4) == 2
    found = language.identify(df, ~held_out).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    held = [i for i in range(400) if fold(i, 4) == 2]
    right = sum(by_id[i].lang_pred == names[i % 3] for i in held)
    assert right >= 0.97 * len(held)
    for i, t in enumerate(ODD):
        r = by_id[1000 + i]
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or "")), t
        assert 0 <= r.score <= 1
    # The language column of held-out rows changes nothing.
    other = df.withColumn("lang", F.when(held_out, F.lit("xx")).otherwise(F.col("lang")))
    again = {r.doc_id: r for r in language.identify(other, ~held_out).collect()}
    assert all(again[i] == by_id[i] for i in by_id)
    none = language.identify(df, F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert language.identify(make_docs([]), F.lit(True)).collect() == []


def test_most_weights_of_features_seen_are_zero(make_docs):
    rng = np.random.default_rng(4)
    words = {la: ["".join(rng.choice(list(own), 6)) for _ in range(300)] for la, own in {"a": "abcdefgh", "b": "efghijkl"}.items()}
    rows = [(i, " ".join(rng.choice(words["ab"[i % 2]], 40)), "ab"[i % 2], "s") for i in range(400)]
    model = language.fit(make_docs(rows))
    letters = language.letter_table()
    seen = np.unique(np.concatenate([language.features(r[1], letters)[0] for r in rows]))
    assert len(seen) > 500
    assert 0.5 < (model.weights[seen] == 0).mean() < 1.0


def test_leader_weights_are_sparse():
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(300):
        at = np.unique(rng.integers(0, 50, 8)) + 100 * (i % 2)
        rows.append((at, np.full(len(at), 1 / math.sqrt(len(at)))))
        labels.append(i % 2)
    weights = language.follow_the_leader(rows, np.array(labels), 2, 1, 0.3)
    assert (weights == 0).mean() > 0.99
    assert all((x @ weights[at]).argmax() == y for (at, x), y in zip(rows, labels))
    logits = np.array([[4.0, 0.0]] * 90 + [[0.0, 4.0]] * 10)
    assert language.fit_temperature(logits, np.zeros(100, int)) > 1.5  # too sure of itself


def plain_base(texts, learned):
    split = [[w for w in (t or "").encode().lower().split()] + [None] for t in texts]
    c = Counter(w for words, use in zip(split, learned) if use for w in words)
    n, v = sum(c.values()), len(c)
    return [
        (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + 1 * (v + 1))) for x in w))
        for w in split
    ]


def test_lm_scores(make_docs):
    rng = random.Random(3)
    words = SETS["xx"]
    after = {w: rng.sample(words, 3) for w in words}

    def chain(n):
        out = [rng.choice(words)]
        while len(out) < n:
            out.append(rng.choice(after[out[-1]]))
        return " ".join(out)

    texts = ODD + [chain(rng.randint(5, 300)) for _ in range(500)] + ["Unseen wörds HERE"]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    learn = [fold(i, 7) != 2 for i in range(len(texts))]
    found = lm.score(make_docs(rows), learn_fold("doc_id", 7) != 2).collect()
    assert len(found) == len(rows)
    want = plain_base(texts, learn)
    gain = total = 0
    for r in found:
        n, known, tokens, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, tokens)
        assert abs(r.base_score - base) < 1e-6
        assert r.score < 0 and (r.bits_per_byte is None) == (not texts[r.doc_id])
        if not learn[r.doc_id] and len(ODD) <= r.doc_id < len(texts) - 1:
            gain, total = gain + r.score - base, total + n
    assert gain / total > 0.8  # three successors, not four hundred words
    nothing = lm.score(make_docs(rows[:12]), F.lit(False)).collect()
    assert all(r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in nothing)
    assert lm.score(make_docs([]), F.lit(True)).collect() == []


def test_huffman_code_is_a_tree():
    code = lm.huffman(np.array([50, 1, 1, 7, 7, 30]))
    lengths = np.diff(code.starts)
    assert abs(sum(2.0**-n for n in lengths) - 1) < 1e-12
    assert lengths[0] == lengths.min() and lengths[1] == lengths.max()
    paths = [tuple(code.bits[code.starts[s] : code.starts[s + 1]]) for s in range(6)]
    assert len(set(paths)) == 6


def test_lm_probabilities_sum_to_one():
    """Over all symbols that may come next, the model's probabilities add up to one."""
    rng = np.random.default_rng(4)
    code = lm.huffman(np.array([5, 9, 2, 2, 30, 1]))
    tables = rng.standard_normal((lm.WORD_TABLES + lm.BYTE_TABLES, lm.SLOTS)).astype(np.float32)
    known = rng.integers(0, 3, lm.SLOTS).astype(np.uint8)
    weights = rng.standard_normal((lm.GATES, lm.PREDICTORS)) / 3
    hashes = np.arange(1, 6) * 7919
    model = lm.Model(hashes, np.arange(1, 6), code, tables, known, weights, np.zeros((8, lm.BYTE_TABLES)))
    coder = lm.Coder(*model[:3])
    start = np.array([3, 1, 4])
    costs = []
    for s in range(6):
        symbols = np.append(start, s)
        own = np.append(hashes[start - 1], hashes[s - 1] if s else 1)
        starts = np.array([0, 4])
        contexts = coder.contexts(symbols, own, starts)
        whole = lm.text_bits(symbols, contexts, starts, model)[0]
        costs.append(whole - lm.text_bits(start, contexts[:, :3], np.array([0, 3]), model)[0])
    assert abs(sum(2.0**-c for c in costs) - 1) < 1e-4
    words = [bytes([b]) for b in range(256) if b != 10]
    model = model._replace(byte_weights=rng.standard_normal((8, lm.BYTE_TABLES)) / 3)
    first = lm.spelling_bits([b""], model)[0]
    ends = lm.spelling_bits([w + b"" for w in words], model)
    assert first > 0 and (ends > 0).all()


RUDE = "idiot scum trash moron".split()


def toxic_rows(seed, n=700):
    rng = random.Random(seed)
    words = SETS["xx"]
    rows, labels = [], []
    for i in range(n):
        text = prose(rng, rng.randint(5, 80), words).split()
        toxic = i % 6 == 0
        if toxic:
            for w in rng.choices(RUDE, k=2):
                text.insert(rng.randint(0, len(text)), w)
        rows.append((i, " ".join(text), "xx", "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark, make_docs):
    rows, known = toxic_rows(5)
    rows += [(2000 + i, t, None, None) for i, t in enumerate(ODD)] + [(None, "an idiot", None, None)]
    labels = spark.createDataFrame([*known, known[0], (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    df = make_docs(rows)
    index = toxicity.fit(df, labels, learn_fold("doc_id", 5) != 0)
    found = toxicity.predict(df, index).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    held = [(i, y) for i, _, y in known if fold(i, 5) == 0]
    assert all(by_id[i].predicted == y for i, y in held)
    assert by_id[None].predicted == 1 and set(by_id[None].terms) & {"idiot", "idio*", "idiot*"}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(by_id[2000 + i].predicted == 0 for i in range(len(ODD)))
    # Labels of held-out rows change nothing.
    other = labels.withColumn("toxic", F.when(learn_fold("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.predict(df, toxicity.fit(df, other, learn_fold("doc_id", 5) != 0)).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in found}
    empty = toxicity.fit(make_docs([]), labels.limit(0), F.lit(True))
    assert toxicity.predict(make_docs([]), empty).collect() == []
    assert all(r.score == 0 and r.predicted == 0 for r in toxicity.predict(df, empty).collect())


def test_index_finds_the_exact_neighbours():
    rng = np.random.default_rng(6)
    terms = [f"t{i}" for i in range(40)]
    idf = rng.random(40) + 0.5
    examples = []
    for i in range(600):
        at = rng.choice(40, rng.integers(0, 6), replace=False)
        examples.append((i, int(rng.integers(2)), {int(t): int(rng.integers(1, 4)) for t in at}, 1.0))
    index = toxicity.Index(terms, idf, examples)
    dense = np.zeros((600, 40))
    for i, _, counts, _ in examples:
        if counts:
            at, values = index.vector(counts)
            dense[i, at] = values
    for _ in range(50):
        at = rng.choice(40, 4, replace=False)
        at, values = index.vector({int(t): 1 for t in at})
        query = np.zeros(40)
        query[at] = values
        best = np.sort(dense @ query)[::-1][: toxicity.NEIGHBOURS]
        ids, sims = index.nearest(at, values)
        assert np.allclose(sims, best[: len(sims)]) and (best[len(sims) :] == 0).all()
        assert np.allclose(dense[index.ids[ids]] @ query, sims)


def test_index_of_all_words(spark, make_docs):
    """No word is left out: few toxic documents, and words that no label makes likelier, count."""
    rng = random.Random(8)
    words = SETS["xx"]
    rows = [(i, " ".join(rng.choices(words, k=30)), None, None) for i in range(300)]
    rows += [(1000 + i, rows[i][1], None, None) for i in range(20)] + [(2000, "...", None, None)]
    labels = spark.createDataFrame([(i, 1, int(i < 4)) for i in range(300)], "doc_id long, quality int, toxic int")
    index = toxicity.fit(make_docs(rows), labels, F.lit(True))
    assert set(index.terms) == {t for _, text, _, _ in rows for w in toxicity.TOKEN.findall(text) for t in toxicity.terms_of(w)}
    found = {r.doc_id: r for r in toxicity.predict(make_docs(rows), index).collect()}
    assert all(found[1000 + i].neighbours[0] == i and len(found[i].terms) == 3 for i in range(20))
    assert found[2000].neighbours == []


def test_index_with_rare_and_common_terms_is_exact():
    rng = np.random.default_rng(9)
    n = 3000
    chance = 1 / np.arange(1, n + 1)
    idf, examples = rng.random(n) + 0.5, []
    for i in range(1500):
        at = np.unique(rng.choice(n, 40, p=chance / chance.sum()))
        examples.append((i, i % 2, {int(t): int(rng.integers(1, 4)) for t in at}, 1.0))
    index = toxicity.Index([f"t{i}" for i in range(n)], idf, examples)
    assert len(index.rows) and (index.column >= 0).sum() == toxicity.COMMON
    dense = np.zeros((1500, n))
    for i, _, counts, _ in examples:
        at, values = index.vector(counts)
        dense[i, at] = values
    queries = [index.vector(examples[i][2]) for i in range(0, 1500, 10)]
    for (at, values), (ids, sims) in zip(queries, index.nearest_of(queries, [-1] * len(queries))):
        want = dense[:, at] @ values
        assert np.allclose(sims, np.sort(want)[::-1][:32]) and np.allclose(want[index.ids[ids]], sims)


def test_counts_are_those_of_lowered_words():
    odd = [*ODD, "ΟΔΟΣ ΑΣ'Α Σ", "İSTANBUL Kelvin \u212a", "a_b-C3\x1cd\xa0É́e", "x²½ ﬀ ß ẞ", "l'été\u2019s", "É" * 5 + "_" + "É" * 7]
    texts = [t for t in odd if t] + [" ".join(odd[-6:] * 3)]
    for text in texts:
        want = Counter(t for w in toxicity.TOKEN.findall(text.lower()) for t in toxicity.terms_of(w))
        terms = sorted(want)
        at, times = toxicity.counts_of(text, toxicity.Known({t: i for i, t in enumerate(terms)}))
        assert {terms[i]: n for i, n in zip(at.tolist(), times.tolist())} == want
        assert (np.diff(at) > 0).all()


def test_texts_without_a_word_of_the_index():
    """All texts of a batch may be without one."""
    examples = [(i, i % 2, {i % 7: 1, 7 + i: 2}, 1.0) for i in range(40)]
    index = toxicity.Index([f"t{i}" for i in range(47)], np.ones(47), examples)
    none = toxicity.counts_of("!!", index.known)
    assert index.score([none]) == [(index.blank, [], [])]
    assert index.score([none, toxicity.counts_of("t3", index.known)])[1][1][0] == 3


def test_votes_hold_no_copy_of_the_postings():
    rng = np.random.default_rng(3)
    terms, n = 60_000, 2000
    examples = [(i, i % 2, dict.fromkeys(rng.choice(terms, 300, replace=False).tolist(), 1), 1.0) for i in range(n)]
    index = toxicity.Index([f"t{i}" for i in range(terms)], np.ones(terms), examples)
    tracemalloc.start()
    votes = index.votes(np.arange(4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(votes) == 4 and peak < 4 * 300 * n


def test_lm_contexts_tell_two_words_and_four_bytes():
    code = lm.huffman(np.ones(200))
    coder = lm.Coder(np.arange(199), np.arange(1, 200), code)
    hashes = lm.word_hash([b"one", b"same", b"next", b"two", b"same", b"next"])
    seen = coder.contexts(np.array([100, 101, 102, 103, 101, 102]), hashes, np.array([0, 3, 6]))
    assert (seen[:, 2] != seen[:, 5]).any()
    number, slots, _, _ = lm.byte_bits([b"xabcd", b"yabcd", b"xbbcd"])
    ends = [np.flatnonzero(number == i)[-8:] for i in range(3)]  # of the word's end
    same = [[(s[ends[0]] == s[ends[i]]).all() for s in slots] for i in (1, 2)]
    assert same == [[True, True, False], [True, False, False]]


def test_lm_counts_come_from_all_learning_texts(make_docs):
    """Texts held back for the weights are in the tables in the end."""
    rows = [(i, f"left{i} right{i} middle{i}", None, None) for i in range(200)]
    blocks = lm.settled(lm.blocks_of(make_docs(rows), F.lit(True), "text", ("doc_id",)))
    words = sorted({w.encode() for _, t, _, _ in rows for w in t.split()})
    hashes = lm.word_hash(words)
    model = lm.fit(blocks, hashes, np.ones(len(words), np.int64), len(rows), 0)
    coder = lm.Coder(model.hashes, model.symbols, model.code)
    for _, text, _, _ in rows:
        own = lm.word_hash([w.encode() for w in text.split()])
        symbols = coder.symbols_of(own)
        contexts = coder.contexts(symbols, own, np.array([0, 3]))
        word, node, _, _ = coder.expand(symbols)
        assert (model.known[lm.slot(contexts[-1][word], node)] > 0).all()


def test_lm_weights_come_from_all_learning_texts(make_docs, spark):
    """Every word of every text to learn from is a step of the weights, of long texts too."""
    rows = [(i, " ".join(f"w{(i * k) % 97}" for k in range(1, 2500 if i < 4 else 6)), None, None) for i in range(1500)]
    learn = F.col("doc_id") % 5 != 0
    blocks = lm.settled(lm.blocks_of(make_docs(rows), learn, "text", ("doc_id",)))
    hashes = np.sort(lm.word_hash([f"w{i}".encode() for i in range(60)]))
    code = lm.huffman(np.ones(62))
    tables = np.ones((lm.WORD_TABLES + lm.BYTE_TABLES, lm.SLOTS), np.float32)
    known = np.zeros(lm.SLOTS, np.uint8)
    weights = np.zeros((lm.GATES, lm.PREDICTORS)), np.zeros((8, lm.BYTE_TABLES))
    model = lm.Model(hashes, np.arange(1, 61), code, tables, known, *weights)
    coder = lm.Coder(*model[:3])
    want = 0
    for i, text, _, _ in rows:
        if i % 5:
            symbols = coder.symbols_of(lm.word_hash([w.encode() for w in text.split()] + [lm.END]))
            want += len(coder.expand(symbols)[0])
    shared = spark.sparkContext.broadcast(model)
    found = [r for held in (False, True) for r in lm.weight_sums(blocks, shared, lm.HALF, held).collect()]
    assert sum(r.seen for r in found if r.spelled == 0 and r.input == 0) == want


def test_the_driver_makes_no_index(make_docs, spark, monkeypatch):
    """Tasks make the index and count the votes that the curve is fitted on."""
    rows = [(i, f"{'vile' if i % 2 else 'kind'} word{i % 7} w{i}", None, None) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")

    def made(*_):
        raise AssertionError("an index on the driver")

    with monkeypatch.context() as m:
        m.setattr(toxicity.Index, "__init__", made)
        fitted = toxicity.fit(make_docs(rows), labels, F.lit(True))
    assert (fitted.slope, fitted.shift) != (1.0, 0.0)
    found = toxicity.predict(make_docs(rows), fitted).collect()
    assert all(r.predicted == r.doc_id % 2 for r in found)


def test_large_blocks_are_passed_as_often_as_small_ones(spark):
    """The first weights of a block of many words are those of three passes, kept bits or not."""
    rng = np.random.default_rng(6)
    names = [b"a", b"bb", b"c", b"dd", b"e"]
    text = " ".join(names[i].decode() for i in rng.choice(5, 210_000, p=[0.4, 0.3, 0.15, 0.1, 0.05]))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    code = lm.huffman(np.array([1, 50, 30, 15, 10, 5, 1]))
    hashes = lm.word_hash([*names, lm.END])
    order = np.argsort(hashes)
    tables = rng.standard_normal((lm.WORD_TABLES + lm.BYTE_TABLES, lm.SLOTS)).astype(np.float32)
    model = lm.Model(
        hashes[order], order + 1, code, tables, rng.integers(0, 3, lm.SLOTS).astype(np.uint8),
        np.zeros((lm.GATES, lm.PREDICTORS)), np.zeros((8, lm.BYTE_TABLES)),
    )
    blocks = lm.blocks_of(df, F.lit(True), "text", ("doc_id",)).cache()
    shared = spark.sparkContext.broadcast(model)
    found = np.zeros((lm.GATES, lm.PREDICTORS))
    for held in (True, False):
        for r in lm.weight_sums(blocks, shared, 0.5, held).where("spelled = 0 and seen > 0").collect():
            found[r.gate, r.input] = r.total / r.seen
    row = blocks.first()
    words, ids = lm.words_of(row), lm.ids_of(row)
    coder = lm.Coder(*model[:3])
    symbols = coder.symbols_of(lm.word_hash(words))
    contexts = coder.contexts(symbols[ids], lm.word_hash(words)[ids], np.array([0, len(ids)]))
    whole = [
        lm.predictions(coder, tables, model.known, contexts[:, at : at + 50_000], symbols[ids[at : at + 50_000]])[1:]
        for at in range(0, len(ids), 50_000)
    ]
    rates = (lm.FIRST_RATE, lm.FIRST_RATE, lm.FIRST_RATE / 4)
    weights, met = lm.fit_weights(lambda: whole, lm.GATES, lm.PREDICTORS, lm.WORD_START, rates)
    assert np.allclose(found[met > 0], weights[met > 0], atol=1e-9)
    for most in (0, 6, 100):
        parts = lm.kept_parts(lambda done: ([np.zeros(3, np.uint8)] for _ in range(done, 4)), most)
        assert [len(list(parts())) for _ in range(3)] == [4, 4, 4]
