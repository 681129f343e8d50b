import random
import re
from collections import Counter

from conftest_llm import ODD, prose, vocabulary

from docmill.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:]))
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(covered),
        len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )


def test_base_columns_and_verdict(spark, make_docs):
    rng = random.Random(1)
    words = vocabulary(1)
    clean = [prose(rng, rng.randint(60, 300), words) for _ in range(120)]
    junk = [" ".join(w + "***" for w in prose(rng, 100, words).split()) for _ in range(12)]
    loop = ["round and round we go again " * 30]
    texts = ODD + clean + junk + loop + [clean[0]] * 3
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}") for i, t in enumerate(texts)]
    rows.append((None, clean[1], None, None))
    found = quality.judge(make_docs(rows))
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().toString())
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert len(by_id) == len(rows)
    for i, t, _, _ in rows:
        r = by_id[i]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == plain(t), (i, got, plain(t))
    first = len(ODD)
    assert all(by_id[i].kept for i in range(first, first + 120))
    assert not any(by_id[i].kept for i in range(first + 120, first + 133))
    assert not any(by_id[i].kept for i in range(first) if by_id[i].base_failed)


def test_groups_alike_and_empty_table(spark, make_docs):
    rng = random.Random(2)
    text = prose(rng, 80, vocabulary(2))
    same = quality.judge(make_docs([(i, text, "en", "s") for i in range(40)])).collect()
    assert len(same) == 40 and all(r.kept for r in same)
    assert quality.judge(make_docs([(1, None, None, None)])).collect()[0].kept is False
    assert quality.judge(make_docs([])).collect() == []
