"""The registered queries over the smallest tables: contract columns, and plain versions."""

import math
import os
import shutil
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pytest

import corpus_pipeline
from docmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
COLUMNS = {
    "op1": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2": "doc_id piece start length ids_crc32 sequence_id offset",
    "op3": "doc_id held_out lang_pred score",
    "op4": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op5": "doc_id n_bytes n_tokens over_limit",
    "op6": "query_id rank vec_id score",
    "op7": "doc_id size source_size target taken",
    "op8": "doc_id held_out score predicted",
    "op9": "doc_id n_shingles component_id kept",
    "op10": "page_id url text n_chars",
    "op11": "anchor_id positive_id rank negative_id positive_score negative_score",
    "op13": "doc_id n_words n_removed kept_sha256",
    "op12": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
}
PER_ROW = {"op1", "op3", "op4", "op5", "op7", "op8", "op9", "op10"}


@pytest.fixture(scope="module")
def results(spark):
    return {name.split("_")[0]: run(spark, SF).toPandas() for name, run in QUERIES.items()}


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("op", COLUMNS)
def test_columns_and_rows(results, docs, op):
    wanted = COLUMNS[op].split()
    assert list(results[op].columns[: len(wanted)]) == wanted
    if op in PER_ROW:
        rows = len(docs) if op != "op10" else len(pd.read_parquet(f"{SF}/pages.parquet"))
        assert len(results[op]) == rows


def test_folds(results):
    for op, parts, rest in (("op3", 4, 2), ("op4", 7, 2), ("op8", 5, 0)):
        for r in results[op].itertuples():
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest)


def test_base_scores(results, docs):
    texts = {i: [*t.encode().lower().split(), None] for i, t in zip(docs.doc_id, docs.text)}
    held = dict(zip(results["op4"].doc_id, results["op4"].held_out))
    c = Counter(w for i, words in texts.items() if not held[i] for w in words)
    floor = math.log10(sum(c.values()) + len(c) + 1)
    for r in results["op4"].itertuples():
        want = sum(math.log10(c[w] + 1) - floor for w in texts[r.doc_id])
        assert abs(r.base_score - want) < 1e-6 and r.train_tokens == sum(c.values())


def test_near_duplicates(results, docs):
    sets = {}
    for i, t in zip(docs.doc_id, docs.text):
        w = t.encode().lower().split()
        sets[i] = frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for r in results["op9"].itertuples():
        assert (r.component_id, r.n_shingles, r.kept) == (find(r.doc_id), len(sets[r.doc_id]), find(r.doc_id) == r.doc_id)


def test_mixture(results, docs):
    source = dict(zip(docs.doc_id, docs.source))
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in results["op7"].itertuples():
        s = source[r.doc_id]
        size[s], taken[s], target[s] = size[s] + r.size, taken[s] + r.taken, r.target
        assert r.taken <= 2 * r.size
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1
    longest = results["op7"]["size"].max()
    assert all(abs(taken[s] - target[s]) <= longest for s in size)


def test_pipeline(spark, tmp_path):
    """Planted cases go or stay, stage by stage; whatever is kept is packed whole."""
    for name in ("documents", "labels"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = docs.where("length(text) > 400").limit(1).collect()[0]
    extra = [
        (9001, clean.text, "en", "src1", 1), (9002, clean.text + " tail", "en", "src1", 1),
        (9003, "12 34 56 !!", None, None, None), (9004, None, None, None, None), (9005, "", "en", "", 0),
        (9001, clean.text, "en", "src1", 1),
    ]
    frame = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    clean_ids = {r.doc_id for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        path = f"{tmp_path}/stage-{name}"
        out.write.parquet(path)
        if name != "packing":
            assert out.columns == docs.columns
            kept[name] = [r.doc_id for r in spark.read.parquet(path).select("doc_id").collect()]
        frame = spark.read.parquet(path)
    assert {9003, 9004, 9005} <= set(kept["toxicity"]) and not {9003, 9004, 9005} & set(kept["language_id"])
    assert len(set(kept["language_id"]) & clean_ids) >= 0.98 * len(set(kept["toxicity"]) & clean_ids)
    single = kept["near_duplicates"]
    assert len(single) == len(set(single)) and 9001 not in single and 9002 not in single
    counts = Counter(kept["mixture"])
    assert set(counts) <= set(single) and max(counts.values()) <= 2
    pieces = frame.toPandas()
    assert (pieces.groupby("sequence_id").length.sum() <= 2048).all()
    assert Counter(pieces[pieces.piece == 0].doc_id) == counts


def test_entry_works_without_the_subpackage(tmp_path):
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(k.startswith('op') for k in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, check=True)
    number, pipeline, operators = done.stdout.split()[-3:]
    assert int(number) > 60 and (pipeline, operators) == ("False", "False")
