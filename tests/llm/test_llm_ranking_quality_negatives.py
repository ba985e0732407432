"""Ranked search, quality rules and hard negatives against brute force and their oracles, and on edge rows."""

import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import compare
import numpy as np
import pytest
from conftest import ROOT, SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import negatives, quality, ranking, registry
from lorekeep.session import table

NEW = ["op11_ranked_search", "op12_quality_rules", "op13_hard_negatives"]
DOCS = "doc_id long, text string, lang string, rank int, score string, row long, trusted int"


@pytest.mark.parametrize("name", NEW)
def test_equals_oracle(spark, name):
    assert compare.differences(spark, registry.QUERIES, registry.ORACLE_SQL, name, SMALL) == ""


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", 1, "x", 2, 1) for i, t in texts], schema)


# ---- ranked search ----------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked_by_hand(docs, items, top=20):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc, c), n in zip(counts, sizes):
            m = 75 + (25 * n * n_docs) // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                found.append((-s, doc is None, doc or 0))
        out += [(item, k + 1, None if null else doc, -s) for k, (s, null, doc) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def search(docs, items, **options):
    return sorted((tuple(r) for r in ranking.ranked(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def random_docs(rng, n, words):
    return [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 20, 200])))) for k in range(n)]


def test_ranking_by_hand_with_ties_and_edges(spark):
    rng = random.Random(3)
    words = ["Mill", "mill", "É", "é", "x1", "a_b", "river", "日本", "zz", "the"]
    rows = random_docs(rng, 90, words) + [(200 + k, "mill RIVER mill") for k in range(60)] + [(None, "mill river mill"), (300, None), (301, ""), (302, "!!"), (303, "heron " * 60_000), (5, "mill mill")]
    items = [(1, "mill river the the the"), (2, None), (3, "nothing known here"), (None, "heron zz"), (4, "É é a_b")]
    got = search(frame(spark, rows), spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double"))
    assert got == ranked_by_hand(rows, items)


def test_ranking_parts_tiles_and_groups_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    rows = random_docs(rng, 120, words)
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 400)))) for k in range(9)]
    docs, asked = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = ranked_by_hand(rows, items)
    for name, value in {"PART_WEIGHT": 2500, "PART_COLUMNS": 7, "TILE_ITEMS": 2, "TILE_DOCS": 5, "ITEMS_AT_ONCE": 4, "TERMS_AT_ONCE": 150}.items():
        monkeypatch.setattr(ranking, name, value)
    assert search(docs, asked) == want


def test_ranking_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a mill")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "mill")], "item_id long, text string")
    assert search(none, items) == [] and search(some, items.where("false")) == []
    assert search(some, items) == [(1, 1, 1, 287 * (1_000_000_000 // (1000 + 12 * 100)))]  # ln(4 / 3)


def test_wide_impacts_stay_whole():
    n = np.array([2**40, 5])
    got = ranking.impacts(np.array([3, 1]), n, 2**30, 2**45)
    assert got.tolist() == [3_000_000_000 // (3000 + 12 * (75 + 25 * k * 2**30 // 2**45)) if t == 3 else 1_000_000_000 // (1000 + 12 * (75 + 25 * k * 2**30 // 2**45)) for k, t in zip(n.tolist(), (3, 1))]


# ---- quality rules ----------------------------------------------------------


def counts_by_hand(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    many = Counter(runs)
    covered = {k + j for k, run in enumerate(runs) if many[run] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def judged(spark, rows, labels):
    docs = frame(spark, rows)
    own = spark.createDataFrame(labels, "doc_id long, quality int, score double")
    return quality.op12_quality_rules(docs, own)


def test_base_counts_by_hand(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice([" ", "\n", "\t ", "\r\n"]).join(rng.choice(["a", "b", "c#", "|", "日本", "é%"]) for _ in range(rng.choice([0, 1, 4, 5, 6, 9, 12, 40, 300])))) for k in range(150)]
    rows += [(500, None), (501, ""), (502, " \n\n \x0b"), (503, "one two\none two\n\none two \nx"), (504, "heron mill " * 30_000), (505, "a b c d e a b c d e a b c d e"), (None, "x " * 12), (None, "x " * 12), (506, "a\x00b  c d")]
    got = [tuple(r) for r in judged(spark, rows, []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    assert Counter(got) == Counter((i, *counts_by_hand(t)) for i, t in rows)


def test_without_labels_only_the_rules_fail(spark):
    rows = [(1, " ".join(f"w{k}" for k in range(30))), (2, "few words")]
    for labels in ([], [(1, 1, 0.0)], [(1, None, 0.0), (None, 0, 0.0)]):
        assert {r.doc_id: r.kept for r in judged(spark, rows, labels).collect()} == {1: True, 2: False}
    assert judged(spark, [], [(1, 1, 0.0)]).collect() == []


def test_unlabelled_junk_goes_and_clean_text_stays(spark):
    rng = random.Random(2)
    words = [f"word{k}" for k in range(300)]
    clean = lambda: " ".join(rng.choice(words) for _ in range(60))
    junk = lambda: " ".join(f"{rng.choice(words)}{rng.choice(['|', '%%%', '!!'])}" for _ in range(60))
    rows = [(k, junk() if k % 5 == 0 else clean()) for k in range(400)]
    labels = [(k, int(k % 5 != 0), 0.0) for k in range(0, 400, 3)] + [(3, 1, 1.0)]
    out = judged(spark, rows, labels).collect()
    wrong = [r.doc_id for r in out if r.kept != (r.doc_id % 5 != 0)]
    assert len(wrong) <= 4


def test_score_by_hand(spark):
    rows = [(1, "mill river mill"), (2, "mill"), (3, None)]
    of = [(7 * k) % 19 - 9 for k in range(quality.BUCKETS)]
    code = lambda w: zlib.crc32(w.encode())
    total = sum(of[code(w) % quality.BUCKETS] for w in ("mill", "river", "mill")) + sum(of[(code(a) * 31 + code(b)) % quality.BUCKETS] for a, b in (("mill", "river"), ("river", "mill")))
    got = {r.doc_id: r.score for r in quality.judge(frame(spark, rows), of, None).collect()}
    assert got == {1: total / 5, 2: float(of[code("mill") % quality.BUCKETS]), 3: 0.0}


def test_quality_plan_has_no_python(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    assert "Python" not in quality.op12_quality_rules(docs, labels)._jdf.queryExecution().executedPlan().toString()


@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(0, 1), st.integers(1, 5)), max_size=30))
@settings(max_examples=80, deadline=None)
def test_threshold_is_the_lowest_best(rows):
    n1, n0 = (sum(n for _, t, n in rows if t == k) for k in (1, 0))
    told = lambda cut: sum(n for s, t, n in rows if t == 1 and s >= cut) * n0 + sum(n for s, t, n in rows if t == 0 and s < cut) * n1
    want = max(sorted({s for s, _, _ in rows}), key=told) if n1 and n0 else None
    assert quality.threshold(rows) == want


# ---- hard negatives ---------------------------------------------------------


@given(st.integers(1, 5), st.integers(1, 9), st.integers(0, 6), st.sampled_from([3, 150, 3_000, 10**6, 2**24]), st.integers(0, 2**32))
@settings(max_examples=120, deadline=None)
def test_packed_products_are_exact(n, m, dims, size, seed):
    rng = np.random.default_rng(seed)
    a, c = rng.integers(-size, size + 1, (n, dims)), rng.integers(-size, size + 1, (m, dims))
    spec = negatives.packing(-size, size, dims)
    assert spec[3] == ((dims * (2 * size) ** 2).bit_length() <= 53)
    assert (negatives.products(a, c, spec) == a @ c.T).all()


def mined_by_hand(rows):
    good = [(i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for k, (anchor, label, a) in enumerate(good):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(x * y for x, y in zip(a, c)), i, own == label) for j, (i, own, c) in enumerate(good) if j != k]
        for p, positive, _ in sorted((r for r in scored if r[2]), key=order)[:5]:
            fit = sorted((r for r in scored if not r[2] and 30 * p <= 100 * r[0] <= 90 * p), key=order)[:10]
            out += [(anchor, positive, rank + 1, i, p, s) for rank, (s, i, _) in enumerate(fit)]
    return Counter(out)


def mined(spark, rows):
    vectors = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], "vec_id long, embedding array<float>, label int, rid string, nth int")
    return Counter(tuple(r) for r in negatives.op13_hard_negatives(vectors).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def some_vectors(rng, n, dims, scale):
    return [(k, [float(np.float32(rng.gauss(0, 1) * scale)) for _ in range(dims)], rng.randrange(4)) for k in range(n)]


@pytest.mark.parametrize("scale", [0.2, 90.0, 4e5])
def test_negatives_by_hand(spark, scale):
    rng = random.Random(int(scale))
    rows = some_vectors(rng, 420, 6, scale)
    same = [float(np.float32(x * scale)) for x in (0.5, 0.25, 0.5, 0.25, 0.5, 0.25)]
    near = [float(np.float32(x * scale)) for x in (0.4, 0.2, 0.3, 0.2, 0.3, 0.2)]
    rows += [(500, same, 1), (500, same, 1), *[(501 + k, same, 1) for k in range(8)], *[(600 + k, near, 2) for k in range(30)], (None, near, 3), (None, same, 1), (700, None, 1), (800, same, None), (900, [float("nan"), *same[1:]], 1), (901, [float("inf"), *same[1:]], 1), (902, [None, *same[1:]], 1), (1000, same[:2], 1), (1100, [], 2)]
    assert mined(spark, rows) == mined_by_hand(rows)


def test_negatives_in_small_chunks(spark, monkeypatch):
    rng = random.Random(1)
    rows = some_vectors(rng, 700, 5, 0.3)
    for name, value in {"ANCHORS": 2, "CHUNK": 13, "TILE": 4, "BROADCAST_BYTES": 0}.items():
        monkeypatch.setattr(negatives, name, value)
    assert mined(spark, rows) == mined_by_hand(rows)


def test_negatives_of_empty_tables(spark):
    assert mined(spark, []) == Counter() and mined(spark, [(100, [0.5], None)]) == Counter() and mined(spark, [(100, [0.5], 1)]) == Counter()


# ---- shipping ---------------------------------------------------------------

WITHOUT = f"""
import os, sys
assert not any(os.path.abspath(p or ".") == {ROOT!r} for p in sys.path)
sys.path.append({ROOT!r})  # the driver's path only
from lorekeep.session import local_session
spark = local_session(2, 2)
spark.sparkContext.setLogLevel("OFF")
import __spark_entry__ as entry
def importable(batches):
    import importlib.util, pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("lorekeep") is not None] * b.num_rows)], names=["found"])
assert not any(r.found for r in spark.range(2).mapInArrow(importable, "found boolean").collect())
for name in sys.argv[1:]:
    f = entry.queries().get(name)
    out = f(spark, {SMALL!r}) if f else entry.corpus_pipeline.toxicity(spark, spark.read.parquet({SMALL!r} + "/documents.parquet"), {SMALL!r})
    assert out.count() > 0, name
"""


def test_workers_need_not_import_the_package(tmp_path):
    """A broadcast is pickled by reference to its classes, so none may hold a class of this package."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    names = ["op1_license_scan", "op2_near_dedup", "op4_language", "op6_url_filter", "op10_toxicity", "toxicity-stage", *NEW]
    done = subprocess.run([sys.executable, "-c", WITHOUT, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
