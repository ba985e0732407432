"""Findings of the fourth round: what failed before, on small tables."""

import numpy as np
from conftest import SMALL


def test_f1_f3_f4_f5_f6_f8_segments_are_hashed_once_for_all_passes_and_blocks(spark, monkeypatch):
    from lorekeep.operators import dense, lexical
    from lorekeep.plans import catalogue

    calls, made, texts = [], dense.hash_beside, dense.hash_vectors

    def counted(units, key, *rest):
        out = made(units, key, *rest)
        calls.append(out)
        return out

    def of_segments(units, key, *rest):
        assert "seq" not in key, "a segment is hashed again"
        return texts(units, key, *rest)

    passes, best = [], lexical.best
    monkeypatch.setattr(dense, "hash_beside", counted)
    monkeypatch.setattr(dense, "hash_vectors", of_segments)
    monkeypatch.setattr(lexical, "best", lambda units, *rest, **more: (passes.append(units._jdf.queryExecution().toString()), best(units, *rest, **more))[1])
    for name in ("calibrated_topk", "hierarchy_view"):
        calls.clear()
        catalogue.QUERIES[name](spark, SMALL).collect()
        assert len(calls) == 1, name
    assert all("MapInArrow" not in plan for plan in passes)  # a block of questions reads a table, it does not make it


def test_f8_a_task_returns_no_more_than_its_best_groups_and_their_exact_scores(spark):
    from lorekeep.operators import lexical

    rng, n, n_asked, k = np.random.default_rng(7), 3_000, 6, 4
    words = [f"w{i}" for i in range(60)]
    lists = [[words[i] for i in rng.choice(60, 12, replace=False)] for _ in range(n)]
    asked = [[words[i] for i in rng.choice(60, 20, replace=False)] for _ in range(n_asked)]
    idf, vecs, wanted = dict(zip(words, rng.uniform(0.1, 4.0, 60))), rng.integers(-30, 30, (n, 8)), rng.normal(size=(n_asked, 8))
    wanted /= np.linalg.norm(wanted, axis=1, keepdims=True)
    units = spark.createDataFrame([(f"d{i // 3}", i % 3, 12, lists[i], [1.0] * 12, vecs[i].tolist()) for i in range(n)], "source string, seq int, len long, terms array<string>, tf array<double>, vec array<int>").coalesce(1)
    terms = spark.createDataFrame([(q, w) for q in range(n_asked) for w in asked[q]], "query_id long, term string")
    df = spark.createDataFrame([(w, max(1, int(n * np.exp(-idf[w])))) for w in words], "term string, df long")
    stats = spark.createDataFrame([(n, 12.0)], "docs long, mean double")
    near = spark.createDataFrame([(q, wanted[q].tolist()) for q in range(n_asked)], "query_id long, vec array<double>")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # many steps
    try:
        rows = lexical.best(units, df, stats, terms, ["source", "seq"], [], k, near, 2.0).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    counts = {r["term"]: r["df"] for r in df.collect()}
    weight = {w: np.log(1 + (n - c + 0.5) / (c + 0.5)) for w, c in counts.items()}
    unit = vecs / np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-300)
    score = np.array([[sum(weight[w] for w in set(lists[i]) & set(asked[q])) + 2 * max(0.0, unit[i] @ wanted[q]) for q in range(n_asked)] for i in range(n)])
    groups = score.reshape(-1, 3, n_asked).max(axis=1)
    for q in range(n_asked):
        got = {(r["source"], r["seq"]): r["score"] for r in rows if r["query_id"] == q}
        assert all(abs(v - score[int(s[1:]) * 3 + seq, q]) < 1e-9 for (s, seq), v in got.items())
        assert set(np.argsort(-groups[:, q])[:k]) <= {int(s[1:]) for s, _ in got}
        assert len({s for s, _ in got}) <= k + 1  # what earlier steps kept is dropped when later ones have better


def test_f9_f10_f13_f15_units_are_a_table_before_blocks_of_questions_meet_them(spark, monkeypatch):
    from lorekeep.operators import lexical
    from lorekeep.plans import catalogue

    plans, best = [], lexical.best
    monkeypatch.setattr(lexical, "best", lambda units, *rest, **more: (plans.append(units._jdf.queryExecution().optimizedPlan().toString()), best(units, *rest, **more))[1])
    monkeypatch.setattr("lorekeep.operators.index.best", lexical.best)
    for name in ("bm25_batch", "fact_search", "fact_search_limits", "index_deltas"):
        catalogue.QUERIES[name](spark, SMALL)
        assert "regexp_extract_all" not in plans[-1] and "Aggregate" not in plans[-1], name
    assert len(plans) == 4


def test_f9_f10_statistics_come_from_distinct_terms(spark):
    from lorekeep.operators import lexical

    units = spark.createDataFrame([("a", 3, ["x", "y", "x"]), ("b", 0, []), ("c", 1, ["x"])], "id string, len long, terms array<string>")
    held = lexical.listed(units)
    assert sorted((r["id"], sorted(zip(r["terms"], r["tf"]))) for r in held.collect()) == [("a", [("x", 2), ("y", 1)]), ("b", []), ("c", [("x", 1)])]
    asked = spark.createDataFrame([(1, "x"), (2, "x"), (2, "z")], "query_id long, term string")
    assert [tuple(r) for r in lexical.frequencies(held, asked, []).collect()] == [("x", 2)]
    assert tuple(lexical.lengths_of(held, []).first()) == (3, 4 / 3)


def test_f11_f12_a_search_over_workspaces_keeps_each_vector_once_and_as_whole_numbers(spark, monkeypatch):
    import sys

    from lorekeep import session
    from lorekeep.plans import catalogue

    kept, write = [], session.saved
    for module in [m for n, m in sys.modules.items() if n.startswith("lorekeep") and getattr(m, "saved", None) is write]:
        monkeypatch.setattr(module, "saved", lambda df, name: (kept.append((name, dict(df.dtypes))), write(df, name))[1])
    catalogue.QUERIES["workspace_search"](spark, SMALL)
    of_segments = [(name, kinds["vec"]) for name, kinds in kept if "vec" in kinds and "seq" in kinds and "query_id" not in kinds]
    assert of_segments == [("units", "array<int>")]
    assert not [name for name, kinds in kept if {"term", "tf"} <= set(kinds)]  # nor is there a row for each segment and word


def test_f14_stored_vectors_are_whole_numbers_of_the_same_direction(spark):
    import pyarrow as pa
    from lorekeep.operators import dense, lexical, store

    rows = spark.createDataFrame([("w", "a", "chapter", 1, 1, "The heron stood by the river. Mill and mill."), ("w", "b", "chapter", 2, 2, "...")], "workspace string, source string, kind string, chapter int, ordinal long, text string")
    names = spark.createDataFrame([("heron", "heron", "CONCEPT")], "key string, name string, type string")
    whole = store.indexed(rows, names)["vectors"]
    assert dict(whole.dtypes)["vec"] == "array<int>" and [r["source"] for r in whole.collect()] == ["a"]
    plain = dense.hash_vectors(rows.where("source = 'a'"), ["source"]).first()["vec"]
    assert np.allclose(lexical.unit_rows(pa.array([whole.first()["vec"]]))[0], plain, atol=1e-12)
    asked = spark.createDataFrame([(1, plain)], "query_id long, vec array<double>")
    assert abs(dense.similarities(whole, asked, ["source"]).first()["sim"] - 1) < 1e-12


def test_f11_f12_f14_tables_are_written_with_zstd(spark):
    import glob
    import pyarrow.parquet as pq
    from lorekeep.session import saved

    path = saved(spark.range(10), "numbers").inputFiles()[0].replace("file://", "").replace("file:", "")
    assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in glob.glob(path)} == {"ZSTD"}
