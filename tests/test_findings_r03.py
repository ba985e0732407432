"""One small case for each finding of FINDINGS_r03.md: each failed before its change."""

import compare
import duckdb

from lorekeep.plans import catalogue


def against_sql(spark, folder, name, **tables):
    """The query's and its SQL's sorted rows over tables of rows (a schema and tuples)."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(folder))
    rel = con.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in rel.description]
    return compare.rows_of(df.columns, df.collect()), compare.rows_of(names, rel.fetchall())


DOCUMENTS = "doc_id long, text string, lang string, source string"


def test_f17_one_chapter_a_document_whatever_its_text(spark, tmp_path):
    rows = [(1, "see ch. 3 and Chapter 44", "en", "a"), (2, None, "en", "a"), (3, "", "en", "a"), (44, "the last chapter", "en", "b")]
    got, want = against_sql(spark, tmp_path, "chapter_entities", documents=(DOCUMENTS, rows))
    assert got == want and len(got) == 4


def test_f21_a_question_without_relations_counts_as_in_sql(spark):
    from lorekeep.plans.catalogue_workspace import related

    rows = [(1, "body", 1414, False), (2, "body", 1500, False), (3, "body\n\n### Quan hệ đã biết (known relations)\n- a", 90, True), (4, "body", 1499, True)]
    got = related(spark.createDataFrame(rows, "query_id long, context string, tokens long, known boolean"), 1500).orderBy("query_id").collect()
    con = duckdb.connect()
    blocks = {1: None, 2: None, 3: "x" * 36, 4: "x" * 36}
    spent = {1: 1414, 2: 1500, 3: 80, 4: 1499}
    from lorekeep.plans import sql as S

    for r in got:
        fits, cost = con.execute(f"SELECT CAST(? AS BIGINT) + {S.estimate('block')} <= 1500, {S.estimate('block')} FROM (SELECT CAST(? AS VARCHAR) AS block)", [spent[r.query_id], blocks[r.query_id]]).fetchone()
        assert (r.related, r.tokens) == (fits, spent[r.query_id] + (cost if fits else 0))


def test_f18_f19_all_rounds_are_gone(spark, tmp_path):
    import pytest
    from lorekeep.operators import graph

    men = spark.createDataFrame([("w", "s", i, e, c) for i, row in enumerate(["aab", "bc", "cd", "da", "e"]) for e, c in {x: row.count(x) for x in row}.items()], "workspace string, source string, seq int, entity string, count long")
    start = spark.createDataFrame([(1, "w", "a", 0.75), (1, "w", "c", 0.25), (2, "w", "e", 1.0), (3, "w", "unheard", 1.0)], "query_id long, workspace string, entity string, weight double")
    key = ["workspace", "source", "seq"]
    every = graph.ppr((graph.transitions(men, key),), start, key, tolerance=0.0)  # as matrices
    by_joins = graph.ppr(graph.moves(men, key), start, key, tolerance=0.0)
    got, want = ({(r.query_id, r.entity): (pytest.approx(r.pi, abs=1e-12), r.rounds) for r in df.collect()} for df in (every, by_joins))
    assert got == want and {n for _, n in got.values()} == {graph.ROUNDS}
    for name in ("ppr_scores", "graph_segment_scores"):
        assert "delta" not in catalogue.ORACLE_SQL[name]


def test_f20_every_label_counts(spark):
    from lorekeep.llm import quality

    ids = spark.range(0, 20_500).selectExpr("id as doc_id", "1 as quality").unionByName(spark.range(20_500, 41_010).selectExpr("id as doc_id", "0 as quality"))
    assert quality.sample(ids).groupBy("trusted").count().orderBy("trusted").collect() == [(0, 20_510), (1, 20_500)]


def test_f1_f5_f11_the_best_of_each_task_hold_the_best(spark):
    """The kernel's candidates against all scores: ties, repeats, several steps, questions of two places."""
    import random

    from lorekeep.operators import index, lexical

    rng = random.Random(3)
    rows = [(f"w{i % 2}", i, " ".join(rng.choice(["mill", "river", "heron", "iron", "bridge", "sloop"]) for _ in range(rng.randint(0, 9)))) for i in range(120)]
    units = spark.createDataFrame(rows, "workspace string, id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "w0", "mill river river"), (2, "w1", "heron iron mill"), (3, "w0", "sloop"), (4, "w1", "unheard")], "query_id long, workspace string, query string")
    key, within = ["workspace", "id"], ("workspace",)
    terms = lexical.query_terms(asked)
    every = sorted((r.query_id, r.id, round(r.score, 9)) for r in lexical.bm25(units, key, terms, within=within).collect())
    held = index.built(units, key, within)
    for some in (lexical.bm25(units, key, terms, within=within, k=200), index.scores(held, terms, key, within, 200)):
        assert sorted((r.query_id, r.id, round(r.score, 9)) for r in some.collect()) == every
    few = {(r.query_id, r.id) for r in lexical.bm25(units, key, terms, within=within, k=5).collect()}
    best = [x for q in (1, 2, 3) for x in sorted((e for e in every if e[0] == q), key=lambda e: (-e[2], e[1]))[:5]]
    assert {x[:2] for x in best} <= few and len(few) < len(every)


def test_f2_f3_records_are_found_without_a_row_for_each_pair(spark):
    """The kernel's records against search over all scores: entities that are named, dates, limits, records that diverge, ties."""
    import random

    from lorekeep.operators import facts, lexical

    rng = random.Random(5)
    words = ["mill", "river", "heron", "iron", "bridge", "sloop"]
    kinds = "id string, claim string, entities array<string>, tags array<string>, note string, start_key long, end_key long, diverges boolean"
    rows = [(f"r{i:03d}", " ".join(rng.choices(words, k=rng.randint(0, 6))), rng.choice([["Mill"], ["mill", "Iron"], [], None, [" ", None]]), ["t"], None, rng.choice([None, i]), rng.choice([None, i + 5]), i % 4 == 0) for i in range(90)]
    records = spark.createDataFrame(rows, kinds).repartition(3)
    asked = spark.createDataFrame([(1, "mill river", 50, None, 7), (2, "Iron mill", None, 40, 0), (3, "heron", 60, 20, 99), (4, "unheard", None, None, None), (5, "", None, None, 3)], "query_id long, query string, before long, after long, limit int")
    scores = lexical.bm25(records.select("id", facts.indexed_text().alias("text")), ["id"], lexical.query_terms(asked.select("query_id", "query")))
    for queries in (asked, asked.drop("limit")):
        for divergences in (True, False):
            got, want = (sorted(map(tuple, df.collect())) for df in (facts.found(records, queries, divergences=divergences), facts.search(scores, records, queries, divergences=divergences)))
            assert got == want and got


def _counted(monkeypatch, spark, names, limits):
    """Run the queries; how often each of (module, function) made its rows must stay within its limit."""
    for name in names:
        calls = {}
        with monkeypatch.context() as m:
            for (module, function), _ in limits.items():
                own = getattr(module, function)
                m.setattr(module, function, lambda *a, own=own, function=function, **k: (calls.__setitem__(function, calls.get(function, 0) + 1), own(*a, **k))[1])
            catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
        for (_, function), most in limits.items():
            assert calls.get(function, 0) <= most, (name, calls)


def test_f28_f29_f30_f33_f41_texts_are_segmented_and_names_learnt_once(spark, monkeypatch):
    from lorekeep.operators import entities, segments

    once = {(segments, "segment"): 1, (entities, "frequent_terms"): 1}
    _counted(monkeypatch, spark, ["clear_tables", "delete_sources", "entity_neighbours", "entity_profile", "seed_alignment"], once)


def test_f24_f26_only_tables_that_are_read_are_made(spark, monkeypatch):
    from lorekeep.operators import dense, entities, index, segments

    limits = {(segments, "segment"): 1, (entities, "frequent_terms"): 1, (dense, "hash_vectors"): 0, (index, "built"): 0}
    _counted(monkeypatch, spark, ["workspace_activation", "workspace_profiles"], limits)


def test_f25_texts_that_fail_are_hashed_together(spark):
    import pyarrow as pa
    from lorekeep.operators import cache, dense

    class Odd:
        space, batch = "odd@1", 1

        def encode(self, texts):
            if len(texts[0]) % 2:
                raise RuntimeError("odd")
            return [[1.0]]

    calls, hashed = [], dense.hashed_rows(8)
    run = cache._calls(Odd(), "encode", lambda lists: (calls.append(len(lists)), hashed(lists))[1])
    texts = ["a1", "b", "cc", "ddd", "e2e"]
    batch = pa.RecordBatch.from_arrays([pa.array(list("vwxyz")), pa.array(texts), pa.array([[t] for t in texts])], names=["hash", "text", "t"])
    rows = pa.Table.from_batches(list(run([batch]))).to_pylist()
    assert calls == [3] and [r["origin"] for r in rows] == ["provider", "fallback", "provider", "fallback", "fallback"]
    alone = hashed(pa.array([[t] for t in texts])).tolist()
    assert [r["value"] for r in rows] == [[1.0], alone[1], [1.0], alone[3], alone[4]]
    assert [r["problem"] for r in rows] == [None, "RuntimeError: odd", None, "RuntimeError: odd", "RuntimeError: odd"]


def test_f27_vectors_of_a_key_that_comes_once_are_not_shuffled(spark):
    from lorekeep.operators import cache

    kinds = cache.CACHE.format(value=cache.VECTOR)
    old = spark.createDataFrame([("a", "s", [1.0], 1), ("b", "s", [2.0], 1)], kinds)
    apart, both = (spark.createDataFrame(rows, kinds) for rows in ([("c", "s", [3.0], 2), ("a", "t", [4.0], 2)], [("b", "s", [5.0], 2), ("c", "s", [3.0], 2)]))
    assert sorted(map(tuple, cache._merged(old, both).collect())) == [("a", "s", [1.0], 1), ("b", "s", [5.0], 2), ("c", "s", [3.0], 2)]
    merged = cache._merged(old, apart)
    assert merged.count() == 4 and "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()


def test_f31_f32_f34_f39_places_of_terms_count_characters(spark):
    """Behind a character of two UTF-16 units the place is still the number of characters before the term."""
    from lorekeep.operators import facts

    drafts = facts.prepared(spark.createDataFrame([(1, "😀 In 1500 the mill, 1600 mills and the water mill stood", 13001231)], "draft_id long, text string, scene_key int"))
    kinds = "id string, claim string, start_key int, end_key int, ongoing boolean, locked boolean, introduces array<string>, anchors array<string>"
    records = spark.createDataFrame([("a", "c", 14000101, None, False, True, ["mill"], []), ("b", "c", 14000101, None, False, True, ["sloop"], [])], kinds)
    assert [(r.record_id, r.term, r.at) for r in facts.premature(drafts, records).collect()] == [("a", "mill", 14)]
    assert [(r.record_id, r.term, r.at, r.year) for r in facts.year_conflicts(drafts, records).collect()] == [("a", "mill", 14, 1500)]
    assert sorted((r.pos, r.year) for r in facts.years_in(drafts).collect()) == [(5, 1500), (20, 1600)]


def test_f35_f36_f38_f40_tokens_of_a_length_need_no_filter(spark):
    from lorekeep.functions import text as X
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("A1 b 7 ٣ éa x́y ab_c Đường 𝐀𝐁 𝐀 longer",), ("",), (None,)], "t string").select(X.tokens("t").alias("all"), X.tokens("t", 5).alias("long"))
    old = F.filter("all", lambda t: F.length(t) >= 5)
    assert df.where(old != F.col("long")).count() == 0
    assert "lambdafunction" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.first()["all"] == ["a1", "7", "٣", "ea", "ab", "duong", "𝐀𝐁", "longer"]


def test_f14_f15_the_best_of_each_task_give_the_same_evidence(spark):
    """Two workspaces: candidates of the kernels against all scores, which are many more rows."""
    from lorekeep.operators import search
    from lorekeep.plans import catalogue_workspace as W

    d = "/root/testdata/sf0.001"
    own = W.names(spark, d)
    held, asked = W.searched(spark, d, own), W.questions(spark, d)
    every, few = (search.ask(held, asked, own, k) for k in (None, 8))
    rows = [sorted((r.query_id, r.workspace, r.source, r.seq, round(r.score, 6), r.role) for r in a.evidence(8).collect()) for a in (every, few)]
    assert rows[0] == rows[1] and rows[0]
    assert few.scores.count() < every.scores.count()


def test_f23_proper_names_need_no_row_for_each_word(spark):
    """Runs become rows, words do not: no window, one grouping; places, stopwords, long runs and capitals as before."""
    from lorekeep.operators import entities

    texts = [
        "Foo ran. The Foo Bar saw foo and Ann", "Ann. Bob! He saw Bob", "A B c D", "NASA. The OF of Of", None, "", '"Zed (Yan) — Xia', "so\n\nYan\nAnn  Bob",
        " ".join(f"W{i}" for i in range(13)), "x Éa ÉA éa, Éa", "1A Ab9 a-Bc Bc_De fooBar",
    ]
    out = entities.proper_nouns(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("Exchange") == 1
    got = {i: {(r.entity, r.name, r["count"]) for r in out.collect() if r.doc_id == i} for i in range(len(texts))}
    assert got[0] == {("the foo bar", "The Foo Bar", 1), ("ann", "Ann", 1), ("foo", "Foo", 1)}
    assert got[1] == {("bob", "Bob", 2)}
    assert got[2] == {("a b", "A B", 1)} and got[3] == {("nasa", "NASA", 1)} and got[4] == got[5] == set()
    assert got[6] == {("xia", "Xia", 1)} and got[7] == {("yan", "Yan", 1), ("ann", "Ann", 1), ("bob", "Bob", 1)}
    assert {x[0] for x in got[8]} == {"w0 w1 w2 w3 w4 w5", "w6 w7 w8 w9 w10 w11", "w12"}
    assert got[9] == {("ea ea", "Éa ÉA", 1), ("ea", "Éa", 1)}
    assert got[10] == {("ab9", "Ab9", 1), ("bc bc", "Bc Bc", 1), ("de", "De", 1)}


def test_f23_known_names_are_counted_once(spark):
    from lorekeep.operators import entities

    units = spark.createDataFrame([(1, "the old mill and Mill Hill; Ann saw the mill, ch. 3 of 1,500")], "id long, text string")
    names = spark.createDataFrame([("mill", "Mill", "PLACE"), ("old mill", "Old Mill", "PLACE")], "key string, name string, type string")
    out = entities.all_mentions(units, ["id"], names)
    assert {(r.entity, r.name, r.type, r["count"]) for r in out.collect()} == {("mill", "Mill", "PLACE", 3), ("old mill", "Old Mill", "PLACE", 1), ("mill hill", "Mill Hill", "PROPER", 1), ("ann", "Ann", "PROPER", 1), ("chapter:3", "Chương 3", "CHAPTER", 1), ("num:1,500", "1,500", "NUMBER", 1)}
    assert "regexp_extract_all(lower(text" not in out._jdf.queryExecution().optimizedPlan().toString()  # a table by then


def test_f23_vectors_are_those_of_the_features(spark):
    """Words, trigrams and pairs hashed one by one, in plain Python."""
    import numpy as np
    import pyarrow as pa
    from lorekeep.functions import text as X
    from lorekeep.operators import dense

    def fnv(word, seed):
        state = X.FNV_OFFSET ^ seed
        for c in word:
            state = ((state ^ (ord(c) & 0xFF)) * X.FNV_PRIME) & 0xFFFFFFFF
        return state

    lists = [["mill", "the", "ab", "mill", "7"], [], ["đường", "𐀀x", "a" * 40], ["the"], ["the", "of"]]
    want = np.zeros((len(lists), 384))
    for row, words in zip(want, lists):
        stop = [w in X.FOLDED_STOPWORDS for w in words]
        found = [("w:" + w, X.STOP_WEIGHT if s else X.WORD_WEIGHT) for w, s in zip(words, stop)] + [("b:" + a + "_" + b, X.BIGRAM_WEIGHT) for a, b in zip(words, words[1:])]
        found += [("c:" + f"^{w}$"[k : k + 3], X.TRIGRAM_WEIGHT) for w, s in zip(words, stop) if not s for k in range(len(w))]
        for name, weight in found:
            row[fnv(name, X.INDEX_SEED) % 384] += weight if fnv(name, X.SIGN_SEED) % 2 else -weight
        row /= max(np.linalg.norm(row), 1e-300)
    for step in (dense.STEP_GRAMS, 3):  # also a few grams at once
        held, dense.STEP_GRAMS = dense.STEP_GRAMS, step
        try:
            assert np.allclose(dense.hashed_rows()(pa.array(lists)), want, atol=1e-12)
        finally:
            dense.STEP_GRAMS = held


def test_f6_postings_are_counted_where_texts_are(spark):
    from lorekeep.operators import index

    units = spark.createDataFrame([("w", 1, "mill river mill"), ("w", 2, ""), ("v", 1, "Mill é 7"), ("w", 3, None)], "workspace string, id long, text string")
    out = index.built(units, ["workspace", "id"], ("workspace",))
    got = {n: sorted(tuple(r) for r in t.collect()) for n, t in out.items()}
    assert got["postings"] == [("v", 1, 2, "7", 1), ("v", 1, 2, "mill", 1), ("w", 1, 3, "mill", 2), ("w", 1, 3, "river", 1)]
    assert got["lengths"] == [("v", 1, 2), ("w", 1, 3), ("w", 2, 0), ("w", 3, 0)]
    assert got["terms"] == [("v", "7", 1), ("v", "mill", 1), ("w", "mill", 1), ("w", "river", 1)] and got["totals"] == [("v", 1, 2), ("w", 3, 3)]
    assert "Exchange" not in out["postings"]._jdf.queryExecution().executedPlan().toString()
    assert all("regexp" not in t._jdf.queryExecution().optimizedPlan().toString() for t in out.values())  # texts become tokens once


def test_f4_a_row_for_each_question_and_segment_without_a_shuffle(spark, monkeypatch):
    """Two workspaces, blocks of one question, small steps, an entity nobody mentions: the same rows as by joins."""
    import pytest
    from lorekeep.operators import graph

    men = spark.createDataFrame([(w, "s", i, e, 1) for w in ("v", "w") for i, row in enumerate(["ab", "bc", "cde", "x", "a"]) for e in row], "workspace string, source string, seq int, entity string, count long")
    pi = spark.createDataFrame([(1, "w", "a", 0.5), (1, "w", "c", 0.25), (1, "w", "q", 0.25), (2, "v", "b", 0.75), (2, "v", "e", 0.0), (3, "w", "a", 1.0)], "query_id long, workspace string, entity string, pi double")
    key = ["workspace", "source", "seq"]
    want = {("w", 1): {0: 0.5, 1: 0.25, 2: 0.25, 4: 0.5}, ("v", 2): {0: 0.75, 1: 0.75}, ("w", 3): {0: 1.0, 4: 1.0}}
    for change in ({}, {"AT_ONCE": 1, "STEP_SUMS": 2}, {"SUMMED_ENTITIES": 0}):
        for name, value in change.items():
            monkeypatch.setattr(graph, name, value)
        out, got = graph.segment_scores(men, key, pi), {}
        for r in out.collect():
            got.setdefault((r.workspace, r.query_id), {})[r.seq] = pytest.approx(r.score)
        assert got == want and out.columns == ["query_id", *key, "score"] and out.count() == 8
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("Join" in plan) == (graph.SUMMED_ENTITIES == 0)
    assert graph.segment_scores(men, key, pi.where("false")).count() == 0
