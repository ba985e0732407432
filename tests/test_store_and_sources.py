"""Versioned tables, the stored index, caches with failing providers, workspaces on disk and chapter files."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import cache, entities, facts, graph, index, lexical, search, segments, store
from lorekeep.operators.versions import Conflict, Versions
from lorekeep.sources import workspaces

SOURCES = "workspace string, source string, kind string, chapter int, ordinal long, text string"
NAMES = "workspace string, key string, name string, type string"


def some(spark, *rows):
    return spark.createDataFrame([(w, s, "chapter", 1, 1001, t) for w, s, t in rows], SOURCES)


@pytest.fixture
def versions(spark, tmp_path):
    return Versions(spark, str(tmp_path / "store"))


def texts(versions, number=None):
    return sorted((r.workspace, r.source, r.text) for r in versions.table("segments", number).collect())


def test_all_tables_of_a_source_change_together(spark, versions):
    names = spark.createDataFrame([("a", "lan anh", "Lan Anh", "PERSON"), ("b", "khoa", "Khoa", "PERSON")], NAMES)
    rel = spark.createDataFrame([("a", "x", 1, "Lan Anh", "OWNS", "mill")], "workspace string, source string, id long, subject string, relation string, object string")
    store.commit_sources(versions, some(spark, ("a", "x", "lan anh owns the mill."), ("a", "y", "the mill burns."), ("b", "x", "khoa and lan anh.")), names, rel)
    first = versions.number()
    store.commit_sources(versions, some(spark, ("a", "x", "nothing here.")), names)
    assert texts(versions, first) == [("a", "x", "lan anh owns the mill."), ("a", "y", "the mill burns."), ("b", "x", "khoa and lan anh.")]
    assert texts(versions) == [("a", "x", "nothing here."), ("a", "y", "the mill burns."), ("b", "x", "khoa and lan anh.")]
    now = versions.tables()
    assert now["relations"].count() == 0 and versions.table("relations", first).count() == 1
    assert {(r.workspace, r.entity) for r in store.entities_of(now).collect()} == {("b", "khoa")}  # each workspace has its own names
    assert {(r.workspace, r.entity) for r in store.entities_of(versions.tables(first)).collect()} == {("a", "lan anh"), ("b", "khoa")}
    df = {r.term: r.df for r in now["terms"].where("workspace = 'a'").groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").collect()}
    assert df == {"nothing": 1, "here": 1, "the": 1, "mill": 1, "burns": 1}
    store.commit_deletion(versions, some(spark, ("a", "y", "")).select("workspace", "source"))
    before = {n: sorted(map(str, t.collect())) for n, t in versions.tables().items() if n not in index.SUMMED}
    versions.compact()
    assert {n: sorted(map(str, t.collect())) for n, t in versions.tables().items() if n not in index.SUMMED} == before
    assert all(len(e["parts"]) == 1 for e in versions.manifest()["tables"].values())
    assert versions.vacuum(keep=1) and {n: sorted(map(str, t.collect())) for n, t in versions.tables().items() if n not in index.SUMMED} == before


def test_a_commit_that_fails_half_way_changes_nothing(spark, versions):
    key = ["workspace", "source"]
    good = some(spark, ("a", "x", "old"))
    versions.commit({"segments": good, "sources": good.select(*key)}, good)
    new = some(spark, ("a", "x", "new"))
    broken = new.select(*key).withColumn("source", F.raise_error(F.lit("disk is full")).cast("string"))
    with pytest.raises(Exception, match="disk is full"):
        versions.commit({"segments": new, "sources": broken}, new)
    assert versions.number() == 1 and texts(versions) == [("a", "x", "old")]
    versions.commit({"segments": new, "sources": new.select(*key)}, new)
    assert texts(versions) == [("a", "x", "new")] and texts(versions, 1) == [("a", "x", "old")]


def test_of_two_writers_one_wins(spark, versions):
    rows = some(spark, ("a", "x", "one"))
    held = versions.manifest()
    versions.commit({"segments": rows}, rows)
    with pytest.raises(Conflict):
        versions._swap(held, 1)
    assert texts(versions) == [("a", "x", "one")]


def test_index_by_deltas_equals_a_new_one_and_reads_no_text(spark, tmp_path):
    key, within = ["workspace", "source", "seq"], ("workspace",)
    unit = lambda *rows: spark.createDataFrame([(w, s, 0, t) for w, s, t in rows], "workspace string, source string, seq int, text string")
    old = unit(("a", "x", "heron mill mill"), ("a", "y", "river"), ("a", "z", "heron river"), ("b", "x", "heron heron"))
    held = index.built(old, key, within)
    gone = unit(("a", "x", ""), ("a", "z", ""))
    held = index.applied(held, index.built(unit(("a", "x", "heron by the river")), key, within), gone, ["workspace", "source"], within)
    for name, rows in held.items():
        rows.write.parquet(f"{tmp_path}/{name}")
    held = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in held}
    terms = spark.createDataFrame([(1, "a", "heron"), (1, "a", "river"), (1, "a", "mill"), (2, "b", "heron"), (2, "b", "river")], "query_id long, workspace string, term string")
    got = index.scores(held, terms, key, within)
    assert "text" not in got._jdf.queryExecution().executedPlan().toString()
    want = lexical.bm25(unit(("a", "x", "heron by the river"), ("a", "y", "river"), ("b", "x", "heron heron")), key, terms, within=within)
    rounded = lambda df: {(r.query_id, r.workspace, r.source): round(r.score, 9) for r in df.collect()}
    assert rounded(got) == rounded(want) and set(rounded(got)) == {(1, "a", "x"), (1, "a", "y"), (2, "b", "x")}


def test_failing_calls_touch_only_their_texts(spark):
    class Provider:
        space, batch = "toy@1", 1

        def encode(self, texts):
            if "bad" in texts[0]:
                raise RuntimeError("no such word")
            return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(1, "good"), (2, "bad luck"), (3, "good"), (4, None)], "id long, text string")
    none = spark.createDataFrame([], cache.CACHE.format(value=cache.VECTOR))
    got, held = cache.embedded(rows, ["id"], none, Provider(), 1)
    got = {r.id: r for r in got.collect()}
    assert [got[i].origin for i in (1, 2, 3, 4)] == ["provider", "fallback", "provider", "provider"] and got[2].space == cache.HASH_SPACE and len(got[2].vec) == 384
    assert got[1].vec == [4.0] and got[4].vec == [0.0] and "no such word" in got[2].problem
    again, held = cache.embedded(rows, ["id"], held, Provider(), 2)
    assert {r.id: r.origin for r in again.collect()} == {1: "cache", 2: "fallback", 3: "cache", 4: "cache"}  # what failed is tried again


def test_extractions_are_cached_and_enrich_mentions(spark):
    class Extractor:
        space, batch = "toy-extractor", 2

        def extract(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("refused")
            return ['{"segments":[{"index":0,"entities":[{"name":"Mill"}]}]}' for _ in texts]

    rows = spark.createDataFrame([(1, "the mill"), (2, "bad")], "id long, text string").coalesce(1)
    none = spark.createDataFrame([], cache.CACHE.format(value=cache.PAYLOAD))
    got, held = cache.extracted(rows.where("id = 1"), ["id"], none, Extractor(), 1)
    assert got.first().payload and held.count() == 1
    got = {r.id: r for r in cache.extracted(rows, ["id"], held, Extractor(), 2)[0].collect()}
    assert got[1].origin == "cache" and got[2].payload is None and "refused" in got[2].problem
    men = spark.createDataFrame([(1, "mill", 3)], "id long, entity string, count long")
    more = spark.createDataFrame([(1, "mill"), (1, "miller"), (1, "miller")], "id long, entity string")
    assert {(r.entity, r["count"]) for r in cache.enriched(men, more, ["id"]).collect()} == {("mill", 3), ("miller", 1)}


# ---- workspaces on disk -------------------------------------------------------------

FILES = {
    "alpha/context/characters.md": "# Cast\n\n## Lan Anh (captain)\n\nShe owns the **Grey Heron** sloop.\n\n- sails at dawn\n- fears fog\n\n## Old Mill\n\nIt stands.\n",
    "alpha/context/deep/notes.txt": "Lan Anh was born in 1801.",
    "alpha/chapters/chapter-002-fog.md": "# Chapter 2: Fog\n\nlan anh saw the Grey Heron leave the Old Mill.",
    "alpha/chapters/story 7.md": "Nobody came.",
    "beta/context/characters.md": "# Cast\n\n## Old Mill\n\nMinh Đức keeps it. lan anh is unknown here.\n",
    "beta/chapters/chuong-1.md": "The old mill burned.",
    "Not A Slug/context/x.md": "## Lost Name\n",
    "alpha/context/picture.png": "no text",
}


@pytest.fixture(scope="module")
def shelf(tmp_path_factory):
    root = tmp_path_factory.mktemp("shelf")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    (root / "alpha/novel.json").write_text('{\n "title": "alpha tale",\n "created_at": 5.0\n}', encoding="utf-8")
    (root / "beta/novel.json").write_text("{ not json", encoding="utf-8")
    (root / "gamma").mkdir()
    (root / "gamma/novel.json").write_text('{"title": "Zeta", "created_at": 9.5, "description": "d"}', encoding="utf-8")
    (root / "delta").mkdir()
    (root / "delta/novel.json").write_text('{"title": "Eta", "created_at": 9.5}', encoding="utf-8")
    return root


def test_manifests(spark, shelf):
    got = [tuple(r) for r in workspaces.manifests(spark, str(shelf)).collect()]
    assert got == [("delta", "Eta", "", 9.5, False), ("gamma", "Zeta", "d", 9.5, False), ("alpha", "alpha tale", "", 5.0, False), ("beta", "beta", "", 0.0, True)]


def test_files_have_kinds_and_chapters(spark, shelf):
    got = {(r.workspace, r.source): (r.kind, r.chapter) for r in workspaces.markdown(spark, str(shelf)).collect()}
    assert got == {
        ("alpha", "characters.md"): ("reference", None), ("alpha", "notes.txt"): ("reference", None), ("alpha", "chapter-002-fog.md"): ("chapter", 2), ("alpha", "story 7.md"): ("chapter", None),
        ("beta", "characters.md"): ("reference", None), ("beta", "chuong-1.md"): ("chapter", 1),
    }


def test_workspaces_from_files_to_tables(spark, shelf, versions, tmp_path):
    workspaces.ingest(spark, str(shelf), versions)
    now = versions.tables()
    ordinals = {(r.workspace, r.source): r.ordinal for r in now["sources"].collect()}
    assert ordinals == {("alpha", "characters.md"): 0, ("alpha", "notes.txt"): 1, ("alpha", "chapter-002-fog.md"): 1002, ("alpha", "story 7.md"): 1000, ("beta", "characters.md"): 0, ("beta", "chuong-1.md"): 1001}
    now["segments"].write.parquet(f"{tmp_path}/seg")
    now["mentions"].write.parquet(f"{tmp_path}/men")
    # whole names in the text or, once, in the heading of the scene; names are those that the workspace's own files declare
    names = "(VALUES ('alpha', 'lan anh'), ('alpha', 'grey heron'), ('alpha', 'old mill'), ('beta', 'old mill')) n(workspace, entity)"
    want = duckdb.sql(
        rf"""WITH seg AS (SELECT * FROM '{tmp_path}/seg/*.parquet'), unit AS (SELECT *, lower(CASE WHEN heading <> '' AND NOT contains(text, heading) THEN heading || chr(10) || text ELSE text END) AS t FROM seg),
        own AS (SELECT workspace, source, seq, entity, length(regexp_extract_all(t, '\b' || entity || '\b')) AS n FROM unit JOIN {names} USING (workspace) WHERE regexp_matches(t, '\b' || entity || '\b')),
        head AS (SELECT DISTINCT workspace, source, scene, entity FROM own JOIN seg USING (workspace, source, seq) WHERE seg_kind = 'heading'),
        more AS (SELECT workspace, source, seq, entity, 1 FROM head JOIN seg USING (workspace, source, scene) WHERE seg_kind <> 'heading' AND (workspace, source, seq, entity) NOT IN (SELECT (workspace, source, seq, entity) FROM own))
        SELECT * FROM own UNION ALL SELECT * FROM more"""
    ).fetchall()
    got = duckdb.sql(f"SELECT workspace, source, seq, entity, count FROM '{tmp_path}/men/*.parquet' WHERE entity IN ('lan anh', 'grey heron', 'old mill')").fetchall()
    assert sorted(got) == sorted(want) and len(got) >= 10
    known = {(r.workspace, r.entity): (r.name, r.type) for r in store.entities_of(now).collect()}
    assert known[("alpha", "lan anh")] == ("Lan Anh", "PERSON") and ("beta", "lan anh") not in known and known[("alpha", "num:1801")] == ("1801", "NUMBER")


def test_questions_never_cross_workspaces(spark, shelf, versions):
    workspaces.ingest(spark, str(shelf), versions)
    tables, names = versions.tables(), workspaces.gazetteer(workspaces.markdown(spark, str(shelf)))
    asked = spark.createDataFrame([(1, "alpha", "who is Lan Anh"), (2, "beta", "who is Lan Anh"), (3, "beta", "the Old Mill burned"), (4, "gamma", "Old Mill")], "query_id long, workspace string, query string")
    answer = search.ask(tables, asked, names)
    rows = answer.evidence(8).collect()
    assert {r.workspace for r in rows if r.query_id == 1} == {"alpha"} and {r.workspace for r in rows if r.query_id in (2, 3)} == {"beta"} and not [r for r in rows if r.query_id == 4]
    assert {r.query_id: r.route for r in answer.routes.collect()} == {1: "relational", 2: "local", 3: "relational", 4: "local"}
    rel = spark.createDataFrame([("alpha", "x", 1, "Lan Anh", "OWNS", "Grey Heron"), ("beta", "x", 2, "Lan Anh", "BURNED", "Old Mill")], "workspace string, source string, id long, subject string, relation string, object string")
    got = {r.query_id: r for r in answer.contexts(rel, 3000).collect()}
    assert "Lan Anh —OWNS→ Grey Heron" in got[1].context and "BURNED" not in got[1].context and "BURNED" in got[3].context and "OWNS" not in got[3].context
    assert all("heron" not in r.context.lower() for q, r in got.items() if q in (2, 3)) and [u.seq for u in got[1].used]
    tight = {r.query_id: r for r in answer.contexts(rel, got[1].tokens - 1).collect()}
    assert "OWNS" not in tight[1].context and tight[1].tokens < got[1].tokens
    total = graph.entity_totals(tables["mentions"], names.select("workspace", F.col("key").alias("entity")), ("workspace",)).collect()
    assert {(r.workspace, r.entity) for r in total} >= {("alpha", "old mill"), ("beta", "old mill")}


def test_headings_pass_names_on(spark):
    book = spark.createDataFrame([("w", "s", "## Lan Anh\n\nShe sails.\n\n## Fog\n\nNothing.")], "workspace string, source string, text string")
    seg = segments.segment(book)
    names = spark.createDataFrame([("lan anh", "Lan Anh", "PERSON")], "key string, name string, type string")
    found = entities.mentions(seg, ["workspace", "source", "seq"], names)
    got = {r.seq: r["count"] for r in entities.with_heading_mentions(seg, found, ["workspace", "source"]).collect()}
    assert got == {0: 1, 1: 1}


def test_headings_pass_names_on_in_their_section(spark):
    """A scene ends after four segments, a section at the next heading; what stands before the first heading gets nothing."""
    text = "Before.\n\n## Lan Anh\n\n" + "\n\n".join(f"Part {i}." for i in range(6)) + "\n\nLan Anh and Lan Anh.\n\n## Fog\n\nNothing."
    seg = segments.segment(spark.createDataFrame([("w", "s", text)], "workspace string, source string, text string"))
    names = spark.createDataFrame([("lan anh", "Lan Anh", "PERSON")], "key string, name string, type string")
    key = ["workspace", "source"]
    found = entities.mentions(seg, [*key, "seq"], names)
    got = {s: {r.seq: r["count"] for r in entities.with_heading_mentions(seg, found, key, s).collect()} for s in ("scene", "section")}
    assert got["scene"] == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 2}
    assert got["section"] == {**{i: 1 for i in range(1, 8)}, 8: 2}
    assert entities.with_heading_mentions(seg.limit(0), found.limit(0), key, "section").count() == 0
    with pytest.raises(ValueError):
        entities.with_heading_mentions(seg, found, key, "chapter")


# ---- chapter files ----------------------------------------------------------------------


def test_chapter_files(spark, tmp_path):
    rows = [("alpha", 3, "Đêm dài!", "The night."), ("alpha", 12, None, "No title."), ("beta", 1, "x" * 50, None)]
    chapters = spark.createDataFrame(rows, "workspace string, chapter int, title string, text string")
    workspaces.write_chapters(chapters, str(tmp_path))
    found = {str(p.relative_to(tmp_path)): p.read_text(encoding="utf-8") for p in tmp_path.rglob("*") if p.is_file()}
    assert found == {"alpha/chapters/chapter-003-đêm-dài.md": "# Chapter 3: Đêm dài!\n\nThe night.", "alpha/chapters/chapter-012-untitled.md": "# Chapter 12\n\nNo title.", f"beta/chapters/chapter-001-{'x' * 40}.md": f"# Chapter 1: {'x' * 50}\n\n"}
    times = {p: os.stat(p).st_mtime_ns for p in tmp_path.rglob("*.md")}
    workspaces.write_chapters(chapters.withColumn("text", F.when(F.col("chapter") == 3, "Another night.").otherwise(F.col("text"))), str(tmp_path))
    changed = {p.name for p, t in times.items() if os.stat(p).st_mtime_ns != t}
    assert changed == {"chapter-003-đêm-dài.md"} and "Another" in (tmp_path / "alpha/chapters/chapter-003-đêm-dài.md").read_text(encoding="utf-8")


def test_a_failed_write_leaves_no_chapter(spark, tmp_path):
    chapters = spark.createDataFrame([("alpha", k, f"t{k}", "body") for k in range(6)], "workspace string, chapter int, title string, text string").repartition(3)
    broken = chapters.withColumn("text", F.when(F.col("chapter") == 4, F.raise_error(F.lit("torn page")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="torn page"):
        workspaces.write_chapters(broken, str(tmp_path))
    assert not list(tmp_path.rglob("*.md"))


# ---- what is said about records -------------------------------------------------------------


def test_records_of_a_session(spark):
    schema = "session int, call int, id string, claim string, start_key int, end_key int, sources array<string>, locked boolean, diverges boolean, divergence_note string"
    hits = spark.createDataFrame([(1, 1, "b", "old", 17890101, 17891231, ["s"], True, False, None), (1, 2, "b", "new", 17890101, 17891231, ["s", "t"], True, False, None), (1, 1, "a", "it", None, None, ["s"], False, True, "not so")], schema)
    text = facts.reference(facts.served(hits)).first().text
    assert text.startswith("## Sử liệu đã thẩm định (chỉ dùng những gì có ở đây)\n\n- **it** (không rõ niên đại) — s\n  - ⚠ Truyện rẽ nhánh tại đây: not so\n  - Viết theo hướng rẽ nhánh, không theo sử liệu gốc.\n- **new** (1789) — s; t\n  - Không được mâu thuẫn với ghi chép này.\n\nNgoài danh sách trên")


def test_record_filter_and_limits(spark):
    rows = spark.createDataFrame([("a", "Bến Đá burned", ["mill"], ["Ledger"]), ("b", "nothing", ["BẾN ĐÁ"], []), ("c", None, [], ["Mill"])], "id string, claim string, entities array<string>, sources array<string>")
    assert {r.id for r in facts.matching(rows, " bến Đá ").collect()} == {"a", "b"} and {r.id for r in facts.matching(rows, "MILL").collect()} == {"a", "c"} and facts.matching(rows, "").count() == 3
    asked = spark.createDataFrame([(0,), (None,), (-4,), (3,), (99,)], "n int")
    assert [r[0] for r in asked.select(facts.clamped(F.col("n"))).collect()] == [6, 6, 1, 3, 10]
