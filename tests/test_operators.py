"""Behaviour on small authored texts: headings, lists, names, records, payloads, superseding, streaming."""

import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.operators import dense, entities, facts, graph, payload, retrieval, segments, store
from lorekeep.sources import files

BOOK = """# Cast

Some opening words.

## Lan Anh (captain – 30)

- **Home**: the harbour
- **Ship**: a sloop of Bến Đá
- Sails at dawn
- Owns a map
- Fears fog

## Old Mill

The mill stands by the **Grey Heron** inn. "Who goes there?" asked Minh Đức. Nobody knew.
"""


def book(spark, text=BOOK, source="characters.md"):
    return spark.createDataFrame([("w", source, text)], "workspace string, source string, text string")


def test_segments_of_headings_and_lists(spark):
    rows = segments.segment(book(spark)).orderBy("seq").collect()
    assert [r.seg_kind for r in rows] == ["heading", "prose", "heading", *["list"] * 5, "heading", "prose"]
    assert [r.heading for r in rows][-1] == "Old Mill"
    lan = [r.scene for r in rows if r.heading.startswith("Lan")]
    assert lan == [2, 2, 2, 2, 2, 3]  # the fifth list line starts a scene
    assert rows[-1].scene == 4


def test_sentences_split_before_any_capital(spark):
    text = 'Trời mưa. Đường vắng! "Ai đó?" Ông hỏi… Ừ, tôi đây. 3 giờ sáng. version 1.2 stays'
    got = spark.createDataFrame([(text,)], "t string").select(segments.sentences("t").alias("s")).first().s
    assert got == ["Trời mưa.", "Đường vắng!", '"Ai đó?"', "Ông hỏi…", "Ừ, tôi đây.", "3 giờ sáng. version 1.2 stays"]


def plain_tokens(text):
    out = []
    for t in re.findall(r"[^\W_]+", text):
        t = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c)).replace("đ", "d")
        if len(t) > 1 or t.isdigit():
            out.append(t)
    return out


def test_tokens_fold_accents(spark):
    for text in ("Đường về Bến Đá, 7 người_khác", unicodedata.normalize("NFD", "Về Bến"), "ÉCOLE Straße a 1", ""):
        assert spark.createDataFrame([(text,)], "t string").select(X.tokens("t").alias("x")).first().x == plain_tokens(text)


def test_hashed_vector_has_unit_length(spark):
    rows = spark.createDataFrame([(1, "the grey heron sails"), (2, "")], "id long, text string")
    got = dense.hash_embed(rows, ["id"]).collect()
    assert {r.id for r in got} == {1} and math.isclose(sum(r.value**2 for r in got), 1.0)


def test_gazetteer_keeps_names_not_labels(spark):
    got = {r.name: r.type for r in entities.gazetteer_of(book(spark)).collect()}
    assert got["Lan Anh"] == "PERSON" and got["Grey Heron"] == "ITEM" and "Home" not in got and "Cast" not in got


def test_mentions_in_both_spellings(spark):
    names = spark.createDataFrame([("ben da", "Bến Đá", "PLACE"), ("heron", "Heron", "ITEM")], "key string, name string, type string")
    rows = spark.createDataFrame([(1, "Bến Đá, ben da. Ben Dá; herons, heron HERON")], "id long, text string")
    assert {r.entity: r["count"] for r in entities.mentions(rows, ["id"], names).collect()} == {"ben da": 2, "heron": 2}


def test_proper_nouns(spark):
    text = "Suddenly Lan Anh met Khoa. The Khoa of old, said NASA. Khoa left; Tuesday came. and Tuesday"
    got = {r.name: r["count"] for r in entities.proper_nouns(spark.createDataFrame([(1, text)], "id long, text string"), ["id"]).collect()}
    assert got == {"Suddenly Lan Anh": 1, "Khoa": 2, "The Khoa": 1, "NASA": 1, "Tuesday": 2}


def test_chapters_and_numbers(spark):
    rows = spark.createDataFrame([(1, "see Chapter 12, ch. 3 and chương 4; 1,500 men, 7 ships, 3.")], "id long, text string")
    assert {r.entity for r in entities.chapter_mentions(rows, ["id"]).collect()} == {"chapter:12", "chapter:3", "chapter:4"}
    assert {r.entity for r in entities.number_mentions(rows, ["id"]).collect()} == {"num:12", "num:1,500"}


def test_pagerank_equals_power_iteration(spark):
    rows = [("s", 0, "a", 1), ("s", 0, "b", 2), ("s", 1, "b", 1), ("s", 1, "c", 1), ("s", 2, "d", 1), ("t", 0, "e", 5), ("t", 0, "f", 5)]
    men = spark.createDataFrame([("w", *r) for r in rows] + [("v", "s", 0, "a", 1), ("v", "s", 0, "z", 9)], "workspace string, source string, seq int, entity string, count long")
    start = spark.createDataFrame([(1, "w", "a", 1.0), (2, "w", "e", 0.5), (2, "w", "f", 0.5), (3, "v", "a", 1.0)], "query_id long, workspace string, entity string, weight double")
    key = ["workspace", "source", "seq"]
    pairs = graph.transitions(men, key)
    moves = [(r.workspace, r.src, r.dst, r.p) for r in pairs.collect()]
    want = {}
    for query, ws, seeds in ((1, "w", {"a": 1.0}), (2, "w", {"e": 0.5, "f": 0.5}), (3, "v", {"a": 1.0})):
        pi = dict(seeds)
        for turn in range(1, graph.ROUNDS + 1):
            after = {k: (1 - graph.GAMMA) * v for k, v in seeds.items()}
            for own, src, dst, p in moves:
                if own == ws and src in pi:
                    after[dst] = after.get(dst, 0) + graph.GAMMA * p * pi[src]
            delta = sum(abs(v - pi.get(k, 0)) for k, v in after.items())
            pi = after
            if delta < graph.TOLERANCE:
                break
        want |= {(query, ws, k): (v, turn) for k, v in pi.items()}
    for by in ((pairs,), graph.moves(men, key)):  # both kinds of steps
        got = {(r.query_id, r.workspace, r.entity): (r.pi, r.rounds) for r in graph.ppr(by, start, key).collect()}
        assert set(got) == set(want) and all(math.isclose(got[k][0], want[k][0], abs_tol=1e-12) and got[k][1] == want[k][1] for k in got)
    assert {r for (q, _, _), (_, r) in want.items() if q == 2} == {1} and {k for q, _, k in want if q == 3} == {"a", "z"}


def test_closure_keeps_scene_and_headings(spark):
    seg = segments.segment(book(spark)).withColumn("ordinal", F.lit(0).cast("long")).withColumn("chapter", F.lit(None).cast("int")).withColumn("kind", F.lit("reference"))
    match = spark.createDataFrame([(1, "w", "characters.md", 4, 1.0, "match", 1)], "query_id long, workspace string, source string, seq int, score double, role string, rank int")
    got = {r.seq: r.role for r in retrieval.closure(match, seg).collect()}
    assert got == {4: "match", 3: "neighbour", 5: "neighbour", 2: "heading"}
    kept = retrieval.within_budget(retrieval.closure(match, seg), seg, 60)
    text = retrieval.context(retrieval.blocks(kept, seg)).first().context
    assert text.startswith("### characters.md — Lan Anh (captain – 30)\n") and text.count("\n") >= 2


RECORDS = """
- id: bridge
  claim: The bridge opened.
  date: 1801
  sources: [Ledger]
  introduces: [iron bridge]
  anchors: [bridge opening]
- id: office
  claim: The office was founded.
  date: 1792-05
  until: 1820
  source: Ledger
  introduces: [harbour office]
- id: Bad Id
  claim: Something.
  date: 1789-02-30
"""


@pytest.fixture(scope="module")
def curated(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("records")
    (folder / "own.yaml").write_text(RECORDS, encoding="utf-8")
    return files.records(spark, [str(folder)])


def test_records_are_validated(curated):
    got = {(r.id, r.problem) for r in facts.problems(curated).collect()}
    assert got == {("Bad Id", "bad id"), ("Bad Id", "no source"), ("Bad Id", "bad date")}


def test_dates_widen(spark):
    rows = spark.createDataFrame([("1789",), ("1789-02",), ("1788-02-29",), ("1789-13",), ("x",)], "d string")
    got = [(r.a, r.b) for r in rows.select(facts.date_key(F.col("d")).alias("a"), facts.date_key(F.col("d"), True).alias("b")).collect()]
    assert got == [(17890101, 17891231), (17890201, 17890229), (17880229, 17880229), (None, None), (None, None)]


def test_checks(spark, curated):
    rec = curated.where("id <> 'Bad Id'").select(
        "id", "claim", facts.date_key(F.col("date")).alias("start_key"), facts.date_key(F.coalesce("until", "date"), True).alias("end_key"), "ongoing", "locked", "introduces", "anchors"
    )
    texts = [
        (1, "They met on the iron bridge and used a telegraph.", 17951231),
        (2, "The bridge opening of 1805 was grand.", 18501231),
        (3, "The bridge opening of 1801 was grand. The harbour office of 1795 stood.", 18501231),
        (4, "The harbour office of 1780 was small.", None),
    ]
    drafts = facts.prepared(spark.createDataFrame(texts, "draft_id long, text string, scene_key int"))
    got = {(r.draft_id, r.kind, r.term) for r in facts.check(drafts, rec).collect()}
    assert got == {(1, "anachronism", "iron bridge"), (1, "anachronism", "telegraph"), (2, "conflict", "bridge opening"), (4, "conflict", "harbour office")}


def test_loose_payloads(spark):
    raws = [
        (1, '```json\n{"segments":[{"index":3,"entities":[{"name":"Lan","type":"person"},"Khoa"],"relations":[{"source":"Lan","relation":"is friend","target":"Khoa"}]}]}\n```'),
        (2, 'Here: [{"entities":[{"text":"Mill","type":"location"}],"relations":[{"subject":"she","relation":"OWNS","object":"Mill"}]}] thanks'),
        (3, "no json at all"),
    ]
    parsed = payload.parsed(spark.createDataFrame(raws, "batch_id long, raw string"))
    assert {(r.batch_id, r["index"], r.name, r.type) for r in payload.entities(parsed).collect()} == {(1, 3, "Lan", "PERSON"), (1, 3, "Khoa", "PROPER"), (2, 0, "Mill", "PLACE")}
    assert [tuple(r) for r in payload.relations(parsed).collect()] == [(1, 3, "Lan", "IS_FRIEND", "Khoa")]


def test_write_superseding_and_stream(spark, tmp_path):
    from lorekeep.streaming import ingest

    schema = "workspace string, source string, kind string, chapter int, ordinal long, version long, text string"
    spark.createDataFrame([("w", "a", "chapter", 1, 1001, 1, "Old words."), ("w", "b", "chapter", 2, 1002, 1, "Stay.")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    ingest.start(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    spark.createDataFrame([("w", "a", "chapter", 1, 1001, 2, "New words.\n\nMore.")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    ingest.start(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = sorted((r.source, r.seq, r.text) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 0, "New words."), ("a", 1, "More."), ("b", 0, "Stay.")]


def test_ordinals_are_stable(spark):
    schema = "workspace string, source string, kind string, chapter int, arrived long"
    rows = spark.createDataFrame([("w", "a.md", "reference", None, 1), ("w", "n.md", "document", None, 2), ("w", "c.md", "chapter", 4, 3)], schema)
    assert {r.source: r.ordinal for r in store.ordinals(rows).collect()} == {"a.md": 0, "n.md": 1000, "c.md": 1004}


def test_draft_and_budget(spark):
    row = spark.createDataFrame([("a " * 50,)], "t string").select(X.fit_draft("t", 20).alias("short"), X.output_budget(F.lit(1000)).alias("budget")).first()
    assert row.short == " ".join(["a"] * 7) + "\n\n[... middle truncated for token budget ...]\n\n" + " ".join(["a"] * 7) and row.budget == 2880


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "chapter-007.md").write_text("# Seven\n\nText.", encoding="utf-8")
    row = files.markdown(spark, str(tmp_path), reference=False).first()
    assert (row.source, row.chapter, row.kind) == ("chapter-007.md", 7, "chapter")
