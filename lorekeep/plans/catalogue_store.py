"""Queries over the store's changes, relations, payloads of any shape, and what is said about records and drafts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import entities, facts, payload, retrieval, store
from ..session import saved, table
from . import sql as S
from .catalogue import documents, query, sources, terms_sql
from .catalogue_search import BASE, DRAFTS, LEXICON, SEG, WEIGHED, YEARS, drafts, gazetteer, in_one, mentions_of, names_of, one_space, records


def _counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, t in sorted(tables.items())])


# ---- changes of the store ---------------------------------------------------


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    seg = saved(one_space(spark, d), "segments")
    men = mentions_of(spark, d, seg=seg)
    return {
        "sources": sources(spark, d).drop("text"), "segments": seg, "mentions": men, "entities": men.select("entity").distinct(),
        "embed_cache": seg.select(F.sha2("text", 256).alias("hash")).distinct(),
    }


@query(
    f"""WITH {BASE}, gone AS (SELECT source FROM src WHERE doc_id % 7 = 0)
    SELECT 'sources' AS name, count(*) AS n FROM src WHERE source NOT IN (SELECT source FROM gone) UNION ALL SELECT 'segments', count(*) FROM seg WHERE source NOT IN (SELECT source FROM gone)
    UNION ALL SELECT 'mentions', count(*) FROM men WHERE source NOT IN (SELECT source FROM gone) UNION ALL SELECT 'entities', count(DISTINCT entity) FROM men WHERE source NOT IN (SELECT source FROM gone)
    UNION ALL SELECT 'embed_cache', count(DISTINCT text) FROM seg"""
)
def delete_sources(spark, d):
    return _counts(store.without_sources(_tables(spark, d), sources(spark, d).where("doc_id % 7 = 0"), ("source",)))


@query(f"WITH {S.SEGMENTS} SELECT unnest(['entities', 'mentions', 'segments', 'sources']) AS name, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'embed_cache', count(DISTINCT text) FROM seg")
def clear_tables(spark, d):
    return _counts(store.cleared(_tables(spark, d)))


NEW_SEGMENTS = S.SEGMENTS.replace("doc_id, text FROM documents)", "doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' Then see Chapter 977.' ELSE text END AS text FROM documents)")


@query(
    f"""WITH {NEW_SEGMENTS} SELECT source, count(*) AS segments, CAST(sum(CASE WHEN contains(text, 'Chapter 977') THEN 1 ELSE 0 END) AS BIGINT) AS chapters,
    count(*) FILTER (length({S.tokens('text')}) > 0) AS vectors FROM seg GROUP BY source"""
)
def ingest_replaces(spark, d):
    """All sources are ingested, then every fifth once more with another end: nothing of its old rows is left."""
    names, rows = saved(gazetteer(spark, d), "gazetteer"), sources(spark, d).drop("doc_id")
    old = {n: saved(t, f"old-{n}") for n, t in store.indexed(rows, names).items()}
    fresh = sources(spark, d).where("doc_id % 5 = 0").drop("doc_id").withColumn("text", F.concat("text", F.lit(" Then see Chapter 977.")))
    now = store.ingested(old, fresh, names)
    seg = now["segments"].groupBy("source").agg(F.count("*").alias("segments"))
    men = now["mentions"].where("entity = 'chapter:977'").groupBy("source").agg(F.sum("count").alias("chapters"))
    vec = now["vectors"].groupBy("source").agg(F.count("*").alias("vectors"))
    return seg.join(men, "source", "left").join(vec, "source", "left").select("source", "segments", F.coalesce("chapters", F.lit(0)).alias("chapters"), F.coalesce("vectors", F.lit(0)).alias("vectors"))


NUMBERS = r"num AS (SELECT doc_id, 'num:' || raw AS entity, count(*) AS count FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b\d[\d.,]*\b')) AS raw FROM documents) WHERE length(raw) >= 2 GROUP BY ALL)"


@query(f"WITH {NUMBERS} SELECT doc_id, entity, CAST(CASE WHEN doc_id % 2 = 0 THEN 2 * count ELSE count END AS BIGINT) AS count FROM num")
def mentions_accumulate(spark, d):
    found = entities.number_mentions(documents(spark, d), ["doc_id"])
    return store.accumulated(found, found.where("doc_id % 2 = 0"), ["doc_id", "entity"])


@query("SELECT lang AS workspace, CAST(coalesce(max(CASE WHEN doc_id % 10 <> 0 THEN doc_id END), 0) + 1 AS INTEGER) AS chapter FROM documents GROUP BY lang")
def next_chapter(spark, d):
    return store.next_chapter(sources(spark, d))


@query("SELECT lang AS workspace, count(*) FILTER (doc_id % 10 = 0) AS reference, count(*) FILTER (doc_id % 10 <> 0) AS chapters, row_number() OVER (ORDER BY lang) AS place FROM documents GROUP BY lang")
def workspace_files(spark, d):
    """Files of each workspace by kind, the workspaces in order of their names (few rows)."""
    rows = sources(spark, d).groupBy("workspace").agg(F.count(F.when(F.col("kind") == "reference", 1)).alias("reference"), F.count(F.when(F.col("kind") == "chapter", 1)).alias("chapters"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy("workspace")).cast("long"))


@query("SELECT vec_id, label FROM embeddings WHERE label % 3 = 1")
def vectors_of_space(spark, d):
    rows = table(spark, d, "embeddings").withColumn("space", F.concat(F.lit("m@"), (F.col("label") % 3).cast("string")))
    return store.of_space(rows, "m@1").select("vec_id", "label")


@query(r"SELECT doc_id, substr(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}_]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS slug, CAST(nullif(regexp_replace(source || doc_id, '[^0-9]', '', 'g'), '') AS BIGINT) AS chapter FROM (SELECT doc_id, source, split_part(text, chr(10), 1) AS title FROM documents)")
def chapter_names(spark, d):
    rows = documents(spark, d).select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.concat("source", F.col("doc_id").cast("string")).alias("name"))
    return rows.select("doc_id", X.chapter_slug("title").alias("slug"), X.chapter_number("name").alias("chapter"))


# ---- proper names -----------------------------------------------------------

BOUNDARY = entities.BOUNDARY.replace("'", "''").replace("\n", "' || chr(10) || '")
PROPER = rf"""WITH tk AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') AS t FROM documents),
w0 AS (SELECT doc_id, i, t[i] AS word, CASE WHEN i > 1 THEN t[i - 1] ELSE '' END AS gap FROM (SELECT doc_id, t, unnest(generate_series(1, len(t))) AS i FROM tk) WHERE regexp_matches(t[i], '^[\p{{L}}\p{{N}}]')),
w1 AS (SELECT *, regexp_matches(word, '^\p{{Lu}}') AS cap, {S.fold('word')} AS low, regexp_replace(gap, '[\s\p{{Z}}]+$', '') AS trimmed FROM w0),
w2 AS (SELECT *, list_contains({S.STOP}, low) AS stop, (trimmed = '' AND row_number() OVER o = 1) OR (trimmed <> '' AND contains('{BOUNDARY}', right(trimmed, 1))) AS starts,
    CASE WHEN cap AND gap = ' ' AND coalesce(lag(cap) OVER o, false) THEN 0 ELSE 1 END AS head FROM w1 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
w3 AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM w2), w4 AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, island ORDER BY i) - 1) // 6 AS run FROM w3 WHERE cap),
runs AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS name, string_agg(low, ' ' ORDER BY i) AS entity, count(*) AS n, min(i) AS place, bool_and(stop) AS all_stop FROM w4 GROUP BY doc_id, island, run),
mid AS (SELECT DISTINCT doc_id, low AS entity, true AS mid FROM w4 WHERE NOT starts)
SELECT doc_id, entity, arg_min(name, place) AS name, count(*) AS count FROM runs LEFT JOIN mid USING (doc_id, entity)
WHERE NOT all_stop AND (n > 1 OR (length(name) > 1 AND (coalesce(mid, false) OR upper(name) = name))) GROUP BY doc_id, entity"""


@query(PROPER)
def proper_nouns(spark, d):
    return entities.proper_nouns(documents(spark, d), ["doc_id"])


# ---- relations --------------------------------------------------------------

ENDS = r"""SELECT conv_id * 100000 + turn AS id, regexp_extract(text, '\p{L}+') AS subject, 'SPEAKS_TO' AS relation, regexp_extract(text, '(\p{L}+)\P{L}*$', 1) AS object, conv_id FROM conversations"""
TRIPLES = f"tri AS (SELECT * FROM ({ENDS}) WHERE subject <> '' AND object <> '')"


def _triples(spark: SparkSession, d: str) -> DataFrame:
    """A relation of the first and the last word of every turn; later turns and conversations are newer."""
    first, last = F.regexp_extract("text", r"\p{L}+", 0), F.regexp_extract("text", r"(\p{L}+)\P{L}*$", 1)
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), first.alias("subject"), F.lit("SPEAKS_TO").alias("relation"), last.alias("object"), "conv_id")
    return rows.where("subject <> '' and object <> ''")


NEWEST = f"""ends AS (SELECT DISTINCT id, subject, relation, object, {S.fold('side')} AS entity FROM (SELECT *, unnest([subject, object]) AS side FROM tri)),
newest AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY id DESC) AS rank, subject, relation, object FROM ends JOIN (SELECT DISTINCT {S.fold('subject')} AS entity FROM tri WHERE conv_id % 10 = 0) USING (entity) QUALIFY rank <= 8)"""


def _newest(spark: SparkSession, d: str) -> DataFrame:
    rows = _triples(spark, d)
    names = rows.where("conv_id % 10 = 0").select(X.fold("subject").alias("entity")).distinct()
    return payload.relations_of(rows, names, 8)


@query(f"WITH {TRIPLES}, {NEWEST} SELECT * FROM newest")
def relations_newest(spark, d):
    return _newest(spark, d).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""WITH {TRIPLES}, {NEWEST}, l AS (SELECT entity, '- ' || subject || ' —' || relation || '→ ' || object AS line, min(rank) AS place FROM newest GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY place, line) AS nth FROM l QUALIFY nth <= 3)
    SELECT entity AS query_id, md5('### Quan hệ đã biết (known relations)' || chr(10) || string_agg(line, chr(10) ORDER BY nth)) AS body FROM k GROUP BY entity"""
)
def relation_lines(spark, d):
    rows = _newest(spark, d).select(F.col("entity").alias("query_id"), F.col("rank").alias("place"), "subject", "relation", "object")
    return payload.relation_block(rows, 3).select("query_id", F.md5(F.col("text").cast("binary")).alias("body"))


@query(f"WITH {TRIPLES} SELECT count(*) AS relations, count(DISTINCT {S.fold('subject')}) AS subjects FROM tri")
def relation_counts(spark, d):
    return _triples(spark, d).agg(F.count("*").alias("relations"), F.countDistinct(X.fold("subject")).alias("subjects"))


@query(
    f"""WITH {BASE}, {WEIGHED}, near AS (SELECT a.entity, b.entity AS neighbour, round(sum(a.w * b.w), 6) AS weight FROM wm a JOIN wm b USING (source, seq) WHERE a.entity <> b.entity GROUP BY ALL),
    top AS (SELECT entity, neighbour, row_number() OVER (PARTITION BY entity ORDER BY weight DESC, neighbour) AS rank FROM near QUALIFY rank <= 10),
    rel AS (SELECT entity, string_agg(neighbour, ', ' ORDER BY rank) AS related FROM top GROUP BY entity),
    last AS (SELECT entity, source || '#' || seq AS place, ordinal, seq FROM men JOIN seg USING (source, seq) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ordinal DESC, source DESC, seq DESC) <= 8),
    shown AS (SELECT entity, string_agg(place, ', ' ORDER BY ordinal, seq, place) AS segments FROM last GROUP BY entity)
    SELECT entity, entity AS name, 'CONCEPT' AS type, true AS found, CAST(sum(n) AS BIGINT) AS mentions, any_value(segments) AS segments, any_value(related) AS related FROM men JOIN shown USING (entity) LEFT JOIN rel USING (entity) GROUP BY entity
    UNION ALL SELECT 'zzzunknown', 'Zzzunknown', NULL, false, 0, NULL, NULL"""
)
def entity_profiles(spark, d):
    """Every mentioned name and one unknown: best seed, mentions, last segments, related entities."""
    names, seg = names_of(spark, d), saved(one_space(spark, d), "segments")
    men = mentions_of(spark, d, names, seg)
    asked = men.select(F.col("entity").alias("name"), F.col("entity").alias("key")).distinct().unionByName(spark.range(1).select(F.lit("Zzzunknown").alias("name"), F.lit("zzzunknown").alias("key")))
    out = retrieval.profiles(in_one(asked), men, seg.select(*SEG, "ordinal"), names)
    return out.drop("workspace", "asked", "relations")


# ---- payloads ---------------------------------------------------------------


def _odd_payloads(spark: SparkSession, d: str) -> DataFrame:
    """A payload for every turn, in one of seven shapes."""
    name = F.regexp_replace("text", r"[^\p{L} ]+", " ")
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("batch_id"), F.substring(F.trim(F.regexp_replace(name, " +", " ")), 1, 30).alias("name"))
    rows = rows.where("name <> ''").withColumn("name", F.trim("name")).withColumn("shape", F.col("batch_id") % 7)
    item = F.concat(F.lit('"entities": [{"surface": "'), "name", F.lit('", "kind": "people"}, "'), "name", F.lit(' II"]'))
    raw = (
        F.when(F.col("shape") == 0, F.concat(F.lit('```json\n{"segments": [{"idx": 1, '), item, F.lit("}]}\n```")))
        .when(F.col("shape") == 1, F.concat(F.lit("Here it is: [{"), item, F.lit("}] - that [is] all]")))
        .when(F.col("shape") == 2, F.concat(F.lit('{"segments": [{"index": 9, '), item, F.lit("}]}")))
        .when(F.col("shape") == 3, F.concat(F.lit("no json "), "name"))
        .when(F.col("shape") == 4, F.concat(F.lit('{"index": 0, '), item, F.lit("} and so on {}")))
        .when(F.col("shape") == 5, F.concat(F.lit('[{"segment_index": "x", '), item, F.lit("}, {"), item, F.lit("}]")))
        .otherwise(F.concat(F.lit('{"segments": [{'), item))
    )
    return rows.select("batch_id", raw.alias("raw"), F.lit(3).alias("count"))


ODD = r"""odd AS (SELECT conv_id * 100000 + turn AS batch_id, trim(substr(trim(regexp_replace(regexp_replace(text, '[^\p{L} ]+', ' ', 'g'), ' +', ' ', 'g')), 1, 30)) AS name, (conv_id * 100000 + turn) % 7 AS shape FROM conversations)"""


@query(
    f"""WITH {ODD}, i AS (SELECT batch_id, name, unnest(CASE shape WHEN 0 THEN [1] WHEN 1 THEN [0] WHEN 4 THEN [0] WHEN 5 THEN [0, 1] ELSE CAST([] AS INTEGER[]) END) AS index FROM odd WHERE name <> '')
    SELECT batch_id, index, name, 'PERSON' AS type FROM i UNION ALL SELECT batch_id, index, name || ' II', 'PROPER' FROM i"""
)
def payload_shapes(spark, d):
    return payload.entities(payload.parsed(_odd_payloads(spark, d), count="count"))


@query(f"WITH {ODD} SELECT batch_id FROM odd WHERE name <> '' AND shape IN (3, 6)")
def payload_unreadable(spark, d):
    return payload.unreadable(_odd_payloads(spark, d))


# ---- records and drafts -----------------------------------------------------

RECORDS = """rec AS (SELECT o_orderkey, 'r' || o_orderkey AS id, 'claim ' || o_orderpriority AS claim, CAST(year(o_orderdate) * 10000 + CASE o_orderkey % 3 WHEN 0 THEN 101 WHEN 1 THEN 101 ELSE month(o_orderdate) * 100 + day(o_orderdate) END AS INTEGER) AS a,
    CAST(CASE o_orderkey % 3 WHEN 0 THEN year(o_orderdate) * 10000 + 1231 WHEN 1 THEN (year(o_orderdate) + 2) * 10000 + 1231 ELSE year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) END AS INTEGER) AS b FROM orders),
lab AS (SELECT *, CASE WHEN a // 10000 <> b // 10000 THEN (a // 10000) || '–' || (b // 10000) WHEN a % 10000 = 101 AND b % 10000 // 100 = 12 THEN '' || (a // 10000) ELSE format('{:04d}-{:02d}-{:02d}', a // 10000, a % 10000 // 100, a % 100) END AS dated FROM rec)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    """orders as records: a year, a span of years, or a day."""
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    day = F.year(t) * 10000 + F.month(t) * 100 + F.dayofmonth(t)
    start = F.when(k % 3 == 2, day).otherwise(F.year(t) * 10000 + 101)
    end = F.when(k % 3 == 0, F.year(t) * 10000 + 1231).when(k % 3 == 1, (F.year(t) + 2) * 10000 + 1231).otherwise(day)
    return table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("r"), k.cast("string")).alias("id"), F.concat(F.lit("claim "), "o_orderpriority").alias("claim"), start.alias("start_key"), end.alias("end_key"),
        F.array(F.lit("a"), "o_orderstatus").alias("sources"), F.when(k % 5 == 0, "disputed").otherwise("attested").alias("confidence"), F.when(k % 4 == 0, F.lit("see also")).alias("note"),
        (k % 6 == 0).alias("diverges"), (k % 2 == 0).alias("locked"), F.lit("it goes on").alias("divergence_note"),
    )


@query(f"WITH {RECORDS} SELECT id, '[' || id || ' · ' || dated || '] ' || claim || ' — nguồn: a; ' || o_orderstatus AS citation FROM lab JOIN orders USING (o_orderkey)")
def record_citations(spark, d):
    return facts.citation(_records(spark, d))


@query(
    f"""WITH {RECORDS}, l AS (SELECT o_custkey AS query_id, o_orderkey, '● [' || id || '] ' || dated || ' — ' || claim || CASE WHEN o_orderkey % 5 = 0 THEN '  (mức độ: disputed)' ELSE '' END || chr(10) || '   nguồn: a; ' || o_orderstatus
    || CASE WHEN o_orderkey % 4 = 0 THEN chr(10) || '   ghi chú: see also' ELSE '' END || CASE WHEN o_orderkey % 6 = 0 THEN chr(10) || '   ⚠ TRUYỆN NÀY RẼ NHÁNH TẠI ĐÂY: it goes on' || chr(10) || '   → Hãy viết theo hướng rẽ nhánh, KHÔNG theo sử liệu gốc.'
    WHEN o_orderkey % 2 = 0 THEN chr(10) || '   → Ghi chép khóa: chương không được mâu thuẫn với điều này.' ELSE '' END AS line FROM lab JOIN orders USING (o_orderkey))
    SELECT query_id, md5(string_agg(line, chr(10) || chr(10) ORDER BY o_orderkey)) AS body FROM l GROUP BY query_id"""
)
def record_rendering(spark, d):
    hits = _records(spark, d).join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("query_id")), "o_orderkey").withColumn("rank", F.col("o_orderkey"))
    return facts.rendered(hits).select("query_id", F.md5(F.col("text").cast("binary")).alias("body"))


@query(
    f"""WITH {RECORDS}, l AS (SELECT o_custkey AS query_id, o_orderkey, '● [' || id || '] ' || dated || ' — ' || claim || CASE WHEN o_orderkey % 5 = 0 THEN '  (mức độ: disputed)' ELSE '' END || chr(10) || '   nguồn: a; ' || o_orderstatus
    || CASE WHEN o_orderkey % 4 = 0 THEN chr(10) || '   ghi chú: see also' ELSE '' END || CASE WHEN o_orderkey % 6 = 0 THEN chr(10) || '   ⚠ TRUYỆN NÀY RẼ NHÁNH TẠI ĐÂY: it goes on' || chr(10) || '   → Hãy viết theo hướng rẽ nhánh, KHÔNG theo sử liệu gốc.'
    WHEN o_orderkey % 2 = 0 THEN chr(10) || '   → Ghi chép khóa: chương không được mâu thuẫn với điều này.' ELSE '' END AS line FROM lab JOIN orders USING (o_orderkey))
    SELECT c_custkey AS query_id, md5(coalesce(string_agg(line, chr(10) || chr(10) ORDER BY o_orderkey), '{facts.NOTHING}')) AS body FROM customer LEFT JOIN l ON query_id = c_custkey GROUP BY c_custkey"""
)
def record_answers(spark, d):
    """What every customer is told, also those without an order."""
    hits = _records(spark, d).join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("query_id")), "o_orderkey").withColumn("rank", F.col("o_orderkey"))
    return facts.rendered(hits, table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"))).select("query_id", F.md5(F.col("text").cast("binary")).alias("body"))


@query(
    f"""WITH {RECORDS}, l AS (SELECT o_custkey AS session, id, '- **' || claim || '** (' || dated || ') — a; ' || o_orderstatus || CASE WHEN o_orderkey % 6 = 0 THEN chr(10) || '  - ⚠ Truyện rẽ nhánh tại đây: it goes on' || chr(10) || '  - Viết theo hướng rẽ nhánh, không theo sử liệu gốc.'
    WHEN o_orderkey % 2 = 0 THEN chr(10) || '  - Không được mâu thuẫn với ghi chép này.' ELSE '' END AS line FROM lab JOIN orders USING (o_orderkey))
    SELECT session, count(*) AS records, md5('{facts.REFERENCE}' || chr(10) || string_agg(line, chr(10) ORDER BY id) || chr(10) || '{facts.REFERENCE_END}') AS body FROM l GROUP BY session"""
)
def record_reference(spark, d):
    """Every customer's session was shown its orders, and some of them twice."""
    hits = _records(spark, d).join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("session")), "o_orderkey")
    hits = hits.withColumn("call", F.lit(1)).unionByName(hits.where("o_orderkey % 3 = 0").withColumn("call", F.lit(2)))
    shown = facts.served(hits)
    return shown.groupBy("session").agg(F.count("*").alias("records")).join(facts.reference(shown), "session").select("session", "records", F.md5(F.col("text").cast("binary")).alias("body"))


@query(
    """WITH r AS (SELECT event_id, 'e' || event_id AS id, CASE WHEN event_id % 10 <> 0 THEN CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS INTEGER) END AS start_key FROM events),
    t AS (SELECT *, 0 AS late FROM r WHERE start_key BETWEEN 20240105 AND 20240120 QUALIFY row_number() OVER (ORDER BY start_key, id) <= 1000)
    SELECT event_id, start_key, late FROM t UNION ALL SELECT event_id, start_key, 1 FROM r WHERE start_key IS NULL"""
)
def record_listing(spark, d):
    """A window of the timeline, and the undated records behind it."""
    key = F.year("ts") * 10000 + F.month("ts") * 100 + F.dayofmonth("ts")
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.when(F.col("event_id") % 10 != 0, key).alias("start_key"), F.lit(None).cast("int").alias("end_key"))
    return facts.listing(rows, 20240105, 20240120).select("event_id", "start_key", "late")


@query(
    f"""WITH u AS (SELECT 'r' || doc_id AS id, text || chr(10) || source || chr(10) || lang AS text, source, doc_id FROM documents),
    asked AS (SELECT doc_id AS query_id, text AS query, 15000000 + doc_id // 2 AS after, least(greatest(doc_id // 100 * 7 - 3, 1), 10) AS most FROM documents WHERE doc_id % 100 = 0), {terms_sql('asked')}, {S.bm25('u', 'id', 'terms')},
    bonus AS (SELECT query_id, id, 2.5 AS bonus FROM u JOIN asked ON contains({S.fold('query')}, source)),
    s AS (SELECT query_id, id, round(coalesce(score, 0) + CAST(coalesce(bonus, 0) AS DOUBLE), 3) AS score FROM bm25 FULL JOIN bonus USING (query_id, id))
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 15000000 + doc_id, id) AS rank, id, score FROM s JOIN u USING (id) JOIN asked USING (query_id) WHERE doc_id % 4 <> 0 AND 15000000 + doc_id >= after QUALIFY rank <= any_value(most) OVER (PARTITION BY query_id)"""
)
def fact_search_limits(spark, d):
    """Without records that diverge, from a date on, as many as asked for (clamped)."""
    i = F.col("doc_id")
    rows = documents(spark, d).select(
        F.concat(F.lit("r"), i.cast("string")).alias("id"), F.col("text").alias("claim"), F.array("source").alias("entities"), F.array("lang").alias("tags"), F.lit(None).cast("string").alias("note"),
        (15000000 + i).alias("start_key"), (15000000 + i).alias("end_key"), (i % 4 == 0).alias("diverges"),
    )
    asked = documents(spark, d).where("doc_id % 100 = 0").select(i.alias("query_id"), F.col("text").alias("query"), F.lit(None).cast("long").alias("before"), (15000000 + F.floor(i / 2)).alias("after"), (F.floor(i / 100) * 7 - 3).cast("int").alias("limit"))
    return facts.found(rows, asked, divergences=False).withColumn("rank", F.col("rank").cast("long"))


@query(
    """WITH n AS (SELECT event_type AS file, user_id % 3 AS scope, 'u' || user_id AS id, count(*) AS n FROM events GROUP BY ALL)
    SELECT DISTINCT id, 'duplicate id in one file' AS problem FROM n WHERE n > 1 UNION ALL SELECT 'u' || user_id, 'diverges without a note' FROM events WHERE event_id % 50 = 0"""
)
def records_refused(spark, d):
    u = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    rows = table(spark, d, "events").select(
        u.alias("id"), F.lit("c").alias("claim"), F.array(F.lit("s")).alias("sources"), F.lit("attested").alias("confidence"), F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("until"),
        (F.col("event_id") % 25 == 0).alias("diverges"), F.when(F.col("event_id") % 50 != 0, "n").alias("divergence_note"), (F.col("user_id") % 3).alias("scope_rank"), F.col("event_type").alias("file"),
    )
    return facts.problems(rows).unionByName(facts.duplicates(rows))


LABELS = "(VALUES " + ", ".join(f"({r}, '{what}')" for r, (_, _, what) in enumerate(facts.ANACHRONISMS)) + ") AS l(rule, what)"


@query(
    f"""WITH {LEXICON}, {DRAFTS.replace('CAST(NULL AS VARCHAR) AS record_id FROM df', 'CAST(NULL AS VARCHAR) AS record_id, rule, year, scene_key FROM df')}, {YEARS.replace('bool_or(', 'max(year) AS most, arg_min(year, pos) AS nearest, any_value(ongoing) AS ong, any_value(y0) AS ya, any_value(y1) AS yb, bool_or(')},
    e AS (SELECT draft_id, 'anachronism' AS kind, term, "at", record_id, '“' || term || '” (' || what || ') chưa tồn tại vào năm ' || (scene_key // 10000) || '; sớm nhất khoảng ' || year || '.' AS message FROM old JOIN {LABELS} USING (rule)
    UNION ALL SELECT draft_id, kind, term, "at", record_id, '“' || term || '” chỉ xuất hiện từ ' || CASE WHEN r.y0 <> r.y1 THEN r.y0 || '–' || r.y1 ELSE r.y0 || '-01-01' END || ', sau thời điểm của cảnh này.' FROM early JOIN (SELECT id AS record_id, y0, y1 FROM rec) r USING (record_id)
    UNION ALL SELECT draft_id, kind, term, "at", record_id, 'Bản thảo đặt “' || term || '” vào năm ' || CASE WHEN ong THEN most ELSE nearest END || ', nhưng ghi chép xác nhận ' || CASE WHEN ya <> yb THEN ya || '–' || yb ELSE ya || '-01-01' END || '.' FROM wrong WHERE NOT ok AND (draft_id, record_id) NOT IN (SELECT (draft_id, record_id) FROM early)),
    p AS (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY CASE kind WHEN 'conflict' THEN 0 ELSE 1 END, "at", coalesce(record_id, ''), term) AS place FROM e)
    SELECT draft_id, place, kind, message, kind IS NULL AS ok FROM (SELECT draft_id FROM dr) LEFT JOIN p USING (draft_id)"""
)
def check_report(spark, d):
    out = facts.report(drafts(spark, d), saved(records(spark, d), "records"))
    return out.select("draft_id", F.col("place").cast("long").alias("place"), "kind", "message", "ok")
