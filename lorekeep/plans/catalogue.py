"""Registered queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chat, dense, entities, lexical, segments, store
from ..session import saved, table
from . import sql as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its name, with its oracle."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


# ---- bindings of the tables -------------------------------------------------


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def sources(spark: SparkSession, d: str) -> DataFrame:
    """documents as sources: every tenth is reference material, the others are chapters."""
    i, reference = F.col("doc_id"), F.col("doc_id") % 10 == 0
    return documents(spark, d).select(
        F.col("lang").alias("workspace"),
        F.concat(F.lit("doc-"), i.cast("string")).alias("source"),
        F.when(reference, "reference").otherwise("chapter").alias("kind"),
        F.when(~reference, i.cast("int")).alias("chapter"),
        F.when(reference, F.floor(i / 10)).otherwise(1000 + i).cast("long").alias("ordinal"),
        "doc_id",
        "text",
    )


def segments_of(spark: SparkSession, d: str) -> DataFrame:
    return segments.segment(sources(spark, d))


def fixed_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "the edition and that heating"), (2, "thonre oried onnt"), (3, "la rele ouvi éau")], "query_id long, query string")


def asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated batch of queries: every document whose id is divisible by 100, whole text."""
    return documents(spark, d).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


FIXED_SQL = "fixed(query_id, query) AS (VALUES (1, 'the edition and that heating'), (2, 'thonre oried onnt'), (3, 'la rele ouvi éau'))"


def terms_sql(queries: str, name: str = "terms") -> str:
    return f"{name} AS (SELECT DISTINCT CAST(query_id AS BIGINT) AS query_id, unnest(CASE WHEN length(c) > 0 THEN c ELSE k END) AS term FROM (SELECT query_id, {S.content('query')} AS c, {S.tokens('query')} AS k FROM {queries}))"


# ---- text -------------------------------------------------------------------


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({S.tokens('text')}) AS term FROM documents) GROUP BY term")
def tokenize_counts(spark, d):
    return documents(spark, d).select(F.explode(X.tokens("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, length(c) AS n, length(list_distinct(c)) AS n_distinct, md5(array_to_string(c, ' ')) AS digest FROM (SELECT doc_id, {S.content('text')} AS c FROM documents)")
def content_tokens(spark, d):
    rows = documents(spark, d).select("doc_id", X.content_tokens("text").alias("c"))
    return rows.select("doc_id", F.size("c").cast("long").alias("n"), F.size(F.array_distinct("c")).cast("long").alias("n_distinct"), F.md5(F.array_join("c", " ").cast("binary")).alias("digest"))


@query(f"SELECT doc_id, md5({S.fold('text')}) AS folded FROM documents")
def accent_fold(spark, d):
    return documents(spark, d).select("doc_id", F.md5(X.fold("text").cast("binary")).alias("folded"))


@query(f"SELECT doc_id, CAST({S.estimate('text')} AS BIGINT) AS tokens FROM documents")
def estimate_tokens(spark, d):
    return documents(spark, d).select("doc_id", X.estimate_tokens("text").alias("tokens"))


@query(f"SELECT CAST({S.fnv('feature', X.INDEX_SEED)} % 384 AS BIGINT) AS bucket, count(*) AS n FROM (SELECT DISTINCT 'w:' || term AS feature FROM (SELECT unnest({S.tokens('text')}) AS term FROM documents)) GROUP BY 1")
def fnv_hash_buckets(spark, d):
    words = documents(spark, d).select(F.explode(X.tokens("text")).alias("term")).distinct().select(F.concat(F.lit("w:"), "term").alias("feature"))
    return words.groupBy((X.fnv1a("feature", X.INDEX_SEED) % 384).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {S.features('documents', 'doc_id')} SELECT doc_id, dim, round(value, 6) AS value FROM vec WHERE abs(value) > 1e-9")
def hash_embed_sparse(spark, d):
    return dense.hash_embed(documents(spark, d), ["doc_id"]).where("abs(value) > 1e-9").select("doc_id", "dim", F.round("value", 6).alias("value"))


SLUG = rf"regexp_replace(substr(regexp_replace(regexp_replace({S.fold('title')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), '-+$', '')"


@query(rf"SELECT doc_id, title, CASE WHEN {SLUG} = '' THEN 'novel' ELSE {SLUG} END AS slug FROM (SELECT doc_id, regexp_replace(split_part(text, chr(10), 1), '^[# ]+', '') AS title FROM documents)")
def slugify_titles(spark, d):
    rows = documents(spark, d).select("doc_id", X.title_of("text").alias("title"))
    return rows.select("doc_id", "title", X.slugify("title").alias("slug"))


@query(f"SELECT doc_id, length({S.words('text')}) AS words FROM documents")
def word_counts(spark, d):
    return documents(spark, d).select("doc_id", X.word_count("text").alias("words"))


@query(f"SELECT doc_id, CAST(least(greatest(floor(length({S.words('text')}) * CAST(2.4 AS DOUBLE) * CAST(1.2 AS DOUBLE)), 1024), 16384) AS BIGINT) AS budget FROM documents")
def output_budget(spark, d):
    return documents(spark, d).select("doc_id", X.output_budget(X.word_count("text")).alias("budget"))


@query(
    f"""SELECT doc_id, md5(CASE WHEN greatest(length(text) // 3, length(w)) <= 400 THEN text
        ELSE array_to_string(w[1:150], ' ') || chr(10) || chr(10) || '[... middle truncated for token budget ...]' || chr(10) || chr(10) || array_to_string(w[-150:], ' ') END) AS draft
        FROM (SELECT doc_id, text, {S.words('text')} AS w FROM documents)"""
)
def draft_trim(spark, d):
    rows = documents(spark, d).select("doc_id", X.fit_draft("text", 400).alias("draft"))
    return rows.select("doc_id", F.md5(F.col("draft").cast("binary")).alias("draft"))


HINTS = lambda hints: " OR ".join(f"contains(lower(text), '{h}')" for h in hints)


@query(f"SELECT conv_id, turn, CASE WHEN {HINTS(X.CONTINUITY_HINTS)} THEN 'continuity' WHEN {HINTS(X.DESCRIPTION_HINTS)} THEN 'description' ELSE 'general' END AS intent FROM conversations WHERE role = 'user'")
def intent_classify(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", X.intent("text").alias("intent"))


@query(
    r"""SELECT page_id, length(name) > 0 AND length(name) <= 255 AND NOT regexp_matches(name, '[/\\\x00:]') AND NOT starts_with(name, '.')
        AND NOT regexp_matches(lower(name), '^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$') AS safe FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS name FROM pages)"""
)
def safe_names(spark, d):
    return table(spark, d, "pages").select("page_id", X.safe_name(F.regexp_replace("url", "^[a-z]+://", "")).alias("safe"))


# ---- segmentation -----------------------------------------------------------


@query(f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS nth, md5(s[i]) AS sentence FROM (SELECT doc_id, s, unnest(generate_series(1, length(s))) AS i FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents))")
def sentence_split(spark, d):
    rows = documents(spark, d).select("doc_id", F.posexplode(segments.sentences("text")).alias("nth", "s"))
    return rows.select("doc_id", F.col("nth").cast("long").alias("nth"), F.md5(F.col("s").cast("binary")).alias("sentence"))


@query(f"WITH {S.SEGMENTS} SELECT workspace, source, CAST(seq AS BIGINT) AS seq, CAST({S.estimate('text')} AS BIGINT) AS tokens, md5(text) AS digest FROM seg")
def segment_pack(spark, d):
    return segments_of(spark, d).select("workspace", "source", F.col("seq").cast("long").alias("seq"), X.estimate_tokens("text").alias("tokens"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"WITH {S.SEGMENTS} SELECT workspace, source, CAST(scene AS BIGINT) AS scene, count(*) AS segments, CAST(min(seq) AS BIGINT) AS first_seq FROM seg GROUP BY ALL")
def scene_assign(spark, d):
    return segments_of(spark, d).groupBy("workspace", "source", F.col("scene").cast("long").alias("scene")).agg(F.count("*").alias("segments"), F.min("seq").cast("long").alias("first_seq"))


BARE = r"regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g')"
PAGE_PARTS = rf"""parts AS (SELECT page_id, unnest(p) AS part, generate_subscripts(p, 1) AS nth FROM (SELECT page_id, regexp_extract_all({BARE}, '(?s)<(?:h1|li|p)(?:\s[^>]*)?>.*?</(?:h1|li|p)>') AS p FROM pages)),
lines AS (SELECT page_id, nth, CASE WHEN part LIKE '<h1%' THEN 'heading' WHEN part LIKE '<li%' THEN 'list' ELSE 'prose' END AS kind,
    trim(regexp_replace(regexp_replace(regexp_replace(part, '<[^>]*>', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM parts)"""


def page_segments(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.files import page_markdown

    rows = table(spark, d, "pages").select(F.lit("web").alias("workspace"), F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("source"), "page_id", page_markdown("html").alias("text"))
    return segments.segment(rows)


@query(f"WITH {PAGE_PARTS} SELECT page_id, count(*) AS headings, min(trim('# ' || body)) AS title FROM lines WHERE kind = 'heading' AND body <> '' GROUP BY page_id")
def page_heading_segments(spark, d):
    rows = page_segments(spark, d).where("seg_kind = 'heading'")
    return rows.groupBy("page_id").agg(F.count("*").alias("headings"), F.min("text").alias("title"))


@query(f"WITH {PAGE_PARTS} SELECT page_id, count(*) AS items, md5(string_agg('- ' || body, chr(10) ORDER BY nth)) AS digest FROM lines WHERE kind = 'list' AND body <> '' GROUP BY page_id")
def list_segments(spark, d):
    rows = page_segments(spark, d).where("seg_kind = 'list'").groupBy("page_id").agg(F.count("*").alias("items"), F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("t"))
    return rows.select("page_id", "items", F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "\n").cast("binary")).alias("digest"))


@query(f"WITH {S.SEGMENTS} SELECT source, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM seg WHERE seg_kind <> 'heading' GROUP BY source")
def chunk_units(spark, d):
    return segments_of(spark, d).where("seg_kind <> 'heading'").groupBy("source").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


# ---- lexical and dense ------------------------------------------------------


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({S.tokens('text')}) AS term FROM documents) GROUP BY ALL")
def postings(spark, d):
    return lexical.postings(documents(spark, d), ["doc_id"])


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({S.tokens('text')}) AS term FROM documents) GROUP BY term")
def doc_freq(spark, d):
    return documents(spark, d).select(F.explode(F.array_distinct(X.tokens("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@query(f"SELECT lang, count(*) AS docs, CAST(sum(len) AS BIGINT) AS tokens, CAST(max(len) AS BIGINT) AS longest, round(avg(len), 6) AS mean FROM (SELECT lang, length({S.tokens('text')}) AS len FROM documents) GROUP BY lang")
def doc_length_stats(spark, d):
    rows = lexical.lengths(documents(spark, d), ["lang"])
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("len").alias("tokens"), F.max("len").alias("longest"), F.round(F.avg("len"), 6).alias("mean"))


def _top(scores: DataFrame, key: list[str], k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), *key)
    rows = scores.select("query_id", *key, F.round("score", 6).alias("score"))
    return rows.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


TOP10 = "SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm25 QUALIFY rank <= 10"


@query(f"WITH {FIXED_SQL}, {terms_sql('fixed')}, {S.bm25('documents', 'doc_id', 'terms')} {TOP10}")
def bm25_topk(spark, d):
    """The flagship: ten best documents for three questions."""
    return _top(lexical.bm25(documents(spark, d), ["doc_id"], lexical.query_terms(fixed_queries(spark))), ["doc_id"], 10)


@query(f"WITH asked AS (SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_id % 100 = 0), {terms_sql('asked')}, {S.bm25('documents', 'doc_id', 'terms')} {TOP10}")
def bm25_batch(spark, d):
    return _top(lexical.bm25(documents(spark, d), ["doc_id"], lexical.query_terms(asked(spark, d)), k=10), ["doc_id"], 10)


NORM = "sqrt(list_sum(list_transform({0}, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))))"


@query(
    f"""WITH q AS (SELECT vec_id AS query_id, embedding AS wanted FROM embeddings WHERE vec_id % 100 = 0), s AS (
    SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(embedding, wanted), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / ({NORM.format('embedding')} * {NORM.format('wanted')}), 6) AS sim FROM embeddings CROSS JOIN q)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s QUALIFY rank <= 10"""
)
def cosine_topk(spark, d):
    rows = table(spark, d, "embeddings")
    wanted = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("wanted"))
    return dense.dense_topk(rows.select("vec_id", "embedding"), wanted, 10).select("query_id", "vec_id", "sim", F.col("rank").cast("long").alias("rank"))


SIMS = "sims AS (SELECT q.query_id, v.doc_id, greatest(0.0, sum(v.value * q.value)) AS sim FROM vec v JOIN (SELECT doc_id AS query_id, dim, value FROM vec WHERE doc_id % 100 = 0) q USING (dim) GROUP BY ALL)"


@query(f"WITH {S.features('documents', 'doc_id')}, {SIMS} SELECT query_id, doc_id, round(sim, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, doc_id) AS rank FROM sims QUALIFY rank <= 10")
def hash_cosine_topk(spark, d):
    vec = saved(dense.hash_vectors(documents(spark, d), ["doc_id"]), "vectors")
    q = vec.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vec")
    return _top(dense.similarities(vec, q, ["doc_id"], k=10, every=True).withColumnRenamed("sim", "score"), ["doc_id"], 10)


@query(f"WITH {FIXED_SQL}, {terms_sql('fixed')}, {S.bm25('documents', 'doc_id', 'terms')} SELECT query_id, doc_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM bm25")
def max_normalize(spark, d):
    from ..operators.retrieval import max_normalized

    scores = lexical.bm25(documents(spark, d), ["doc_id"], lexical.query_terms(fixed_queries(spark)))
    return max_normalized(scores).select("query_id", "doc_id", F.round("score", 6).alias("score"))


# ---- store and chat ---------------------------------------------------------


@query(f"WITH {S.SEGMENTS} SELECT s.workspace, s.source, s.kind, s.chapter, s.ordinal, count(g.source) AS segments FROM src s LEFT JOIN seg g USING (workspace, source) GROUP BY ALL")
def sources_summary(spark, d):
    return store.source_summary(sources(spark, d), segments_of(spark, d)).select("workspace", "source", "kind", "chapter", "ordinal", "segments")


@query(f"WITH {S.SEGMENTS} SELECT workspace, count(DISTINCT source) AS sources, count(*) AS segments, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(ordinal) AS BIGINT) AS latest FROM seg GROUP BY workspace")
def store_stats(spark, d):
    return segments_of(spark, d).groupBy("workspace").agg(F.countDistinct("source").alias("sources"), F.count("*").alias("segments"), F.sum(F.length("text")).alias("chars"), F.max("ordinal").alias("latest"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def supersede_latest(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return store.latest(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


ARRIVALS = "arr AS (SELECT lang AS workspace, 'doc-' || doc_id AS source, CASE WHEN doc_id % 3 = 0 THEN 'reference' ELSE 'document' END AS kind, CASE WHEN doc_id % 7 = 1 THEN CAST(doc_id AS INTEGER) END AS chapter, doc_id AS arrived FROM documents)"


@query(
    f"""WITH {ARRIVALS}, had AS (SELECT workspace, source, kind, arrived AS ordinal FROM arr WHERE arrived % 5 = 0),
    most AS (SELECT workspace, kind, max(ordinal) AS most FROM had GROUP BY ALL)
    SELECT workspace, source, kind, CAST(CASE WHEN chapter IS NOT NULL THEN 1000 + chapter WHEN h IS NOT NULL THEN h
        ELSE coalesce(most + 1, CASE WHEN kind = 'reference' THEN 0 ELSE 1000 END) + sum(CASE WHEN chapter IS NULL AND h IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY workspace, kind ORDER BY arrived, source) - 1 END AS BIGINT) AS ordinal
    FROM (SELECT arr.*, had.ordinal AS h FROM arr LEFT JOIN had USING (workspace, source)) LEFT JOIN most USING (workspace, kind)"""
)
def ordinal_assign(spark, d):
    i = F.col("doc_id")
    rows = documents(spark, d).select(F.col("lang").alias("workspace"), F.concat(F.lit("doc-"), i.cast("string")).alias("source"), F.when(i % 3 == 0, "reference").otherwise("document").alias("kind"), F.when(i % 7 == 1, i.cast("int")).alias("chapter"), i.alias("arrived"))
    had = rows.where("arrived % 5 = 0").select("workspace", "source", "kind", F.col("arrived").alias("ordinal"))
    return store.ordinals(rows, had).select("workspace", "source", "kind", "ordinal")


@query(
    f"""WITH {S.SEGMENTS}, cache AS (SELECT DISTINCT sha256(text) AS hash, 'hash-v2@384' AS space FROM seg WHERE seq % 2 = 0)
    SELECT DISTINCT sha256(text) AS hash FROM seg WHERE sha256(text) NOT IN (SELECT hash FROM cache WHERE space = 'hash-v2@384')"""
)
def embed_cache_misses(spark, d):
    rows = segments_of(spark, d)
    cache = rows.where("seq % 2 = 0").select(F.sha2("text", 256).alias("hash"), F.lit("hash-v2@384").alias("space")).distinct()
    return store.cache_misses(rows, cache, "hash-v2@384")


@query("SELECT source AS stem, doc_id AS scope, md5(text) AS body FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1")
def markdown_override(spark, d):
    from ..sources.files import overridden

    rows = documents(spark, d).select(F.col("source").alias("stem"), F.col("doc_id").alias("scope"), "text")
    return overridden(rows).select("stem", "scope", F.md5(F.col("text").cast("binary")).alias("body"))


@query(
    """WITH src AS (SELECT lang AS workspace, source, doc_id, text FROM documents), new AS (SELECT * FROM src WHERE doc_id % 4 = 0)
    SELECT workspace, source, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
        SELECT * FROM new UNION ALL SELECT * FROM src WHERE (workspace, source) NOT IN (SELECT (workspace, source) FROM new)) GROUP BY ALL"""
)
def supersede_sources(spark, d):
    rows = documents(spark, d).select(F.col("lang").alias("workspace"), "source", "doc_id", "text")
    out = store.supersede(rows, rows.where("doc_id % 4 = 0"), ["workspace", "source"])
    return out.groupBy("workspace", "source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


@query(
    """WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
    SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS query FROM b WHERE back <= 4 AND role = 'user' GROUP BY conv_id"""
)
def chat_query_fold(spark, d):
    return chat.query_fold(table(spark, d, "conversations"))


@query(
    """WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
    SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) AS transcript FROM b WHERE back <= 6 GROUP BY conv_id"""
)
def chat_transcript_tail(spark, d):
    return chat.transcript(table(spark, d, "conversations"))


from . import catalogue_search, catalogue_store, catalogue_workspace  # noqa: E402,F401  register the rest
