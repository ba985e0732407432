"""Quality rules: plain counts, and a hashed n-gram likelihood ratio of trusted against raw text.

Words are runs of characters other than white space (ASCII). Grams are single
words and pairs of neighbours, hashed (CRC-32 of a word's UTF-8) into BUCKETS. Two
multinomials over the buckets, both with one added to each count: that of the
trusted documents (all labelled ones that teach) and that of the raw corpus (all documents).
A bucket's weight is the logarithm of their ratio in thousandths, rounded, so a
document's sum is an exact integer; its score is the sum over its number of grams.

The threshold comes from labelled documents that taught nothing: of all whole
thresholds the lowest that keeps most trusted and drops most distrusted ones (in
shares). Every document is judged by it; nothing is drawn at random. Without
labelled documents of both kinds nothing is dropped by the method.

Nothing is bounded: every labelled document teaches or calibrates (by the md5 of
its id). All counts of the raw corpus cover all documents, all texts are judged
whole. `per_class`, if given, takes of each kind only those of smallest md5.

Main path: built-in functions only. A text's arrays are worked on inside its row,
so nothing but one count a bucket is shuffled. `let` names an array that is used
twice, as an expression that is written twice would be computed twice.

Repeated windows of five words are found by 64-bit hashes; only texts where two
are equal sort them (each beside its place), all in O(n log n).

Defined cases: a null, empty or blank text has no words and fails; rows that
repeat are each judged (and counted); a document labelled twice is distrusted if
one label says so; null ids have no label. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small

BUCKETS = 1 << 16
#: Labels are counted first and broadcast if they have at most so many rows; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000
WINDOW = 5
# Fewest words, most repeated words in percent.
FEWEST, REPEATED = 10, 20
SYMBOLS = "#*$%&|<>"
WORD = r"[^\x20\x09-\x0D]"
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def words(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def codes(of: Column) -> Column:
    """CRC-32 of each word."""
    return F.transform(of, lambda w: F.crc32(w.cast("binary")))


def _pair(a: Column, b: Column) -> Column:
    return (a * 31 + b) % BUCKETS


def buckets(code: Column) -> Column:
    """The buckets of all single words and pairs."""
    n = F.size(code)
    pairs = F.zip_with(F.slice(code, 1, F.greatest(n - 1, F.lit(0))), F.slice(code, 2, F.greatest(n, F.lit(1))), _pair)
    return F.concat(F.transform(code, lambda c: c % BUCKETS), pairs)


def _covered(windows: Column) -> Column:
    """How many words lie in windows that stand twice or more; windows are hashes in order."""

    def slow(h: Column) -> Column:
        n = F.size(h).cast("long")
        keyed = F.sort_array(F.transform(h, lambda x, i: let(F.shiftrightunsigned(x, 1), lambda y: y - y % n + i)))

        def of_sorted(s: Column) -> Column:
            as_next = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.coalesce(a - a % n == b - b % n, F.lit(False)))
            twice = let(as_next, lambda x: F.zip_with(x, F.concat(F.array(F.lit(False)), F.slice(x, 1, F.size(x) - 1)), lambda a, b: a | b))
            places = F.sort_array(F.filter(F.zip_with(s, twice, lambda k, d: F.when(d, k % n)), lambda p: p.isNotNull()))
            steps = let(places, lambda p: F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(WINDOW).cast("long"), F.coalesce(b - a, F.lit(WINDOW).cast("long")))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return let(keyed, of_sorted)

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(slow(h)))


def repeated(of: Column) -> Column:
    """How many of these words lie in runs of WINDOW words that stand twice or more."""

    def shifted(x: Column, by: int) -> Column:
        return F.slice(x, by + 1, F.size(x))

    def windows(h: Column) -> Column:
        two = F.zip_with(h, shifted(h, 1), lambda a, b: F.xxhash64(a, b))
        four = let(two, lambda x: F.zip_with(x, shifted(x, 2), lambda a, b: F.xxhash64(a, b)))
        five = F.zip_with(four, shifted(h, 4), lambda a, b: F.xxhash64(a, b))
        return F.slice(five, 1, F.size(h) - (WINDOW - 1))

    return F.when(F.size(of) <= WINDOW, F.lit(0).cast("long")).otherwise(let(F.transform(of, lambda w: F.xxhash64(w)), lambda h: _covered(windows(h))))


def base_columns(text: Column, of: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return {
        "n_words": F.size(of).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated(of),
    }


def sample(labels: DataFrame, per_class: int | None = None) -> DataFrame:
    """(doc_id, trusted, teaches): all labelled documents, or at most per_class of each kind; half of the trusted ones teach."""
    own = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("trusted"))
    own = own.withColumn("h", F.md5(F.col("doc_id").cast("string").cast("binary")))
    if per_class is not None:
        parts = [own.where(F.col("trusted") == k).orderBy("h", "doc_id").limit(per_class) for k in (1, 0)]
        own = parts[0].unionByName(parts[1])
    return own.select(F.col("doc_id").alias("id"), "trusted", ((F.col("trusted") == 1) & (F.substring("h", 1, 1) < "8")).alias("teaches"))


def weights(raw: dict[int, int], trusted: dict[int, int]) -> list[int]:
    """Of each bucket, thousandths of the logarithm of the ratio of its shares."""
    n, m = sum(raw.values()) + BUCKETS, sum(trusted.values()) + BUCKETS
    return [math.floor(1000 * math.log(((trusted.get(b, 0) + 1) * n) / ((raw.get(b, 0) + 1) * m)) + 0.5) for b in range(BUCKETS)]


def _sum(code: Column, of: list[int]) -> Column:
    table = F.split(F.lit(",".join(map(str, of))), ",").cast("array<int>")  # folded to one constant of BUCKETS numbers

    def both(a: Column, b: Column) -> Column:
        own = F.get(table, (a % BUCKETS).cast("int"))
        return F.when(b.isNull(), own).otherwise(own + F.get(table, _pair(a, b).cast("int")))

    return F.aggregate(F.zip_with(code, F.slice(code, 2, F.greatest(F.size(code), F.lit(1))), both), F.lit(0).cast("long"), lambda acc, x: acc + x)


def threshold(rows: list[tuple[int, int, int]]) -> int | None:
    """(score, trusted, documents) of the calibration to the lowest whole score that tells the kinds apart best."""
    total = {k: sum(n for _, t, n in rows if t == k) for k in (0, 1)}
    if not total[0] or not total[1]:
        return None
    best, least, kept, dropped = -1, None, total[1], 0
    by_score: dict[int, list[int]] = {}
    for score, trusted, n in rows:
        by_score.setdefault(score, [0, 0])[trusted] += n
    for score in sorted(by_score):
        if kept * total[0] + dropped * total[1] > best:
            best, least = kept * total[0] + dropped * total[1], score
        dropped += by_score[score][0]
        kept -= by_score[score][1]
    return least


def fit(docs: DataFrame, labels: DataFrame, per_class: int | None = None) -> tuple[list[int], int | None]:
    """(weight of each bucket, threshold) from docs(doc_id, text) and labels(doc_id, quality)."""
    ids = small(sample(labels, per_class), "quality-labels", BROADCAST_ROWS)
    known = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("id"), "left")
    grams = known.select(F.coalesce("teaches", F.lit(False)).cast("int").alias("teaches"), F.explode(let(codes(words("text")), buckets)).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("n"), F.sum("teaches").alias("m")).collect()  # at most one row a bucket
    of = weights({r["b"]: r["n"] for r in counts}, {r["b"]: r["m"] for r in counts})
    judged = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("id")).where("not teaches")
    # one value out of one expression: a filter on it would compute it once more
    score = lambda c: F.when(F.size(c) >= FEWEST, F.floor(_sum(c, of) / (2 * F.size(c) - 1)))
    scored = judged.select("trusted", let(codes(words("text")), score).alias("score"))
    rows = scored.groupBy("score", "trusted").agg(F.count("*").alias("n")).collect()  # at most one row a whole score of either kind
    return of, threshold([(r["score"], r["trusted"], r["n"]) for r in rows if r["score"] is not None])


def judge(docs: DataFrame, of: list[int], least: int | None) -> DataFrame:
    """(doc_id, the base counts, base_failed, score, kept) of every row; score is in thousandths for each gram."""
    rows = docs.select("doc_id", "text", words("text").alias("w"))
    rows = rows.select("doc_id", *[c.alias(name) for name, c in base_columns(F.col("text"), F.col("w")).items()], let(codes(F.col("w")), lambda c: _sum(c, of)).alias("sum"))
    failed = (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    good = F.lit(True) if least is None else F.col("sum") >= least * grams
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.col("sum") / grams).alias("score"), (~F.col("base_failed") & good).alias("kept"))


def op12_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: its counts, whether they fail, its likelihood ratio, and whether it is kept."""
    return judge(docs, *fit(docs, labels))


def _crc_table() -> list[int]:
    table = []
    for b in range(256):
        for _ in range(8):
            b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
        table.append(b)
    return table


def oracle(per_class: int = 20_000) -> str:
    """DuckDB text of op12. CRC-32 is computed once for each different word."""
    assert zlib.crc32(b"a") == 0xE8B7BE43
    table = "[" + ", ".join(map(str, _crc_table())) + "]"
    hexed = "list_transform(range(1, length(hex(encode(w))), 2), lambda i: CAST((strpos('0123456789ABCDEF', substr(hex(encode(w)), i, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(encode(w)), i + 1, 1)) - 1 AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {hexed}), lambda a, x: xor(a >> 8, CAST({table}[CAST(xor(a, x) & 255 AS INTEGER) + 1] AS BIGINT))), CAST(4294967295 AS BIGINT))"
    w = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    lines = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))"
    symbols = r"coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0)"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {w} AS w, {symbols} AS n_symbols, {lines} AS lines FROM documents),
x AS (SELECT rid, i, w[i] AS w FROM (SELECT rid, w, unnest(generate_series(1, length(w))) AS i FROM d)),
code AS (SELECT w, {crc} AS c FROM (SELECT DISTINCT w FROM x)),
xc AS (SELECT rid, i, c, lead(c) OVER (PARTITION BY rid ORDER BY i) AS after FROM x JOIN code USING (w)),
g AS (SELECT rid, c % {BUCKETS} AS b FROM xc UNION ALL SELECT rid, (c * 31 + after) % {BUCKETS} FROM xc WHERE after IS NOT NULL),
own AS (SELECT doc_id, min(quality) AS trusted, md5(CAST(doc_id AS VARCHAR)) AS h FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id),
pick AS (SELECT doc_id, trusted, trusted = 1 AND substr(h, 1, 1) < '8' AS teaches FROM own QUALIFY row_number() OVER (PARTITION BY trusted ORDER BY h, doc_id) <= {per_class}),
raw AS (SELECT b, count(*) AS n FROM g GROUP BY b), good AS (SELECT b, count(*) AS m FROM g JOIN d USING (rid) JOIN pick USING (doc_id) WHERE teaches GROUP BY b),
tot AS (SELECT (SELECT coalesce(sum(n), 0) FROM raw) + {BUCKETS} AS n, (SELECT coalesce(sum(m), 0) FROM good) + {BUCKETS} AS m),
wt AS (SELECT b, CAST(floor(1000 * ln(((coalesce(raw.m, 0) + 1) * tot.n)::DOUBLE / ((raw.n + 1) * tot.m)) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS wt FROM (SELECT raw.b, raw.n, good.m FROM raw LEFT JOIN good USING (b)) raw, tot),
s AS (SELECT rid, CAST(sum(wt) AS BIGINT) AS sum FROM g JOIN wt USING (b) GROUP BY rid),
cal AS (SELECT trusted, CAST(floor(sum::DOUBLE / (2 * length(w) - 1)) AS BIGINT) AS score FROM d JOIN s USING (rid) JOIN pick USING (doc_id) WHERE NOT teaches AND length(w) >= {FEWEST}),
sizes AS (SELECT count(*) FILTER (trusted = 1) AS n1, count(*) FILTER (trusted = 0) AS n0 FROM cal),
cuts AS (SELECT c.score, (SELECT count(*) FROM cal WHERE trusted = 1 AND cal.score >= c.score) * n0 + (SELECT count(*) FROM cal WHERE trusted = 0 AND cal.score < c.score) * n1 AS told FROM (SELECT DISTINCT score FROM cal) c, sizes WHERE n1 > 0 AND n0 > 0),
least AS (SELECT arg_max(score, told * CAST(1000000 AS HUGEINT) - score) AS least FROM cuts),
win AS (SELECT rid, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS run FROM x WINDOW o AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i FROM win WHERE run IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, run) > 1), range(0, {WINDOW}) AS k(k) GROUP BY rid),
r AS (SELECT doc_id, CAST(length(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda v: length(v))), 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(length(lines) - length(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(sum, 0) AS sum, greatest(2 * length(w) - 1, 1) AS grams FROM d LEFT JOIN rep USING (rid) LEFT JOIN s USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {FEWEST} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed, sum / CAST(grams AS DOUBLE) AS score,
    NOT (n_words < {FEWEST} OR 100 * n_repeat_words > {REPEATED} * n_words) AND coalesce(sum >= (SELECT least FROM least) * grams, true) AS kept FROM r"""
