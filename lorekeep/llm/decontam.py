"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Built-in Spark functions only. A window has as many words as a benchmark item
(the whole text, if that is shorter) and may start at any word. Similarity is
the share of the item's weighted shingles (runs of five words, weighted by
their letters, with multiplicity) that the window has; an item of fewer words
is one shingle. A window without any shingle of an item of its size has
similarity 0 to all of them, so it needs no fingerprint; every other one, at
whatever place its shingles stand, gets one.

The 64-bit SimHash sums, for each bit, the lengths of the window's words whose
hash has that bit, and sets the bit if that is more than half of all. Sums of
several bits share one long, as lanes. A window at similarity 0.8 that lacks
words at an end is 12 bits away in the mean, with a deviation of 3, hence
RADIUS 19. BLOCKS blocks of bits: of two fingerprints at most RADIUS apart at
least one block differs in at most RADIUS // BLOCKS bits, so the join of the
windows' blocks with all such variants of the items' blocks, within one item
size, finds every fingerprint within the radius. Equal fingerprints are looked
up once. Each text and item found is then verified over all their windows, and
the best window counts.

The search is exact within the radius; a text is lost only where each of its
windows at 0.8 or more is farther than RADIUS from the item (measured on the
tests' truncated and edited passages against all windows: none of 480).

Defined cases: null and wordless texts and items match nothing; an item of
fewer than five words is found wherever its words stand in a row; rows that
repeat are each returned; items that repeat under one id count once by their
best window, under several ids for each id. Ties between windows go to the
first. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import saved
from .columns import bounded, text_key, whole_rows, words

SIMILARITY = 0.8
SIZE = 5
RADIUS, BLOCKS = 19, 5
CUTS = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
#: Words longer than this weigh as much as one of this length in the fingerprint.
LONGEST = 63
#: A shingle is one number: its hash, and its letters in the low bits.
LETTER_BITS = 20
LETTERS = (1 << LETTER_BITS) - 1
#: Broadcast sides are counted first and hold at most so many rows of fixed size.
BROADCAST_ROWS = 500_000


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the hashes `wh` and the lengths `wl` of its words instead of text."""
    held = df.withColumn("w", words(text)).drop(text)
    return held.withColumn("wh", F.transform("w", lambda w: F.xxhash64(w))).withColumn("wl", F.transform("w", lambda w: F.length(w))).drop("w")


def runs(size: int) -> Column:
    """Every run of so many words of wh and wl, hash and letters in one number; none if there are fewer words."""
    n = F.size("wh")
    tag = [F.lit(size)] if size < SIZE else []

    def one(i: Column) -> Column:
        letters = sum((F.get("wl", i + k) for k in range(1, size)), F.get("wl", i))
        return F.xxhash64(*tag, *[F.get("wh", i + k) for k in range(size)]).bitwiseAND(_long(~LETTERS)).bitwiseOR(F.least(letters, F.lit(LETTERS)).cast("bigint"))

    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), one)).otherwise(F.array().cast("array<bigint>"))


def _ranked(grams: Column) -> Column:
    """The same numbers, but equal ones told apart by their rank among each other."""

    def told(g: Column, i: Column) -> Column:
        nth = F.size(F.filter(F.slice(grams, 1, i + 1), lambda o: o == g))
        return F.when(nth == 1, g).otherwise(F.xxhash64(g, nth).bitwiseAND(_long(~LETTERS)).bitwiseOR(g.bitwiseAND(_long(LETTERS))))

    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), grams).otherwise(F.transform(grams, told))


def _letters(grams: Column) -> Column:
    return F.aggregate(grams, _long(0), lambda a, g: a + g.bitwiseAND(_long(LETTERS)))


def _lanes(width: int) -> Column:
    """For each word of wh and wl: its length in the lane of each set bit of its hash, 64 / width lanes a long, and last
    its length."""
    each = 64 // width
    table = _numbers([sum(1 << width * b for b in range(each) if v >> b & 1) for v in range(1 << each)])

    def word(h: Column, i: Column) -> Column:
        weight = F.least(F.get("wl", i), F.lit(LONGEST)).cast("bigint")
        longs = [F.element_at(table, F.shiftrightunsigned(h, each * j).bitwiseAND(_long((1 << each) - 1)).cast("int") + 1) * weight for j in range(width)]
        return F.array(*longs, weight)

    return F.transform("wh", word)


def _simhash(lanes: Column, width: int) -> Column:
    """64-bit SimHash of the words whose lanes these are."""
    each, mask = 64 // width, _long((1 << width) - 1)

    def done(sums: Column) -> Column:
        out, total = _long(0), F.get(sums, width)
        for b in range(64):
            lane = F.shiftrightunsigned(F.get(sums, b // each), width * (b % each)).bitwiseAND(mask)
            out = out.bitwiseOR(F.when(lane * 2 > total, _long(-(1 << 63) if b == 63 else 1 << b)).otherwise(_long(0)))
        return out

    return F.aggregate(lanes, F.array(*[_long(0)] * (width + 1)), lambda a, x: F.zip_with(a, x, lambda p, q: p + q), done)


def _blocks(fingerprint: str) -> Column:
    """(block, bits) of the blocks that cover the 64 bits."""
    return F.array(*[
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(F.col(fingerprint), CUTS[k]).bitwiseAND(_long((1 << CUTS[k + 1] - CUTS[k]) - 1)).alias("bits"))
        for k in range(BLOCKS)
    ])


def _variants(marks: DataFrame) -> DataFrame:
    """marks(n, iid, mark) with every (block, bits) that differs from its block in at most RADIUS // BLOCKS bits."""
    flips = [_numbers([v for v in range(1 << CUTS[k + 1] - CUTS[k]) if v.bit_count() <= RADIUS // BLOCKS]) for k in range(BLOCKS)]
    rows = marks.select("n", "iid", "mark", F.explode(_blocks("mark")).alias("b"))
    chosen = F.element_at(F.array(*flips), F.col("b.block") + 1)
    return rows.select("n", "iid", "mark", F.col("b.block").alias("block"), F.col("b.bits").alias("own"), F.explode(chosen).alias("flip")).select("n", "iid", "mark", "block", F.col("own").bitwiseXOR(F.col("flip")).alias("bits"))


def prepared_items(benchmark: DataFrame) -> tuple[DataFrame, list[int], int]:
    """(items, sizes under SIZE, lane width): items(item_id, iid, n, grams, mark), equal texts with equal iid."""
    items = with_words(benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()).where(F.size("wh") > 0)
    items = saved(items.withColumn("n", F.size("wh")), "leak-items")
    most = items.agg(F.max("n")).first()[0] or 0
    short = sorted(r["n"] for r in items.where(F.col("n") < SIZE).select("n").distinct().collect())  # at most four numbers
    width = 16 if most * LONGEST < 1 << 16 else 32
    grams = runs(SIZE)
    for k in short:
        grams = F.when(F.col("n") == k, runs(k)).otherwise(grams)
    items = items.withColumn("grams", grams).withColumn("lanes", _lanes(width))
    return saved(items.select("item_id", F.xxhash64("wh").alias("iid"), "n", _ranked(F.col("grams")).alias("grams"), _simhash(F.col("lanes"), width).alias("mark"), F.array_distinct("grams").alias("seeds")), "leak-items"), short, width


def windows(docs: DataFrame, items: DataFrame, short: list[int], width: int, text: str = "text") -> DataFrame:
    """(key, m, runs..., spots, prints): for each different text with a shingle of an item its number of words, its
    shingles, its windows (n x 2**32 + first word) and their fingerprints."""
    seeds = bounded(saved(items.select(F.explode("seeds").alias("gram"), "n").distinct(), "leak-seeds"), BROADCAST_ROWS)
    hashed = with_words(docs.select(text_key(text).alias("key"), F.col(text).alias("text")))
    # rows of equal texts find the same hits, which are combined before they are shuffled
    hits = None
    for size in [SIZE, *short]:
        part = hashed.select("key", F.posexplode(runs(size)).alias("pos", "gram")).join(seeds, "gram").select("key", F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.col("pos").cast("bigint")).alias("hit"))
        hits = part if hits is None else hits.unionByName(part)
    hits = saved(hits.groupBy("key").agg(F.collect_set("hit").alias("hits")), "leak-hits")
    keyed = docs.select(text_key(text).alias("key"), F.col(text).alias("text"))
    held = keyed.join(bounded(hits.select("key"), BROADCAST_ROWS), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    held = with_words(held.join(hits, "key")).withColumn("m", F.size("wh"))

    def spots(hit: Column) -> Column:
        n, pos = F.shiftright(hit, 32), hit.bitwiseAND(_long(0xFFFFFFFF))
        first = F.greatest(pos - F.greatest(n - SIZE, _long(0)), _long(0))
        last = F.least(pos, F.greatest(F.col("m") - n, _long(0)))
        return F.transform(F.sequence(first, last), lambda s: F.shiftleft(n, 32).bitwiseOR(s))

    held = held.withColumn("spots", F.array_distinct(F.flatten(F.transform("hits", spots)))).withColumn("lanes", _lanes(width))
    for size in [SIZE, *short]:
        held = held.withColumn(f"runs{size}", runs(size))
    prints = F.transform("spots", lambda s: _simhash(F.slice("lanes", s.bitwiseAND(_long(0xFFFFFFFF)).cast("int") + 1, F.shiftright(s, 32).cast("int")), width))
    return saved(held.select("key", "m", *[f"runs{size}" for size in [SIZE, *short]], "spots", prints.alias("prints")), "leak-texts")


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(key, item_id, start_word, n_words, similarity): for each different text (key: md5) and item its best window."""
    items, short, width = prepared_items(benchmark)
    texts = windows(docs, items, short, width, text)
    spots = texts.select("key", F.explode(F.arrays_zip("spots", "prints")).alias("s")).select("key", F.shiftright("s.spots", 32).cast("int").alias("n"), F.col("s.prints").alias("print")).distinct()
    spots = saved(spots, "leak-spots")
    variants = bounded(saved(_variants(items.select("n", "iid", "mark").distinct()), "leak-variants"), BROADCAST_ROWS)
    blocks = spots.select("n", "print").distinct().select("n", "print", F.explode(_blocks("print")).alias("b")).select("n", "print", "b.*")
    near = blocks.join(variants, ["n", "block", "bits"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("mark"))) <= RADIUS).select("n", "print", "iid").distinct()
    pairs = spots.join(bounded(saved(near, "leak-near"), BROADCAST_ROWS), ["n", "print"]).select("key", "iid").distinct()

    both = saved(pairs, "leak-pairs").join(texts.drop("prints"), "key").join(items.select("iid", "item_id", "n", "grams"), "iid")
    own = F.col(f"runs{SIZE}")
    for k in short:
        own = F.when(F.col("n") == k, F.col(f"runs{k}")).otherwise(own)
    starts = F.transform(F.filter("spots", lambda s: F.shiftright(s, 32) == F.col("n")), lambda s: s.bitwiseAND(_long(0xFFFFFFFF)).cast("int"))
    both = both.select("key", "item_id", "n", "m", "grams", own.alias("own"), starts.alias("starts"), _letters(F.col("grams")).alias("every"))

    def scored(s: Column) -> Column:
        window = F.slice("own", s + 1, F.greatest(F.col("n") - (SIZE - 1), F.lit(1)))
        return F.struct((_letters(F.array_intersect(_ranked(window), F.col("grams"))) / F.col("every")).alias("similarity"), (-s).alias("at"))

    best = both.select("key", "item_id", F.least("n", "m").alias("n_words"), F.array_max(F.transform("starts", scored)).alias("best"))
    best = best.groupBy("key", "item_id").agg(F.max(F.struct("best.similarity", "best.at", "n_words")).alias("b")).where(F.col("b.similarity") >= SIMILARITY)
    return best.select("key", "item_id", (-F.col("b.at")).alias("start_word"), F.col("b.n_words").alias("n_words"), F.col("b.similarity").alias("similarity"))


def op8_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, start_word, n_words, similarity."""
    found = saved(leaks(docs, benchmark), "leaks")
    rows = docs.select("doc_id", text_key("text").alias("key"))
    return rows.join(bounded(found, BROADCAST_ROWS), "key").select("doc_id", "item_id", "start_word", "n_words", "similarity")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    found = saved(leaks(docs, benchmark, text).select("key").distinct(), "leaks")
    rows = whole_rows(docs).withColumn("key", text_key(F.col(f"row.`{text}`")))
    return rows.join(bounded(found, BROADCAST_ROWS), "key", "left_anti").select("row.*")


def _sql_words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda v: v <> '')"


def _sql_grams(w: str, k: str) -> str:
    return f"CASE WHEN len({w}) >= {k} THEN list_transform(generate_series(1, len({w}) - {k} + 1), lambda i: array_to_string({w}[i:i + {k} - 1], ' ')) ELSE [] END"


#: DuckDB text of op8: every item-sized window of every text against every item that the text shares a shingle with.
ORACLE = f"""WITH d AS (SELECT text, {_sql_words('text')} AS w FROM (SELECT DISTINCT text FROM documents)),
i AS (SELECT DISTINCT item_id, {_sql_words('text')} AS w FROM benchmark), ig AS (SELECT item_id, len(w) AS n, least(len(w), {SIZE}) AS k, {_sql_grams('w', f'least(len(w), {SIZE})')} AS g FROM i WHERE len(w) > 0),
dg AS (SELECT text, k, len(w) AS m, {_sql_grams('w', 'k')} AS g FROM d CROSS JOIN (SELECT DISTINCT k FROM ig)),
du AS (SELECT DISTINCT text, k, unnest(g) AS gram FROM dg), iu AS (SELECT DISTINCT item_id, k, unnest(g) AS gram FROM ig),
pairs AS (SELECT DISTINCT text, item_id, k FROM du JOIN iu USING (k, gram)),
win AS (SELECT text, item_id, n, m, ig.g AS ig, dg.g AS dg, unnest(generate_series(0, greatest(m - n, 0))) AS start, n - k + 1 AS wide FROM pairs JOIN dg USING (text, k) JOIN ig USING (item_id, k)),
cut AS (SELECT text, item_id, start, least(n, m) AS n_words, ig, list_slice(dg, start + 1, start + wide) AS wg FROM win),
scored AS (SELECT text, item_id, start, n_words, list_sum(list_transform(generate_series(1, len(ig)), lambda j: CASE WHEN len(list_filter(wg, lambda o: o = ig[j])) >= len(list_filter(ig[1:j], lambda o: o = ig[j]))
        THEN len(replace(ig[j], ' ', '')) ELSE 0 END)) / list_sum(list_transform(ig, lambda x: len(replace(x, ' ', '')))) AS similarity FROM cut WHERE list_has_any(wg, ig)),
best AS (SELECT * FROM scored WHERE similarity >= {SIMILARITY} QUALIFY row_number() OVER (PARTITION BY text, item_id ORDER BY similarity DESC, start) = 1)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start_word, CAST(n_words AS INTEGER) AS n_words, CAST(similarity AS DOUBLE) AS similarity FROM documents JOIN best USING (text)"""
