"""Gazetteers, entity mentions, and proper names."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ACCENTED, FOLDED_STOPWORDS, PLAIN, STOPWORDS, canonical, strip, tokens
from ..session import saved, small

#: A broadcast side is counted first and holds at most so many rows.
BROADCAST_ROWS = 200_000
# Beginnings of section headings that name no entity.
SECTION_PREFIXES = ["nhân vật phụ", "ghi chú", "notes", "arc ", "cấu trúc", "kết thúc", "các địa điểm", "tổng quan", "overview", "outline", "structure", "timeline"]
# What is cut from a heading, and how a chapter is referred to.
HEADING_CUTS = [r"\s*[(（].*?[)）]\s*$", r"\s*[–—-]\s*.*$", r"^[ :–—-]+|[ :–—-]+$"]
CHAPTER = r"(?iU)(?=c)\b(?:chương|chapter|ch\.?)\s*(\d+)\b"
# Characters behind which a capital starts a sentence or a markup element.
BOUNDARY = ".!?…:\n*#-•|>\"'“”‘’([{"
LETTERS = r"[\p{L}\p{N}_]"


def clean_heading(x: Column) -> Column:
    """Without a bracketed end, and without what follows the first dash."""
    bracket, dash, edges = HEADING_CUTS
    return F.regexp_replace(strip(F.regexp_replace(strip(F.regexp_replace(x, bracket, "")), dash, "")), edges, "")


def is_section_label(x: Column) -> Column:
    low = F.lower(strip(x))
    return low.endswith("?") | low.rlike("^(" + "|".join(SECTION_PREFIXES) + ")")


def type_of_source(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike("character|nhan-vat|nhanvat"), "PERSON").when(low.rlike("location|place|dia-diem"), "PLACE").otherwise("CONCEPT")


def gazetteer_of(documents: DataFrame, name: str = "source", text: str = "text", within: tuple[str, ...] = ()) -> DataFrame:
    """(within..., key, name, type) from markdown: section headings, and bold capitalised terms of several words; the first
    wins, in each value of within."""
    heads = documents.select(*within, F.col(name).alias("source"), F.lit(0).alias("rank"), F.posexplode(F.regexp_extract_all(text, F.lit(r"(?m)^#{2,6}\s+(.+?)\s*$"), F.lit(1))).alias("at", "raw"))
    heads = heads.select(*within, "source", "rank", "at", clean_heading(F.col("raw")).alias("name"), type_of_source(F.col("source")).alias("type"))
    bold = documents.select(*within, F.col(name).alias("source"), F.lit(1).alias("rank"), F.posexplode(F.regexp_extract_all(text, F.lit(r"\*\*(.+?)\*\*(?!\s*[:：])"), F.lit(1))).alias("at", "raw"))
    bold = bold.select(*within, "source", "rank", "at", clean_heading(F.col("raw")).alias("name"), F.lit("ITEM").alias("type"))
    bold = bold.where(F.length("name").between(2, 40) & F.col("name").rlike(r"^\p{Lu}") & F.contains("name", F.lit(" ")))
    every = heads.unionByName(bold).where((F.length("name") >= 2) & ~is_section_label(F.col("name")))
    every = every.withColumn("key", canonical("name")).where((F.col("key") != "") & ~F.col("key").isin(STOPWORDS))
    return every.groupBy(*within, "key").agg(F.min_by(F.struct("name", "type"), F.struct("source", "rank", "at")).alias("v")).select(*within, "key", "v.name", "v.type")


def frequent_terms(documents: DataFrame, share: float, text: str = "text", min_length: int = 5, within: tuple[str, ...] = ()) -> DataFrame:
    """(within..., key, name, type): the content tokens that at least this share of all documents (of each value of within) hold,
    as a gazetteer. There are at most a document's mean number of tokens over share of them, however many documents there are."""
    found = documents.select(*within, F.explode(F.array_distinct(tokens(text, min_length))).alias("key")).where(~F.col("key").isin(FOLDED_STOPWORDS))
    total = documents.groupBy(*within).agg((F.count("*") * share).alias("least"))
    df = found.groupBy(*within, "key").agg(F.count("*").alias("df"))
    top = df.join(F.broadcast(total), list(within)).where("df >= least") if within else df.join(F.broadcast(total), F.col("df") >= F.col("least"))  # a row for each value of within
    return top.select(*within, "key", F.col("key").alias("name"), F.lit("CONCEPT").alias("type"))


def mentions(units: DataFrame, key: list[str], gazetteer: DataFrame, text: str = "text") -> DataFrame:
    """(key..., entity, count): whole-word, case-insensitive occurrences of a name or its spelling without accents.

    Names are joined to units on their first word; a name of one word is counted by that join alone, one of several
    words is then counted in the text. The gazetteer is saved and counted, and broadcast if it is small enough. Where it
    has columns of key (a workspace), its names are known only there.
    """
    low, within = F.lower(F.col("name")), [c for c in key if c in gazetteer.columns]
    variants = gazetteer.select(*within, F.col("key").alias("entity"), F.explode(F.array_distinct(F.array(low, F.translate(low, ACCENTED, PLAIN)))).alias("form"))
    variants = variants.withColumn("word", F.regexp_extract("form", LETTERS + "+", 0)).withColumn("single", F.col("word") == F.col("form"))
    variants = small(variants, "names", BROADCAST_ROWS)
    shortest = max(1, variants.agg(F.min(F.length("word"))).first()[0] or 1)  # shorter words are no name's
    words = units.select(*key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(LETTERS + f"{{{shortest},}}"), F.lit(0))).alias("word"))
    met = words.join(variants, [*within, "word"]).groupBy(*key, "entity", "form", "single").agg(F.count("*").alias("n"))
    one = met.where("single").select(*key, "entity", F.col("n").alias("count"))
    several = met.where("not single").join(units.select(*key, F.lower(text).alias("__low")), key)
    quoted = F.concat(F.lit(rf"(?<!{LETTERS})\Q"), F.col("form"), F.lit(rf"\E(?!{LETTERS})"))
    several = several.select(*key, "entity", F.regexp_count("__low", quoted).cast("long").alias("count")).where("count > 0")
    return one.unionByName(several).groupBy(*key, "entity").agg(F.sum("count").alias("count"))


def number_mentions(units: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """num:<digits, dots, commas> of at least two characters."""
    found = units.select(*key, F.explode(F.regexp_extract_all(text, F.lit(r"(?U)(?=\d)\b\d[\d.,]*\b"), F.lit(0))).alias("raw")).where(F.length("raw") >= 2)
    return found.groupBy(*key, F.concat(F.lit("num:"), "raw").alias("entity")).agg(F.count("*").alias("count"))


def chapter_mentions(units: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """chapter:<n> of references such as `chapter 3`, `ch. 3`, `chương 3`."""
    found = units.select(*key, F.explode(F.regexp_extract_all(text, F.lit(CHAPTER), F.lit(1))).alias("n"))
    return found.groupBy(*key, F.concat(F.lit("chapter:"), "n").alias("entity")).agg(F.count("*").alias("count"))


def proper_nouns(units: DataFrame, key: list[str], text: str = "text", longest: int = 6) -> DataFrame:
    """(key..., entity, name, count) of runs of capitalised words, each one space apart, at most `longest` words.

    A run of several words needs one that is no stopword; a single word must be no stopword, have two characters, and
    be all capitals or stand capitalised somewhere inside a sentence of the unit. Built-in functions: one pattern finds runs
    with the gap before each, so only they become rows, which one grouping settles.
    """
    letter = r"[\p{L}\p{N}]"
    run = rf"[^\p{{L}}\p{{N}}]++\p{{Lu}}{letter}*+(?: \p{{Lu}}{letter}*+){{0,{longest - 1}}}+"
    marks = "".join("\\" + c if c.isascii() else c for c in BOUNDARY if c != "\n")
    # a text begins as behind the end of a sentence, so a gap is before every word; the rest of a run that is too long follows a space, so inside one
    rows = units.select(*key, F.posexplode(F.regexp_extract_all(F.concat(F.lit("."), text), F.lit(run), F.lit(0))).alias("at", "found"))
    rows = rows.select(*key, "at", F.regexp_extract("found", r"\p{Lu}.*", 0).alias("name"), F.col("found").rlike(rf"[{marks}](?U:\s)*\p{{Lu}}").alias("starts"))
    rows = rows.withColumn("low", F.translate(F.lower("name"), ACCENTED, PLAIN)).withColumn("single", ~F.contains("name", F.lit(" ")))
    inside = F.when(F.col("single"), F.array().cast("array<string>")).otherwise(F.slice(F.split("low", " "), F.when(F.col("starts"), 2).otherwise(1), F.lit(longest)))
    # a run, and behind it the words that stand inside a sentence
    rows = rows.select(*key, "at", "name", "single", "starts", F.posexplode(F.concat(F.array("low"), inside)).alias("nth", "entity"))
    whole = (F.col("nth") == 0) & (~F.col("single") | (F.length("name") > 1))
    loud = whole & (F.upper("name") == F.col("name"))
    mid = (F.col("nth") > 0) | (F.col("single") & ~F.col("starts"))
    found = rows.groupBy(*key, "entity").agg(
        F.max(mid).alias("mid"), F.count_if(whole).alias("every"), F.count_if(loud).alias("louds"), F.min_by("name", F.when(whole, F.col("at"))).alias("first"), F.min_by("name", F.when(loud, F.col("at"))).alias("first_loud")
    )
    free = F.contains("entity", F.lit(" ")) | F.col("mid")
    found = found.select(*key, "entity", F.when(free, F.col("first")).otherwise(F.col("first_loud")).alias("name"), F.when(free, F.col("every")).otherwise(F.col("louds")).alias("count"))
    return found.where((F.col("count") > 0) & ~F.forall(F.split("entity", " "), lambda w: w.isin(FOLDED_STOPWORDS)))


def all_mentions(units: DataFrame, key: list[str], gazetteer: DataFrame, text: str = "text") -> DataFrame:
    """Known names, then other proper names, chapter references and numbers: (key..., entity, name, type, count)."""
    within = [c for c in key if c in gazetteer.columns]
    known = saved(mentions(units, key, gazetteer, text), "known").join(gazetteer.select(*within, F.col("key").alias("entity"), "name", "type"), [*within, "entity"])
    scanned = proper_nouns(units, key, text).withColumn("type", F.lit("PROPER")).join(known.select(*key, "entity"), [*key, "entity"], "left_anti")
    chapters = chapter_mentions(units, key, text).withColumn("name", F.regexp_replace("entity", "chapter:", "Chương ")).withColumn("type", F.lit("CHAPTER"))
    numbers = number_mentions(units, key, text).withColumn("name", F.substring("entity", 5, 1000)).withColumn("type", F.lit("NUMBER"))
    columns = [*key, "entity", "name", "type", "count"]
    return known.select(columns).unionByName(scanned.select(columns)).unionByName(chapters.select(columns)).unionByName(numbers.select(columns))


def with_heading_mentions(segments: DataFrame, found: DataFrame, source: list[str], scope: str = "scene") -> DataFrame:
    """found and, once, every entity of a heading in the other segments of its scope that lack it.

    scope: the heading's scene, which ends after so many segments, or its whole section, up to the next heading.
    """
    if scope not in ("scene", "section"):
        raise ValueError(f"heading scope {scope!r} is neither scene nor section")
    place = segments.select(*source, "seq", "scene", "seg_kind")
    if scope == "section":
        upto = Window.partitionBy(*source).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        place = place.withColumn("section", F.sum((F.col("seg_kind") == "heading").cast("int")).over(upto))
    heads = found.join(place.where("seg_kind = 'heading'"), [*source, "seq"]).select(*source, scope, "entity").distinct()
    spread = place.where("seg_kind <> 'heading'").join(heads, [*source, scope]).select(*source, "seq", "entity")
    missing = spread.join(found, [*source, "seq", "entity"], "left_anti").withColumn("count", F.lit(1).cast("long"))
    return found.select(*source, "seq", "entity", "count").unionByName(missing)
