"""Documents to ordered segments with headings and scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, let, strip

# Tokens a segment may have, body segments a scene has.
SEGMENT_TOKENS, SCENE_SIZE = 320, 4

SENTENCE_END = r"""([.!?…]+["'”’)\]}]*)(?U:\s+)(?=[\p{Lu}\p{Nd}"'“‘(\[{—\-•*])"""
BLANK_LINE = r"\n(?U:\s*)\n+"
HEADING = r"^#{1,6}\s+.*$"
LIST_LINE = r"^(?U:\s*)([-*+](?U:\s+)|\d+[.)](?U:\s+))"


def sentences(block: str | Column) -> Column:
    """A sentence ends at .!?… and closing marks before white space and a capital, digit or opening mark."""
    block = F.col(block) if isinstance(block, str) else block
    cut = F.split(F.regexp_replace(block, SENTENCE_END, "$1\u0001"), "\u0001")
    return F.filter(F.transform(cut, strip), lambda s: s != "")


def paragraphs(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(text, BLANK_LINE), strip), lambda p: p != "")


def packed(block: Column, limit: int = SEGMENT_TOKENS) -> Column:
    """A block that is too long, as runs of whole sentences that fit: an ordered fold over its sentences."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).cast("bigint").alias("cost"))

    def add(state: Column, s: Column) -> Column:
        full = (state["now"] != "") & (state["cost"] + s["cost"] > limit)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["now"]))).otherwise(state["done"]).alias("done"),
            F.when(full | (state["now"] == ""), s["text"]).otherwise(F.concat(state["now"], F.lit(" "), s["text"])).alias("now"),
            F.when(full, s["cost"]).otherwise(state["cost"] + s["cost"]).alias("cost"),
        )

    costed = F.transform(sentences(block), lambda s: F.struct(s.alias("text"), estimate_tokens(s).alias("cost")))
    folded = F.aggregate(costed, empty, add, lambda s: F.concat(s["done"], F.filter(F.array(s["now"]), lambda x: x != "")))
    return F.when(estimate_tokens(block) <= limit, F.array(block)).otherwise(folded)


def _piece(text: Column, kind: str, heading: Column) -> Column:
    return F.struct(text.alias("text"), F.lit(kind).alias("seg_kind"), heading.alias("heading"))


NO_PIECES = "array<struct<text:string,seg_kind:string,heading:string>>"


def _pieces(block: Column) -> Column:
    """The segments of one block: its heading line, then its list lines or its packed prose."""
    none = F.lit(None).cast("string")

    def of_body(body: Column) -> Column:
        own = F.filter(F.split(body, "\n"), lambda x: strip(x) != "")
        lines = let(own, lambda x: F.when((F.size(x) > 0) & F.forall(x, lambda y: y.rlike(LIST_LINE)), F.transform(x, lambda y: _piece(strip(y), "list", none))))
        prose = F.transform(packed(body), lambda x: _piece(x, "prose", none))
        # list lines begin with a list line: most prose is settled by its first one
        return F.when(body == "", F.array().cast(NO_PIECES)).when(body.rlike(LIST_LINE), F.coalesce(lines, prose)).otherwise(prose)

    def headed(first: Column) -> Column:
        head = F.array(_piece(first, "heading", strip(F.regexp_replace(first, r"^#{1,6}\s+", ""))))
        lines = F.split(block, "\n")
        return F.concat(head, let(strip(F.array_join(F.slice(lines, 2, F.size(lines)), "\n")), of_body))

    # a heading is the block's first line; blocks begin with their first character
    return F.when(block.startswith("#"), let(strip(F.get(F.split(block, "\n"), 0)), lambda first: F.when(first.rlike(HEADING), headed(first)).otherwise(of_body(block)))).otherwise(of_body(block))


def segment(sources: DataFrame, key: tuple[str, ...] = ("workspace", "source")) -> DataFrame:
    """sources(key..., text) to one row per segment: seq, scene, heading, seg_kind, text, beside the other columns.

    A heading starts a scene; so does every SCENE_SIZE-th body segment after it.
    Windows run within one source, so one shuffle on the key serves all of them.
    """
    others = [c for c in sources.columns if c not in ("text", *key)]
    parts = sources.select(*key, *others, F.posexplode(F.flatten(F.transform(paragraphs("text"), _pieces))).alias("seq", "p"))
    rows = parts.select(*key, *others, "seq", F.col("p.seg_kind").alias("seg_kind"), F.col("p.heading").alias("own"), F.col("p.text").alias("text"))
    upto = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("section", F.sum((F.col("seg_kind") == "heading").cast("int")).over(upto)).withColumn("heading", F.coalesce(F.last("own", ignorenulls=True).over(upto), F.lit("")))
    within = Window.partitionBy(*key, "section").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    body = F.sum((F.col("seg_kind") != "heading").cast("int")).over(within) - 1
    rows = rows.withColumn("step", F.when(F.col("seg_kind") == "heading", 1).when((body > 0) & (body % SCENE_SIZE == 0), 1).otherwise(0))
    return rows.withColumn("scene", F.sum("step").over(upto)).select(*key, *others, "seq", "scene", "heading", "seg_kind", "text")


def indexable(text: str = "text", heading: str = "heading") -> Column:
    """The text, after its heading unless it holds it."""
    return F.when((F.col(heading) != "") & ~F.contains(F.col(text), F.col(heading)), F.concat(F.col(heading), F.lit("\n"), F.col(text))).otherwise(F.col(text))
