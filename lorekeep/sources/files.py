"""Markdown folders, overrides, record files, and pages as sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def markdown(spark: SparkSession, folder: str, workspace: str = "default", reference: bool = True) -> DataFrame:
    """(workspace, source, kind, chapter, text) of all .md and .txt files below a folder."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,txt}").text(folder, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = rows.select(F.lit(workspace).alias("workspace"), name.alias("source"), F.col("value").alias("text"))
    chapter = F.lit(None).cast("int") if reference else chapter_of(F.col("source"))
    return rows.select("workspace", "source", F.lit("reference" if reference else "chapter").alias("kind"), chapter.alias("chapter"), "text")


def chapter_of(name: Column) -> Column:
    """The first number of a file name."""
    return F.try_to_number(F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int")


def overridden(entries: DataFrame) -> DataFrame:
    """entries(stem, scope, body): the body of the highest scope for each stem."""
    first = Window.partitionBy("stem").orderBy(F.desc("scope"))
    return entries.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def page_markdown(html: str | Column) -> Column:
    """h1 as a heading, li as list lines, p as paragraphs, tags and entities removed; comments and scripts are skipped."""
    html = F.col(html) if isinstance(html, str) else html
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>", "")
    parts = F.regexp_extract_all(bare, F.lit(r"(?s)<(?:h1|li|p)(?:\s[^>]*)?>.*?</(?:h1|li|p)>"), F.lit(0))

    def line(p: Column) -> Column:
        body = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "<[^>]*>", " "), "&[a-z]+;", " "), r"\s+", " "))
        return F.when(p.startswith("<h1"), F.concat(F.lit("\n\n# "), body, F.lit("\n"))).when(p.startswith("<li"), F.concat(F.lit("\n- "), body)).otherwise(F.concat(F.lit("\n\n"), body, F.lit("\n")))

    return F.array_join(F.transform(parts, line), "")


def records(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Raw records of the .yaml files of folders, later folders ranking higher. A curated list, read on the driver."""
    import yaml

    class Loader(yaml.SafeLoader):
        """Dates stay text: the records' own rules judge them."""

    Loader.yaml_implicit_resolvers = {k: [(tag, e) for tag, e in v if not tag.endswith(":timestamp")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    rows = []
    for scope, folder in enumerate(folders):
        texts = spark.read.option("pathGlobFilter", "*.{yaml,yml}").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
        for file, text in sorted((r["file"], r["value"]) for r in texts.collect()):
            for position, item in enumerate(yaml.load(text, Loader) or []):
                many = {k: [str(x) for x in (v if isinstance(v, list) else [v]) if str(x).strip()] for k in ("entities", "tags", "introduces", "anchors") if (v := item.get(k)) is not None}
                own = item.get("sources", item.get("source"))
                until = item.get("until", item.get("date_end"))
                rows.append(
                    (
                        item.get("id"), item.get("claim"), None if item.get("date") is None else str(item["date"]), None if until is None else str(until),
                        [str(x) for x in (own if isinstance(own, list) else [own] if own else [])], item.get("confidence", "attested"), many.get("entities", []), many.get("tags", []),
                        many.get("introduces", []), many.get("anchors", []), bool(item.get("locked", True)) and not item.get("diverges", False), bool(item.get("diverges", False)),
                        bool(item.get("ongoing", until is not None)), item.get("note"), scope, file, position,
                    )
                )
    schema = "id string, claim string, date string, until string, sources array<string>, confidence string, entities array<string>, tags array<string>, introduces array<string>, anchors array<string>, locked boolean, diverges boolean, ongoing boolean, note string, scope_rank int, file string, position int"
    return spark.createDataFrame(rows, schema)
