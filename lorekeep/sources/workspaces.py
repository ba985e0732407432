"""Workspaces on disk: manifests, the markdown of all of them in one scan, and chapter files as a sink.

A workspace is a folder whose name is a slug: `novel.json`-like manifest, reference
material below `context/`, chapters elsewhere.
"""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.text import chapter_slug
from ..operators import entities, store
from .files import chapter_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What a workspace may be called, where its reference material is, what names a chapter, and manifest fields.
SLUG = r"^[a-z0-9][a-z0-9-]{0,63}$"
CONTEXT, CHAPTER_WORDS = "context", "chapter|chuong"
MANIFEST = "title string, description string, created_at double, broken string"


def manifests(spark: SparkSession, root: str, name: str = "novel.json") -> DataFrame:
    """(workspace, title, description, created_at, place) of all workspaces below root that have a manifest, newest first, then
    by title. A manifest that cannot be read counts as empty: the title is the folder's name then, and it was made at 0."""
    rows = spark.read.schema(MANIFEST).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(f"{root.rstrip('/')}/*/{name}")
    rows = rows.withColumn("workspace", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).where(F.col("workspace").rlike(SLUG))
    sound = F.col("broken").isNull()
    title = F.when(sound & (F.coalesce("title", F.lit("")) != ""), F.col("title")).otherwise(F.col("workspace"))
    rows = rows.select("workspace", title.alias("title"), F.when(sound, F.coalesce("description", F.lit(""))).otherwise("").alias("description"), F.when(sound, F.coalesce("created_at", F.lit(0.0))).otherwise(0.0).alias("created_at"), (~sound).alias("broken"))
    return rows.orderBy(F.desc("created_at"), F.lower("title"), "workspace")


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """(workspace, source, path, kind, chapter, text) of all .md and .txt files of all workspaces below root, by one scan.

    kind is reference below context/ and chapter elsewhere; a number counts as a chapter only if the name says so.
    """
    base = root.rstrip("/").split("://")[-1]
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,txt,MD,TXT}").text(root, wholetext=True)
    path = F.url_decode(F.replace(F.substring_index(F.col("_metadata.file_path"), base + "/", -1), F.lit("+"), F.lit("%2B")))
    rows = files.select(path.alias("path"), F.col("value").alias("text")).withColumn("workspace", F.split_part("path", F.lit("/"), F.lit(1)))
    rows = rows.where(F.col("workspace").rlike(SLUG) & F.contains("path", F.lit("/")))
    source = F.element_at(F.split("path", "/"), -1)
    reference = F.split_part("path", F.lit("/"), F.lit(2)) == CONTEXT
    chapter = F.when(F.lower(source).rlike(CHAPTER_WORDS), chapter_of(source))
    return rows.select("workspace", source.alias("source"), "path", F.when(reference, "reference").otherwise("chapter").alias("kind"), chapter.alias("chapter"), "text")


def arrivals(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """files with the ordinal of each source; files of one name in a workspace are one source, of which the last path stays."""
    last = store.latest(files, ["workspace", "source"], [F.col("path")])
    # by name of the path within a workspace: numbers, as ordinals are given in order of arrival
    by_path = Window.partitionBy("workspace").orderBy("path")
    order = last.select("workspace", "source", "kind", "chapter", F.row_number().over(by_path).cast("long").alias("arrived"))
    placed = store.ordinals(order, existing).select("workspace", "source", "ordinal")
    return last.join(placed, ["workspace", "source"]).select("workspace", "source", "kind", "chapter", "ordinal", "text")


def gazetteer(files: DataFrame) -> DataFrame:
    """(workspace, key, name, type) of what each workspace's reference markdown declares."""
    own = files.where((F.col("kind") == "reference") & F.lower("source").endswith(".md"))
    return entities.gazetteer_of(own, within=("workspace",))


def ingest(spark: SparkSession, root: str, versions, relations: DataFrame | None = None) -> int:
    """All workspaces' files as one version of the store. The gazetteer is made of all files first, so that every segment is
    read with the names that any file declares; headings pass their names on to their scenes."""
    from ..session import saved

    files = saved(markdown(spark, root), "files")
    had = versions.table("sources").select("workspace", "source", "kind", "ordinal") if versions.number() else None
    return store.commit_sources(versions, arrivals(files, had), gazetteer(files), relations)


# ---- chapter files ---------------------------------------------------------------


def chapter_files(chapters: DataFrame) -> DataFrame:
    """(workspace, name, body) of chapters(workspace, chapter, title, text), as the files that `chapters` writes."""
    title = F.coalesce("title", F.lit(""))
    slug = F.regexp_replace(chapter_slug(title), "-+$", "")
    name = F.format_string("chapter-%03d-%s.md", "chapter", F.when(slug == "", "untitled").otherwise(slug))
    head = F.concat(F.lit("# Chapter "), F.col("chapter").cast("string"), F.when(title != "", F.concat(F.lit(": "), title)).otherwise(""))
    return chapters.select("workspace", name.alias("name"), F.concat(head, F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("body"))


class Written(WriterCommitMessage):
    """What a task has put aside: (place aside, place), and how many files were there with the same body."""

    def __init__(self, moves: list[tuple[str, str]], same: int):
        self.moves, self.same = moves, same


class _Files(DataSourceWriter):
    """One file a row. Tasks write aside; a commit moves all into place, and an abort removes what lies aside."""

    def __init__(self, root: str):
        self.root = root

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")

    def write(self, iterator) -> Written:
        store_, base = self._open()
        moves, same = [], 0
        for row in iterator:
            folder = f"{base}/{row['workspace']}/chapters"
            place, body = f"{folder}/{row['name']}", row["body"].encode()
            if store_.get_file_info(place).is_file and store_.get_file_info(place).size == len(body):
                with store_.open_input_stream(place) as f:
                    if f.read() == body:
                        same += 1
                        continue
            store_.create_dir(folder, recursive=True)
            aside = f"{folder}/.{uuid.uuid4().hex}.tmp"
            with store_.open_output_stream(aside) as f:
                f.write(body)
            moves.append((aside, place))
        return Written(moves, same)

    def commit(self, messages) -> None:
        store_, _ = self._open()
        for aside, place in (m for x in messages if x for m in x.moves):
            store_.move(aside, place)

    def abort(self, messages) -> None:
        store_, _ = self._open()
        for aside, _ in (m for x in messages if x for m in x.moves):
            store_.delete_file(aside)


class ChapterFiles(DataSource):
    """df.write.format("chapters").mode("append").save(root): rows (workspace, name, body) to root/workspace/chapters/name."""

    @classmethod
    def name(cls) -> str:
        return "chapters"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Files(self.options["path"])


def write_chapters(chapters: DataFrame, root: str) -> None:
    """Write or replace the files of chapters(workspace, chapter, title, text); those that would not change are left alone."""
    chapters.sparkSession.dataSource.register(ChapterFiles)
    chapter_files(chapters).write.format("chapters").mode("append").save(root)
