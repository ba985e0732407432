"""Tables of a workspace: ordinals, superseding, deletion, summaries, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved
from . import dense, entities, index, segments
from .versions import Versions

# Where the ordinals of reference and of narrative sources begin.
REFERENCE_BASE, NARRATIVE_BASE = 0, 1000
#: Arrivals (numbers in order of arrival) that one step of numbering takes together.
ARRIVALS = 10_000


def ordinals(arrivals: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """arrivals(workspace, source, kind, chapter, arrived) with `ordinal`: the chapter's place, else the one that the
    source has, else the next free one of its kind in order of arrival."""
    base = F.when(F.col("kind") == "reference", REFERENCE_BASE).otherwise(NARRATIVE_BASE)
    rows = arrivals
    if existing is None:
        rows = rows.withColumn("had", F.lit(None).cast("long")).withColumn("most", F.lit(None).cast("long"))
    else:
        most = existing.groupBy("workspace", "kind").agg(F.max("ordinal").alias("most"))
        rows = rows.join(existing.select("workspace", "source", F.col("ordinal").alias("had")), ["workspace", "source"], "left").join(most, ["workspace", "kind"], "left")
    free = F.col("chapter").isNull() & F.col("had").isNull()
    # numbered in two steps, so that no task needs all rows of a kind: within blocks of arrivals, then over the blocks' sums
    rows = rows.withColumn("free", free.cast("long")).withColumn("part", F.floor(F.col("arrived") / ARRIVALS))
    sums = rows.groupBy("workspace", "kind", "part").agg(F.sum("free").alias("sum"))
    earlier = Window.partitionBy("workspace", "kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("workspace", "kind", "part", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    rows = rows.join(sums, ["workspace", "kind", "part"])
    nth = F.col("before") + F.sum("free").over(Window.partitionBy("workspace", "kind", "part").orderBy("arrived", "source"))
    fresh = F.coalesce(F.col("most") + 1, base) + nth - 1
    return rows.withColumn("ordinal", F.when(F.col("chapter").isNotNull(), NARRATIVE_BASE + F.col("chapter")).otherwise(F.coalesce(F.col("had"), fresh)).cast("long")).drop("had", "most", "free", "part", "before")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of the rows of a key the last by order: an aggregate, so that partial maxima are combined before the shuffle."""
    others = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r"))
    return best.select(*key, *[F.col(f"r.{c}").alias(c) for c in others])


def supersede(table: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """table without the keys that fresh replaces, and fresh."""
    return table.join(fresh.select(*key).distinct(), key, "left_anti").unionByName(fresh)


def write_superseding(fresh: DataFrame, path: str, parts: tuple[str, ...] = ("workspace", "source")) -> None:
    """Overwrite only the partitions that fresh has. Readers may see the moment of the job's commit."""
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def _node(*tables: DataFrame) -> list[str]:
    """What an entity is known by: its workspace, where all of these tables have one, and its key."""
    return [c for c in ("workspace", "entity") if all(c in t.columns for t in tables)]


def without_orphans(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    node = _node(entities, mentions)
    return entities.join(mentions.select(*node).distinct(), node, "left_semi")


def source_summary(sources: DataFrame, segments: DataFrame) -> DataFrame:
    counts = segments.groupBy("workspace", "source").agg(F.count("*").alias("segments"))
    return sources.join(counts, ["workspace", "source"], "left").withColumn("segments", F.coalesce("segments", F.lit(0)).cast("long"))


def cache_misses(wanted: DataFrame, cache: DataFrame, space: str, text: str = "text") -> DataFrame:
    """The distinct hashes of texts that the cache lacks in this space."""
    hashes = wanted.select(F.sha2(F.col(text), 256).alias("hash")).distinct()
    return hashes.join(cache.where(F.col("space") == space).select("hash"), "hash", "left_anti")


#: Tables that a deletion and a clearing leave as they are: they are keyed by content.
CACHES = ("extract_cache", "embed_cache")


def without_sources(tables: dict[str, DataFrame], gone: DataFrame, key: tuple[str, ...] = ("workspace", "source")) -> dict[str, DataFrame]:
    """All tables without the rows of the sources in gone(key...), and without entities that nothing mentions any more."""
    names = gone.select(*key).distinct()
    left = {n: t if n in CACHES or n == "entities" else t.join(names, list(key), "left_anti") for n, t in tables.items()}
    return left | {"entities": without_orphans(tables["entities"], left["mentions"])}


def cleared(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables without rows, but for the caches."""
    return {n: t if n in CACHES else t.where(F.lit(False)) for n, t in tables.items()}


def accumulated(table: DataFrame, fresh: DataFrame, key: list[str], count: str = "count") -> DataFrame:
    """table with the counts of fresh added to those of the same key."""
    return table.select(*key, count).unionByName(fresh.select(*key, count)).groupBy(*key).agg(F.sum(count).alias(count))


def indexed(sources: DataFrame, gazetteer: DataFrame, heading_scope: str = "scene") -> dict[str, DataFrame]:
    """The tables of sources(workspace, source, kind, chapter, ordinal, text): segments, mentions with those that headings
    pass on (in their scene or section), entities and vectors. Headings count as text of their segments. Names are those of the gazetteer(key, name, type),
    and, if it has a workspace, only that workspace's."""
    key = ["workspace", "source"]
    seg = saved(segments.segment(sources), "segments")  # several tables are made of it
    units = seg.withColumn("text", segments.indexable()).select(*key, "seq", "text")
    found = saved(entities.all_mentions(units, [*key, "seq"], gazetteer), "found")
    known = found.groupBy("workspace", "entity").agg(F.min_by(F.struct("name", "type"), F.struct("source", "seq")).alias("n")).select("workspace", "entity", "n.name", "n.type")
    mentions = entities.with_heading_mentions(seg, found.select(*key, "seq", "entity", "count"), key, heading_scope)
    return {"sources": sources.drop("text"), "segments": seg, "mentions": mentions, "entities": known, "vectors": dense.hash_vectors(units, [*key, "seq"], whole=True)}


def ingested(tables: dict[str, DataFrame], fresh: DataFrame, gazetteer: DataFrame, heading_scope: str = "scene") -> dict[str, DataFrame]:
    """tables after the sources in fresh were ingested: every table's rows of these sources are replaced, known entities
    keep their names and types, and those that nothing mentions any more go."""
    new = indexed(fresh, gazetteer, heading_scope)
    kept = without_sources(tables, fresh)
    both = {n: kept[n].unionByName(new[n]) for n in ("sources", "segments", "mentions", "vectors") if n in kept}
    node = _node(tables["entities"], new["entities"])
    added = new["entities"].join(tables["entities"].select(*node), node, "left_anti")
    return kept | both | {"entities": without_orphans(tables["entities"].unionByName(added), both["mentions"])}


#: Names are kept whatever happens to the source that had them first; the index's sums are added up; other tables go by source.
UNKEYED = index.SUMMED | {"names": []}


def commit_sources(versions: Versions, fresh: DataFrame, gazetteer: DataFrame, relations: DataFrame | None = None, heading_scope: str = "scene") -> int:
    """Ingest fresh(workspace, source, kind, chapter, ordinal, text) as one version: whatever the store has of these sources is
    replaced in all tables at once. relations(workspace, source, id, subject, relation, object) are theirs. Only these sources
    are read, and the postings that they replace."""
    now, fresh = versions.number(), saved(fresh, "fresh")
    new = indexed(fresh, gazetteer, heading_scope)
    units = new["segments"].withColumn("text", segments.indexable()).select("workspace", "source", "seq", "text")
    new = new | index.built(units, ["workspace", "source", "seq"], ("workspace",))
    new["names"] = new.pop("entities").withColumn("seen", F.lit(now).cast("long"))
    own = relations if relations is not None else fresh.sparkSession.createDataFrame([], "workspace string, source string, id long, subject string, relation string, object string")
    new["relations"] = own.select("workspace", "source", "id", "subject", "relation", "object")
    if now:
        less = index.removal(versions.tables(now), fresh, ["workspace", "source"], ("workspace",))
        new |= {n: new[n].unionByName(less[n]) for n in index.SUMMED}
    return versions.commit(new, fresh, UNKEYED)


def commit_deletion(versions: Versions, gone: DataFrame) -> int:
    """Delete the sources of gone(workspace, source) from all tables at once."""
    return versions.commit(index.removal(versions.tables(), gone, ["workspace", "source"], ("workspace",)), gone, UNKEYED)


def entities_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(workspace, entity, name, type) of what is mentioned, by the name that was seen first."""
    names = tables["names"].groupBy("workspace", "entity").agg(F.min_by(F.struct("name", "type"), F.struct("seen", "name")).alias("n"))
    return without_orphans(names.select("workspace", "entity", "n.name", "n.type"), tables["mentions"])


def of_space(vectors: DataFrame, space: str) -> DataFrame:
    return vectors.where(F.col("space") == space)


def next_chapter(sources: DataFrame) -> DataFrame:
    """(workspace, chapter): the number that the next chapter gets."""
    return sources.groupBy("workspace").agg((F.coalesce(F.max("chapter"), F.lit(0)) + 1).alias("chapter"))
