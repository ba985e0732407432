"""Vectors and extractions computed once for each content: a cache by hash, providers, and what stands in when they fail.

A provider is any object with `space` (a name for what it computes), `batch` (texts
a call) and `encode(texts)`, which gives a vector for each; an extractor has `space`,
`batch` and `extract(texts)`, which gives a payload (JSON) for each. They run inside
tasks on Arrow batches; a call that fails touches only its own texts. For vectors the
hashed features then stand in, in their own space; an extraction is left out, as
names are found without it too. `origin` and `problem` say so in each row.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import HASH_DIMS, tokens
from ..session import saved, small
from . import dense, store

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HASH_SPACE = f"hash-v2@{HASH_DIMS}"
CACHE = "hash string, space string, {value}, made long"
VECTOR, PAYLOAD = "vec array<double>", "payload string"
NAMES = ["hash", "space", "value", "origin", "problem"]
#: A broadcast side is counted first and holds at most so many rows.
BROADCAST_ROWS = 200_000


class HashProvider:
    """The hashed features as a provider; its calls cannot fail. Texts come as lists of tokens."""

    space, batch, encode = HASH_SPACE, 10_000, None


def _calls(provider, method: str, fallback):
    """Rows (hash, text, tokens) to (hash, space, value, origin, problem), one call for `batch` texts."""
    call = getattr(provider, method)

    def run(batches):
        kind = pa.list_(pa.float64()) if method == "encode" else pa.string()
        for batch in batches:
            if call is None:
                rows = fallback(batch.column(2))
                n, offsets = batch.num_rows, pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * rows.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([provider.space] * n, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(rows.ravel())), pa.array(["provider"] * n, pa.string()), pa.nulls(n, pa.string())], names=NAMES)
                continue
            every, spaces, problems, failed = [], [], [], []
            for at in range(0, batch.num_rows, provider.batch):
                part, problem = batch.slice(at, provider.batch), None
                try:
                    values = [None if v is None else v if isinstance(v, str) else np.asarray(v, dtype=float) for v in call(part.column(1).to_pylist())]
                    if len(values) != part.num_rows:
                        raise ValueError(f"{len(values)} results for {part.num_rows} texts")
                except Exception as e:  # providers have errors of their own; the row says which
                    problem = f"{type(e).__name__}: {e}"[:200]
                    values = [None] * part.num_rows
                    failed += range(at, at + part.num_rows)
                every += values
                spaces += [HASH_SPACE if problem is not None and method == "encode" else provider.space] * part.num_rows
                problems += [problem] * part.num_rows
            if failed:  # all texts of the batch that failed at once
                for i, value in zip(failed, fallback(batch.column(2).take(pa.array(failed)))):
                    every[i] = value
            origins = ["provider" if p is None else "fallback" for p in problems]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spaces, pa.string()), pa.array(every, kind), pa.array(origins, pa.string()), pa.array(problems, pa.string())], names=NAMES)

    return run


def _through(units: DataFrame, key: list[str], cache: DataFrame, provider, method: str, value: str, fallback, text: str) -> tuple[DataFrame, DataFrame]:
    hashed = saved(units.select(*key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("hash"), F.coalesce(F.col(text), F.lit("")).alias("text")), "hashed")
    name, kind = value.split(" ", 1)
    known = cache.where(F.col("space") == provider.space).select("hash", "space", F.col(name).alias("value"), F.lit("cache").alias("origin"), F.lit(None).cast("string").alias("problem"))
    missing = hashed.join(known.select("hash"), "hash", "left_anti").groupBy("hash").agg(F.first("text").alias("text"))
    fresh = saved(missing.select("hash", "text", tokens("text").alias("t")).mapInArrow(_calls(provider, method, fallback), f"hash string, space string, value {kind}, origin string, problem string"), "computed")
    rows = hashed.drop("text").join(known.unionByName(fresh), "hash").withColumnRenamed("value", name)
    return rows, fresh.withColumnRenamed("value", name)


def embedded(units: DataFrame, key: list[str], cache: DataFrame, provider, made: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(vectors, cache): vectors(key..., hash, space, vec, origin, problem) of all units, each different text that the cache
    lacks computed once, and the cache(hash, space, vec, made) with what is new, the newest winning."""
    rows, fresh = _through(units, key, cache, provider, "encode", VECTOR, dense.hashed_rows(HASH_DIMS), text)
    added = fresh.where("vec is not null").select("hash", "space", "vec", F.lit(made).cast("long").alias("made"))
    return rows, _merged(cache, added)


def extracted(units: DataFrame, key: list[str], cache: DataFrame, extractor, made: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(payloads, cache) as for embedded; payload is null where the extractor failed, and such texts are tried again next time."""
    rows, fresh = _through(units, key, cache, extractor, "extract", PAYLOAD, lambda lists: [None] * len(lists), text)
    added = fresh.where("payload is not null").select("hash", "space", "payload", F.lit(made).cast("long").alias("made"))
    return rows, _merged(cache, added)


def _merged(cache: DataFrame, added: DataFrame) -> DataFrame:
    """Of rows with one hash and space the newest: hashes alone are grouped, and only rows whose key comes twice are shuffled."""
    every, key = cache.unionByName(added), ["hash", "space"]
    twice = small(every.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "twice", BROADCAST_ROWS)
    if twice.isEmpty():
        return every
    return every.join(twice, key, "left_anti").unionByName(store.latest(every.join(twice, key, "left_semi"), key, [F.col("made")]))


def enriched(mentions: DataFrame, found: DataFrame, segment: list[str]) -> DataFrame:
    """mentions(segment..., entity, count) and, once, each entity of found(segment..., entity) that its segment lacks."""
    more = found.select(*segment, "entity").distinct().join(mentions, [*segment, "entity"], "left_anti")
    return mentions.select(*segment, "entity", "count").unionByName(more.withColumn("count", F.lit(1).cast("long")))
