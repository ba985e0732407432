"""Hard-negative mining with Kronecker-packed integer products.

Components become integers (floor of SCALE times each) and scores their inner
products. Components are biased by the least one, so that anchors and candidates
have none below 0 and an inner product is at least 0 and below 2**width. So
several candidates' components stand in separated fields, `width` bits each, of
one wide integer; an anchor's component is multiplied once with it, and the
fields of the sum are the products of each candidate, from which the biases are
taken away again. Where two or more fields, or one, fit in 53 bits, the wide
integers are held in float64, which multiplies and adds integers of that size
exactly, and blocks are multiplied by BLAS; larger components use Python's
integers of any width through the same steps.

Anchors (a stated query set) stand in blocks of ANCHORS rows, all vectors in
chunks of at most CHUNK; every block meets every chunk. A first round finds each
anchor's positives, multiplying only rows of one label; the second finds the
negatives in the positives' bands. Each meeting gives an anchor's best rows of one
chunk, so a frequent label or vector is spread over all chunks.

Defined cases: rows with a null label, a null vector, or a null or non-finite
component take no part; shorter vectors are as if filled up with zeros; a null
vec_id is no anchor and comes last at equal scores; rows that repeat are rows of
their own (also for each other); anchors without positives, and positives without
negatives in their band, give no rows; a score beyond 64 bits raises. Extra
columns are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What components are multiplied with, positives of an anchor, negatives of a positive, the band in percent.
SCALE, POSITIVES, NEGATIVES, LOW, HIGH, OF = 256, 5, 10, 30, 90, 100
ANCHORS, CHUNK, TILE = 512, 65_536, 4_096
#: Bits of an integer that float64 holds exactly, and fields of a wider integer.
EXACT_BITS, WIDE_FIELDS = 53, 8
#: The blocks of anchors are broadcast if they have at most so many bytes.
BROADCAST_BYTES = 256 << 20
KINDS = "n int, size int, kind string, rid binary, id binary, known binary, label binary, data binary, held binary"


def packing(low: int, high: int, dims: int) -> tuple[int, int, int, bool]:
    """(bias, width of a field in bits, fields of an integer, whether float64 holds it) for components from low to high."""
    width = max((dims * (high - low) ** 2).bit_length(), 1)
    fields = EXACT_BITS // width
    return (low, width, fields, True) if fields else (low, width, WIDE_FIELDS, False)


def products(a: np.ndarray, c: np.ndarray, spec: tuple[int, int, int, bool]) -> np.ndarray:
    """All inner products of the rows of a and c, exactly, as 64-bit integers."""
    bias, width, fields, small = spec
    kind = np.float64 if small else object
    groups = -(-len(c) // fields)
    biased = np.zeros((groups * fields, c.shape[1]), kind)
    biased[: len(c)] = c.astype(kind) - bias
    wide = biased[:groups]
    for k in range(1, fields):
        wide = wide + biased[k * groups : (k + 1) * groups] * (1 << (k * width))
    sums = (a.astype(kind) - bias) @ wide.T
    sums = sums.astype(np.int64) if small else sums
    mask = (1 << width) - 1
    found = np.concatenate([(sums >> (k * width)) & mask for k in range(fields)], axis=1)[:, : len(c)]
    whole = np.int64 if small else object
    found = found + bias * (a.astype(whole).sum(axis=1)[:, None] + c.astype(whole).sum(axis=1)[None, :]) - c.shape[1] * bias * bias
    return found if small else np.array(found.tolist(), dtype=np.int64).reshape(found.shape)


def usable(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """(vec_id, label, components) of the rows that take part."""
    x = F.col(embedding)
    whole = F.forall(x, lambda v: F.coalesce((F.abs(v.cast("double")) < float("inf")) & ~F.isnan(v), F.lit(False)))
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return vectors.where(F.col("label").isNotNull() & x.isNotNull() & whole).select("vec_id", relabelled.alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("long")).alias("c"))


def _matrices(rows_at_once: int, dims: int, kind: str, ordered: bool):
    """Rows to matrices: (rid, vec_id, label, c, held...) in runs of at most so many rows."""

    def pack(batch: pa.Table) -> dict:
        ids = batch.column("vec_id").combine_chunks()
        known, ids = ~np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
        order = np.lexsort((ids, ~known)) if ordered else np.arange(len(ids))
        lists = batch.column("c").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        size = np.diff(np.asarray(lists.offsets))
        data = np.zeros((len(ids), dims), np.dtype(kind))
        row = np.repeat(np.arange(len(ids)), size)
        data[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(lists.flatten())
        out = {"n": len(ids), "size": dims, "kind": kind, "rid": np.asarray(batch.column("rid")), "id": ids, "known": known, "label": np.asarray(batch.column("label")), "data": data}
        out = {k: v[order].tobytes() if isinstance(v, np.ndarray) else v for k, v in out.items()}
        return out | {"held": np.asarray(batch.column("held").combine_chunks().flatten(), dtype=np.int64).tobytes() if "held" in batch.column_names else b""}

    kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 6]
    names = ["n", "size", "kind", "rid", "id", "known", "label", "data", "held"]

    def run(batches):
        waiting, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part, batch = batch.slice(0, rows_at_once - n), batch.slice(rows_at_once - n)
                waiting.append(part)
                n += part.num_rows
                if n == rows_at_once:
                    yield _row(pack(pa.Table.from_batches(waiting)))
                    waiting, n = [], 0
        if n:
            yield _row(pack(pa.Table.from_batches(waiting)))

    def _row(values: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([values[name]], t) for name, t in zip(names, kinds)], names=names)

    return run


def _read(row: dict, prefix: str) -> dict:
    kinds = {"rid": np.int64, "id": np.int64, "known": bool, "label": np.int64, "data": np.dtype(row[f"{prefix}kind"]), "held": np.int64}
    out = {k: np.frombuffer(row[f"{prefix}{k}"], dtype=t) for k, t in kinds.items()}
    return out | {"data": out["data"].reshape(row[f"{prefix}n"], row[f"{prefix}size"])}


def _first(groups: np.ndarray, scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k first rows of each group by falling score and rising place."""
    order = np.lexsort((places, -scores, groups))
    start = np.searchsorted(groups[order], groups[order], side="left")
    return order[np.arange(len(order)) - start < k]


def _positives(spec: tuple[int, int, int, bool]):
    """The best rows of the anchor's own label in a chunk, other than itself."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, c = _read(row, "a_"), _read(row, "")
                found = [np.zeros(0, np.int64)] * 3  # anchor, place in the chunk, score
                for label in np.unique(a["label"]):
                    own, others = np.flatnonzero(a["label"] == label), np.flatnonzero(c["label"] == label)
                    for at in range(0, len(others), TILE):
                        place = others[at : at + TILE]
                        scores = products(a["data"][own], c["data"][place], spec)
                        i, j = np.nonzero(a["rid"][own][:, None] != c["rid"][place][None, :])
                        best = _first(i, scores[i, j], j, POSITIVES)
                        now = [own[i[best]], place[j[best]], scores[i[best], j[best]]]
                        found = [np.concatenate(both) for both in zip(found, now)]
                best = _first(found[0], found[2], found[1], POSITIVES)
                i, j, s = (x[best] for x in found)
                yield pa.RecordBatch.from_arrays([pa.array(a["rid"][i]), pa.array(c["id"][j], mask=~c["known"][j]), pa.array(c["rid"][j]), pa.array(s)], names=["rid", "positive_id", "prid", "score"])

    return run


def _share(x: np.ndarray, percent: int) -> np.ndarray:
    """x * percent div OF, where the product may exceed 64 bits."""
    return x // OF * percent + x % OF * percent // OF


def _negatives(spec: tuple[int, int, int, bool]):
    """The best rows of another label in a chunk in the band of each positive of the anchor."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, c = _read(row, "a_"), _read(row, "")
                held = a["held"].reshape(len(a["rid"]), POSITIVES, 2)  # whether there is a positive, and its score
                low = np.where(held[:, :, 0] > 0, -_share(-held[:, :, 1], LOW), np.iinfo(np.int64).max)
                high = np.where(held[:, :, 0] > 0, _share(held[:, :, 1], HIGH), np.iinfo(np.int64).min)
                found = [np.zeros(0, np.int64)] * 4  # anchor, positive, place in the chunk, score
                for at in range(0, len(c["label"]), TILE):
                    scores = products(a["data"], c["data"][at : at + TILE], spec)
                    other = a["label"][:, None] != c["label"][None, at : at + TILE]
                    i, j = np.nonzero(other & (scores >= low.min(axis=1)[:, None]) & (scores <= high.max(axis=1)[:, None]))
                    s = scores[i, j]
                    for nth in range(POSITIVES):
                        inside = np.flatnonzero((s >= low[i, nth]) & (s <= high[i, nth]))
                        best = inside[_first(i[inside], s[inside], j[inside], NEGATIVES)]
                        now = [i[best], np.full(len(best), nth), j[best] + at, s[best]]
                        found = [np.concatenate(both) for both in zip(found, now)]
                best = _first(found[0] * POSITIVES + found[1], found[3], found[2], NEGATIVES)
                i, nth, j, s = (x[best] for x in found)
                yield pa.RecordBatch.from_arrays([pa.array(a["rid"][i]), pa.array(nth.astype(np.int32)), pa.array(c["id"][j], mask=~c["known"][j]), pa.array(s)], names=["rid", "nth", "negative_id", "score"])

    return run


def _met(chunks: DataFrame, blocks: DataFrame, n_bytes: int) -> DataFrame:
    """Every chunk beside every block of the stated query set."""
    named = blocks.select(*[F.col(c).alias(f"a_{c}") for c in blocks.columns])
    return chunks.crossJoin(F.broadcast(named) if n_bytes <= BROADCAST_BYTES else named)


def _ranked(rows: DataFrame, key: list[str], other: str, k: int) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last(other))
    return rows.withColumn("nth" if k == POSITIVES else "rank", F.row_number().over(order)).where(F.col("nth" if k == POSITIVES else "rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, embedding: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for vectors(vec_id, label, embedding)."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = saved(usable(vectors, embedding).repartition(parts).withColumn("rid", F.monotonically_increasing_id()), "negatives-rows")
    anchors = rows.where(is_anchor)
    s = rows.agg(F.min(F.array_min("c")).alias("low"), F.max(F.array_max("c")).alias("high"), F.max(F.size("c")).alias("dims")).first()
    n = anchors.count()
    dims, low, high = s["dims"] or 0, min(s["low"] or 0, 0), max(s["high"] or 0, 0)  # shorter vectors have zeros
    kind = next((t.__name__ for t in (np.int16, np.int32) if np.iinfo(t).min <= low and high <= np.iinfo(t).max), "int64")
    spec, n_bytes, n_blocks = packing(low, high, dims), n * (dims * np.dtype(kind).itemsize + 128), max(1, -(-n // ANCHORS))
    columns = ["rid", "vec_id", "label", "c"]
    chunks = saved(rows.select(columns).mapInArrow(_matrices(CHUNK, dims, kind, True), KINDS), "negatives-chunks")
    blocks = saved(anchors.select(columns).repartition(n_blocks).mapInArrow(_matrices(ANCHORS, dims, kind, False), KINDS), "negatives-anchors")
    first = _met(chunks, blocks, n_bytes).mapInArrow(_positives(spec), "rid long, positive_id long, prid long, score long")
    positives = saved(_ranked(first, ["rid"], "positive_id", POSITIVES).withColumn("nth", F.col("nth") - 1), "negatives-positives")

    # an anchor has at most POSITIVES rows here
    taken = positives.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("nth", "score"))).alias("m"))
    held = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(POSITIVES - 1)), lambda k: F.array(F.when(F.map_contains_key("m", k), 1).otherwise(0).cast("long"), F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long")))))
    asked = anchors.join(taken, "rid").select(*columns, held.alias("held"))
    blocks = saved(asked.repartition(n_blocks).mapInArrow(_matrices(ANCHORS, dims, kind, False), KINDS), "negatives-asked")
    second = _met(chunks, blocks, n_bytes).mapInArrow(_negatives(spec), "rid long, nth int, negative_id long, score long")
    best = _ranked(second, ["rid", "nth"], "negative_id", NEGATIVES)
    named = anchors.select("rid", F.col("vec_id").alias("anchor_id")).join(positives.select("rid", "nth", "positive_id", F.col("score").alias("positive_score")), "rid")
    return best.join(named, ["rid", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(vectors: DataFrame) -> DataFrame:
    """Hard negatives for every anchor (a row whose vec_id is divisible by 100) and each of its positives."""
    return mine(vectors, F.col("vec_id") % 100 == 0)


ORACLE = f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS c
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND length(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS own, CAST(list_sum(list_transform(list_zip(a.c, b.c), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT own AND {LOW} * positive_score <= {OF} * score AND {OF} * score <= {HIGH} * positive_score QUALIFY rank <= {NEGATIVES}"""
