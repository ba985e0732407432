"""Ranked lexical search: all documents for each item, by dense blocked multiplication.

A document's impact for a term is (10**9 * tf) div (1000 * tf + 12 * m), an item's
weight for it the times it has the term, times w. A score is their inner product,
so a tile of scores is one product of two matrices: weights (items x terms, only
the terms that these items hold) by impacts (terms x documents). Impacts are
below 10**6; a part of the terms is closed before an item's weights in it reach
2**53 / 10**6, and a single larger weight is split over several columns, so every
partial sum in float64 is an exact integer. Parts are added in 64-bit integers.

A task keeps each item's best documents so far. A tile adds what reaches the worst
of them or ties with it, so equal scores are never lost; Spark merges the tasks'
lists in two steps.

Two passes over the whole texts: the first counts documents, terms and document
frequencies of the items' terms, the second scores. Items come to the driver in
groups of at most ITEMS_AT_ONCE items and, as far as one item allows,
TERMS_AT_ONCE terms; each group is a pair of passes.

Defined cases: null and empty texts have no terms; documents without a term are
not counted and never found; rows that repeat are documents of their own; a null
doc_id comes after all others at equal scores; rows of items that repeat, or have
a null id, are ranked each; an item without a term, or an empty table on either
side, gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP = 20
ITEMS_AT_ONCE, TERMS_AT_ONCE = 1_000, 20_000
#: Items and documents of a tile, columns of a part.
TILE_ITEMS, TILE_DOCS, PART_COLUMNS = 256, 512, 2_048
#: No impact reaches this; no item's weights in one part exceed PART_WEIGHT.
IMPACT = 10**6
PART_WEIGHT = (2**53 - 1) // IMPACT
#: Parts that the merging of the tasks' lists is dealt over first.
SALTS = 32


def _groups(items: DataFrame) -> Iterator[list[tuple[int | None, Counter]]]:
    """(item_id, times of each term) of all items, in groups of bounded size."""
    group, terms = [], 0
    for row in items.toLocalIterator():
        own = Counter(T.words_of(row["text"]))
        if group and (len(group) >= ITEMS_AT_ONCE or terms + len(own) > TERMS_AT_ONCE):
            yield group
            group, terms = [], 0
        group.append((row["item_id"], own))
        terms += len(own)
    if group:
        yield group


def _counted(vocabulary):
    """For each task: documents with a term, their terms, and document frequencies (term -2, -1 and 0 up)."""

    def run(batches):
        term = vocabulary.value
        df, n_docs, n_terms = np.zeros(len(term), np.int64), 0, 0
        for batch, raw, offsets in T.pieces(batches, "text"):
            for i in range(batch.num_rows):
                words = raw[offsets[i] : offsets[i + 1]].tobytes().translate(T.FOLD).split()
                if words:
                    n_docs, n_terms = n_docs + 1, n_terms + len(words)
                    own = set(map(term.get, words))
                    own.discard(None)
                    df[list(own)] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-2, -1], held)), pa.int64()), pa.array(np.concatenate(([n_docs, n_terms], df[held])), pa.int64())], names=["term", "n"])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _tiles(group: list[tuple[int | None, Counter]], vocabulary: dict[bytes, int], weights: list[int]) -> list[tuple[int, int, list]]:
    """(first item, items, parts); a part is (terms, rows, columns, values) of a matrix of weights."""
    tiles, first = [], 0
    while first < len(group):
        terms, upto = set(), first
        while upto < len(group) and upto - first < TILE_ITEMS and (upto == first or len(terms | group[upto][1].keys()) <= 2 * PART_COLUMNS):
            terms |= group[upto][1].keys()
            upto += 1
        parts, columns, sums = [], [], np.zeros(upto - first, np.int64)
        entries = {vocabulary[t]: [] for t in sorted(terms)}
        for row in range(first, upto):
            for t, times in group[row][1].items():
                if weights[vocabulary[t]]:
                    entries[vocabulary[t]].append((row - first, times * weights[vocabulary[t]]))
        for term, of in entries.items():
            while of:  # more than once only if a weight fills a part alone
                now = [(r, min(v, PART_WEIGHT)) for r, v in of]
                if len(columns) >= PART_COLUMNS or any(sums[r] + v > PART_WEIGHT for r, v in now):
                    parts.append(columns)
                    columns, sums = [], np.zeros(upto - first, np.int64)
                columns.append((term, now))
                for r, v in now:
                    sums[r] += v
                of = [(r, v - PART_WEIGHT) for r, v in of if v > PART_WEIGHT]
        parts = [p for p in (*parts, columns) if p]
        flat = [
            (np.array([t for t, _ in p]), np.array([r for _, of in p for r, _ in of]), np.array([c for c, (_, of) in enumerate(p) for _ in of]), np.array([v for _, of in p for _, v in of], float))
            for p in parts
        ]
        tiles.append((first, upto - first, flat))
        first = upto
    return tiles


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Of terms that stand tf times in documents of n terms, in 64-bit integers (n in wider ones where it is needed)."""
    if 25 * int(n.max(initial=0)) * n_docs >= 2**63:
        n = n.astype(object)
    m = (100 - 25 + (25 * n * n_docs) // n_terms).astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class _Best:
    """Each item's best documents so far."""

    def __init__(self, n_items: int, top: int):
        self.top, self.worst = top, np.ones(n_items, np.int64)  # what a new one has to reach
        self.rows = [np.zeros(0, np.int64)] * 4  # item, -score, null id, id

    def add(self, items: np.ndarray, scores: np.ndarray, nulls: np.ndarray, ids: np.ndarray) -> None:
        rows = [np.concatenate(both) for both in zip(self.rows, (items, -scores, nulls, ids))]
        order = np.lexsort(rows[::-1])
        rows = [r[order] for r in rows]
        start = np.searchsorted(rows[0], rows[0], side="left")
        nth = np.arange(len(start)) - start
        full = nth == self.top - 1
        self.worst[rows[0][full]] = -rows[1][full]
        self.rows = [r[nth < self.top] for r in rows]


def _scored(shared):
    def run(batches):
        vocabulary, tiles, item_ids, n_docs, n_terms, top = shared.value
        best, local = _Best(len(item_ids), top), np.zeros(len(vocabulary), np.int64)
        dense = [(first, n, [(terms, _dense(n, len(terms), *of)) for terms, *of in parts]) for first, n, parts in tiles]
        for batch, raw, offsets in T.pieces(batches, "text"):
            column = batch.column(batch.schema.get_field_index("doc_id"))
            all_nulls, all_ids = np.asarray(column.is_null()), np.asarray(column.fill_null(0))
            for at in range(0, batch.num_rows, TILE_DOCS):
                upto = min(at + TILE_DOCS, batch.num_rows)
                docs, terms, tf, n = [], [], [], np.zeros(upto - at, np.int64)
                for i in range(at, upto):
                    words = raw[offsets[i] : offsets[i + 1]].tobytes().translate(T.FOLD).split()
                    n[i - at] = len(words)
                    own = Counter(map(vocabulary.get, words))
                    own.pop(None, None)
                    docs += [i - at] * len(own)
                    terms += own.keys()
                    tf += own.values()
                if not docs:
                    continue
                docs, terms, tf = np.array(docs), np.array(terms), np.array(tf, np.int64)
                value = impacts(tf, n[docs], n_docs, n_terms).astype(float)
                for first, n_items, parts in dense:
                    scores = np.zeros((n_items, upto - at), np.int64)
                    for part_terms, weights in parts:
                        # a term may fill several columns of the parts, but only one of each
                        local[:] = -1
                        local[part_terms] = np.arange(len(part_terms))
                        column_of = local[terms]
                        here = column_of >= 0
                        tile = np.zeros((len(part_terms), upto - at))
                        tile[column_of[here], docs[here]] = value[here]
                        scores += (weights @ tile).astype(np.int64)
                    items, where = np.nonzero(scores >= best.worst[first : first + n_items, None])
                    if len(items):
                        best.add(items + first, scores[items, where], all_nulls[at:upto][where].astype(np.int64), all_ids[at:upto][where])
        item, score, null, doc = best.rows
        names = pa.array([item_ids[i] for i in item], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), names, pa.array(doc, pa.int64(), mask=null.astype(bool)), pa.array(-score, pa.int64())], names=["row", "item_id", "doc_id", "score"])

    return run


def _dense(n_rows: int, n_columns: int, rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros((n_rows, n_columns))
    out[rows, columns] = values
    return out


def _searched(docs: DataFrame, group: list[tuple[int | None, Counter]], top: int) -> DataFrame | None:
    spark = docs.sparkSession
    vocabulary = {t: k for k, t in enumerate(sorted(set().union(*(own.keys() for _, own in group))))}
    if not vocabulary:
        return None
    held = spark.sparkContext.broadcast(vocabulary)
    counts = docs.select("text").mapInArrow(_counted(held), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # at most one row a term of the group
    n = {r["term"]: r["n"] for r in counts}
    n_docs, n_terms = n.get(-2, 0), n.get(-1, 0)
    if not n_terms:
        return None
    weights = [weight(n_docs, n.get(k, 0)) for k in range(len(vocabulary))]
    shared = spark.sparkContext.broadcast((vocabulary, _tiles(group, vocabulary, weights), [i for i, _ in group], n_docs, n_terms, top))
    return docs.select("doc_id", "text").mapInArrow(_scored(shared), "row long, item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score) of each row of items: its `top` best documents."""
    found: Iterable[DataFrame] = []
    for number, group in enumerate(_groups(items.select("item_id", "text"))):
        part = _searched(docs, group, top)
        if part is not None:
            found.append(part.withColumn("group", F.lit(number)))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rows = found[0]
    for part in found[1:]:
        rows = rows.unionByName(part)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    for key in (["group", "row", "salt"], ["group", "row"]):
        order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return rows.select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Each item's 20 best documents with a score above 0."""
    return ranked(docs, items)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
len AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), stat AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM len),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM df, stat),
i AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)) AS impact FROM tf JOIN len USING (doc_id), stat),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * impact) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN i USING (term) GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s QUALIFY rank <= 20"""
