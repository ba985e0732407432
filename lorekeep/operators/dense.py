"""Hashed feature vectors, dense or in long form, and cosine.

Dense vectors are one array a row. Queries come in blocks of a stated batch; each block is
multiplied with the vectors of a task as matrices, so a product makes no rows of its own.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BIGRAM_WEIGHT, FNV_OFFSET, FNV_PRIME, FOLDED_STOPWORDS, HASH_DIMS, INDEX_SEED, SIGN_SEED, STOP_WEIGHT, TRIGRAM_WEIGHT, WORD_WEIGHT, tokens
from ..session import saved, small
from .lexical import distinct, unit_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens that one vectorised step handles (one longer text is handled alone), and their trigrams of one sum.
STEP_TOKENS, STEP_GRAMS = 200_000, 2_000_000
#: A broadcast side is counted first and holds at most so many rows.
BROADCAST_ROWS = 200_000
#: Queries of one pass, products of one step, and what counts as a tie.
QUERIES_AT_ONCE, STEP_PRODUCTS, SLACK = 2_048, 2_000_000, 1e-6


class _Words:
    """The code points of distinct words as a matrix, for hashes of many words at once."""

    def __init__(self, words: list[str]):
        self.length = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) & np.uint32(0xFF)
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.bytes = np.append(flat, np.uint32(0))

    def after(self, state: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The FNV-1a states after these words' characters."""
        order = np.argsort(-self.length[words], kind="stable")  # the longest first, so each step takes the first ones
        length, start, held = self.length[words[order]], self.start[words[order]], state[order]
        for k in range(int(length[0]) if len(length) else 0):
            on = int(np.searchsorted(-length, -k, side="left"))
            held[:on] = (held[:on] ^ self.bytes[start[:on] + k]) * np.uint32(FNV_PRIME)
        state = state.copy()
        state[order] = held
        return state

    def grams(self, words: np.ndarray, states: list[np.uint32]) -> list[np.ndarray]:
        """The FNV-1a states after each three characters of these words (as many as a word has) between ^ and $, from these states."""
        length = self.length[words]
        upto = np.cumsum(length + 2)
        first = upto - length - 2
        edged = self.bytes[np.clip(np.repeat(self.start[words] - 1 - first, length + 2) + np.arange(int((length + 2).sum())), 0, len(self.bytes) - 1)]
        edged[first], edged[upto - 1] = ord("^"), ord("$")
        at = np.repeat(first - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
        out = []
        for state in states:
            held = np.full(len(at), state, dtype=np.uint32)
            for k in range(3):
                held = (held ^ edged[at + k]) * np.uint32(FNV_PRIME)
            out.append(held)
        return out


def _started(prefix: str, seed: int) -> np.uint32:
    state = FNV_OFFSET ^ seed
    for c in prefix:
        state = ((state ^ (ord(c) & 0xFF)) * FNV_PRIME) & 0xFFFFFFFF
    return np.uint32(state)


def _hashed(words: _Words, prefix: str, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dimension seed's hash, sign) of prefix + word."""
    first, second = (words.after(np.full(len(of), _started(prefix, seed), dtype=np.uint32), of) for seed in (INDEX_SEED, SIGN_SEED))
    return first, np.where(second % 2 == 1, 1.0, -1.0)


def _vectors(dims: int):
    stop = set(FOLDED_STOPWORDS)

    def of(lists: pa.Array) -> np.ndarray:
        """One dense row for each list of tokens."""
        n, offsets = len(lists), np.asarray(lists.offsets)
        row = np.repeat(np.arange(n), np.diff(offsets))
        coded = lists.flatten().dictionary_encode()
        index, names = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
        out = np.zeros(n * dims)
        if not len(index):
            return out.reshape(n, dims)
        words, common = _Words(names), np.array([w in stop for w in names])
        dim, sign = _hashed(words, "w:", np.arange(len(names)))
        out += np.bincount(row * dims + (dim % dims)[index], sign[index] * np.where(common, STOP_WEIGHT, WORD_WEIGHT)[index], n * dims)
        content = np.flatnonzero(~common)
        if len(content):
            dim, second = words.grams(content, [_started("c:", seed) for seed in (INDEX_SEED, SIGN_SEED)])
            dim, weight = dim % dims, np.where(second % 2 == 1, TRIGRAM_WEIGHT, -TRIGRAM_WEIGHT)
            fan = np.where(common, 0, words.length)
            first, at = np.cumsum(fan) - fan, 0
            upto = np.cumsum(fan[index])
            while at < len(index):  # the grams of so many tokens at once
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP_GRAMS, side="right")))
                some = fan[index[at:end]]
                gram = np.repeat(first[index[at:end]] - np.cumsum(some) + some, some) + np.arange(int(some.sum()))
                out += np.bincount(np.repeat(row[at:end] * dims, some) + dim[gram], weight[gram], n * dims)
                at = end
        next_to = np.flatnonzero(row[1:] == row[:-1])
        if len(next_to):
            pair, which = np.unique(index[next_to] * len(names) + index[next_to + 1], return_inverse=True)
            left, right = pair // len(names), pair % len(names)
            states = []
            for seed in (INDEX_SEED, SIGN_SEED):
                state = words.after(np.full(len(names), _started("b:", seed), dtype=np.uint32), np.arange(len(names)))
                states.append(words.after(((state ^ np.uint32(ord("_"))) * np.uint32(FNV_PRIME))[left], right))
            out += np.bincount(row[next_to] * dims + (states[0] % dims)[which], np.where(states[1] % 2 == 1, 1.0, -1.0)[which] * BIGRAM_WEIGHT, n * dims)
        return out.reshape(n, dims)

    return of


#: The weights of hashed features are so many parts of 1, so a vector before it has unit length is one of whole numbers.
WHOLE = 20


def hashed_rows(dims: int = HASH_DIMS, whole: bool = False):
    """Lists of tokens (an Arrow array) to rows of unit length (of zeros without a token), a bounded step at a time; with whole,
    to whole numbers of the same directions."""
    of = _vectors(dims)

    def run(lists: pa.Array) -> np.ndarray:
        counts, at, out = np.diff(np.asarray(lists.offsets)), 0, [np.zeros((0, dims))]
        while at < len(lists):
            upto = max(at + 1, at + int(np.searchsorted(np.cumsum(counts[at:]), STEP_TOKENS, side="right")))
            dense = of(lists.slice(at, upto - at))
            out.append(np.rint(dense * WHOLE) if whole else dense / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-300))
            at = upto
        return np.concatenate(out)

    return run


def _embedded(dims: int, rows_at_once: int = 2_000, whole: bool = False):
    rows_of = hashed_rows(dims, whole)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                yield part, rows_of(part.column(part.num_columns - 1))

    return run


def _kinds(df: DataFrame, n: int) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:n])


def hash_embed(units: DataFrame, key: list[str], text: str = "text", dims: int = HASH_DIMS) -> DataFrame:
    """(key..., dim, value), unit length: every word, trigram of a word that is no stopword, and word pair adds its signed
    weight to one dimension. One row of units gives one vector without a shuffle; a task hashes its distinct words and
    pairs once a step."""
    held, of = units.select(*key, tokens(text).alias("t")), _embedded(dims)

    def run(batches):
        for part, dense in of(batches):
            rows, at_dim = np.nonzero(dense)
            keys = [c.take(pa.array(rows)) for c in part.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(at_dim.astype(np.int32)), pa.array(dense[rows, at_dim])], names=[*part.schema.names[:-1], "dim", "value"])

    return held.mapInArrow(run, f"{_kinds(held, -1)}, dim int, value double")


def hash_vectors(units: DataFrame, key: list[str], text: str = "text", dims: int = HASH_DIMS, whole: bool = False) -> DataFrame:
    """(key..., vec): the same vectors, one array a row; units without a token have none. With whole, whole numbers of the same
    direction, which take a small part of the disk that fractions do; what scores vectors takes either."""
    held, of = units.select(*key, tokens(text).alias("t")), _embedded(dims, whole=whole)

    def run(batches):
        for part, dense in of(batches):
            some = np.flatnonzero(dense.any(axis=1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * dims), pa.array(dense[some].ravel().astype(np.int32 if whole else float)))
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(some)) for c in part.columns[:-1]], lists], names=[*part.schema.names[:-1], "vec"])

    return held.mapInArrow(run, f"{_kinds(held, -1)}, vec array<{'int' if whole else 'double'}>")


def hash_beside(units: DataFrame, key: list[str], text: str = "text", dims: int = HASH_DIMS) -> DataFrame:
    """(key..., len, terms, tf, vec): the number of tokens, the distinct ones and how often each is there, and the direction of
    the vector as whole numbers (of zeros without a token), which take a small part of the disk that fractions do."""
    held, of = units.select(*key, tokens(text).alias("t")), _embedded(dims, whole=True)

    def run(batches):
        for part, dense in of(batches):
            lists, n = part.column(part.num_columns - 1), part.num_rows
            vecs = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims), pa.array(dense.ravel().astype(np.int32)))
            lens = pa.array(np.diff(np.asarray(lists.offsets)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], lens, *distinct(lists), vecs], names=[*part.schema.names[:-1], "len", "terms", "tf", "vec"])

    return held.mapInArrow(run, f"{_kinds(held, -1)}, len long, terms array<string>, tf array<int>, vec array<int>")


def _matrix(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type.value_type):
        return unit_rows(column)
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _products(shared, names: list[str], k: int | None, every: bool, signed: bool):
    """Rows (key..., place, vec) times a block of queries of the same place to rows (query_id, key..., sim), positive ones; with
    every, also others (as 0) that share a dimension."""

    def run(batches):
        ids, places, wanted = shared.value
        floors = {here: np.full(len(asked), -np.inf if signed else 0.0) for here, asked in places.items()}
        for batch in batches:
            place = np.array(batch.column(batch.num_columns - 2).to_pylist(), dtype=object)
            for here in set(place.tolist()) & places.keys():
                mine, asked = np.flatnonzero(place == here), places[here]
                step = max(1, STEP_PRODUCTS // len(asked))
                for at in range(0, len(mine), step):
                    rows = mine[at : at + step]
                    held = _matrix(batch.column(batch.num_columns - 1).take(pa.array(rows)))
                    sims = held @ wanted[asked].T
                    if k is not None and k < len(rows):  # what the task has seen sets how near a row must be
                        floors[here] = np.maximum(floors[here], np.partition(sims, len(rows) - k, axis=0)[len(rows) - k] - SLACK)
                    on = ((sims > 0) | signed) & (sims >= floors[here])
                    if every and len(low := np.flatnonzero(floors[here] <= 0)):
                        on[:, low] |= (sims[:, low] <= 0) & ((held != 0).astype(float) @ (wanted[asked[low]] != 0).T.astype(float) > 0)
                        sims = np.maximum(sims, 0.0)
                    i, j = np.nonzero(on)
                    keys = [c.take(pa.array(rows[i])) for c in batch.columns[:-2]]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in asked[j]]) if len(j) else pa.array([], type=pa.int64()), *keys, pa.array(sims[i, j])], names=names)

    return run


def similarities(vectors: DataFrame, queries: DataFrame, key: list[str], within: str | None = None, k: int | None = None, every: bool = False, signed: bool = False) -> DataFrame:
    """(query_id, key..., sim) of vectors(key..., vec) and queries(query_id, vec), all of unit length, where sim is positive
    (with every, 0 for any other that shares a dimension; with signed, whatever it is);
    with `within`, a column of both, only inside it; with k, at least the k best of each query (each task's best, and what
    ties with them up to SLACK, for a top-k that follows).

    The batch comes to the driver in blocks of at most QUERIES_AT_ONCE; each block is one pass over the vectors.
    """
    spark = vectors.sparkSession
    place = F.col(within).cast("string") if within else F.lit("")
    held = vectors.select(*key, F.coalesce(place, F.lit("")).alias("__place"), "vec")
    kinds = f"query_id long, {_kinds(held, len(key))}, sim double"
    parts, block = [], []

    def passed() -> None:
        places: dict[str, list[int]] = {}
        for i, r in enumerate(block):
            places.setdefault(r["place"], []).append(i)
        shared = spark.sparkContext.broadcast(([r["query_id"] for r in block], {p: np.array(i) for p, i in places.items()}, np.array([r["vec"] for r in block])))
        parts.append(held.mapInArrow(_products(shared, ["query_id", *key, "sim"], k, every, signed), kinds))

    for row in saved(queries.select("query_id", F.coalesce(place, F.lit("")).alias("place"), "vec"), "query-vectors").toLocalIterator():
        block.append(row)
        if len(block) == QUERIES_AT_ONCE:
            passed()
            block.clear()
    if block or not parts:
        passed()
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sparse_cosine(units: DataFrame, key: list[str], queries: DataFrame) -> DataFrame:
    """(query_id, key..., sim) over vectors in long form; queries(query_id, dim, value) is a stated batch."""
    q = queries.select("query_id", "dim", F.col("value").alias("asked"))
    met = units.join(small(q, "asked-vectors", BROADCAST_ROWS), "dim").groupBy("query_id", *key).agg(F.sum(F.col("value") * F.col("asked")).alias("dot"))
    return met.select("query_id", *key, F.greatest(F.lit(0.0), "dot").alias("sim"))


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, sim): the k nearest by cosine; queries(query_id, wanted) is a stated batch in blocks."""
    def length(c):
        return F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))

    def plain(norm):
        return F.coalesce((norm > 0) & (norm < float("inf")), F.lit(False))

    def unit(c, norm):
        return F.transform(c, lambda x: x.cast("double") / norm).alias("vec")

    held = vectors.withColumn("norm", length("embedding"))
    asked = queries.withColumn("q_norm", length("wanted"))
    near = similarities(held.where(plain(F.col("norm"))).select("vec_id", unit("embedding", F.col("norm"))), asked.where(plain(F.col("q_norm"))).select("query_id", unit("wanted", F.col("q_norm"))), ["vec_id"], k=k, signed=True)
    # vectors without a length of their own (null, of zeros or not finite) meet all others by the plain expression
    odd = small(held.where(~plain(F.col("norm"))), "odd-vectors", BROADCAST_ROWS)
    odd_asked = small(asked.where(~plain(F.col("q_norm"))), "odd-asked", BROADCAST_ROWS)
    pairs = [asked.where(plain(F.col("q_norm"))).join(odd, F.lit(True)), held.join(odd_asked, F.lit(True))]
    dot = F.aggregate(F.zip_with("embedding", "wanted", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    rest = [p.select("query_id", "vec_id", (dot / (F.col("norm") * F.col("q_norm"))).alias("sim")) for p in pairs]
    scored = near.unionByName(rest[0]).unionByName(rest[1]).select("query_id", "vec_id", F.round("sim", 6).alias("sim"))
    best = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
