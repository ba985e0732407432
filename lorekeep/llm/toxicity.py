"""Toxicity: a factorization machine over hashed terms.

Terms are the words of the whole text and the first five bytes of each word
(stems), each set once per text and hashed into 2**18 buckets. An additive
linear model only sums a weight for each term; the factorization machine adds,
for each pair of present terms, the product of their latent vectors over the
number of the text's terms, so that an insult beside a group mention can weigh
more than both.

Fitting: at most `per_class` labelled rows of each class (the ones with the
smallest hash of their id); every term that they hold has a weight and a latent
vector, none is left out beforehand. Both are fitted to the logistic loss with
all rows in every step: the weights by proximal steps, whose threshold is KAPPA
standard deviations of what chance would give (so most weights are 0), the
vectors by Adagrad as long as the loss of a held-back part of the rows falls.
The bias is corrected to the share of the label over all training rows. Scoring
is one pass over the texts without a shuffle.

Defined cases: a null or empty text has no terms and gets the bias alone; rows
that repeat are scored alike; labels that are null, or whose document is
missing, teach nothing; without labels of both classes every score is the
share of toxic labels (0 without any). Extra columns are ignored.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved
from . import text as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

N_BUCKETS = 1 << 18
#: 0 stands for the whole word, the others for its first bytes.
TERM_LENGTHS = (0, 5)
THRESHOLD = 0.3
#: A weight leaves 0 where its gradient is so many standard deviations of a term without effect; it stays for a fifth.
KAPPA, STAYS = 3.5, 0.2
FACTORS, STEPS, PATIENCE, HELD_BACK = 4, 60, 8, 0.15


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    """slot: for each bucket, where its weight and latent vector are (0: none, with zeros)."""

    slot: np.ndarray
    weight: np.ndarray
    factors: np.ndarray
    bias: float

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """What is broadcast: plain arrays, so that workers need not be able to import this package."""
        return self.slot, self.weight, self.factors, self.bias

    def scores(self, n: int, rows: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        return scores(self.parts(), n, rows, buckets)


def scores(parts: tuple[np.ndarray, np.ndarray, np.ndarray, float], n: int, rows: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Of n texts; buckets must be distinct within each row."""
    slot, weight, factors, bias = parts
    share = 0.5 / np.maximum(np.bincount(rows, minlength=n), 1)
    at = slot[buckets]
    rows, at = rows[at > 0], at[at > 0]
    z = np.bincount(rows, weight[at], n) + bias
    for v in factors.T:
        s = np.bincount(rows, v[at], n)
        z += share * (s * s - np.bincount(rows, v[at] ** 2, n))
    return _sigmoid(z)


def terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct terms of each text, by row."""
    words = T.Words(raw, offsets)
    if not len(words.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = [(words.text * N_BUCKETS + (h >> np.uint64(46)).astype(np.int64)) for h in words.hashes(*TERM_LENGTHS)]
    key = np.unique(np.concatenate(keys))
    return key // N_BUCKETS, key % N_BUCKETS


def _term_lists(batches):
    for batch, raw, offsets in T.pieces(batches, "text"):
        rows, buckets = terms(raw, offsets)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), T.lists(rows, buckets.astype(np.int32), batch.num_rows, pa.int32())],
            names=["doc_id", "label", "terms"],
        )


def _sums(values: np.ndarray, starts: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """Sums of consecutive values between the starts."""
    inside = ~empty
    out = np.zeros(len(starts))
    if inside.any():
        out[inside] = np.add.reduceat(values, starts[inside])
    return out


def _fit(rows: np.ndarray, buckets: np.ndarray, labels: np.ndarray, rate: float = 0.3, step: float = 0.05) -> Model:
    """rows (sorted) and buckets (distinct in a row) are the terms, labels has one entry a row."""
    n, rng = len(labels), np.random.default_rng(7)
    held = np.bincount(buckets, minlength=N_BUCKETS)
    used = np.flatnonzero(held)
    slot = np.zeros(N_BUCKETS, np.int32)
    slot[used] = np.arange(1, len(used) + 1)
    at = slot[buckets] - 1
    of_term, row_of = np.cumsum(held[used]) - held[used], rows[np.argsort(at, kind="stable")].astype(np.int32)
    count = np.bincount(rows, minlength=n)
    of_row = np.cumsum(count) - count
    del rows, buckets
    bare, none = count == 0, np.zeros(len(used), bool)
    back = rng.random(n) < HELD_BACK if n >= 100 else np.zeros(n, bool)
    taught, share = ~back, 0.5 / np.maximum(count, 1)
    p = min(max(float(labels[taught].mean()), 1e-3), 1 - 1e-3)
    spread = p * (1 - p) * np.maximum(_sums(taught[row_of].astype(float), of_term, none), 1e-9)  # of a gradient without effect
    limit = KAPPA * np.sqrt(spread)

    def losses(z: np.ndarray) -> np.ndarray:
        return np.logaddexp(0, np.where(labels == 1, -z, z))

    weight, bias, last, kept = np.zeros(len(used)), np.log(p / (1 - p)), np.inf, None
    for _ in range(STEPS):
        z = bias + _sums(weight[at], of_row, bare)
        loss = losses(z)[taught].mean()
        if loss > last + 1e-3:  # the step was too long for terms that stand together: back, and shorter ones
            step, (weight, bias) = step / 2, kept
            z = bias + _sums(weight[at], of_row, bare)
        else:
            last, kept = loss, (weight, bias)
        s = _sigmoid(z)
        error = np.where(taught, s - labels, 0.0)
        moved = weight - step * _sums(error[row_of], of_term, none) / spread
        weight = np.sign(moved) * np.maximum(np.abs(moved) - step * limit / spread * np.where(weight != 0, STAYS, 1.0), 0)
        bias -= 0.5 * error.sum() / max((s * (1 - s))[taught].sum(), 1e-3)
    weight, bias = kept
    linear = bias + _sums(weight[at], of_row, bare)
    vectors, seen = rng.normal(0, 0.05, (FACTORS, len(used))), np.full((FACTORS, len(used)), 1e-6)
    judged = back if back.any() else taught
    best, since, found = losses(linear)[judged].mean(), 0, np.zeros((FACTORS, len(used)))
    for _ in range(STEPS):
        sums, z = [], linear.copy()
        for v in vectors:
            own = v[at]
            sums.append(_sums(own, of_row, bare))
            z += share * (sums[-1] * sums[-1] - _sums(own * own, of_row, bare))
        loss = losses(z)[judged].mean()
        if loss < best - 1e-5:
            best, since, found = loss, 0, vectors
        elif (since := since + 1) > PATIENCE:
            break
        error = np.where(taught, _sigmoid(z) - labels, 0.0) * 2 * share
        alone = _sums(error[row_of], of_term, none)
        gradient = np.stack([_sums((error * s)[row_of], of_term, none) - alone * v for s, v in zip(sums, vectors)])
        seen = seen + gradient * gradient
        vectors = vectors - rate * gradient / np.sqrt(seen)
    return Model(slot, np.concatenate(([0.0], weight)), np.vstack((np.zeros((1, FACTORS)), found.T)), float(bias))


def training_rows(labels: DataFrame, held_out: bool = True) -> DataFrame:
    """(doc_id, label) of the rows that may teach: those whose crc32(doc_id as text) mod 4 is not 2."""
    rows = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    return rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2) if held_out else rows


def fit(docs: DataFrame, labelled: DataFrame, per_class: int = 4000) -> Model:
    """labelled: (doc_id, label). The sample is bounded by per_class rows of each class."""
    none = Model(np.zeros(N_BUCKETS, np.int32), np.zeros(1), np.zeros((1, 1)), -40.0)
    labelled = labelled.groupBy("doc_id").agg(F.max("label").alias("label"))  # a document labelled twice counts once
    known = labelled.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return none if not counts.get(1) else Model(none.slot, none.weight, none.factors, 40.0)
    by_hash = F.xxhash64("doc_id")
    ids = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(by_hash, "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    ids = saved(ids, "toxicity-sample")  # at most 2 * per_class rows
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text")
    sample = saved(sample.mapInArrow(_term_lists, "doc_id long, label int, terms array<int>"), "toxicity-terms")
    data = sample.select("label", "terms").orderBy("doc_id", "label", "terms").toArrow()  # at most 2 * per_class rows
    labels = np.asarray(data["label"], dtype=float)
    lists = data["terms"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    rows = np.repeat(np.arange(len(labels), dtype=np.int32), np.diff(np.asarray(lists.offsets)))
    model = _fit(rows, np.asarray(lists.flatten()), labels)
    n1 = labels.sum()
    model.bias += float(np.log(counts[1] / counts[0]) - np.log(max(n1, 1) / max(len(labels) - n1, 1)))
    return model


def score(docs: DataFrame, model: Model, columns: list[str], text: str = "text") -> DataFrame:
    """The given columns of docs and `score`, for the whole of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())
    chosen = docs.select(*[F.col(c) for c in columns], F.col(text).alias("__text"))

    def run(batches):
        for batch, raw, offsets in T.pieces(batches, "__text"):
            s = scores(shared.value, batch.num_rows, *terms(raw, offsets))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s)], names=[*columns, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{kinds}, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches):
        for batch, raw, offsets in T.pieces(batches, text):
            s = scores(shared.value, batch.num_rows, *terms(raw, offsets))
            yield batch.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    out = score(docs, fit(docs, training_rows(labels)), ["doc_id"])
    return out.select(
        "doc_id",
        (F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 4 == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
