"""Language identification by nearest centroid.

A text's vector counts the 3-byte grams of its lower-cased UTF-8 (a space
between words and at both ends) in DIMS hashed buckets: (1 + ln count) x inverse
document frequency, scaled to length 1. Inverse document frequencies come from
all learnable documents. Each language gets up to CLUSTERS centroids: spherical
k-means over at most `per_language` of its documents (those with the smallest
hash of their id). The language of the centroid with the largest cosine wins;
a text farther from it than 99.9 % of that cluster's own documents is marked
as rejected.

Defined cases: `und` and score 0 for a null text, one without any letter, and
where nothing can be learned; ties go to the alphabetically first language;
rows that repeat are each predicted. Extra columns are ignored.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved
from . import text as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMS, CLUSTERS = 4096, 4
ROWS_AT_ONCE = 256
SALTS = 32


def gram_counts(texts: list[str]) -> np.ndarray:
    """One row of DIMS bucket counts for each text."""
    folded = [t.lower().encode("utf-8", "surrogatepass").translate(T.FOLD) for t in texts]
    whole = np.frombuffer(b" " + b" ".join(folded) + b" ", dtype=np.uint8).astype(np.uint32)
    ends = np.cumsum([len(f) + 1 for f in folded])
    if len(whole) < 3:
        return np.zeros((len(texts), DIMS))
    gram = (whole[:-2] << 16) | (whole[1:-1] << 8) | whole[2:]
    bucket = ((gram * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    row = np.searchsorted(ends, np.arange(len(gram)) + 1, side="right")
    inside = row < len(texts)
    inside[ends[ends <= len(gram)] - 1] = False  # grams from the end of one text into the next
    return np.bincount(row[inside] * DIMS + bucket[inside], minlength=len(texts) * DIMS).reshape(len(texts), DIMS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0.0) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _rows(batches, column: str):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            texts = part.column(part.schema.get_field_index(column)).to_pylist()
            done = 0
            while done < len(texts):  # a few very long texts at a time
                upto, size = done, 0
                while upto < len(texts) and (upto == done or size + len(texts[upto] or "") <= T.STEP_BYTES):
                    size += len(texts[upto] or "")
                    upto += 1
                yield part.slice(done, upto - done), texts[done:upto]
                done = upto


def _document_frequencies(batches):
    seen, n = np.zeros(DIMS, dtype=np.int64), 0
    for _, texts in _rows(batches, "text"):
        seen += (gram_counts([t or "" for t in texts]) > 0).sum(axis=0)
        n += len(texts)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS), pa.int32()), pa.array(seen), pa.array(np.full(DIMS, n), pa.int64())], names=["dim", "df", "n"])


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from the mean and the points farthest from the centres so far: (centres, each row's centre)."""
    centres = [x.mean(axis=0)]
    while len(centres) < min(k, len(x)):
        centres.append(x[np.argmin(np.max(x @ np.array(centres).T, axis=1))])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = np.argmax(x @ c.T, axis=1)
        c = np.array([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, np.argmax(x @ c.T, axis=1)


def _centroids(idf: np.ndarray, clusters: int):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        x = vectors(np.vstack([gram_counts([t or ""]) for t in rows["text"]]), idf)
        c, own = k_means(x, clusters)
        near = (x * c[own]).sum(axis=1)
        least = [float(np.quantile(near[own == i], 0.001)) if (own == i).any() else 1.0 for i in range(len(c))]
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centre": list(c.astype(float)), "least": least, "n": [int((own == i).sum()) for i in range(len(c))]})

    return fit


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)  # of each centre
    centres: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMS)))
    least: np.ndarray = field(default_factory=lambda: np.zeros(0))
    idf: np.ndarray = field(default_factory=lambda: np.ones(DIMS))


def fold_of(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def fit(docs: DataFrame, per_language: int = 400, clusters: int = CLUSTERS) -> Model:
    """Learns from docs(doc_id, text, lang) outside fold 1 with a language and a text. per_language bounds the sample for
    the centroids; document frequencies cover all."""
    learn = docs.where(fold_of() != 1).where("lang is not null and text is not null")
    df = learn.select("text").mapInArrow(_document_frequencies, "dim int, df long, n long").groupBy("dim").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).collect()
    if not df:
        return Model()
    idf = np.zeros(DIMS)
    for r in df:
        idf[r["dim"]] = np.log((1 + r["n"]) / (1 + r["df"])) + 0.1
    # the first by hash in each of SALTS parts of a language, then the first of these: no task holds a whole language
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = learn.select("doc_id", "lang", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(SALTS)).alias("salt"))
    for parts in (["lang", "salt"], ["lang"]):
        first = Window.partitionBy(*parts).orderBy(*by_hash)
        ids = ids.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_language)
    ids = saved(ids.select("doc_id", F.col("lang").alias("__lang")), "lang-sample")  # bounded: per_language rows a language
    sample = learn.join(F.broadcast(ids), "doc_id").where(F.col("lang") == F.col("__lang")).select("doc_id", "lang", "text")
    rows = sample.groupBy("lang").applyInPandas(_centroids(idf, clusters), "lang string, centre array<double>, least double, n long")
    rows = sorted((r for r in rows.collect() if r["n"] > 0), key=lambda r: r["lang"])
    return Model([r["lang"] for r in rows], np.array([r["centre"] for r in rows]).reshape(-1, DIMS), np.array([r["least"] for r in rows]), idf)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for the whole of each text."""
    # plain lists and arrays: workers need not be able to import this package
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.centres, model.least, model.idf))

    def run(batches):
        langs, centres, least, idf = shared.value
        for part, texts in _rows(batches, "text"):
            lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts]) & (len(langs) > 0)
            best, score = np.zeros(len(texts), dtype=int), np.zeros(len(texts))
            if len(langs):
                near = vectors(gram_counts([t or "" for t in texts]), idf) @ centres.T
                best = np.argmax(near, axis=1)
                score = np.where(lettered, np.clip(near[np.arange(len(texts)), best], 0, 1), 0.0)
            names = [langs[b] if ok else "und" for b, ok in zip(best, lettered)]
            rejected = [not ok or bool(s < least[b]) for b, s, ok in zip(best, score, lettered)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op4_language(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    out = predict(docs, fit(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", (F.coalesce(fold_of(), F.lit(0)) == 1).alias("held_out"), "lang_pred", "score", "rejected")
