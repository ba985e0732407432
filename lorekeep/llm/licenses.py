"""License scans: an exact set-similarity join of text blocks with license templates.

A text's words (see text.py) are cut into blocks of BLOCK words that start every
STRIDE words, so any run of up to BLOCK - STRIDE words lies whole in the block
in whose first STRIDE words it starts. A template matches a block if the block
has at least `threshold` of the template's different words.

The join: all words of templates are ranked by how many blocks of the whole
corpus have them, rarest first. A template of n words that needs m of them
must share one of its n - m + 1 rarest (prefix filter); a block with fewer than
m template words cannot match (length filter); if the shared word is i-th of
the template and j-th of the block's template words, at most min(i, j) words
before and min(n - i, k - j) - 1 behind it can be common (positional filter).
What remains is verified by intersection, and phrases by the places where their
words stand consecutively. Nothing is sampled or cut off.

Defined cases: a null or empty text has 0 words, no labels and score 0; rows
that repeat are each returned; templates longer than BLOCK - STRIDE words are
refused. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK, STRIDE = 64, 32
THRESHOLD = 0.9

# Phrases that must stand word by word, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# License notices that are matched by containment, and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
}


def _blocks(words: list[bytes]):
    for start in range(0, max(1, len(words)), STRIDE):
        yield start, words[start : start + BLOCK]


def _frequencies(vocabulary: frozenset):
    def count(batches):
        seen: Counter = Counter()
        for batch, raw, offsets in T.pieces(batches, "text"):
            folded = T.FOLD
            for i in range(batch.num_rows):
                words = raw[offsets[i] : offsets[i + 1]].tobytes().translate(folded).split()
                for start, block in _blocks(words):
                    seen.update(vocabulary.intersection(block))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return count


def _candidates(rank: dict[bytes, int], prefixes: frozenset):
    """For each text its number of words and the blocks that have a word of some template's prefix."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("ids", pa.list_(pa.int32()))]))

    def find(batches):
        for batch, raw, offsets in T.pieces(batches, "text"):
            counts, found, keys = [], [], []
            for i in range(batch.num_rows):
                body = raw[offsets[i] : offsets[i + 1]].tobytes()
                words = body.translate(T.FOLD).split()
                counts.append(len(words))
                keys.append(hashlib.md5(body).hexdigest())
                blocks = []
                if not prefixes.isdisjoint(words):
                    blocks = [{"start": start, "ids": [rank.get(w, 0) for w in block]} for start, block in _blocks(words) if not prefixes.isdisjoint(block)]
                found.append(blocks)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array(counts, pa.int64()), pa.array(found, kind)], names=["doc_id", "key", "n_words", "blocks"])

    return find


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """For each row of docs: doc_id, n_words, hits: the distinct (label, phrase, start, similarity) of its blocks."""
    templates, phrases = templates if templates is not None else TEMPLATES, phrases if phrases is not None else PHRASES
    wanted = [(p, label, True, 1.0) for p, label in phrases.items()] + [(t, label, False, threshold) for t, label in templates.items()]
    sequences = [T.words_of(p) for p, *_ in wanted]
    if any(len(s) > BLOCK - STRIDE for s in sequences):
        raise ValueError(f"templates have at most {BLOCK - STRIDE} words")
    vocabulary = frozenset(w for s in sequences for w in s)
    bodies = docs.select("doc_id", F.col(text).alias("text"))
    counts = bodies.select("text").mapInArrow(_frequencies(vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequency = {r["word"].encode(): r["n"] for r in counts.collect()}  # at most one row for each template word
    rank = {w: k + 1 for k, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    rows = []
    for k, ((_, label, exact, need), words) in enumerate(zip(wanted, sequences)):
        own = sorted({rank[w] for w in words})
        least = int(np.ceil(need * len(own) - 1e-9))
        for i, token in enumerate(own[: len(own) - least + 1]):
            rows.append((token, i, k, label, exact, least, own, [rank[w] for w in words]))
    back = {v: w for w, v in rank.items()}
    prefixes = frozenset(back[r[0]] for r in rows)
    schema = "token int, i int, template int, label string, exact boolean, least int, own array<int>, words array<int>"
    index = docs.sparkSession.createDataFrame(rows, schema)  # bounded by the templates' words

    found = bodies.mapInArrow(_candidates(rank, prefixes), "doc_id long, key string, n_words long, blocks array<struct<start:int,ids:array<int>>>")
    # the first element marks the row itself
    marked = F.concat(F.array(F.struct(F.lit(-1).alias("start"), F.array().cast("array<int>").alias("ids"))), F.col("blocks"))
    blocks = found.select("doc_id", "key", "n_words", F.explode(marked).alias("b")).select("doc_id", "key", "n_words", "b.start", "b.ids")
    blocks = blocks.withColumn("set", F.array_sort(F.array_remove(F.array_distinct("ids"), 0)))
    tokens = blocks.select("*", F.posexplode_outer("set").alias("j", "token"))
    met = tokens.join(F.broadcast(index), "token", "left")
    n, k = F.size("own"), F.size("set")
    fits = (k >= F.col("least")) & (F.least("i", "j") + 1 + F.least(n - F.col("i"), k - F.col("j")) - 1 >= F.col("least"))
    common = F.size(F.array_intersect("own", "set"))
    met = met.withColumn("similarity", F.when(fits & (common >= F.col("least")), common / n))
    length = F.size("words")
    places = F.filter(F.sequence(F.lit(0), F.least(F.size("ids"), F.lit(STRIDE)) - 1), lambda p: F.slice("ids", p + 1, length) == F.col("words"))
    hit = F.when(F.col("similarity").isNull(), F.array().cast("array<int>")).when(F.col("exact"), places).otherwise(F.array(F.lit(0)))
    starts = F.transform(hit, lambda p: F.struct(F.col("label").alias("label"), F.col("exact").alias("phrase"), F.col("template").alias("template"), (F.col("start") + p).cast("long").alias("start"), F.col("similarity").alias("similarity")))
    starts = met.select("doc_id", "key", "n_words", "start", F.when(F.col("start") >= 0, starts).alias("hits"))
    grouped = starts.groupBy("doc_id", "key", "n_words").agg(F.sum(F.when(F.col("start") == -1, 1)).alias("times"), F.array_distinct(F.flatten(F.collect_set("hits"))).alias("hits"))
    return grouped.select("doc_id", "n_words", "hits", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("copy")).drop("copy")


def op1_license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: its words, the places of the base phrases, and all labels with the best similarity."""
    hits = scan(docs)
    base = F.filter("hits", lambda h: h["phrase"])
    starts = F.transform(base, lambda h: h["start"])

    def joined(which):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(which, lambda h: h["label"]))), ",")

    return hits.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["similarity"])), F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """DuckDB text of op1: every phrase at every place, every template against every block."""
    places = ", ".join(
        f"list_transform(list_filter(generate_series(0, len(w) - {len(p.split())}), lambda i: {' AND '.join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split()))}), lambda i: {{'place': i, 'label': '{label}'}})"
        for p, label in PHRASES.items()
    )
    templates = ", ".join(f"{{'label': '{label}', 'words': [{', '.join(f"'{x}'" for x in dict.fromkeys(t.split()))}]}}" for t, label in TEMPLATES.items())
    return rf"""WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
found AS (SELECT doc_id, len(w) AS n, flatten([{places}]) AS base,
    list_filter(list_transform([{templates}], lambda t: {{'label': t.label, 'best': list_max(list_transform(range(0, greatest(1, len(w)), {STRIDE}), lambda b: CAST(len(list_intersect(list_distinct(w[b + 1:b + {BLOCK}]), t.words)) AS DOUBLE) / len(t.words)))}}), lambda t: t.best >= {THRESHOLD} - 1e-9) AS own FROM words),
named AS (SELECT *, list_transform(base, lambda x: x.label) AS b, list_transform(own, lambda x: x.label) AS o FROM found)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(base) AS BIGINT) AS n_base, CAST(list_min(list_transform(base, lambda x: x.place)) AS BIGINT) AS first_word,
    CAST(list_max(list_transform(base, lambda x: x.place)) AS BIGINT) AS last_word, array_to_string(list_sort(list_distinct(b)), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(b, o))), ',') AS labels,
    CASE WHEN len(base) > 0 THEN 1.0 ELSE coalesce(list_max(list_transform(own, lambda x: x.best)), 0.0) END::DOUBLE AS score FROM named"""
