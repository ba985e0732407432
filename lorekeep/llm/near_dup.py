"""Near-duplicate detection: ProbMinHash, banding, exact verification.

Every text is a set of distinct five-word shingles of equal weight, as the
verification counts them, so that repeated lines do not move candidates.
ProbMinHash gives each shingle a Poisson process whose rate is its weight; the
process's points fall on random registers, and each register keeps the shingle
with the earliest point. A text stops when every register is filled and the
latest of them precedes all points to come. Two registers agree with the
probability Jaccard similarity of the two sets, here the share that is verified.

BANDS bands of ROWS registers propose pairs: two texts at similarity 0.8 meet
in no band with probability 5e-5, at 0.85 with 5e-7. Pairs are verified
exactly: the share of common distinct shingles must be 0.8 or more.

Groups: texts with equal words are one node. A bucket of at most SMALL nodes
proposes all its pairs (a bounded number for each node). A larger one proposes
LEADERS pairs for each node, and what its leaders leave apart is settled
exactly by a prefix-filtered similarity join: shingles of these nodes are
ordered by their frequency, rarest first, and two nodes at similarity t share
one of the first n - ceil(t n) + 1 shingles of each; bounds on the overlap (from
the place of that shingle, and from bit sets of the two texts) drop pairs that
cannot reach t before any is built. So no bucket is ever expanded into all its
pairs and none is cut off.

Defined cases: rows with equal words share a class; null and empty texts have
equal (no) words; a text that has characters but no word is equal only to the
same characters. class_id is the least doc_id of the class (null if all its
ids are null). Rows that repeat are each returned. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved
from . import text as T
from .columns import whole_rows
from .components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
SMALL, LEADERS = 6, 2
MARKS = 8
MARK_NAMES = [f"mark{k}" for k in range(MARKS)]


def probminhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """For each text its registers, each the element whose point came first (0 for a text without elements)."""
    best = np.full(n_texts * registers, np.inf)
    winner = np.zeros(n_texts * registers, dtype=np.uint64)
    arrival, rnd = np.zeros(len(element)), 0
    while len(element):
        rnd += 1
        bits = T.mix(element + np.uint64(rnd * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        arrival = arrival - np.log(((bits >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight
        at = text * registers + (T.mix(bits) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, at, arrival)
        won = best[at] == arrival
        winner[at[won]] = element[won]
        last = best.reshape(n_texts, registers).max(axis=1)
        go = arrival < last[text]
        text, element, weight, arrival = text[go], element[go], weight[go], arrival[go]
    return winner.reshape(n_texts, registers)


def _shingle_sets(raw: np.ndarray, offsets: np.ndarray):
    words = T.Words(raw, offsets)
    (word_hash,) = words.hashes(0)
    found, text = words.shingles(word_hash, SHINGLE)
    return words, T.distinct(text, found)


def _sketch(batches):
    for batch, raw, offsets in T.pieces(batches, "text"):
        n = batch.num_rows
        words, (text, element, _) = _shingle_sets(raw, offsets)
        registers = probminhash(text, element, np.ones(len(element)), n, BANDS * ROWS).reshape(n, BANDS, ROWS)
        bands = np.zeros((n, BANDS), dtype=np.uint64)
        for k in range(ROWS):
            bands = T.mix(bands ^ registers[:, :, k])
        folded, content, kept = words.bytes.tobytes(), [], []
        for i in range(n):
            own = b" ".join(folded[offsets[i] : offsets[i + 1]].split())
            content.append(hashlib.md5(own or b"\0" + raw[offsets[i] : offsets[i + 1]].tobytes()).hexdigest())
            kept.append(bool(own))
        kept = np.array(kept, dtype=bool)
        rows = np.repeat(np.flatnonzero(kept), BANDS)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(content), T.lists(rows, bands[kept].astype(np.int64).ravel(), n, pa.int64())],
            names=["doc_id", "key", "content", "bands"],
        )


def _shingles(batches):
    """The shingles of each text, and MARKS numbers whose 64 bits each shingle toggles one of: two sets differ in at
    least as many shingles as their marks differ in bits."""
    for batch, raw, offsets in T.pieces(batches, "text"):
        n = batch.num_rows
        _, (text, element, _) = _shingle_sets(raw, offsets)
        for row in range(0, n, 1024):  # a few rows' bits at a time
            upto = min(row + 1024, n)
            part = (text >= row) & (text < upto)
            own, values = text[part] - row, element[part]
            bit = own * (64 * MARKS) + (T.mix(values) % np.uint64(64 * MARKS)).astype(np.int64)
            odd = (np.bincount(bit, minlength=(upto - row) * 64 * MARKS) & 1).astype(np.uint8).reshape(upto - row, 64 * MARKS)
            marks = np.packbits(odd, axis=1, bitorder="little").view(np.int64)
            columns = [batch.column(0).slice(row, upto - row), T.lists(own, values.astype(np.int64), upto - row, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(marks[:, k]) for k in range(MARKS)]], names=["content", "shingles", *MARK_NAMES])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough, with their similarity."""
    left = sets.select(F.col("content").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("content").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    short, long = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    both = both.where(short >= SIMILARITY * long)
    common = both.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("common"))
    return common.withColumn("similarity", F.col("common") / (F.col("n") - F.col("common"))).where(F.col("similarity") >= SIMILARITY).select("a", "b", "similarity")


def _residual_pairs(sets: DataFrame, apart: DataFrame) -> DataFrame:
    """Pairs of nodes in different components that share a shingle of their prefixes; apart: (content, root, minor)."""
    own = apart.join(sets, "content")
    exploded = own.select("content", "root", "minor", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    frequency = exploded.groupBy("shingle").agg(F.count("*").alias("f"))
    ordered = exploded.join(frequency, "shingle").groupBy("content", "root", "minor", "n").agg(
        F.sort_array(F.collect_list(F.struct("f", "shingle"))).alias("s")
    )
    # shingles that no other of these nodes has come first and meet nothing: `alone` of them. The others, `rest`, bound the
    # overlap, and so does the place of a common one among them: as many before it, and as many behind it, as both have.
    alone = F.size(F.filter("s", lambda t: t["f"] == 1))
    ordered = ordered.withColumn("alone", alone).withColumn("rest", F.col("n") - F.col("alone"))
    ordered = ordered.withColumn("take", F.col("n") - F.ceil(F.lit(SIMILARITY) * F.col("n")).cast("int") + 1 - F.col("alone"))
    able = ordered.select("content", "root", "minor", "n", "rest", F.slice("s", F.col("alone") + 1, F.greatest("take", F.lit(0))).alias("s"))
    tokens = saved(able.select("content", "root", "minor", "n", "rest", F.posexplode("s").alias("i", "t")).withColumn("shingle", F.col("t.shingle")).drop("t"), "near-prefixes")
    tokens = tokens.join(sets.select("content", *MARK_NAMES), "content")
    minor = tokens.where("minor").select(*[F.col(m).alias(f"a_{m}") for m in MARK_NAMES], F.col("content").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("rest").alias("ma"), F.col("i").alias("ia"), "shingle")
    other = tokens.select(*MARK_NAMES, F.col("content").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("rest").alias("mb"), F.col("i").alias("ib"), "shingle")
    most = F.least("ia", "ib") + F.least(F.col("ma") - F.col("ia"), F.col("mb") - F.col("ib"))
    needed = (F.col("na") + F.col("nb")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6
    apart = sum((F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(m))) for m in MARK_NAMES[1:]), F.bit_count(F.col(f"a_{MARK_NAMES[0]}").bitwiseXOR(F.col(MARK_NAMES[0]))))
    enough = (most >= needed) & ((F.col("na") + F.col("nb") - apart) / 2 >= needed)
    met = minor.join(other, (minor.shingle == other.shingle) & (F.col("ra") != F.col("rb")) & enough)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, links): for each row of docs doc_id, key (md5 of its text), content, root and class_id; the verified links
    (a, b, similarity) between contents, of which there are enough to join each class, not all pairs."""
    keyed = docs.select("doc_id", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = saved(keyed.mapInArrow(_sketch, "doc_id long, key string, content string, bands array<long>"), "near-rows")
    nodes = saved(
        rows.groupBy("content").agg(F.min(F.struct("doc_id", "key")).alias("own"), F.min("doc_id").alias("least"), F.max("bands").alias("bands")), "near-nodes"
    )
    banded = nodes.select("content", F.posexplode("bands").alias("band", "value"))
    sizes = banded.groupBy("band", "value").agg(F.count("*").alias("size")).where("size > 1")
    buckets = saved(banded.join(sizes, ["band", "value"]), "near-buckets")
    small, large = buckets.where(F.col("size") <= SMALL), buckets.where(F.col("size") > SMALL)
    first = Window.partitionBy("band", "value").orderBy(F.xxhash64("band", "content"), "content")
    leaders = large.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= LEADERS)
    x, y = small.select("band", "value", F.col("content").alias("a")), small.select("band", "value", F.col("content").alias("b"))
    pairs = x.join(y, ["band", "value"]).where("a < b").select("a", "b")
    led = large.select("band", "value", "content").join(leaders.select("band", "value", F.col("content").alias("leader")), ["band", "value"])
    led = led.where("content <> leader").select(F.least("content", "leader").alias("a"), F.greatest("content", "leader").alias("b"))
    pairs = saved(pairs.unionByName(led).distinct(), "near-pairs")

    wanted = pairs.select(F.col("a").alias("content")).union(pairs.select("b")).distinct()
    own = nodes.join(wanted, "content", "left_semi").select("content", F.col("own.doc_id").alias("own_id"), F.col("own.key").alias("key"))
    texts = keyed.join(own.hint("shuffle_hash"), (keyed.key == own.key) & keyed.doc_id.eqNullSafe(own.own_id)).select("content", "text")
    sets = saved(texts.mapInArrow(_shingles, "content string, shingles array<long>, " + ", ".join(f"{m} long" for m in MARK_NAMES)).dropDuplicates(["content"]), "near-sets")

    links = saved(_verified(pairs, sets), "near-links")
    roots = components(links)
    labelled = large.join(roots.withColumnRenamed("node", "content"), "content", "left").withColumn("root", F.coalesce("root", "content"))
    per_bucket = labelled.groupBy("band", "value", "root").agg(F.count("*").alias("n"))
    mixed = per_bucket.groupBy("band", "value").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("main")).where("roots > 1")
    apart = labelled.join(mixed, ["band", "value"]).groupBy("content", "root").agg(F.max(F.col("root") != F.col("main.root")).alias("minor"))
    more = saved(_verified(_residual_pairs(sets, saved(apart, "near-apart")), sets), "near-links")
    if more.take(1):
        links = links.unionByName(more).distinct()
        roots = components(links)
    of_node = nodes.select("content", "least").join(roots.withColumnRenamed("node", "content"), "content", "left").withColumn("root", F.coalesce("root", "content"))
    of_root = of_node.groupBy("root").agg(F.min("least").alias("class_id"))
    of_node = of_node.join(of_root, "root").select("content", "class_id", "root")
    return rows.select("doc_id", "key", "content").join(of_node, "content"), links


def op2_near_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id and whether it is the one of its class to keep."""
    rows, _ = classes(docs)
    return rows.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, without all but the first (least doc_id, then text) of each class."""
    rows, _ = classes(docs, text)
    keep = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"))
    keep = keep.select(F.col("first.doc_id").alias("id"), F.col("first.key").alias("key"))
    keyed = whole_rows(docs).withColumn("own_key", F.md5(F.coalesce(F.col(f"row.`{text}`"), F.lit("")).cast("binary"))).withColumn("own_id", F.col("row.doc_id"))
    kept = keyed.join(keep.hint("shuffle_hash"), (F.col("own_key") == F.col("key")) & F.col("own_id").eqNullSafe(F.col("id")), "left_semi")
    return kept.dropDuplicates(["own_id", "own_key"]).select("row.*")
