"""URL filters: rules, and naive Bayes over hosts segmented into words.

The longest rule (host suffix and path prefix) that fits a url decides. For
the others, a host is cut at dots, dashes and digits, and every part is split
into words by a unigram Viterbi: the split whose words have the largest product
of probabilities. Word counts come from the text of all pages (tags removed) and
stay in a table; each different host is joined with the counts of just those of
its substrings that are words, and split once. An unseen word costs ever more
with its length. A multinomial naive Bayes over the hashed words of host and
path, counted over all pages, then decides. As pages carry no labels, their
content and names teach it: a page counts as one to block if its visible text
holds SEEDS at least TOLD times, or one of them is a word of its host or path;
what else such hosts and paths are made of then tells on other urls.

Defined cases: a null url, or one without `://`, has empty host and path, no
rule, and no words, so the more frequent class decides (allow, if none is);
rows that repeat are each judged; of rules of equal length that fit, the
alphabetically first wins. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import saved
from .columns import bounded

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The rules of the contract.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}

# Words that mark a page to learn from as one to block.
SEEDS = {
    "ads", "adserver", "adult", "bets", "betting", "bingo", "casino", "escort", "jackpot", "lottery", "malware", "nude", "phishing", "pills",
    "poker", "porn", "sex", "slots", "spam", "track", "tracker", "tracking", "viagra", "warez", "xxx",
}
TOLD = 3

BUCKETS = 1 << 16
#: Letters that a part of a host name may have; longer runs of letters are split at least there.
LONGEST = 63
#: A broadcast side is counted first and holds at most so many rows.
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, whole, 1), UPPER, LOWER), F.regexp_extract(url, whole, 2)


def rule_for(host: str, path: str, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r), r), reverse=True):
        name, _, rest = rule.partition("/")
        fits = ((F.col(host) == name) | F.col(host).endswith("." + name)) & F.col(path).startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


class Segmenter:
    """Unigram Viterbi over letters."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = total or sum(counts.values()) or 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.unseen = [math.log(total * 10.0) + k * math.log(10.0) for k in range(LONGEST + 1)]

    def split(self, name: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(name) + 1):
            options = []
            for start in range(max(0, end - LONGEST), end):
                word = name[start:end]
                options.append((best[start][0] + self.cost.get(word, self.unseen[len(word)]), start))
            best.append(min(options))
        out, end = [], len(name)
        while end:
            out.append(name[best[end][1] : end])
            end = best[end][1]
        return out[::-1]

    def host(self, host: str) -> list[str]:
        return [w for part in _parts(host) for w in self.split(part)]


def _parts(host: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", host)


def _words(host_words: list[str], path: str) -> list[str]:
    return [*host_words, *("/" + (w if not w.isdigit() else "0") for w in re.findall(r"[^\W\d_]+|\d+", path.lower()))]


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def visible(html: str = "html") -> Column:
    """The lower-cased text of a page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(F.lower(F.coalesce(html, F.lit(""))), r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>", " ")
    return F.regexp_replace(bare, r"<[^>]*>", " ")


def told(html: str = "html") -> Column:
    """Whether the visible text holds the seeds often enough."""
    return F.regexp_count(visible(html), F.lit(r"(?<!\p{L})(?:" + "|".join(sorted(SEEDS)) + r")(?!\p{L})")) >= TOLD


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n): the words of all pages. Seeds that they lack count once."""
    words = pages.select(F.explode(F.regexp_extract_all(visible(), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    seeds = pages.sparkSession.createDataFrame([(w,) for w in sorted(SEEDS)], "word string").withColumn("n", F.lit(0).cast("long"))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).unionByName(seeds)
    return saved(counted.groupBy("word").agg(F.greatest(F.sum("n"), F.lit(1).cast("long")).alias("n")), "url-words")


def _substrings(batches):
    for batch in batches:
        hosts, words = [], []
        for host in batch.column(0).to_pylist():
            own = {p[i:j] for p in _parts(host) for i in range(len(p)) for j in range(i + 1, min(len(p), i + LONGEST) + 1)}
            hosts += [host] * len(own)
            words += own
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(words, pa.string())], names=["host", "word"])


def _split(total: int):
    def split(batches):
        for batch in batches:
            words = [Segmenter({o["word"]: o["n"] for o in own or ()}, total).host(host) for host, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["host", "words"])

    return split


def host_words(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words): each different host once, split with the counts of all words."""
    total = counts.agg(F.sum("n")).first()[0]
    hosts = saved(urls.select("host").distinct(), "url-hosts")
    own = hosts.mapInArrow(_substrings, "host string, word string").join(counts, "word")
    own = own.groupBy("host").agg(F.collect_list(F.struct("word", "n")).alias("own"))
    return saved(hosts.join(own, "host", "left").select("host", "own").mapInArrow(_split(total), "host string, words array<string>"), "url-splits")


def _class_counts(batches):
    seen: Counter = Counter()
    for batch in batches:
        for host, path, by_text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            words = _words(host, path)
            label = int(by_text or any(w.lstrip("/") in SEEDS for w in words))
            seen[(label, -1)] += 1
            seen.update((label, _bucket(w)) for w in words)
    keys = list(seen)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], names=["label", "bucket", "n"])


def op6_url_filter(pages: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict and score (log odds of block)."""
    rules = rules if rules is not None else RULES
    spark = pages.sparkSession
    host, path = host_and_path("url")
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), told().alias("told"))
    urls = urls.join(bounded(host_words(urls, word_counts(pages)), BROADCAST_ROWS), "host")
    rows = urls.select("words", "path", "told").mapInArrow(_class_counts, "label int, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).collect()
    counts, pages_of = np.zeros((2, BUCKETS)), [0, 0]
    for r in rows:  # at most two rows a bucket
        if r["bucket"] < 0:
            pages_of[r["label"]] = r["n"]
        else:
            counts[r["label"], r["bucket"]] = r["n"]
    seen = counts.sum(axis=0) > 0  # a word that no page has weighs nothing
    odds = np.zeros(BUCKETS)
    if min(pages_of):
        smooth = counts[:, seen] + 0.1
        odds[seen] = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    prior = math.log((pages_of[1] + 0.5) / (pages_of[0] + 0.5))
    model = spark.sparkContext.broadcast((odds, prior))

    def judge(batches):
        weights, start = model.value
        for batch in batches:
            scores = [start + sum(weights[_bucket(w)] for w in _words(h, p)) for h, p in zip(batch.column(4).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(scores, pa.float64())], names=[*batch.schema.names[:4], "score"])

    judged = urls.select("page_id", "host", "path", rule_for("host", "path", rules).alias("rule"), "words").mapInArrow(judge, "page_id long, host string, path string, rule string, score double")
    ruled = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        ruled = F.when(F.col("rule") == rule, verdict).otherwise(ruled)
    own = F.when(F.col("score") > 0, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce(ruled, own).alias("verdict"), "score")
