"""The pipeline's stages on the smallest tables, on edge rows and on columns of any names."""

from collections import Counter

import pytest
from conftest import SMALL

import corpus_pipeline
from lorekeep.llm import mixing
from lorekeep.llm import text as T
from lorekeep.session import saved, table


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "mix", "shard"]
    docs = table(spark, SMALL, "documents")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, SMALL), f"test-{name}")
        assert docs.columns == columns, name
        seen.append(docs.count())
        if name == "near_dedup":
            words = [tuple(T.words_of(r.text)) for r in docs.collect()]
            assert len(words) == len(set(words))
        if name == "decontaminate":
            items = [b" " + b" ".join(T.words_of(r.text)) + b" " for r in table(spark, SMALL, "benchmark").collect()]
            assert not any(x in b" " + b" ".join(T.words_of(r.text)) + b" " for r in docs.collect() for x in items)
    assert seen[0] > seen[1] > seen[2] > seen[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    counts = [sum(r.shard == k for r in last) for k in range(40)]
    assert len(last) == seen[4] and max(counts) - min(counts) <= 1
    assert sorted((r.doc_id, r.text or "") for r in last) == sorted((r.doc_id, r.text or "") for r in docs.collect())
    assert all(sorted(r.slot for r in last if r.shard == k) == list(range(counts[k])) for k in range(40))
    assert seen[4] <= 1.5 * seen[3] and max(Counter(r.doc_id for r in last).values()) <= mixing.MOST
    assert corpus_pipeline.run(spark, SMALL).count() == len(last)


LONG = "the heron walks by the mill " * 4000
ODD = [(1, "A plain text about herons and mills by the river, five words and more.", "en", "s"), (1, "A plain text about herons and mills by the river, five words and more.", "en", "s"),
    (2, None, None, None), (3, "", "fr", None), (None, "no id but words enough for a shingle", "en", "x"), (None, "no id but words enough for a shingle", "en", "x"), (5, LONG, "en", "y"), (6, "???", "de", "y")]
NAMES = "g key row own_id own_key words wh p tokens times label rid copy row_key place shard slot size score rank n terms texts".split()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    for c in NAMES:
        docs = docs.withColumn(c, docs.doc_id.cast("string"))
    for rows in (docs, docs.limit(0)):
        out = stage(spark, rows, SMALL)
        added = ["size", "text_crc32", "shard", "slot"] if name == "shard" else []
        assert out.columns == [f"{c}_before" if c in added else c for c in rows.columns] + added
        got = out.collect()
        kept = [f"{c}_before" if c in added else c for c in NAMES]
        assert all(r[c] == (None if r.doc_id is None else str(r.doc_id)) for r in got for c in kept)
        given = Counter((r.doc_id, r.text) for r in rows.collect())
        here = Counter((r.doc_id, r.text) for r in got)
        if name == "shard":
            assert here == given
        elif name == "near_dedup" and given:
            assert sorted((r.doc_id, r.text) for r in got if r.doc_id is not None) == [(1, ODD[0][1]), (2, None), (5, LONG), (6, "???")] and len(got) == 5
        elif name == "decontaminate":
            assert here == given
        else:
            assert set(here) <= set(given)
