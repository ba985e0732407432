"""The registered queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from ..session import table
from . import chat, decontam, fingerprints, languages, licenses, mixing, near_dup, negatives, quality, ranking, sharding, toxicity, urls


def op1_license_scan(spark, sf_dir):
    return licenses.op1_license_scan(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark, sf_dir):
    return near_dup.op2_near_dedup(table(spark, sf_dir, "documents"))


def op3_mixing(spark, sf_dir):
    return mixing.op3_mixing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language(spark, sf_dir):
    return languages.op4_language(table(spark, sf_dir, "documents"))


def op5_chat(spark, sf_dir):
    return chat.op5_chat(table(spark, sf_dir, "conversations"))


def op6_url_filter(spark, sf_dir):
    return urls.op6_url_filter(table(spark, sf_dir, "pages"))


def op7_fingerprints(spark, sf_dir):
    return fingerprints.op7_fingerprints(table(spark, sf_dir, "documents"))


def op8_decontamination(spark, sf_dir):
    return decontam.op8_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sharding(spark, sf_dir):
    return sharding.op9_sharding(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.op10_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_ranked_search(spark, sf_dir):
    return ranking.op11_ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_quality_rules(spark, sf_dir):
    return quality.op12_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark, sf_dir):
    return negatives.op13_hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_near_dedup, op3_mixing, op4_language, op5_chat, op6_url_filter, op7_fingerprints, op8_decontamination, op9_sharding, op10_toxicity, op11_ranked_search, op12_quality_rules, op13_hard_negatives)}
ORACLE_SQL: dict[str, str] = {"op1_license_scan": licenses.oracle(), "op5_chat": chat.ORACLE, "op8_decontamination": decontam.ORACLE, "op11_ranked_search": ranking.ORACLE, "op12_quality_rules": quality.oracle(), "op13_hard_negatives": negatives.ORACLE}
