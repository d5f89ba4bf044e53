"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbar.llm import (
    curves,
    exact_dedup,
    filter_audit,
    html_diff,
    licenses,
    lm_scoring,
    mixing,
    packing,
    quality_rules,
    sharding,
    simhash,
    spelling,
    toxicity,
)
from lumenbar.sources.testdata import table


def op1_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), added_tokens=True)


def op2_recurrent_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.language_scores(table(spark, folder, "documents"))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_scores(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )


def op4_capped_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op5_page_differencing(spark: SparkSession, folder: str) -> DataFrame:
    return html_diff.main_text(table(spark, folder, "pages"))


def op6_histogram_sharding(spark: SparkSession, folder: str) -> DataFrame:
    found = sharding.histogram_shards(table(spark, folder, "documents"))
    return found.withColumns(
        {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}
    )


def op7_anchor_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicate_groups(table(spark, folder, "documents"))


def op8_counterfactual_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, folder, "documents"))


def op10_hilbert_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return curves.nearest(rows, rows.where("vec_id % 20 = 0"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.filter_audit(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )


def op12_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(table(spark, folder, "documents"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_forms(table(spark, folder, "documents"))


QUERIES = {
    "op1_harmonic_packing": op1_harmonic_packing,
    "op2_recurrent_scoring": op2_recurrent_scoring,
    "op3_quality_rules": op3_quality_rules,
    "op4_capped_mixing": op4_capped_mixing,
    "op5_page_differencing": op5_page_differencing,
    "op6_histogram_sharding": op6_histogram_sharding,
    "op7_anchor_simhash": op7_anchor_simhash,
    "op8_counterfactual_toxicity": op8_counterfactual_toxicity,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_hilbert_neighbours": op10_hilbert_neighbours,
    "op11_filter_audit": op11_filter_audit,
    "op12_license_scan": op12_license_scan,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE = {
    "op4_capped_mixing": mixing.oracle(),
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op11_filter_audit": filter_audit.oracle(),
    "op12_license_scan": licenses.oracle(),
}
