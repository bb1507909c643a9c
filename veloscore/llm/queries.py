"""The registered queries of the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import class_lm, cover_tree, decontaminate, filter_audit, hard_negatives, html_extract, language_id, line_dedup, mixing, ngram_join, pii, substring_dedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_of(_table(spark, sf_dir, "pages"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.curriculum(_table(spark, sf_dir, "documents"))


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_texts(_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(_table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_warc_derivatives, op3_ngram_join, op4_cover_tree, op5_substring_dedup, op6_html_extract, op7_mixing, op8_class_lm, op9_decontaminate, op10_language_id, op11_pii, op12_hard_negatives, op13_filter_audit)
}

#: Operators 2, 6, 8 and 10 parse markup or fit models; they are tested against brute force, round
#: trips and held-out rows instead.
ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op3_ngram_join": ngram_join.ORACLE,
    "op4_cover_tree": cover_tree.ORACLE,
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op11_pii": pii.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
