"""Queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, cross_polytope, html_extract, licenses, line_crf, minhash_join, packing, pii, quality_rules, substring_dedup


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extract": html_extract.op1_html_extract,
        "op2_line_crf": line_crf.op2_line_crf,
        "op3_bpe": bpe.op3_bpe,
        "op4_pii": pii.op4_pii,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_cross_polytope": cross_polytope.op6_cross_polytope,
        "op7_substring_dedup": substring_dedup.op7_substring_dedup,
        "op8_jaccard_join": minhash_join.op8_jaccard_join,
        "op9_packing": packing.op9_packing,
        "op10_licenses": licenses.op10_licenses,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_pii": pii.SQL,
        "op5_quality_rules": quality_rules.SQL,
        "op6_cross_polytope": cross_polytope.SQL,
        "op7_substring_dedup": substring_dedup.SQL,
        "op8_jaccard_join": minhash_join.SQL,
        "op10_licenses": licenses.SQL,
    }
