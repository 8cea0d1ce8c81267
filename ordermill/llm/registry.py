"""The training-data queries by name, and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, html, language, licenses, mixing, ngram_join, packing, quality, topk, toxicity
from .common import prepare


Query = Callable[[SparkSession, str], DataFrame]


def _shipped(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    found = {
        "op1_html_extraction": html.op1_html_extraction,
        "op2_fingerprints": fingerprints.op2_fingerprints,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_license_scan": licenses.op4_license_scan,
        "op5_exact_topk": topk.op5_exact_topk,
        "op6_quality": quality.op6_quality,
        "op7_language_id": language.op7_language_id,
        "op8_mixing": mixing.op8_mixing,
        "op9_ngram_jaccard_join": ngram_join.op9_ngram_jaccard_join,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
    }
    return {name: _shipped(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_topk": topk.OP5_SQL, "op8_mixing": mixing.OP8_SQL}
