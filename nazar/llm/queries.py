"""Registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from nazar.llm import align, ann, decontam, divergence, idfiles, langid, license, mix, neardup, pii, quality, secrets, toxicity

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_mix_sources": mix.op1,
    "op2_nearest_neighbours": ann.op2,
    "op3_personal_data": pii.op3,
    "op4_secret_scan": secrets.op4,
    "op5_ngram_jaccard_join": neardup.op5,
    "op6_toxicity": toxicity.op6,
    "op7_quality": quality.op7,
    "op8_license_scan": license.op8,
    "op9_decontaminate": decontam.op9,
    "op10_language_id": langid.op10,
    "op11_source_divergence": divergence.op11,
    "op12_cross_tokenizer": align.op12,
    "op13_token_files": idfiles.op13,
    "pipeline": corpus_pipeline.run,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op11_source_divergence": divergence.SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
