"""Registered queries of the training-data operators, one per operator, over the whole supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spooltrace.llm.bpe import bpe_query
from spooltrace.llm.common import table
from spooltrace.llm.embdedup import EMBEDDINGS_SQL, embedding_query
from spooltrace.llm.langid import language_query
from spooltrace.llm.licenses import license_query, licenses_sql
from spooltrace.llm.merkle import MERKLE_SQL, manifest_query
from spooltrace.llm.packing import packing_query
from spooltrace.llm.quality import quality_verdicts
from spooltrace.llm.repeats import repeats_query
from spooltrace.llm.secrets import SECRETS_SQL, secrets_query
from spooltrace.llm.sharding import sharding_query
from spooltrace.llm.simhash import simhash_query
from spooltrace.llm.toxicity import toxicity_query
from spooltrace.llm.whitening import whitening_query

Query = Callable[[SparkSession, str], DataFrame]


def _over_documents(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_bpe_round_trip": _over_documents(bpe_query),
        "op2_embedding_dedup": lambda spark, sf_dir: embedding_query(table(spark, sf_dir, "embeddings")),
        "op3_secret_scan": _over_documents(secrets_query),
        "op4_language_id": _over_documents(language_query),
        "op5_license_scan": _over_documents(license_query),
        "op6_stratified_sharding": _over_documents(sharding_query),
        "op7_suffix_dedup": _over_documents(repeats_query),
        "op8_simhash": _over_documents(simhash_query),
        "op9_best_fit_packing": _over_documents(packing_query),
        "op10_quality_rules": lambda spark, sf_dir: quality_verdicts(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op11_merkle_manifest": _over_documents(manifest_query),
        "op12_toxicity": lambda spark, sf_dir: toxicity_query(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op13_embedding_whitening": lambda spark, sf_dir: whitening_query(table(spark, sf_dir, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_dedup": EMBEDDINGS_SQL, "op3_secret_scan": SECRETS_SQL, "op5_license_scan": licenses_sql(),
            "op11_merkle_manifest": MERKLE_SQL}
