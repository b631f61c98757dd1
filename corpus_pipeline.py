"""Corpus preparation: language, near-duplicates, repeated passages, secrets, packing.

Each stage works on all rows its predecessor kept and returns the columns of
``documents``; the last returns packed pieces. ``run`` writes every stage's rows
as Parquet in the session's shared folder and reads them back for the next.

Defined results: texts that are null or hold no letter, or that two languages
explain equally well, leave in the first stage, and ``lang`` is the language
found in the others; of each near-duplicate group the row with the smallest id stays (among
equal ids the first row key, null ids last); repeated passages and secrets are
cut out of the texts, whose rows stay; ``n_chars`` follows the text; an empty
table gives an empty result; columns beyond those of ``documents`` pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spooltrace.llm import langid, packing, repeats, secrets, simhash
from spooltrace.llm.common import materialize, table

# a passage of over 50 words has 260 bytes and more: strings of this length cover all of it
REPEAT_BYTES = 256

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _recount(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(kind))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, with that language in ``lang`` (learned from the rows not held out)."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: 4-word shingles, at most 4 differing bits."""
    return simhash.keep_one_per_group(docs, shingle=4, max_bits=4)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of ``REPEAT_BYTES`` bytes that occur more than once."""
    return _recount(repeats.remove_repeats(docs, length=REPEAT_BYTES))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with found secrets replaced by a mark."""
    return _recount(secrets.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids placed in sequences of at most 1024."""
    return packing.packing_query(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

# classifying, fingerprinting and tokenising are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
