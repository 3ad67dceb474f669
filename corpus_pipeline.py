"""A training corpus from ``documents``: five stages, each on all that the one before kept.

toxicity (documents that it rejects go), line dedup (later copies of repeated
runs of lines go, and documents of which nothing is left), near duplicates (one
document of each group stays), personal data (replaced), packing (pieces of
sequences).  Each stage's result is a stored table, so a lost executor costs no
earlier stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.llm import line_dedup, ngram_join, packing, pii, toxicity
from cohortlens.llm.common import small_batches, stored, table
from cohortlens.llm.queries import TOKENIZER


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` after a change of texts, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    score = toxicity.scorer(*toxicity.learn(docs, table(spark, sf_dir, "labels")))
    names = docs.columns
    scored = docs.withColumn("\0score", score(F.col("text").cast("string")))
    return scored.where(F.col("\0score") < toxicity.THRESHOLD).select(*[F.col(f"`{c}`") for c in names])


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return _counted(line_dedup.dedup_lines(docs, drop_empty=True))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.one_of_each(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return _counted(pii.replace_pii(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pieces_digest(packing.pack(docs, public_tokenizers.path(TOKENIZER)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", delete_repeated_lines),
    ("near_duplicates", keep_one_of_each),
    ("pii", replace_personal_data),
    ("packing", pack),
]

#: Learned scores, keyed hashes and token ids have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
