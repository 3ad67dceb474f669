"""Registered queries of the llm operators and the SQL that some of them have."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, hard_negatives, licenses, line_dedup, ngram_join, packing, permutation_index, pii, prefix_trie, pu_quality, quality as rules, secrets, toxicity
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secrets(table(spark, sf_dir, "documents")))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces_digest(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "covered_words", "base_failed", "kept")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)
    return found.drop("n_scored")


def op12_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turns_of(table(spark, sf_dir, "conversations"))))


# Words by the same rule; a word in a span of a repeat of m words or more is a
# word in some m-word window that occurs again, and a repeat longer than L words
# exists if some window of L + 1 words occurs again.
_Q10 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT k, m, i, list_slice(ws, i, i + m - 1) AS gram
      FROM w, (VALUES (3), ({rules.MIN_REPEAT}), ({rules.MAX_REPEAT + 1})) AS sizes(m), unnest(range(1, len(ws) - m + 2)) AS u(i)),
r AS (SELECT k, m, i FROM (SELECT k, m, i, count(*) OVER (PARTITION BY k, m, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT k, m, count(DISTINCT i + j) AS n FROM r, unnest(range(0, m)) AS u(j) WHERE m <= {rules.MIN_REPEAT} GROUP BY k, m),
s AS (SELECT w.*, len(ws) AS n_words, coalesce(c3.n, 0) AS n_repeat_words, coalesce(cl.n, 0) AS covered_words,
             w.k IN (SELECT k FROM r WHERE m = {rules.MAX_REPEAT + 1}) AS too_long
      FROM w LEFT JOIN c AS c3 ON c3.k = w.k AND c3.m = 3 LEFT JOIN c AS cl ON cl.k = w.k AND cl.m = {rules.MIN_REPEAT})
SELECT doc_id, n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
       length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
       len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_repeat_words, covered_words,
       n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words)
         AND covered_words <= {rules.MAX_COVERED} * n_words AND NOT too_long AS kept
FROM s
"""

QUERIES = {"op1_permutation_index": op1_permutation_index, "op2_secrets": op2_secrets, "op3_licenses": op3_licenses, "op4_toxicity": op4_toxicity, "op5_line_dedup": op5_line_dedup, "op6_ngram_join": op6_ngram_join, "op7_pii": op7_pii, "op8_bpe": op8_bpe, "op9_packing": op9_packing, "op10_quality": op10_quality,
           "op11_hard_negatives": op11_hard_negatives, "op12_pu_quality": op12_pu_quality, "op13_prefix_trie": op13_prefix_trie}
ORACLE = {"op2_secrets": secrets.oracle_sql(), "op3_licenses": licenses.oracle_sql(), "op10_quality": _Q10, "op11_hard_negatives": hard_negatives.ORACLE_SQL,
          "op13_prefix_trie": prefix_trie.ORACLE_SQL}
