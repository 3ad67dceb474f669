"""The registered llm queries against their SQL, and the pipeline."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from cohortlens.llm import ngram_join, pii, queries
from tests.oracle_harness import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, sf_dir, name):
    res = compare(spark, name, queries.QUERIES[name], queries.ORACLE[name], sf_dir)
    assert res["cols_match"] and res["spark_rows"] == res["oracle_rows"] and res.get("match", res.get("values_match", True)), res


def test_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = (before, docs)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    before, after = kept["toxicity"]
    assert before.join(labels.where("toxic = 0"), "doc_id").join(after, "doc_id", "left_anti").count() == 0
    assert after.join(labels.where("toxic = 1"), "doc_id").count() <= 0.05 * labels.where("toxic = 1").count()
    before, after = kept["near_duplicates"]
    assert after.count() == ngram_join.near_duplicates(before).where("class_id IS NOT NULL").select("class_id").distinct().count()
    _, after = kept["pii"]
    real = pii.mentions(kept["pii"][0]).select("kind", "norm").distinct()
    assert pii.mentions(after).join(real, ["kind", "norm"]).count() == 0
    before, after = kept["packing"]
    assert after.select("doc_id").distinct().count() == before.count()
    assert corpus_pipeline.run(spark, sf_dir).count() == after.count()


def test_pipeline_of_odd_rows(spark, sf_dir):
    rows = [(1, None, "en", "s", 0, "x"), (None, "", None, None, None, "y"), (2, "you idiot", "en", "s", 9, None), (2, "you idiot", "en", "s", 9, None), (3, "a b c d e f", "en", None, 11, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string")
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, some, sf_dir).count() <= 5
