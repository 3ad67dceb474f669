"""Files in and out: text staging by header with quoted line breaks, typed reading
with rejects, stacked lookup sections, materialised stages.  The files are written
from the given tables into the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import cohort, lookup
from cohortlens.session import shared_path
from cohortlens.sources import export, staging
from cohortlens.sources.proxies import read_table

#: Stand-in for dirty files: orders of these customers have a price that is no number, or a field too many.
BAD_PRICE, EXTRA_FIELD = 17, 23


def _folder(spark: SparkSession, name: str) -> str:
    return shared_path(spark, f"{name}_{uuid.uuid4().hex}")


def q_stage_by_header(spark, sf_dir):
    """Texts with quotes, commas and line breaks, exported as CSV and staged back by
    their header: every value as it was."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text")
    path = _folder(spark, "texts_csv")
    export.write_csv(docs, path)
    back = staging.stage_csv_by_header(spark, path)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source",
                       F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


def _dirty_orders(spark: SparkSession, sf_dir: str) -> str:
    """A CSV folder of orders in which some records don't fit (key bigint, price double, status string)."""
    o = read_table(spark, sf_dir, "orders")
    price = F.when(F.col("o_custkey") % BAD_PRICE == 0, "unknown").otherwise(F.col("o_totalprice").cast("double").cast("string"))
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), price, "o_orderstatus")
    line = F.concat(line, F.when(F.col("o_custkey") % EXTRA_FIELD == 0, ",extra").otherwise(""))
    path = _folder(spark, "dirty_orders")
    # The text writer has no header; the reader is told the schema.
    o.select(line.alias("value")).write.text(path)
    return path


def q_typed_rejects(spark, sf_dir):
    """Typed reading of a dirty file: per status, records that fit with the sum of
    their prices, and the number of rejects (status NULL)."""
    schema = "key bigint, price double, status string"
    good, bad = staging.typed_with_rejects(spark, _dirty_orders(spark, sf_dir), schema, _folder(spark, "rejects"), header=False)
    sums = good.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total_price"))
    return sums.unionByName(bad.groupBy().agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(None).cast("string").alias("status"), "n", F.lit(None).cast("double").alias("total_price")))


def q_stacked_sections(spark, sf_dir):
    """Two lookup tables stacked in one file, split again by their header lines."""
    parts = []
    for i, (name, key, text) in enumerate((("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"))):
        rows = read_table(spark, sf_dir, name).select(F.lit(i).alias("s"), F.lit(1).alias("part"), F.col(key).cast("bigint").alias("k"),
                                                      F.concat(F.col(key).cast("string"), F.lit(',"'), F.col(text), F.lit('"')).alias("value"))
        edge = spark.createDataFrame([(i, 0, 0, f"{name}_id,description"), (i, 2, 0, ",")], "s int, part int, k bigint, value string")
        parts += [edge, rows]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    path = _folder(spark, "stacked")
    lines.repartition(1).sortWithinPartitions("s", "part", "k").select("value").write.text(path)  # one small lookup file
    read = staging.read_csv_lines_in_order(spark, path, "id string, description string")
    return lookup.split_stacked_sections(read).select("section", F.col("id").cast("bigint").alias("id"), "description")


def q_materialized(spark, sf_dir):
    """The cleaned appointments as a stage, written once; two consumers read it: the
    rate by gender and, beside each, that of all rows."""
    from cohortlens.plans.noshow import clean_appointments
    from cohortlens.sources.proxies import raw_appointments
    name = f"appointments_{uuid.uuid4().hex}"
    staging.materialize_stage(clean_appointments(raw_appointments(spark, sf_dir)), name)
    stage = staging.read_stage(spark, name)
    by = cohort.rate(stage, ["gender"], "no_show").select("gender", "appointments", F.col("rate_pct").alias("no_show_rate_pct"))
    every = cohort.rate(stage, [], "no_show").select(F.col("rate_pct").alias("overall_rate_pct"))
    return by.crossJoin(F.broadcast(every))  # one row


QUERIES = {name: fn for name, fn in globals().items() if name.startswith("q_")}


def _oracle() -> dict[str, str]:
    from cohortlens.plans import noshow
    overall, gender = noshow.ORACLE["q_overall_rate"], noshow.ORACLE["q_rate_by_gender"]
    return {
        "q_stage_by_header": "SELECT doc_id, source, length(text) AS n_chars, md5(text) AS text_md5 FROM documents",
        "q_typed_rejects": f"""WITH o AS (SELECT *, o_custkey % {BAD_PRICE} = 0 OR o_custkey % {EXTRA_FIELD} = 0 AS bad FROM orders)
SELECT o_orderstatus AS status, COUNT(*) AS n, ROUND(SUM(o_totalprice::DOUBLE), 2) AS total_price FROM o WHERE NOT bad GROUP BY 1
UNION ALL SELECT NULL, COUNT(*), NULL FROM o WHERE bad""",
        "q_stacked_sections": """SELECT 'nation_id' AS section, n_nationkey::BIGINT AS id, n_name AS description FROM nation
UNION ALL SELECT 'region_id', r_regionkey::BIGINT, r_name FROM region""",
        "q_materialized": f"""SELECT g.gender, g.appointments, g.no_show_rate_pct, o.no_show_rate_pct AS overall_rate_pct
FROM ({gender}) g, ({overall}) o""",
    }


ORACLE = _oracle()
