"""Proxy views over the driver's test tables, shaped like the raw inputs of the
three studied analyses (see FIXTURES.md §2):

* A — raw appointments (all text) from ``events``;
* B — raw encounters (all text) from ``orders`` joined to ``customer``;
* C — sales rows from ``lineitem`` joined to ``orders`` and ``part``;
* S — a deterministic score / label column from ``orders``.

Each view exists twice: as a DataFrame and as DuckDB SQL text used by the
oracle.  The two must stay in step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- proxy A
def raw_appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"[0-9]+", 0).try_cast("int")
    d = F.col("ts").cast("date")
    uid, eid = F.col("user_id"), F.col("event_id")
    return ev.select(
        uid.cast("string").alias("PatientId"),
        eid.cast("string").alias("AppointmentID"),
        F.when(uid % 3 == 0, "M").otherwise("F").alias("Gender"),
        d.cast("string").alias("ScheduledDay"),
        F.date_add(d, k - 5).cast("string").alias("AppointmentDay"),
        (F.floor("value").cast("int") - 1).cast("string").alias("Age"),
        F.concat(F.lit("N"), (uid % 17).cast("string")).alias("Neighbourhood"),
        (uid % 2).cast("string").alias("Scholarship"),
        (eid % 2).cast("string").alias("Hipertension"),
        F.when(uid % 5 == 0, 1).otherwise(0).cast("string").alias("Diabetes"),
        F.when(eid % 7 == 0, 1).otherwise(0).cast("string").alias("Alcoholism"),
        (k % 5).cast("string").alias("Handcap"),
        F.when((k > 5) & (eid % 3 == 0), "1").otherwise("0").alias("SMS_received"),
        F.when(F.col("event_type") == "error", "Yes").otherwise("No").alias("No_show"),
    )


_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER)"
RAW_A_SQL = f"""raw_a AS (
  SELECT CAST(user_id AS VARCHAR) AS PatientId,
         CAST(event_id AS VARCHAR) AS AppointmentID,
         CASE WHEN user_id % 3 = 0 THEN 'M' ELSE 'F' END AS Gender,
         CAST(CAST(ts AS DATE) AS VARCHAR) AS ScheduledDay,
         CAST(CAST(CAST(ts AS DATE) + ({_K} - 5) AS DATE) AS VARCHAR) AS AppointmentDay,
         CAST(CAST(floor(value) AS INTEGER) - 1 AS VARCHAR) AS Age,
         'N' || CAST(user_id % 17 AS VARCHAR) AS Neighbourhood,
         CAST(user_id % 2 AS VARCHAR) AS Scholarship,
         CAST(event_id % 2 AS VARCHAR) AS Hipertension,
         CAST(CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS Diabetes,
         CAST(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS Alcoholism,
         CAST({_K} % 5 AS VARCHAR) AS Handcap,
         CASE WHEN {_K} > 5 AND event_id % 3 = 0 THEN '1' ELSE '0' END AS SMS_received,
         CASE WHEN event_type = 'error' THEN 'Yes' ELSE 'No' END AS No_show
  FROM events)"""


# ---------------------------------------------------------------- proxy B
def raw_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    u = F.floor(F.col("o_totalprice") / 100000).cast("int")
    s = lambda e: e.cast("string")
    # customer is the dimension side; the planner (AQE) picks the strategy
    # from its measured size.
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    return j.select(
        s(ok).alias("encounter_id"),
        s(ck).alias("patient_nbr"),
        F.when((ok * 7919) % 1000 < 60 + 30 * u, "<30")
         .when(F.col("o_orderstatus") == "O", ">30").otherwise("NO").alias("readmitted"),
        F.when(F.col("c_mktsegment") == "FURNITURE", "?").otherwise(F.col("c_mktsegment")).alias("race"),
        F.when(ok % 997 == 0, "Unknown/Invalid").when(ck % 2 == 0, "Male").otherwise("Female").alias("gender"),
        F.concat(F.lit("["), s(10 * (F.col("c_nationkey") % 10)), F.lit("-"),
                 s(10 * (F.col("c_nationkey") % 10) + 10), F.lit(")")).alias("age"),
        s(ok % 30 + 1).alias("discharge_disposition_id"),
        s(ok % 8 + 1).alias("admission_type_id"),
        s(u).alias("number_inpatient"),
        s(ok % 4).alias("number_emergency"),
        s(ck % 3).alias("number_outpatient"),
        s(ok % 14 + 1).alias("time_in_hospital"),
        s((ok * 31) % 90).alias("num_lab_procedures"),
        s((ok * 17) % 7).alias("num_procedures"),
        s((ok * 13) % 40 + 1).alias("num_medications"),
        s((ok * 11) % 16 + 1).alias("number_diagnoses"),
        F.when(ok % 6 == 0, ">8").when(ok % 6 == 1, "Norm").otherwise("None").alias("A1Cresult"),
        F.when(ok % 19 == 0, ">200").otherwise("None").alias("max_glu_serum"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Ch").otherwise("No").alias("change"),
        F.when(ck % 4 == 0, "No").otherwise("Yes").alias("diabetesMed"),
        F.when(ok % 5 == 0, "Up").when(ok % 5 == 1, "Down").when(ok % 5 == 2, "Steady")
         .otherwise("No").alias("insulin"),
        F.when(ok % 10 == 0, "?").when(ok % 10 == 1, "V45").when(ok % 10 == 2, "250.83")
         .when(ok % 10 == 3, "E888").otherwise(s(140 + ok % 860)).alias("diag_1"),
    )


_U = "CAST(floor(o_totalprice / 100000) AS INTEGER)"
RAW_B_SQL = f"""raw_b AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS encounter_id,
         CAST(o_custkey AS VARCHAR) AS patient_nbr,
         CASE WHEN (o_orderkey * 7919) % 1000 < 60 + 30 * {_U} THEN '<30'
              WHEN o_orderstatus = 'O' THEN '>30' ELSE 'NO' END AS readmitted,
         CASE WHEN c_mktsegment = 'FURNITURE' THEN '?' ELSE c_mktsegment END AS race,
         CASE WHEN o_orderkey % 997 = 0 THEN 'Unknown/Invalid'
              WHEN o_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
         '[' || CAST(10 * (c_nationkey % 10) AS VARCHAR) || '-'
             || CAST(10 * (c_nationkey % 10) + 10 AS VARCHAR) || ')' AS age,
         CAST(o_orderkey % 30 + 1 AS VARCHAR) AS discharge_disposition_id,
         CAST(o_orderkey % 8 + 1 AS VARCHAR) AS admission_type_id,
         CAST({_U} AS VARCHAR) AS number_inpatient,
         CAST(o_orderkey % 4 AS VARCHAR) AS number_emergency,
         CAST(o_custkey % 3 AS VARCHAR) AS number_outpatient,
         CAST(o_orderkey % 14 + 1 AS VARCHAR) AS time_in_hospital,
         CAST((o_orderkey * 31) % 90 AS VARCHAR) AS num_lab_procedures,
         CAST((o_orderkey * 17) % 7 AS VARCHAR) AS num_procedures,
         CAST((o_orderkey * 13) % 40 + 1 AS VARCHAR) AS num_medications,
         CAST((o_orderkey * 11) % 16 + 1 AS VARCHAR) AS number_diagnoses,
         CASE WHEN o_orderkey % 6 = 0 THEN '>8' WHEN o_orderkey % 6 = 1 THEN 'Norm' ELSE 'None' END AS A1Cresult,
         CASE WHEN o_orderkey % 19 = 0 THEN '>200' ELSE 'None' END AS max_glu_serum,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Ch' ELSE 'No' END AS change,
         CASE WHEN o_custkey % 4 = 0 THEN 'No' ELSE 'Yes' END AS diabetesMed,
         CASE o_orderkey % 5 WHEN 0 THEN 'Up' WHEN 1 THEN 'Down' WHEN 2 THEN 'Steady' ELSE 'No' END AS insulin,
         CASE WHEN o_orderkey % 10 = 0 THEN '?' WHEN o_orderkey % 10 = 1 THEN 'V45'
              WHEN o_orderkey % 10 = 2 THEN '250.83' WHEN o_orderkey % 10 = 3 THEN 'E888'
              ELSE CAST(140 + o_orderkey % 860 AS VARCHAR) END AS diag_1
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


# ---------------------------------------------------------------- proxy C
def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    d = F.col("o_orderdate")
    return j.select(
        F.col("l_orderkey").alias("order_key"),
        F.when(F.col("l_orderkey") % 2 == 0, F.date_format(d, "dd-MM-yyyy"))
         .otherwise(F.date_format(d, "M/d/yyyy")).alias("date"),
        F.col("p_type").alias("item_name"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("transaction_amount"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None).cast("string"))
         .when(F.col("o_orderpriority").isin("2-HIGH", "3-MEDIUM"), "Cash")
         .otherwise("Online").alias("transaction_type"),
        F.when(F.col("l_linenumber") % 5 == 0, "Morning").when(F.col("l_linenumber") % 5 == 1, "Afternoon")
         .when(F.col("l_linenumber") % 5 == 2, "Evening").when(F.col("l_linenumber") % 5 == 3, "Night")
         .otherwise("Midnight").alias("time_of_sale"),
    )


SALES_SQL = """sales_raw AS (
  SELECT l_orderkey AS order_key,
         CASE WHEN l_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d-%m-%Y')
              ELSE strftime(o_orderdate, '%-m/%-d/%Y') END AS date,
         p_type AS item_name,
         CAST(l_quantity AS INTEGER) AS quantity,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS transaction_amount,
         CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN 'Cash'
              WHEN '3-MEDIUM' THEN 'Cash' ELSE 'Online' END AS transaction_type,
         CASE l_linenumber % 5 WHEN 0 THEN 'Morning' WHEN 1 THEN 'Afternoon'
              WHEN 2 THEN 'Evening' WHEN 3 THEN 'Night' ELSE 'Midnight' END AS time_of_sale
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


# ---------------------------------------------------------------- scores
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, score): 500 distinct score values, so ties are exercised."""
    o = read_table(spark, sf_dir, "orders")
    ok = F.col("o_orderkey")
    u = F.floor(F.col("o_totalprice") / 100000).cast("int")
    return o.select(
        ok.alias("id"),
        F.when((ok * 7919) % 1000 < 60 + 30 * u, 1).otherwise(0).cast("int").alias("label"),
        ((u * 100 + (ok * 104729) % 100).cast("double") / 500).alias("score"))


SCORES_SQL = f"""scores AS (
  SELECT o_orderkey AS id,
         CAST(CASE WHEN (o_orderkey * 7919) % 1000 < 60 + 30 * {_U} THEN 1 ELSE 0 END AS INTEGER) AS label,
         CAST({_U} * 100 + (o_orderkey * 104729) % 100 AS DOUBLE) / 500 AS score
  FROM orders)"""
