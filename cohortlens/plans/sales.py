"""Sales study: clean (mixed dates, missing payment label, calendar keys) ->
headline -> revenue by item / time slot / weekday / month -> payment split ->
trend, over proxy C."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.functions import label_missing, month_key, parse_mixed_date, weekday_name
from cohortlens.operators import cohort, lookup, profiling
from cohortlens.sources.export import dates_as_text
from cohortlens.sources.proxies import SALES_SQL, sales

# Display order of the time-of-day slots and of the weekdays.
SLOT_ORDER = ["Morning", "Afternoon", "Evening", "Night", "Midnight"]
WEEKDAY_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
UNKNOWN = "Unknown"
TOP_K = 3


def clean_sales(raw: DataFrame) -> DataFrame:
    d = parse_mixed_date("date")
    return raw.select(
        "order_key", d.alias("date"), "item_name", "quantity", "transaction_amount",
        label_missing("transaction_type", UNKNOWN).alias("transaction_type"), "time_of_sale",
        month_key(d).alias("month"), weekday_name(d).alias("day_of_week"),
        F.year(d).alias("year"))


def sales_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_sales(sales(spark, sf_dir))


def _revenue(df, by):
    return cohort.total_by(df, by, "transaction_amount", "revenue").withColumn(
        "revenue", F.col("revenue").cast("double"))


def q_sales_clean(spark, sf_dir):
    """The cleaned row-level sales table (the CSV extract): parsed date as
    ISO text, payment label, month, weekday and year."""
    return dates_as_text(sales_clean(spark, sf_dir)).withColumn(
        "transaction_amount", F.col("transaction_amount").cast("double"))


def q_mixed_dates(spark, sf_dir):
    s = sales_clean(spark, sf_dir)
    return dates_as_text(s.agg(F.count_if(F.col("date").isNotNull()).alias("parsed_rows"),
                               F.count_if(F.col("date").isNull()).alias("failed_rows"),
                               F.min("date").alias("first_date"), F.max("date").alias("last_date")))


def q_payment_counts(spark, sf_dir):
    return sales_clean(spark, sf_dir).groupBy("transaction_type").agg(
        F.count(F.lit(1)).alias("n"))


def q_calendar_keys(spark, sf_dir):
    s = sales_clean(spark, sf_dir).where(F.col("month").isNotNull())
    return s.groupBy("month", "year").agg(F.count(F.lit(1)).alias("orders"))


def q_headline(spark, sf_dir):
    s = sales_clean(spark, sf_dir)
    h = s.agg(F.sum("transaction_amount").cast("double").alias("total_revenue"),
              F.count(F.lit(1)).alias("total_orders"),
              F.sum("quantity").cast("bigint").alias("items_sold"))
    return h.withColumn("avg_order_value",
                        F.round(F.try_divide(F.col("total_revenue"), F.col("total_orders")), 2))


def q_rev_by_item(spark, sf_dir):
    return _revenue(sales_clean(spark, sf_dir), ["item_name"]).orderBy("revenue")


def q_rev_by_slot(spark, sf_dir):
    return _revenue(sales_clean(spark, sf_dir), ["time_of_sale"])


def q_rev_by_weekday(spark, sf_dir):
    return _revenue(sales_clean(spark, sf_dir), ["day_of_week"])


def q_rev_by_month(spark, sf_dir):
    return _revenue(sales_clean(spark, sf_dir), ["month"]).orderBy("month")


def q_slot_ordered(spark, sf_dir):
    rev = _revenue(sales_clean(spark, sf_dir), ["time_of_sale"])
    return lookup.ordered_dimension(spark, rev, "time_of_sale", SLOT_ORDER)


def q_weekday_ordered(spark, sf_dir):
    rev = _revenue(sales_clean(spark, sf_dir), ["day_of_week"])
    return lookup.ordered_dimension(spark, rev, "day_of_week", WEEKDAY_ORDER)


def q_payment_share(spark, sf_dir):
    return cohort.share_of_known(sales_clean(spark, sf_dir), "transaction_type", UNKNOWN)


def q_above_median(spark, sf_dir):
    rev = _revenue(sales_clean(spark, sf_dir), ["item_name"])
    return cohort.above_median(rev, "revenue")


def q_peak_slot(spark, sf_dir):
    """Busiest slot of the fixed display order (first listed on ties)."""
    rev = _revenue(sales_clean(spark, sf_dir), ["time_of_sale"])
    ordered = lookup.ordered_dimension(spark, rev, "time_of_sale", SLOT_ORDER)
    return cohort.peak(ordered, "revenue", "time_of_sale", "display_order").drop("display_order")


def q_peak_weekday(spark, sf_dir):
    rev = _revenue(sales_clean(spark, sf_dir), ["day_of_week"])
    ordered = lookup.ordered_dimension(spark, rev, "day_of_week", WEEKDAY_ORDER)
    return cohort.peak(ordered, "revenue", "day_of_week", "display_order").drop("display_order")


def q_sales_null_audit(spark, sf_dir):
    return profiling.null_audit(sales(spark, sf_dir), with_types=False)


def q_topk_share(spark, sf_dir):
    """Share of revenue earned by the top-k items."""
    rev = _revenue(sales_clean(spark, sf_dir), ["item_name"])
    top = rev.orderBy(F.col("revenue").desc(), F.col("item_name")).limit(TOP_K)
    t = top.agg(F.sum("revenue").alias("top_k_revenue"))
    tot = rev.agg(F.sum("revenue").alias("total_revenue"))
    return (t.crossJoin(tot)
            .withColumn("top_k_share_pct",
                        F.round(F.try_divide(100.0 * F.col("top_k_revenue"),
                                             F.col("total_revenue")), 1)))


def q_month_change(spark, sf_dir):
    """Month-over-month revenue change with order counts (one row per month;
    the window runs over the monthly aggregate only)."""
    s = sales_clean(spark, sf_dir).where(F.col("month").isNotNull())
    m = s.groupBy("month").agg(F.sum("transaction_amount").cast("double").alias("revenue"),
                               F.count(F.lit(1)).alias("orders"))
    w = Window.orderBy("month")
    return (m.withColumn("prev_revenue", F.lag("revenue").over(w))
            .withColumn("pct_change",
                        F.round(F.try_divide(100.0 * (F.col("revenue") - F.col("prev_revenue")),
                                             F.col("prev_revenue")), 1)))


QUERIES = {name: fn for name, fn in globals().items() if name.startswith("q_")}

_D1 = "CASE WHEN regexp_full_match(trim(date), '[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}') THEN CAST(try_strptime(trim(date), '%d-%m-%Y') AS DATE) END"
_D2 = "CASE WHEN regexp_full_match(trim(date), '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}') THEN CAST(try_strptime(trim(date), '%m/%d/%Y') AS DATE) END"
CLEAN_C_SQL = SALES_SQL + f""",
sales_c AS (
  SELECT order_key, COALESCE({_D1}, {_D2}) AS date, item_name, quantity, transaction_amount,
         COALESCE(transaction_type, 'Unknown') AS transaction_type, time_of_sale
  FROM sales_raw),
sales_k AS (
  SELECT *, strftime(date, '%Y-%m') AS month, dayname(date) AS day_of_week,
         CAST(year(date) AS INTEGER) AS year FROM sales_c)"""


def _w(body):
    return "WITH " + CLEAN_C_SQL + "\n" + body


def _rev(key):
    return f"""SELECT {key}, CAST(SUM(transaction_amount) AS DOUBLE) AS revenue FROM sales_k
WHERE {key} IS NOT NULL GROUP BY {key}"""


def _ordered(key, order):
    vals = ", ".join(f"('{v}', {i})" for i, v in enumerate(order))
    return f"""SELECT d.{key}, r.revenue, d.display_order FROM (VALUES {vals}) d({key}, display_order)
LEFT JOIN ({_rev(key)}) r ON r.{key} = d.{key}"""


ORACLE = {
    "q_sales_clean": _w("""SELECT order_key, strftime(date, '%Y-%m-%d') AS date, item_name, quantity,
       CAST(transaction_amount AS DOUBLE) AS transaction_amount, transaction_type, time_of_sale, month, day_of_week, year FROM sales_k"""),
    "q_mixed_dates": _w("""SELECT COUNT(*) FILTER (WHERE date IS NOT NULL) AS parsed_rows,
       COUNT(*) FILTER (WHERE date IS NULL) AS failed_rows,
       strftime(MIN(date), '%Y-%m-%d') AS first_date, strftime(MAX(date), '%Y-%m-%d') AS last_date FROM sales_k"""),
    "q_payment_counts": _w("SELECT transaction_type, COUNT(*) AS n FROM sales_k GROUP BY transaction_type"),
    "q_calendar_keys": _w("""SELECT month, year, COUNT(*) AS orders FROM sales_k WHERE month IS NOT NULL
GROUP BY month, year"""),
    "q_headline": _w("""SELECT CAST(SUM(transaction_amount) AS DOUBLE) AS total_revenue, COUNT(*) AS total_orders,
       SUM(quantity) AS items_sold,
       ROUND(CAST(SUM(transaction_amount) AS DOUBLE) / COUNT(*), 2) AS avg_order_value FROM sales_k"""),
    "q_rev_by_item": _w(_rev("item_name")),
    "q_rev_by_slot": _w(_rev("time_of_sale")),
    "q_rev_by_weekday": _w(_rev("day_of_week")),
    "q_rev_by_month": _w(_rev("month")),
    "q_slot_ordered": _w(_ordered("time_of_sale", SLOT_ORDER)),
    "q_weekday_ordered": _w(_ordered("day_of_week", WEEKDAY_ORDER)),
    "q_payment_share": _w("""SELECT transaction_type, n,
       round_even(100.0 * n / SUM(n) OVER (), 1) AS pct_of_known,
       (SELECT COUNT(*) FROM sales_k WHERE transaction_type = 'Unknown') AS unknown_n
FROM (SELECT transaction_type, COUNT(*) AS n FROM sales_k WHERE transaction_type <> 'Unknown'
      GROUP BY transaction_type)"""),
    "q_above_median": _w(f"""SELECT item_name, revenue, median_total, revenue >= median_total AS above_median
FROM ({_rev('item_name')}) CROSS JOIN (SELECT quantile_cont(revenue, 0.5) AS median_total FROM ({_rev('item_name')}))"""),
    "q_peak_slot": _w("SELECT time_of_sale, revenue FROM (" + _ordered("time_of_sale", SLOT_ORDER)
                      + ") ORDER BY revenue DESC NULLS LAST, display_order LIMIT 1"),
    "q_peak_weekday": _w("SELECT day_of_week, revenue FROM (" + _ordered("day_of_week", WEEKDAY_ORDER)
                         + ") ORDER BY revenue DESC NULLS LAST, display_order LIMIT 1"),
    "q_sales_null_audit": "WITH " + SALES_SQL + """
SELECT column_name, nulls FROM (UNPIVOT (SELECT
  COUNT(*) FILTER (WHERE order_key IS NULL) AS order_key,
  COUNT(*) FILTER (WHERE date IS NULL) AS date,
  COUNT(*) FILTER (WHERE item_name IS NULL) AS item_name,
  COUNT(*) FILTER (WHERE quantity IS NULL) AS quantity,
  COUNT(*) FILTER (WHERE transaction_amount IS NULL) AS transaction_amount,
  COUNT(*) FILTER (WHERE transaction_type IS NULL) AS transaction_type,
  COUNT(*) FILTER (WHERE time_of_sale IS NULL) AS time_of_sale FROM sales_raw)
  ON COLUMNS(*) INTO NAME column_name VALUE nulls)""",
    "q_topk_share": _w(f"""SELECT top_k_revenue, total_revenue,
       ROUND(100.0 * top_k_revenue / total_revenue, 1) AS top_k_share_pct
FROM (SELECT SUM(revenue) AS top_k_revenue FROM ({_rev('item_name')} ORDER BY revenue DESC, item_name LIMIT {TOP_K}))
CROSS JOIN (SELECT SUM(revenue) AS total_revenue FROM ({_rev('item_name')}))"""),
    "q_month_change": _w("""SELECT month, revenue, orders, LAG(revenue) OVER (ORDER BY month) AS prev_revenue,
       ROUND(100.0 * (revenue - LAG(revenue) OVER (ORDER BY month)) / LAG(revenue) OVER (ORDER BY month), 1) AS pct_change
FROM (SELECT month, CAST(SUM(transaction_amount) AS DOUBLE) AS revenue, COUNT(*) AS orders
      FROM sales_k WHERE month IS NOT NULL GROUP BY month)"""),
}
