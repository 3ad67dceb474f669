"""Running totals and exact quantiles over a global or per-group order, without
funnelling a group (or the whole table) into one task.

A ``Window.partitionBy(entity)`` puts every row of an entity in one task and
``Window.orderBy`` without a partition puts the whole table there.  Both fail
when one entity holds a third of the rows.  So each group is cut into *slices*
that follow its order (a week of a timeline, a range of scores, the leading
bits of a hash), whatever the size of the input:

1. a window inside (group, slice) gives the running sum of the slice;
2. a hash aggregate, merged map-side, gives one total per (group, slice);
3. a window over those totals gives what comes before each slice;
4. a join on (group, slice) adds it, on the partitioning of step 1.

The rows are shuffled once, nothing is stored, and no job runs while the query
is built.  Slices are functions of a row's own values, so a task that is run
again puts its rows where they were.  The window of step 3 sees one row per slice
of a group; the caller chooses slices of which a group has few.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "__slice_key"
SLICE = "__slice"
N_SLICES = 1024


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence,
                   values: dict[str, Column | str], bucket: Column | str,
                   inclusive: bool = True, group_size: str | None = None,
                   extend: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Add ``name = SUM(expr) OVER (PARTITION BY by ORDER BY order ROWS
    UNBOUNDED PRECEDING .. CURRENT ROW)`` for each ``name: expr`` in
    ``values`` (``inclusive=False`` stops at 1 PRECEDING, NULL on the first
    row, as SQL does).  ``order`` must be a total order inside each group
    (end it with a unique key).

    ``bucket`` names the slice of a row and must never fall (NULL lowest) as
    ``order`` goes on.  ``group_size`` names an extra column holding the row
    count of each row's ``by`` group.  ``extend`` may add columns to the table
    of slice totals (the group keys are ``k0``, ``k1``, ... of its struct
    ``KEY``); the rows get them with their totals.  NULL is a group like any
    other."""
    exprs = {f"__v{i}": _col(e) for i, e in enumerate(values.values())}
    # A struct compares its NULL fields as equal, so the window, the aggregate
    # and the join share one plain key and one exchange of the rows.
    key = F.struct(*[F.col(b).alias(f"k{i}") for i, b in enumerate(by)], _col(bucket).alias("at"))
    base = df.select("*", key.alias(KEY), *[e.alias(v) for v, e in exprs.items()])
    last = Window.currentRow if inclusive else -1
    inside = (Window.partitionBy(KEY).orderBy(*[_col(o) for o in order])
              .rowsBetween(Window.unboundedPreceding, last))
    rows = base.select(*df.columns, KEY, *[F.sum(v).over(inside).alias(f"{v}_in") for v in exprs])

    sums = base.groupBy(KEY).agg(*[F.sum(v).alias(v) for v in exprs], F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*[F.col(f"{KEY}.k{i}") for i in range(len(by))])
    earlier = group.orderBy(F.col(f"{KEY}.at")).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(KEY, *[F.sum(v).over(earlier).alias(f"{v}_before") for v in exprs],
                        *([F.sum("__n").over(group).alias(group_size)] if group_size else []))

    given = set(carry.columns)
    carry = extend(carry) if extend else carry
    extra = [c for c in carry.columns if c not in given]

    def total(v):
        here, before = F.col(f"{v}_in"), F.col(f"{v}_before")
        return F.coalesce(here + before, here, before)

    return rows.join(carry, KEY).select(
        *df.columns, *[total(v).alias(name) for v, name in zip(exprs, values)],
        *([group_size] if group_size else []), *extra)


def value_edges(df: DataFrame, value: str, n: int = N_SLICES) -> list[float]:
    """At most ``n - 1`` rising edges that cut the values into slices of about
    equal row counts: one ``approx_percentile`` aggregate, read once, so that
    every use of the edges sees the same numbers."""
    v = F.col(value).cast("double")
    shares = f"array({', '.join(f'{i / n!r}D' for i in range(1, n))})"  # as text: so many column objects take longer than the job
    got = df.select(v.alias("v")).where(~F.isnan("v")).agg(F.expr(f"percentile_approx(v, {shares})").alias("e")).first()["e"]
    return sorted({e for e in got or [] if math.isfinite(e)})


def with_slices(df: DataFrame, value: str, edges: Sequence[float], name: str = SLICE) -> DataFrame:
    """Add the number of the slice of ``value`` (int, rising with it): NULL is
    below all others and NaN above, as Spark orders them."""
    splits = [-math.inf, *(edges or [0.0]), math.inf]
    v = F.col(value).cast("double")
    cut = Bucketizer(splits=splits, inputCol="__v", outputCol="__at", handleInvalid="keep")
    return (cut.transform(df.withColumn("__v", F.coalesce(v, F.lit(0.0))))
            .withColumn(name, F.when(v.isNull(), -1).otherwise(F.col("__at").cast("int")))
            .drop("__v", "__at"))


def value_totals(df: DataFrame, by: Sequence[str], value: str, values: dict[str, Column | str],
                 edges: Sequence[float], descending: bool = False) -> DataFrame:
    """:func:`running_totals` in the order of ``value`` (distinct in a group),
    sliced at ``edges``."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    at = -F.col(SLICE) if descending else F.col(SLICE)
    return running_totals(with_slices(df, value, edges), by, [order], values, at).drop(SLICE)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    by: Sequence[str] = (), n_slices: int = N_SLICES) -> DataFrame:
    """Linearly interpolated quantiles (``quantile_cont`` / numpy 'linear').

    Returns one row per ``by`` group and probability with columns ``prob``
    (double), ``prob_index`` (int) and ``quantile`` (double; NULL if there is
    no value).  The data are first reduced to (value, count) pairs and
    cumulated; one pass then picks the values at the ranks that the
    probabilities of the group need."""
    by = list(by)
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__rows"))
    cum = value_totals(counts, by, value, {"__cum": "__rows"}, value_edges(known, value, n_slices))

    def place(p):
        return (F.col("__total") - 1).cast("double") * F.lit(float(p))

    ranks = [f(place(p)).cast("bigint") for p in probs for f in (F.floor, F.ceil)]
    wanted = known.groupBy(*by).agg(F.count(F.lit(1)).alias("__total")).withColumn(
        "__ranks", F.array_distinct(F.array(*ranks)))
    # Without groups this is one row; with groups, AQE broadcasts it on its
    # measured size or splits the skewed side of the join.
    both = cum.join(wanted, by) if by else cum.crossJoin(F.broadcast(wanted))
    first, last = F.col("__cum") - F.col("__rows"), F.col("__cum") - 1
    found = both.select(*by, "__total", F.col(value).cast("double").alias("__v"),
                        F.explode(F.filter("__ranks", lambda r: (r >= first) & (r <= last))).alias("__k"))
    picked = found.groupBy(*by).agg(
        F.first("__total").alias("__total"),
        F.map_from_entries(F.collect_list(F.struct("__k", "__v"))).alias("__at"))
    cuts = F.array(*[F.struct(F.lit(i).alias("prob_index"), F.lit(float(p)).alias("prob"))
                     for i, p in enumerate(probs)])
    h = (F.col("__total") - 1).cast("double") * F.col("prob")
    low = F.col("__at")[F.floor(h).cast("bigint")]
    high = F.col("__at")[F.ceil(h).cast("bigint")]
    quantile = F.when(F.floor(h) == F.ceil(h), low).otherwise(low + (h - F.floor(h)) * (high - low))
    return (picked.select(*by, "__total", "__at", F.inline(cuts))
            .select(*by, "prob_index", "prob", quantile.alias("quantile")))


def column_summaries(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.5,),
                     accuracy: int = 10_000, n_slices: int = N_SLICES) -> DataFrame:
    """Per column its count, minimum, mean, maximum and exact, linearly
    interpolated quantiles: (column_name, n, min_value, mean_value, max_value,
    quantiles), the last an array in the order of ``probs``; NULL counts nowhere,
    NaN is above all numbers, and a column without values has NULL everywhere.

    Two passes whatever the number of columns.  One aggregate gives the
    statistics and, from a sketch, two values between which the rows that a
    quantile needs must lie: 2 / ``accuracy`` of the ranks on either side, twice
    the sketch's error (everything while that is less than four rows).  Its one
    row is read.  The other pass counts equal values; those below a bracket count
    as one value, those above are left out, so that what is shuffled and put in
    order is the brackets' distinct values, in slices of equal width.  A rank
    outside its bracket fails the query."""
    eps = 1.0 / accuracy
    shares = [min(1.0, max(0.0, p + d * eps)) for p in probs for d in (-2, 2)]
    wide = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    sketch = f"array({', '.join(f'{x!r}D' for x in shares)}), {accuracy}"
    got = wide.agg(*[f(F.col(f"c{i}")).alias(f"{name}{i}") for i in range(len(cols))
                     for name, f in (("n", F.count), ("min", F.min), ("avg", F.avg), ("max", F.max))],
                   *[F.expr(f"percentile_approx(c{i}, {sketch})").alias(f"at{i}") for i in range(len(cols))]).first()
    stats = [(i, c, got[f"n{i}"], got[f"min{i}"], got[f"avg{i}"], got[f"max{i}"]) for i, c in enumerate(cols)]

    cells = []
    for i, _, n, low, _, high in stats:
        for j in range(len(probs)) if n else ():
            lo, hi = (low, high) if 2 * eps * n < 4 else got[f"at{i}"][2 * j:2 * j + 2]
            v, lo, hi = F.col(f"c{i}"), F.lit(lo).cast("double"), F.lit(hi).cast("double")
            # NULL stands for all that is below the bracket, and sorts below it.
            cells.append(F.when(v <= hi, F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), lo.alias("lo"), hi.alias("hi"),
                                                  F.when(v >= lo, v).alias("v"))))
    known = df.sparkSession.createDataFrame(
        stats, "i int, column_name string, n long, min_value double, mean_value double, max_value double")
    if not cells:
        return known.select("column_name", "n", "min_value", "mean_value", "max_value",
                            F.lit(None).cast("array<double>").alias("quantiles"))
    by = ["i", "j", "lo", "hi"]
    counts = (wide.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.*")
              .groupBy(*by, "v").agg(F.count(F.lit(1)).alias("__rows")))
    part = F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * (n_slices - 1)
    at = (F.when(F.col("v").isNull(), -1).when(part.isNull() | F.isnan(part), n_slices - 1)
          .otherwise(F.floor(part).cast("int")))
    cum = running_totals(counts, by, [F.col("v").asc_nulls_first()], {"__cum": "__rows"}, at)

    # The ranks that each quantile needs: a table of cells, fixed by the parameters.
    rank = [(i, j, n, (n - 1) * float(p)) for i, _, n, *_ in stats for j, p in enumerate(probs)]
    wanted = df.sparkSession.createDataFrame(
        [(i, j, h, math.floor(h), math.ceil(h)) for i, j, n, h in rank if n], "i int, j int, h double, k0 long, k1 long")
    first, last = F.col("__cum") - F.col("__rows"), F.col("__cum") - 1

    def value(k):
        here = (F.col(k) >= first) & (F.col(k) <= last)
        return F.max(F.when(here, F.when(F.col("v").isNull(), F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))
                            .otherwise(F.col("v"))))

    found = (cum.join(F.broadcast(wanted), ["i", "j"]).groupBy("i", "j", "h", "k0")
             .agg(value("k0").alias("low"), value("k1").alias("high")))
    part = F.col("h") - F.col("k0")
    exact = (F.when(F.col("low").isNull() | F.col("high").isNull(), F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))
             .when((part == 0) | (F.col("low") == F.col("high")), F.col("low")).otherwise(F.col("low") + part * (F.col("high") - F.col("low"))))
    lists = found.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", exact.alias("q")))),
                                               lambda s: s["q"]).alias("quantiles"))
    return known.join(lists, "i", "left").select(
        "column_name", "n", "min_value", "mean_value", "max_value", "quantiles")


def quantile_array(df: DataFrame, value: str, probs: Sequence[float],
                   n_slices: int = N_SLICES) -> DataFrame:
    """One row, one column ``edges``: the quantiles in ``probs`` order."""
    q = exact_quantiles(df, value, probs, n_slices=n_slices)
    return q.agg(F.transform(F.array_sort(F.collect_list(F.struct("prob_index", "quantile"))),
                             lambda s: s["quantile"]).alias("edges"))
