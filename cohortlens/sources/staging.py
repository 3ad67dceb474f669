"""Staging readers and stage materialisation.

Raw files land as text first: the raw layer stays a faithful copy of the
source, and typing happens in the cleaning projection.  All readers take an
explicit schema where one is known (inference costs a scan and is unstable).

A quoted field may hold line breaks, so where a record begins depends on the
quotes before it, and Spark's own multi-line reader makes each file one task.
:func:`csv_records` reads lines instead, which split at any size, and finds the
records from the parity of quotes:

1. one aggregate counts the quotes of each split of a file (and finds its first
   line and whether any line of it has an odd number of quotes);
2. a window over these counts, one row a split, tells whether a split begins
   inside a quoted field;
3. lines of a split that begins outside and has no odd line are records as they
   are and don't move.  Only the lines of other splits are shuffled, by split, for
   a running count of quotes; pieces of one record meet in one group."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortlens.operators.ordering import running_totals
from cohortlens.session import shared_path
from cohortlens.sources.export import CSV_TEXT

#: Where a record or line stands: its file, the first byte of its split, and its place in the reading order.
PLACE = ["__file", "__block", "__line"]
CORRUPT = "__corrupt"


def text_schema(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType(), True) for c in columns])


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, __file, __block, __line): the lines of the files.  ``__line`` rises
    along the lines of a split; splits of a file follow ``__block``."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__line"))


def csv_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(record, __file, __block, __line): one row per CSV record, without blank
    ones and, with ``header``, without the first line of each file.  Line breaks
    inside quotes are kept; a carriage return at the end of a record is not.  A
    file that ends inside quotes gives what is left as one record."""
    lines = file_lines(spark, path).withColumn("__quotes", F.length("value") - F.length(F.replace("value", F.lit('"'))))
    odd = F.col("__quotes") % 2 != 0
    splits = lines.groupBy("__file", "__block").agg(F.sum("__quotes").alias("__n"), F.max(odd).alias("__odd"), F.min("__line").alias("__from"))
    earlier = Window.partitionBy("__file").orderBy("__block")  # one row a split of a file
    before = F.coalesce(F.sum("__n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("__file", "__block", "__from", (before % 2 != 0).alias("__inside"), "__odd",
                           (F.row_number().over(earlier) == 1).alias("__top"))
    met = lines.join(splits, ["__file", "__block"])  # no hint: as many rows as splits
    if header:
        met = met.where(~(F.col("__top") & (F.col("__line") == F.col("__from"))))
    plain = ~F.col("__inside") & ~F.col("__odd")
    whole = met.where(plain).select(F.col("value").alias("record"), *PLACE)

    # Other splits: the parity before each line, its split's own plus that of the lines before it there.
    own = Window.partitionBy("__file", "__block").orderBy("__line").rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.sum("__quotes").over(own), F.lit(0)) + F.col("__inside").cast("int")
    rest = met.where(~plain).withColumn("__open", here % 2 != 0)
    single = rest.where(~F.col("__open") & ~odd).select(F.col("value").alias("record"), *PLACE)
    pieces = rest.where(F.col("__open") | odd)
    begins = (~F.col("__open")).cast("int")
    numbered = running_totals(pieces, ["__file"], [F.col("__block"), F.col("__line")], {"__record": begins}, bucket="__block")
    # Pieces of one record, at most its own lines.
    piece = F.struct("__block", "__line", "value")
    joined = numbered.groupBy("__file", "__record").agg(F.array_sort(F.collect_list(piece)).alias("x")).select(
        F.array_join(F.transform("x", lambda p: p["value"]), "\n").alias("record"), "__file",
        F.col("x")[0]["__block"].alias("__block"), F.col("x")[0]["__line"].alias("__line"))
    every = whole.unionByName(single).unionByName(joined.select("record", *PLACE))
    return every.withColumn("record", F.regexp_replace("record", "\r$", "")).where(F.length("record") > 0)


def parsed(records: DataFrame, schema: StructType | str, **options) -> DataFrame:
    """The records' fields, their place, and ``CORRUPT``: the text of a record that
    has another number of fields or a field that its type can't hold, else NULL."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    full = StructType([*fields.fields, StructField(CORRUPT, StringType(), True)])
    options = {**CSV_TEXT, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **options}
    read = F.from_csv("record", _ddl(full), options)
    return records.select(read.alias("__r"), *PLACE).select("__r.*", *PLACE)


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def stage_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Positional text staging: skip the header line, bind fields to
    ``columns`` by position (header names are ignored), keep every value as
    text, and keep the literal texts 'None' / 'NULL' (no null marker)."""
    return parsed(csv_records(spark, path), text_schema(columns), nullValue="\u0000").select(*[F.col(f"`{c}`") for c in columns])


def stage_csv_by_header(spark: SparkSession, path: str) -> DataFrame:
    """All-text staging named by the header line (no inference; only the first
    lines are read for the names)."""
    return stage_csv(spark, path, spark.read.options(header=True, inferSchema=False, **CSV_TEXT).csv(path).columns)


def read_typed_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed read with an explicit schema (prior artefacts, sales data).  What a
    type can't hold is NULL; :func:`typed_with_rejects` keeps such records apart."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return parsed(csv_records(spark, path), fields).select(*[F.col(f"`{c}`") for c in fields.fieldNames()])


def typed_with_rejects(spark: SparkSession, path: str, schema: StructType | str, rejects: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects): records that fit the schema, typed; and the others, as
    they stand in their file.  The rejects, (file, block, line, record), are written
    to ``rejects`` and read from there."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    rows = parsed(csv_records(spark, path, header), fields)
    bad = rows.where(F.col(CORRUPT).isNotNull()).select(*[F.col(c).alias(c.strip("_")) for c in PLACE], F.col(CORRUPT).alias("record"))
    bad.write.mode("errorifexists").parquet(rejects)
    return rows.where(F.col(CORRUPT).isNull()).select(*[F.col(f"`{c}`") for c in fields.fieldNames()]), spark.read.schema(bad.schema).parquet(rejects)


def _stage_root(spark: SparkSession, name: str):
    """Folder of a stage's versions, and the file context that it is in."""
    root = shared_path(spark, f"stage_{name}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.org.apache.hadoop.fs.Path(root).toUri(), conf) \
        if "://" in root or root.startswith("file:") else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
    return root, files


def materialize_stage(df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """``CREATE OR REPLACE TABLE name AS ...``: write the stage once into the
    shared checkpoint folder and read it back, so later stages reuse it
    without recomputation and the lineage is cut.

    Each call writes a version of its own; when it is complete, a pointer file is
    swapped by one rename.  A failed write leaves the earlier version in place,
    readers of that version keep it, and a stage may be made from its own earlier
    version."""
    spark = df.sparkSession
    root, files = _stage_root(spark, name)
    version = f"v-{uuid.uuid4().hex}"
    df.write.format(fmt).save(f"{root}/{version}")
    jvm = spark._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fresh = path(f"{root}/_{version}")
    fs = fresh.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(fresh, True)
    try:
        out.write(bytearray(f"{version} {fmt}".encode()))
    finally:
        out.close()
    replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(fresh, path(f"{root}/_current"), replace)
    stage = read_stage(spark, name)
    stage.createOrReplaceTempView(name)
    return stage


def read_stage(spark: SparkSession, name: str) -> DataFrame:
    """The current version of a stage, for any session on the same shared folder."""
    root, _ = _stage_root(spark, name)
    jvm = spark._jvm
    pointer = jvm.org.apache.hadoop.fs.Path(f"{root}/_current")
    stream = pointer.getFileSystem(spark._jsc.hadoopConfiguration()).open(pointer)
    try:
        version, fmt = bytes(stream.readAllBytes()).decode().split()
    finally:
        stream.close()
    return spark.read.format(fmt).load(f"{root}/{version}")


def read_csv_lines_in_order(spark: SparkSession, path: str, schema: str,
                            line_col: str = "__line") -> DataFrame:
    """Read delimited text files keeping their line order: each line is parsed
    with ``from_csv`` (quoted fields keep their commas, the text 'NULL' stays text)
    and placed by file, split and line (``PLACE``); lines are ordered inside a
    file, whatever order Spark reads files and splits in.  Blank lines stay, as
    rows of NULLs."""
    parsed_ = F.from_csv(F.regexp_replace("value", "\r$", ""), schema, {"nullValue": "\u0000"})
    rows = file_lines(spark, path).select(parsed_.alias("__r"), *PLACE).select("__r.*", *PLACE)
    return rows.withColumnRenamed("__line", line_col)
