"""Helpers that the operators share: shared tables, row keys, typed inputs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlens.session import shared_path

#: Bytes of text that one in-task step handles at a time; bounds memory.
STEP_CHARS = 2_000_000


#: Rows of an Arrow batch: with texts as rows, the session's default of 10,000
#: would put tens of MB several times into each Python worker.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, unless a smaller bound is set."""
    now = int(spark.conf.get(_BATCH_CONF))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and reread it.

    Cuts lineage: a lost executor costs a reread, not a recomputation.  The
    folder belongs to the session's checkpoint folder, which the cluster clears.
    """
    spark = df.sparkSession
    path = shared_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(c: Column) -> Column:
    """128-bit content key of a text (two independent 64-bit hashes), as text."""
    return F.concat(F.hex(F.xxhash64(c)), F.lit("-"), F.hex(F.xxhash64(F.lit("second"), c)))


#: Classes of keys that :func:`sifted` tells apart; bounds what it broadcasts (one long each).
SIEVE = 1 << 20


def sifted(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(may, not): the rows whose ``key`` may be among ``keys`` (column of that
    name) and those for which it isn't, told by hashed classes of keys.

    Rows that aren't wanted thus need not be shuffled for an exact join.  The
    broadcast side has at most ``SIEVE`` rows, however many keys there are; with
    very many of them it lets more rows through, and the exact join decides.
    """
    mark = "\0class"
    of = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(SIEVE))
    classes = F.broadcast(keys.select(of.alias(mark)).distinct())
    marked = rows.withColumn(mark, of)
    return marked.join(classes, mark, "left_semi").drop(mark), marked.join(classes, mark, "left_anti").drop(mark)


def text_steps(batches: Iterator[pa.RecordBatch], column: str = "text",
               step_chars: int = STEP_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with at most ``step_chars`` bytes of text, or one row.

    A null text becomes the empty text.
    """
    for batch in batches:
        column_ = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(column_), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(sizes):
            if i > start and size + n > step_chars:
                yield batch.slice(start, i - start), [x or "" for x in column_.slice(start, i - start).to_pylist()]
                start, size = i, 0
            size += n
        if start < len(sizes):
            yield batch.slice(start), [x or "" for x in column_.slice(start).to_pylist()]
    pa.default_memory_pool().release_unused()  # the worker lives on


def per_executor(make: Callable, *args):
    """One instance of ``make(*args)`` per Python worker, kept between tasks."""
    key = (make, args)
    if key not in _KEPT:
        _KEPT[key] = make(*args)
    return _KEPT[key]


_KEPT: dict = {}
