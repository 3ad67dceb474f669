"""Sinks: CSV extracts with a header, BI bundles, and the text presentation of
dates used by extracts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType


# Standard quoting (a quote is doubled), blanks kept as they are.
CSV_TEXT = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def dates_as_text(df: DataFrame, fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Every DATE column as ISO text, the form a CSV extract carries."""
    return df.select(*[F.date_format(F.col(f.name), fmt).alias(f.name)
                       if isinstance(f.dataType, DateType) else F.col(f.name)
                       for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Full table to CSV with a header, written by the executors in parallel
    (a directory of part files; nothing passes through the driver)."""
    df.write.mode(mode).options(header=True, **CSV_TEXT).csv(path)


def write_bundle(tables: Mapping[str, DataFrame], root: str, fmt: str = "csv") -> dict[str, str]:
    """Write a named set of result tables (scored rows, decile, odds, KPI)
    under one folder; returns name -> path."""
    out = {}
    for name, df in tables.items():
        path = f"{root.rstrip('/')}/{name}"
        if fmt == "csv":
            write_csv(df, path)
        else:
            df.write.mode("overwrite").parquet(path)
        out[name] = path
    return out
