"""Event readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cellmob.schema import RAW_EVENT

FILE_PATTERN = "*_msc_*.gps"  # fixed value: how event files are named

_CSV_OPTIONS = {"header": True, "sep": ";", "encoding": "UTF-8"}


def read_events(spark: SparkSession, path: str, pattern: str | None = None,
                timestamp_format: str | None = None) -> DataFrame:
    """Read ``;``-separated event files with a header line.

    ``path`` may hold a glob; ``pattern`` (for instance :data:`FILE_PATTERN`) selects
    files below it. Columns are found by the names in the header, in any order;
    types are fixed, never inferred, so an all-digit subscriber stays a string.
    A cell that does not parse becomes null.
    """
    options = dict(_CSV_OPTIONS)
    if pattern:
        options["pathGlobFilter"] = pattern
    # Without inference this reads one line of one file.
    header = spark.read.options(**options).csv(path).columns
    missing = [f.name for f in RAW_EVENT if f.name not in header]
    if missing:
        raise ValueError(f"event files lack the columns {missing}; their header is {header}")
    known = {f.name: f for f in RAW_EVENT}
    schema = T.StructType([known.get(name, T.StructField(name, T.StringType()))
                           for name in header])
    if timestamp_format:
        options["timestampFormat"] = timestamp_format
    # enforceSchema=False checks every file's header: one with another order fails
    # loudly instead of shifting its columns.
    return (spark.read.options(**options).option("enforceSchema", False)
            .schema(schema).csv(path).select(*RAW_EVENT.names))


def read_events_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The same record from Parquet, where filters and columns reach the scan."""
    return spark.read.schema(RAW_EVENT).parquet(path)
