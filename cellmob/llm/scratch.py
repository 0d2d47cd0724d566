"""Tables written to the folder that the cluster names in ``spark.checkpoint.dir``.

A written table cuts the lineage and survives lost executors. The session's setting is
read; only a local session without one gets a folder of its own. What was written goes
when the Python process ends normally, or with :func:`clear`.
"""

from __future__ import annotations

import atexit
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Table = tuple[SparkSession, str]
_written: list[Table] = []


def folder(spark: SparkSession) -> str:
    named = (spark.conf.get("spark.checkpoint.dir", None)
             or spark.sparkContext.getCheckpointDir())
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="llm-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table on disk, computed once."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(table: DataFrame, rows: int = 50_000) -> DataFrame:
    """``table``, narrow and written, marked for broadcast if its rows are counted as few.
    Beyond that a join shuffles, and Spark splits its hot keys."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


@contextmanager
def recorded() -> Iterator[list[Table]]:
    """What is written inside the block, for :func:`clear`."""
    first, mine = len(_written), []
    try:
        yield mine
    finally:
        mine += _written[first:]


@atexit.register
def clear(tables: list[Table] | None = None) -> None:
    """Delete these tables, or all written so far; results that still read them end with this."""
    for table in list(_written if tables is None else tables):
        if table not in _written:
            continue
        _written.remove(table)
        spark, path = table
        try:
            jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # the session is gone, and with it the way to its files
            return
