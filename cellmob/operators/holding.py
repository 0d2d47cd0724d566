"""Keeping a table that is read many times."""

from __future__ import annotations

import atexit
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """The folder the cluster names for checkpoints, if it does."""
    return (spark.conf.get("spark.checkpoint.dir", None)
            or spark.sparkContext.getCheckpointDir())


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


@contextmanager
def hold(df: DataFrame, cut: bool = False) -> Iterator[DataFrame]:
    """Keep ``df`` for the block: in memory, spilling to disk, computed once.

    With ``cut`` and a shared folder (``spark.checkpoint.dir``, which the cluster vouches
    for), the table is written there as Parquet instead. Later uses read only the columns
    they need, and an executor lost in a long run costs a read, not a recomputation from the
    events. The files go with the block, whatever ends it; nothing that is read after it
    may depend on the table.
    """
    spark = df.sparkSession
    folder = shared_folder(spark) if cut else None
    if folder:
        path = f"{folder}/held-{uuid4().hex}"
        try:
            df.write.parquet(path)
            yield spark.read.schema(df.schema).parquet(path)
        finally:
            _delete(spark, path)
        return
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


_kept: list[tuple[SparkSession, str]] = []


def keep(df: DataFrame) -> DataFrame:
    """``df``, a table that is small against what it was made from, computed at once and
    written to the shared folder; what reads it more than once repeats neither its work nor
    its plan, and Spark knows its size. The files go when the process ends, or with
    ``release``. A local session without a shared folder gets one; on a cluster without
    one, ``df`` itself is returned.
    """
    spark = df.sparkSession
    if not shared_folder(spark):
        if not spark.sparkContext.master.startswith("local["):
            return df
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="kept-"))
    path = f"{shared_folder(spark)}/kept-{uuid4().hex}"
    _kept.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Delete the kept tables; results that still read them end with this."""
    while _kept:
        spark, path = _kept.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session is gone, and with it the way to its files
            return
