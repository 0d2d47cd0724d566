"""Result writers: CSV with a header, and JSON lines; both replace what is there.

With ``single_file`` all rows meet in one task: for small results only. With
``partition_by`` (day, say) there is a folder per value, which readers can prune by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def _arranged(df: DataFrame, order_by: Sequence[str] | None, single_file: bool) -> DataFrame:
    if single_file:
        # repartition, not coalesce: the work before it keeps its parallelism and
        # only the finished rows meet in one task
        df = df.repartition(1)
        return df.sortWithinPartitions(*order_by) if order_by else df
    return df.orderBy(*order_by) if order_by else df


def write_csv(df: DataFrame, path: str, order_by: Sequence[str] | None = None,
              single_file: bool = False, partition_by: Sequence[str] = ()) -> None:
    (_arranged(df, order_by, single_file).write.mode("overwrite")
     .partitionBy(*partition_by).option("header", True).csv(path))


def write_json(df: DataFrame, path: str, order_by: Sequence[str] | None = None,
               single_file: bool = False, partition_by: Sequence[str] = ()) -> None:
    (_arranged(df, order_by, single_file).write.mode("overwrite")
     .partitionBy(*partition_by).json(path))
