"""Running totals over groups of any size, with DataFrame functions only.

Rows carry a hash-random 60-bit key. The range of keys is cut into as many equal parts as
a group's row count asks for, some 256 rows each, and these into coarser parts, so that a
part of either kind stays small: totals of coarse parts, of fine parts inside a coarse one,
and of rows inside a fine one are summed apart and added. No task sees a whole group, and
the random key makes the parts even, whatever the skew of the groups. Rows that share a
key share a part: where many may, make one row of them before (see ``mixing``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellmob.llm.scratch import small, written

_ROWS = 256
_KEY_BITS = 60


def random_key(*columns: str | Column) -> Column:
    """60 bits of the MD5 of the columns as text: alike in every engine and run."""
    text = F.concat_ws("|", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                              for c in columns))
    return F.conv(F.substring(F.md5(text), 1, _KEY_BITS // 4), 16, 10).cast("long")


def running_total(df: DataFrame, group: str, key: str, ties: list[str], value: str,
                  out: str) -> DataFrame:
    """``df`` with column ``out``: the total of ``value`` over the rows of its group before
    it, in the order of ``key``, then ``ties``.

    ``group`` and ``key`` must not be null. ``df`` is read three times: pass a table. Rows
    that tie in everything are ordered arbitrarily; they are interchangeable.
    """
    rows = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    bits = F.ceil(F.log2(F.greatest(F.col("_n") / _ROWS, F.lit(1.0)))).cast("int")
    rows = small(written(rows.select("_g", F.least(bits, F.lit(40)).alias("_bits")), "groups"))

    fine = F.expr(f"shiftright({key}, {_KEY_BITS} - _bits)")
    parts = (df.join(rows, df[group] == rows["_g"])
             .withColumn("_fine", fine)
             .withColumn("_coarse", F.expr("shiftright(_fine, cast(ceil(_bits / 2) as int))")))

    sums = parts.groupBy("_g", "_coarse", "_fine").agg(F.sum(value).alias("_sum"))
    coarse = sums.groupBy("_g", "_coarse").agg(F.sum("_sum").alias("_total"))
    coarse = coarse.select("_g", "_coarse", F.coalesce(
        F.sum("_total").over(W.partitionBy("_g").orderBy("_coarse")
                             .rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_outer"))
    sums = sums.join(coarse, ["_g", "_coarse"]).select("_g", "_coarse", "_fine", (
        F.col("_outer") + F.coalesce(
            F.sum("_sum").over(W.partitionBy("_g", "_coarse").orderBy("_fine")
                               .rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("_start"))
    inside = (W.partitionBy("_g", "_coarse", "_fine").orderBy(key, *ties)
              .rowsBetween(W.unboundedPreceding, -1))
    return (parts.join(sums, ["_g", "_coarse", "_fine"])
            .withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .drop("_g", "_coarse", "_fine", "_bits", "_start"))
