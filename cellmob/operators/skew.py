"""Joins and ranks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A pre-filter broadcasts at most this many hash slots, whatever the data.
_FILTER_SLOTS = 1 << 18
# Buckets that a top-k is taken in first: more make it ask less of each task.
SPREAD = 64
# A key with more rows than a share of all rows, or than HEAVY_ROWS if that is more, is
# split into parts of about that size. Fewer than HEAVY_SHARES keys can be so heavy, and
# they have fewer than 2 * HEAVY_SHARES parts together, so both may be broadcast.
HEAVY_SHARES = 10_000
HEAVY_ROWS = 100_000


def spread_of(columns: Sequence[str], buckets: int | Column = SPREAD) -> Column:
    """A bucket from the row's own values: the same row lands in the same bucket
    when a lost task is run again, which a random salt would not promise."""
    buckets = buckets if isinstance(buckets, Column) else F.lit(buckets)
    return F.pmod(F.xxhash64(*columns), buckets).cast("int")


def heavy_keys(keys: DataFrame, on: Sequence[str], weight: str,
               heavy_rows: int | None = None) -> DataFrame:
    """The keys to split, with ``_parts``, the number of parts of each. ``keys`` is distinct
    and ``weight`` its column with the number of rows of each key."""
    part = F.greatest(F.lit(float(HEAVY_ROWS if heavy_rows is None else heavy_rows)),
                      keys.agg(F.sum(weight) / F.lit(HEAVY_SHARES)).scalar())
    return (keys.withColumn("_parts", F.ceil(F.col(weight) / part).cast("int"))
            .filter(F.col("_parts") > 1).select(*on, "_parts"))


def split_keys(rows: DataFrame, keys: DataFrame, heavy: DataFrame, on: Sequence[str],
               spread_by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join with a column ``_spread`` to join on as well: a row of a heavy
    key has one of the key's parts, and its key is repeated once per part."""
    heavy = F.broadcast(heavy)
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    rows = (rows.join(heavy, [*on], "left")
            .withColumn("_spread", F.when(parts > 1, spread_of(spread_by, parts)).otherwise(F.lit(0)))
            .drop("_parts"))
    keys = (keys.join(heavy, [*on], "left")
            .withColumn("_spread", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts"))
    return rows, keys


def semi_join_spread(rows: DataFrame, keys: DataFrame, on: Sequence[str],
                     spread_by: Sequence[str], weight: str,
                     heavy_rows: int | None = None) -> DataFrame:
    """Left semi join of a big table that splits the rows of heavy keys.

    ``keys`` are distinct, and ``weight`` names their column with the number of rows.
    """
    heavy = heavy_keys(keys, on, weight, heavy_rows)
    split, keys = split_keys(rows, keys.select(*on), heavy, on, spread_by)
    return split.join(keys, [*on, "_spread"], "left_semi").select(*rows.columns)


def semi_join_selective(rows: DataFrame, keys: DataFrame, on: Sequence[str],
                        spread_by: Sequence[str], weight: str,
                        heavy_rows: int | None = None) -> DataFrame:
    """Left semi join for keys that select few of the rows.

    Planned blindly, the join would shuffle the whole big table before the size of
    ``keys`` is known. So rows first pass a filter on the hash slot of their key; the
    slots are broadcast, and there are at most ``_FILTER_SLOTS`` of them (two numbers
    each) however many keys there are. What passes then meets the keys themselves, which
    makes the result exact. A slot also says into how many parts its heaviest key, by
    ``weight``, is split, and all keys of the slot are repeated so many times.
    """
    def slot():
        return F.pmod(F.xxhash64(*on), F.lit(_FILTER_SLOTS))

    part = F.lit(float(HEAVY_ROWS if heavy_rows is None else heavy_rows))
    slots = (keys.groupBy(slot().alias("_slot"))
             .agg(F.max(F.ceil(F.col(weight) / part).cast("int")).alias("_parts")))
    slots = F.broadcast(slots)
    passed = (rows.withColumn("_slot", slot()).join(slots, "_slot")
              .withColumn("_spread", spread_of(spread_by, F.col("_parts"))))
    keys = (keys.select(*on, slot().alias("_slot")).join(slots, "_slot")
            .select(*on, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_spread")))
    return passed.join(keys, [*on, "_spread"], "left_semi").select(*rows.columns)


def top_k_with_ties(rows: DataFrame, group: str, value: str, k: int,
                    spread_by: Sequence[str]) -> DataFrame:
    """Rows whose ``rank`` by ``value`` descending within ``group`` is at most ``k``.

    First the same question per (group, bucket): its answers contain all answers of the
    group, ties included, and Spark prunes them before the shuffle. The k-th value of a
    group then follows from the counts of the distinct values that are left, and a
    comparison with it finishes. No task ever sees a whole group. The thresholds are
    one row per group (the groups are days), hence the broadcast. The first of
    ``spread_by`` must not be null.
    """
    by_bucket = W.partitionBy(group, "_spread").orderBy(F.col(value).desc())
    best = (rows.withColumn("_spread", spread_of(spread_by))
            .withColumn("_rank", F.rank().over(by_bucket))
            .filter(F.col("_rank") <= k).drop("_spread", "_rank"))
    # Counting a column keeps it in the shuffle, so that both uses of it are one.
    counts = best.groupBy(group, value).agg(F.count(spread_by[0]).alias("_n"))
    above = F.sum("_n").over(W.partitionBy(group).orderBy(F.col(value).desc())
                             .rowsBetween(W.unboundedPreceding, -1))
    limits = (counts.withColumn("_above", F.coalesce(above, F.lit(0)))
              .filter(F.col("_above") < k)
              .groupBy(group).agg(F.min(value).alias("_limit")))
    return (best.join(F.broadcast(limits), group)
            .filter(F.col(value) >= F.col("_limit")).select(*rows.columns))
