"""Statistics of daily extents, the widest-ranging subscribers and their trails.

Extents are rounded to 10 m, so a day has at most some two million distinct values, and
whole kilometres at most some twenty thousand. Quartiles and distributions are therefore
read off a histogram: counting combines before the shuffle, and the running sum sees
distinct values, never the rows of a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellmob.functions import whole_km
from cellmob.operators.skew import semi_join_selective, top_k_with_ties
from cellmob.schema import CELL, SUBSCRIBER_DAY


def extent_values(extents: DataFrame) -> DataFrame:
    """``dataset, haversine``: extents without the subscriber."""
    return extents.select("dataset", "haversine")


def distance_metadata(extents: DataFrame) -> DataFrame:
    """Count, min, max and mean of the extents of each day."""
    return extents.groupBy("dataset").agg(
        F.count("haversine").alias("count"), F.min("haversine").alias("min"),
        F.max("haversine").alias("max"), F.avg("haversine").alias("mean"))


def _histogram(values: DataFrame, value: str) -> DataFrame:
    """``dataset, value, _n, _upto, _total`` per distinct value of a day."""
    day = W.partitionBy("dataset")
    return (values.groupBy("dataset", value).agg(F.count("*").alias("_n"))
            .withColumn("_upto", F.sum("_n").over(
                day.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)))
            .withColumn("_total", F.sum("_n").over(day)))


def _one_day(extents: DataFrame) -> DataFrame:
    return extents.select(F.lit("1").alias("dataset"), "haversine")


def distance_quantiles(extents: DataFrame, by_day: bool = True, parts: int = 4) -> DataFrame:
    """Smallest extent of each of ``parts`` equal parts of the ordered extents.

    The parts are those of ``ntile``: sizes differ by at most one, the longer come
    first, and n < ``parts`` values give n rows.
    """
    hist = _histogram(extent_values(extents) if by_day else _one_day(extents), "haversine")
    # 0-based position of the first row of part q in the order of a day
    whole, rest = F.floor(F.col("_total") / F.lit(parts)), F.col("_total") % F.lit(parts)
    start = (F.col("quantile") - 1) * whole + F.least(F.col("quantile") - 1, rest)
    out = (hist.withColumn("quantile", F.explode(F.sequence(F.lit(1), F.lit(parts))))
           .filter((start < F.col("_upto")) & (start >= F.col("_upto") - F.col("_n")))
           .select("dataset", "quantile", "haversine"))
    return out if by_day else out.drop("dataset")


def distance_cume_dist(extents: DataFrame, by_day: bool = True) -> DataFrame:
    """Share of extents at or below each whole number of km that occurs.

    Without ``by_day`` all rows form one group, whose ``dataset`` is ``"1"``.
    """
    values = extent_values(extents) if by_day else _one_day(extents)
    hist = _histogram(values.select("dataset", whole_km("haversine").alias("haversine")),
                      "haversine")
    return hist.select("dataset", "haversine",
                       (F.col("_upto") / F.col("_total")).alias("cume_dist"))


def longest_paths(extents: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` subscribers of each day with the largest extent, and all that tie."""
    return longest_ranges(extents.select(*SUBSCRIBER_DAY, "haversine"), k)


def longest_ranges(ranges: DataFrame, k: int = 5) -> DataFrame:
    """The same with all columns of ``ranges`` (see ``daily_ranges``)."""
    return top_k_with_ties(ranges, "dataset", "haversine", k, spread_by=["subscriber"])


def trails_of(events: DataFrame, subscriber_days: DataFrame, weight: str) -> DataFrame:
    """All events of the given subscriber-days (distinct rows).

    ``weight`` names a column of ``subscriber_days`` with their number of events. Sort by day, subscriber and time where the result is written.
    """
    return semi_join_selective(events, subscriber_days, SUBSCRIBER_DAY,
                               ["timestamp", *CELL], weight)
