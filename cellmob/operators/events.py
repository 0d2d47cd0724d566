"""Cleaning and reducing events, areas, towers, visits, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellmob.functions import day_key, hour_frame, in_area
from cellmob.operators.skew import semi_join_spread
from cellmob.schema import CELL, FRAME_CELL, SUBSCRIBER_DAY, VISIT, Area


def reduce_events(events: DataFrame, area: Area | None = None, day_format: str = "MM.dd",
                  min_lat: float | None = 0.0, min_lng: float | None = 0.0) -> DataFrame:
    """Raw events to clean ones: day key, five columns, complete rows only.

    Rows at or below ``min_lat`` / ``min_lng`` go (``None`` keeps them all), and so do
    rows with a null or NaN. Everything is spelled as plain comparisons, so that all
    but the NaN tests are pushed into the scan.
    """
    # The day is null only where the timestamp is, and those rows go. Coalesced, it is
    # known not to be null: joins then add no null check of their own to some uses of
    # the table, which would keep them from sharing a scan and a shuffle.
    day = F.coalesce(day_key("timestamp", day_format), F.lit(""))
    out = events.select(day.alias("dataset"),
                        "subscriber", "timestamp", "lat", "lng")
    if min_lat is not None:
        out = out.filter(F.col("lat") > F.lit(float(min_lat)))
    if min_lng is not None:
        out = out.filter(F.col("lng") > F.lit(float(min_lng)))
    out = out.filter(
        F.col("subscriber").isNotNull() & F.col("timestamp").isNotNull()
        & F.col("lat").isNotNull() & F.col("lng").isNotNull()
        & ~F.isnan("lat") & ~F.isnan("lng"))
    return out if area is None else within_radius(out, area)


def within_radius(df: DataFrame, area: Area) -> DataFrame:
    """Rows whose ``lat, lng`` lie in the circle."""
    return df.filter(in_area(area))


def unique_cells(events: DataFrame) -> DataFrame:
    """Distinct towers. A tower is its coordinates."""
    return events.select(*CELL).distinct()


def unique_visits(events: DataFrame) -> DataFrame:
    """Distinct towers of each subscriber-day."""
    return events.select(*VISIT).distinct()


def drop_singletons(events: DataFrame) -> DataFrame:
    """Events of subscriber-days that have more than one event."""
    busy = (events.groupBy(*SUBSCRIBER_DAY).agg(F.count("timestamp").alias("n"))
            .filter(F.col("n") > 1))
    return semi_join_spread(events, busy, SUBSCRIBER_DAY, ["timestamp", *CELL], weight="n")


def hour_frames(events: DataFrame) -> DataFrame:
    """One row per event: day, hour of day, tower."""
    hour = F.coalesce(hour_frame("timestamp"), F.lit(0))  # never null, as in reduce_events
    return (events.filter(F.col("timestamp").isNotNull())
            .select("dataset", hour.alias("dataframe"), *CELL).select(*FRAME_CELL))


def profile(df: DataFrame) -> DataFrame:
    """Count, mean, stddev, min and max of numeric and string columns, as strings."""
    return df.describe()


def profile_typed(df: DataFrame) -> DataFrame:
    """The profile with one row per column and numbers kept as numbers.

    ``min_value, max_value`` hold the range of a numeric column, ``min_text, max_text``
    that of a string column. Mean and stddev of a string column are those of its
    values that are numbers. One aggregation over the table.
    """
    fields = [f for f in df.schema
              if isinstance(f.dataType, (T.NumericType, T.StringType))]
    aggs = []
    for i, f in enumerate(fields):
        c = F.col(f.name)
        is_text = isinstance(f.dataType, T.StringType)
        number = c.try_cast("double") if is_text else c.cast("double")
        nothing, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
        aggs += [F.count(c).alias(f"n{i}"), F.avg(number).alias(f"mean{i}"),
                 F.stddev(number).alias(f"sd{i}"),
                 (nothing if is_text else F.min(number)).alias(f"lo{i}"),
                 (nothing if is_text else F.max(number)).alias(f"hi{i}"),
                 (F.min(c) if is_text else no_text).alias(f"lot{i}"),
                 (F.max(c) if is_text else no_text).alias(f"hit{i}")]
    rows = [F.struct(F.lit(f.name).alias("column"), F.col(f"n{i}").alias("count"),
                     F.col(f"mean{i}").alias("mean"), F.col(f"sd{i}").alias("stddev"),
                     F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value"),
                     F.col(f"lot{i}").alias("min_text"), F.col(f"hit{i}").alias("max_text"))
            for i, f in enumerate(fields)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))
