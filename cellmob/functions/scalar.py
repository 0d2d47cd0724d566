"""Time keys and small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_key(timestamp="timestamp", day_format="MM.dd") -> Column:
    """The day as a string. The default has no year: equal dates of two years meet."""
    return F.date_format(timestamp, day_format)


def hour_frame(timestamp="timestamp") -> Column:
    """Hour of the day, 0 to 23."""
    return F.hour(timestamp).cast("int")


def whole_km(km) -> Column:
    """Nearest whole number; halves go up."""
    return F.floor(F.col(km) + F.lit(0.5)).cast("int")


def weighted_crowd(crowd, km) -> Column:
    """Crowd per km of distance; null at distance zero (rounded distances reach 0.0)."""
    return F.try_divide(F.col(crowd).cast("double"), F.col(km))
