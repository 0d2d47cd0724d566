"""Where a subscriber's day ended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmob.operators.distance import trails_of
from cellmob.operators.events import within_radius
from cellmob.schema import AIRPORT, CELL, SUBSCRIBER_DAY, Area


def last_events(events: DataFrame) -> DataFrame:
    """Last event of each subscriber-day, with the day's number of events.

    Of several events at the last moment the one with the greatest ``lat``, then
    ``lng``, counts. An aggregate, not a window: it combines before the shuffle, so a
    subscriber-day of any size costs one row per task.
    """
    return (events.groupBy(*SUBSCRIBER_DAY)
            .agg(F.max(F.struct("timestamp", *CELL)).alias("last"),
                 F.count("timestamp").alias("events"))
            .select(*SUBSCRIBER_DAY, "last.*", "events"))


def days_ending_within(events: DataFrame, area: Area = AIRPORT,
                       min_events: int = 2) -> DataFrame:
    """``dataset, subscriber, events`` of the days whose last event is in ``area``.

    Days with fewer than ``min_events`` events do not count: the default leaves out
    singletons, as ``drop_singletons`` before would, without its join.
    """
    return (within_radius(last_events(events), area)
            .filter(F.col("events") >= min_events)
            .select(*SUBSCRIBER_DAY, "events"))


def trails_ending_within(events: DataFrame, area: Area = AIRPORT,
                         min_events: int = 2) -> DataFrame:
    """All events of the subscriber-days that ended in ``area``."""
    return trails_of(events, days_ending_within(events, area, min_events), weight="events")
