"""What a user asks for: each question as a plan over clean events, lazy but for the choice
of days in ``longest_path_trails``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cellmob.operators.crowd import (
    cell_crowd, cells_of, knn_features, weighted_crowd_of_neighbours)
from cellmob.operators.distance import (
    distance_cume_dist, distance_metadata, distance_quantiles, longest_ranges, trails_of)
from cellmob.operators.events import hour_frames
from cellmob.operators.extent import daily_extent, daily_ranges
from cellmob.operators.holding import keep
from cellmob.operators.neighbours import nearest_cells
from cellmob.operators.arrivals import trails_ending_within
from cellmob.schema import AIRPORT, SUBSCRIBER_DAY, Area


def _by_time(trails: DataFrame) -> DataFrame:
    # Sorting samples its input first. Behind an exchange it samples the few rows that
    # passed; else it would read all events once more for the sample.
    order = [*SUBSCRIBER_DAY, "timestamp"]
    return trails.repartition(*order).orderBy(*order)


def extents(events: DataFrame) -> DataFrame:
    return daily_extent(events)


def metadata(events: DataFrame) -> DataFrame:
    return distance_metadata(extents(events)).orderBy("dataset")


def quartiles(events: DataFrame, by_day: bool = True) -> DataFrame:
    order = ["dataset", "quantile"] if by_day else ["quantile"]
    return distance_quantiles(extents(events), by_day).orderBy(*order)


def cume_dist(events: DataFrame, by_day: bool = True) -> DataFrame:
    out = distance_cume_dist(extents(events), by_day)
    return out.orderBy("dataset", "haversine") if by_day else out


def longest_path_trails(events: DataFrame, k: int = 5) -> DataFrame:
    """The chosen days are found at once, and the events of them when the result is read:
    else the plan of the extents would stand in it four times."""
    chosen = keep(longest_ranges(daily_ranges(events), k))
    return _by_time(trails_of(events, chosen, "events"))


def airport_trails(events: DataFrame, area: Area = AIRPORT) -> DataFrame:
    return _by_time(trails_ending_within(events, area))


def crowd(events: DataFrame) -> DataFrame:
    """Unsorted, as other questions build on it; ``crowd_series`` is the report."""
    return cell_crowd(hour_frames(events))


def crowd_series(events: DataFrame) -> DataFrame:
    return crowd(events).orderBy("dataset", "dataframe")


def crowd_features(events: DataFrame, k: int = 3, mode: str = "global",
                   dedup: bool = False) -> DataFrame:
    crowd_ = crowd(events)
    return knn_features(crowd_, nearest_cells(cells_of(crowd_), k), mode, dedup)


def weighted_crowds(events: DataFrame, k: int = 3) -> DataFrame:
    crowd_ = crowd(events)
    return weighted_crowd_of_neighbours(crowd_, nearest_cells(cells_of(crowd_), k))
