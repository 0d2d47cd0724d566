"""The whole analysis in one run: every question, each result written to a folder."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame

from cellmob.operators.arrivals import trails_ending_within
from cellmob.operators.crowd import cell_crowd, cells_of, knn_features
from cellmob.operators.distance import (
    distance_cume_dist, distance_metadata, distance_quantiles, longest_ranges, trails_of)
from cellmob.operators.events import (
    hour_frames, profile, reduce_events, unique_cells, within_radius)
from cellmob.operators.extent import daily_ranges
from cellmob.operators.holding import hold
from cellmob.operators.neighbours import nearest_cells
from cellmob.operators.predict import MODELS, FittedModel, fit, prepared
from cellmob.schema import AIRPORT, INNER_CITY, OUTER_CITY, SUBSCRIBER_DAY, Area
from cellmob.sources import write_csv

AREAS = {"outer_city": OUTER_CITY, "inner_city": INNER_CITY, "airport": AIRPORT}
PARTS = ("profiles", "cells", "distances", "longest_paths", "airport", "crowd", "prediction")


def run(raw: DataFrame, out: str, parts: Collection[str] = PARTS, area: Area | None = None,
        day_format: str = "MM.dd", k_longest: int = 5, k_neighbours: int = 3,
        lag_mode: str = "global", models: Collection[str] = tuple(MODELS),
        single_file: bool = False,
        write: Callable[..., None] = write_csv) -> dict[str, FittedModel]:
    """Answer the chosen ``parts`` from raw events and write each result below ``out``.

    Tables that several answers need are computed once and held. ``area`` restricts
    everything but the profile of the raw events to a circle. Results are sorted as far
    as a report needs it. Returns the fitted models; their predictions were of the held
    table and cannot be read any more, apply ``pipeline`` to a table instead.
    """
    unknown = set(parts) - set(PARTS)
    if unknown:
        raise ValueError(f"unknown parts {sorted(unknown)}; there are {PARTS}")
    fitted: dict[str, FittedModel] = {}
    order = [*SUBSCRIBER_DAY, "timestamp"]

    def save(df: DataFrame, name: str, *order_by: str) -> None:
        write(df, f"{out}/{name}", order_by=order_by or None, single_file=single_file)

    with hold(reduce_events(raw, area, day_format), cut=True) as events:
        if "profiles" in parts:
            save(profile(raw), "profiles/original")
            save(profile(events), "profiles/reduced")
            for name, circle in AREAS.items():
                save(profile(within_radius(events, circle)), f"profiles/{name}")

        if "cells" in parts:
            save(unique_cells(events), "cells")

        if "distances" in parts or "longest_paths" in parts:
            with hold(daily_ranges(events)) as extents:
                if "distances" in parts:
                    save(distance_metadata(extents), "metadata", "dataset")
                    save(distance_quantiles(extents), "quantiles", "dataset", "quantile")
                    save(distance_cume_dist(extents), "cume_dist", "dataset", "haversine")
                if "longest_paths" in parts:
                    save(trails_of(events, longest_ranges(extents, k_longest), "events")
                         .repartition(*order), "longest_paths", *order)

        if "airport" in parts:
            # an exchange before the sort, which else reads the events once more to sample them
            save(trails_ending_within(events).repartition(*order), "airport", *order)

        if "crowd" in parts or "prediction" in parts:
            with hold(cell_crowd(hour_frames(events))) as crowd:
                if "crowd" in parts:
                    save(crowd, "crowd", "dataset", "dataframe")
                if "prediction" in parts:
                    neighbours = nearest_cells(cells_of(crowd), k_neighbours)
                    features = knn_features(crowd, neighbours, lag_mode)
                    with hold(features, cut=True) as table, prepared(table) as rows:
                        for name in models:
                            fitted[name] = model = fit(name, rows)
                            save(model.metrics(), f"prediction/{name}")
                            save(model.details(raw.sparkSession), f"prediction_details/{name}")
                            if model.has_residuals:
                                save(model.residuals(), f"prediction_residuals/{name}")
    return fitted
