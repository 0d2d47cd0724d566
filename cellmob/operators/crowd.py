"""Crowd per day, hour and tower, and the feature table for its prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellmob.functions import weighted_crowd
from cellmob.schema import CELL, FRAME, FRAME_CELL, KNN_FEATURE


# Bands per degree of latitude.
_BANDS = 64


def cell_crowd(frames: DataFrame) -> DataFrame:
    """Number of events (not of subscribers) per day, hour and tower; a row without
    coordinates has no tower."""
    # Coalesced, the keys are known not to be null: joins then add no null checks to some
    # uses of the table. The filter is always true, and for it the count stays in all uses.
    # So these share the scan and the shuffle.
    known = frames.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    known = known.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in CELL})
    return known.groupBy(*FRAME_CELL).agg(F.count("*").alias("crowd")).filter("crowd > 0")


def cells_of(crowd: DataFrame) -> DataFrame:
    """Distinct towers of a crowd table."""
    return crowd.select(*CELL).distinct()


def lag_crowd(crowd: DataFrame, mode: str = "global") -> DataFrame:
    """Adds ``lastFrameCrowd``.

    ``global``: the crowd of the row before in the order day, hour, lat, lng, which
    mostly is another tower of the same hour; 0 for the very first row.
    ``per_cell``: the crowd of the same tower in the frame before in which it was seen.
    """
    if mode == "per_cell":
        # A tower has at most one row per hour of the year.
        before = W.partitionBy(*CELL).orderBy(*FRAME)
        return crowd.withColumn("lastFrameCrowd", F.lag("crowd", 1, 0).over(before))
    if mode != "global":
        raise ValueError(f"mode must be 'global' or 'per_cell', not {mode!r}")
    # One ordered window would put all rows into one task. So look back inside bands of
    # latitude of a frame (some 1.7 km high), and only the first row of a band looks at the
    # last one of the band before. The ends of bands are ordered inside a day, at most
    # 24 * 183 * _BANDS of them, and only the first band of a day looks at the day before:
    # one task sees a row per day.
    keys = [*FRAME, "_band"]
    band = F.floor(F.least(F.greatest(F.col("lat"), F.lit(-91.0)), F.lit(91.0)) * _BANDS)
    banded = crowd.withColumn("_band", F.coalesce(band.cast("int"), F.lit(0)))
    ends = (banded.groupBy(*keys).agg(F.max_by("crowd", F.struct(*CELL)).alias("_last"))
            .filter(F.col("_last").isNotNull()))  # kept in all uses, as in cell_crowd
    days = (ends.groupBy("dataset").agg(
        F.max_by("_last", F.struct("dataframe", "_band")).alias("_end"))
        .withColumn("_day_before", F.lag("_end", 1, 0).over(W.orderBy("dataset"))).drop("_end"))
    in_day = W.partitionBy("dataset").orderBy("dataframe", "_band")
    ends = (ends.withColumn("_before", F.lag("_last").over(in_day)).join(days, "dataset")
            .select(*keys, F.coalesce("_before", "_day_before").alias("_before")))
    inside = F.lag("crowd").over(W.partitionBy(*keys).orderBy(*CELL))
    return (banded.withColumn("_inside", inside).join(ends, keys)
            .withColumn("lastFrameCrowd", F.coalesce("_inside", "_before"))
            .select(*crowd.columns, "lastFrameCrowd"))


def knn_features(crowd: DataFrame, neighbours: DataFrame, mode: str = "global",
                 dedup: bool = False) -> DataFrame:
    """Crowd rows with statistics of the crowd at their neighbours in the same frame.

    A row is repeated once per neighbour that was seen in its frame (``dedup=True``:
    kept once) and vanishes if there was none. ``knnClosest`` is the distance of the
    farthest such neighbour, whatever its name says.

    The neighbours' crowd is aggregated to the tower first, and the repetition comes
    back from the count, so the repeated rows are never shuffled.
    """
    theirs = crowd.select(*FRAME, F.col("lat").alias("oLat"), F.col("lng").alias("oLng"),
                          F.col("crowd").alias("oCrowd"))
    stats = (theirs.join(neighbours, ["oLat", "oLng"]).groupBy(*FRAME_CELL)
             .agg(F.min("oCrowd").alias("knnMin"), F.sum("oCrowd").alias("knnSum"),
                  F.round(F.avg("oCrowd"), 2).alias("knnAvg"),
                  F.round(F.max("haversine"), 2).alias("knnClosest"),
                  F.count("*").cast("int").alias("_copies")))
    features = lag_crowd(crowd, mode).join(stats, FRAME_CELL)
    if not dedup:
        features = features.withColumn(
            "_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return features.select(*KNN_FEATURE)


def weighted_crowd_of_neighbours(crowd: DataFrame, neighbours: DataFrame) -> DataFrame:
    """``dataset, dataframe, lat, lng, oLat, oLng, weightedCrowd`` of each neighbour of a
    tower that was seen in the same frame."""
    theirs = crowd.select(*FRAME, F.col("lat").alias("oLat"), F.col("lng").alias("oLng"),
                          F.col("crowd").alias("oCrowd"))
    return (crowd.join(neighbours, CELL).join(theirs, [*FRAME, "oLat", "oLng"])
            .select(*FRAME_CELL, "oLat", "oLng",
                    weighted_crowd("oCrowd", "haversine").alias("weightedCrowd")))
