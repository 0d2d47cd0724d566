"""Record schemas and the named areas."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

RAW_EVENT = T.StructType([
    T.StructField("callId", T.IntegerType()),
    T.StructField("subscriber", T.StringType()),
    T.StructField("ni", T.StringType()),
    T.StructField("dt", T.StringType()),
    T.StructField("TAC", T.StringType()),
    T.StructField("eventType", T.IntegerType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("cellId", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lng", T.DoubleType()),
])

EVENT = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("subscriber", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lng", T.DoubleType()),
])

# Column lists of the derived tables, in output order.
SUBSCRIBER_DAY = ["dataset", "subscriber"]
CELL = ["lat", "lng"]
VISIT = SUBSCRIBER_DAY + CELL
FRAME = ["dataset", "dataframe"]
FRAME_CELL = FRAME + CELL
NEIGHBOUR = ["lat", "lng", "oLat", "oLng", "haversine"]
KNN_FEATURE = FRAME_CELL + [
    "crowd", "lastFrameCrowd", "knnMin", "knnSum", "knnAvg", "knnClosest",
]


class Area(NamedTuple):
    """A circle on the earth's surface; the rim belongs to it."""

    lat: float
    lng: float
    radius_km: float


# Centres and radii of the three areas users ask about.
OUTER_CITY = Area(47.49678009, 19.0786338, 20.0)
INNER_CITY = Area(47.4963477, 19.0402499, 2.5)
AIRPORT = Area(47.4353966, 19.2344533, 3.0)
