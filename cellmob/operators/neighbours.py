"""The k nearest towers of each tower, ties included, without comparing all pairs.

Towers become points on the unit sphere, where the straight chord grows with the
great-circle distance, and the space is cut into nested cubes of halving size. A cube is
*full* if it holds more than k towers.

1. For each tower take its smallest full cube. It holds k other towers, so the k-th
   neighbour is no farther than the farthest of any k + 1 members of the cube.
2. Ask all cubes of that size which this distance reaches; there are at most 125.
3. Rank what they hold by the rounded distance.

Cubes adapt to the density down to a side of 49 m, so a crowded place costs no more than an
empty one until towers stand that close, and no step needs a guess, a cap or a second try.
Towers less than 5 m apart have a rounded distance of 0.00; all that tie are neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellmob.functions.geo import EARTH_RADIUS_KM, cos_degrees, haversine
from cellmob.operators.skew import heavy_keys, split_keys
from cellmob.schema import CELL, NEIGHBOUR

# Cube sides are 2**(level - _FINEST) earth radii: 49 m at level 0; at the top level
# the cubes around the origin hold the whole globe.
_FINEST = 17
_TOP = 18
_OFFSET = 1 << (_FINEST + 1)  # positions are within +-(2**17 + 2)
# Towers that tie after rounding to 0.01 km are at most 0.01 km farther; 1 m of reserve.
_TIE_SLACK_KM = 0.011
# Cubes with more towers than this are read by several tasks.
_HEAVY_CUBE = 20_000


def _cube_id(level: Column, *xyz: Column) -> Column:
    """One long: 5 bits of level, three times 19 bits of position."""
    key = level.cast("long")
    for c in xyz:
        key = key * F.lit(2 * _OFFSET) + (c + F.lit(_OFFSET))
    # Never null, and coalesced the optimizer knows: else joins add a null check to some
    # uses of a table only, which then cannot share a shuffle with the others.
    return F.coalesce(key, F.lit(-1))


def _position(coordinate: Column, level: Column) -> Column:
    # a power of two: exact, so cubes of all levels nest
    return F.floor(coordinate * F.pow(F.lit(2.0), F.lit(_FINEST) - level))


def nearest_cells(cells: DataFrame, k: int = 3) -> DataFrame:
    """``lat, lng, oLat, oLng, haversine``: towers whose rank by the distance, rounded
    to two digits, is at most ``k``. ``cells`` are distinct (see ``unique_cells``)."""
    lat, lng = F.col("lat"), F.col("lng")
    cells = cells.filter(lat.isNotNull() & lng.isNotNull())
    points = cells.select(
        *CELL, (cos_degrees(lat) * F.cos(F.radians(lng))).alias("x"),
        (cos_degrees(lat) * F.sin(F.radians(lng))).alias("y"),
        F.sin(F.radians(lat)).alias("z"))
    level = F.col("level")
    xyz = ("x", "y", "z")
    members = (points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(_TOP))))
               .select(*CELL, "level", _cube_id(
                   level, *(_position(F.col(c), level) for c in xyz)).alias("cube")))

    # At most k + 1 members of each cube: enough to see whether it is full.
    some = (members.withColumn("_nr", F.row_number().over(
                W.partitionBy("cube").orderBy(*CELL)))
            .filter(F.col("_nr") <= k + 1)
            .groupBy("cube", "level").agg(F.collect_list(F.struct(*CELL)).alias("some")))
    full = some.filter(F.size("some") == k + 1).select("cube", "some")
    sparse = (some.filter(F.size("some") <= k)
              .select("level", F.inline("some")).groupBy(*CELL)
              .agg(F.max("level").alias("_sparse")))
    homes = (points.join(sparse, [*CELL], "left")
             .withColumn("level", F.least(F.coalesce(F.col("_sparse") + 1, F.lit(0)),
                                          F.lit(_TOP)))
             .withColumn("cube", _cube_id(
                 level, *(_position(F.col(c), level) for c in xyz)))
             .join(full, "cube", "left"))

    # With k towers or fewer no cube is full, and every tower is a neighbour.
    reach = F.coalesce(
        F.aggregate("some", F.lit(0.0), lambda far, q: F.greatest(
            far, haversine(lat, lng, q["lat"], q["lng"]))),
        F.lit(4.0 * EARTH_RADIUS_KM))
    angle = (reach + F.lit(_TIE_SLACK_KM)) / F.lit(2 * EARTH_RADIUS_KM)
    asked = (homes.withColumn("_chord", F.lit(2.0) * F.sin(F.least(angle, F.lit(1.5707963)))
                              + F.lit(1e-7))
             .withColumn("_side", F.pow(F.lit(2.0), level - F.lit(_FINEST)))
             .select(*CELL, *xyz, "level", "_chord", "_side"))
    gap_sq = F.lit(0.0)
    for c in xyz:
        here = _position(F.col(c), level)
        asked = asked.withColumn(f"_{c}", F.explode(F.sequence(here - 2, here + 2)))
        low = F.col(f"_{c}") * F.col("_side")
        gap = F.greatest(low - F.col(c), F.col(c) - (low + F.col("_side")), F.lit(0.0))
        gap_sq = gap_sq + gap * gap
        asked = asked.filter(gap_sq <= F.col("_chord") * F.col("_chord"))
    asked = asked.select(*CELL, _cube_id(
        level, *(F.col(f"_{c}") for c in xyz)).alias("cube"))

    pairs = _join_cubes(asked, members).filter(
        ~((lat == F.col("oLat")) & (lng == F.col("oLng"))))
    near = W.partitionBy(*CELL).orderBy("haversine")
    return (pairs.withColumn("haversine", F.round(
                haversine(lat, lng, F.col("oLat"), F.col("oLng")), 2))
            .withColumn("_rank", F.rank().over(near))
            .filter(F.col("_rank") <= k).select(*NEIGHBOUR))


def _join_cubes(asked: DataFrame, members: DataFrame) -> DataFrame:
    """Towers with the members of the cubes they ask; crowded cubes are split."""
    held = members.select("cube", F.col("lat").alias("oLat"), F.col("lng").alias("oLng"))
    heavy = heavy_keys(held.groupBy("cube").agg(F.count("*").alias("n")), ["cube"], "n", _HEAVY_CUBE)
    held, asked = split_keys(held, asked, heavy, ["cube"], ["oLat", "oLng"])
    return asked.join(held, ["cube", "_spread"])
