"""Daily extent: the largest distance between two towers of a subscriber-day.

The few towers that an ordinary subscriber meets are compared pair by pair, in one row. A
day with many towers (a gateway, an "unknown" id) is never gathered. Its towers become
points on the unit sphere and fall into cubes:

1. The points that lie farthest out in some fixed directions give a lower bound of the
   extent, mostly a tight one.
2. Pairs of cubes stay only if two points of theirs can be as far apart as this bound: by
   the distance of the cubes, and, near half the globe, where distances hardly differ, by
   that of one cube from the point opposite to the other.
3. Cubes with a side of an eighth of the extent that stay are cut into such of 1/128. Then
   the towers of the pairs that are left are compared.

Any shape of day is exact, and pairs of cubes, not days, are the unit of work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmob.functions.geo import chord_sine_to_km
from cellmob.operators.skew import spread_of
from cellmob.schema import CELL, SUBSCRIBER_DAY

# Up to this many towers of a day are compared pair by pair in one row.
FEW_TOWERS = 64
# The towers of a day are gathered in this many parts first; a larger part than FEW_TOWERS
# adds only its outermost towers to the row of the day, which thus holds at most
# BUCKETS * FEW_TOWERS.
BUCKETS = 64

# Sides of the cubes, in powers of two of the extent.
_SIDES = (-3, -7)
_XYZ = ("x", "y", "z")
# Directions: the axes, face and space diagonals.
_DIRECTIONS = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)
               if (a, b, c) > (0, 0, 0)]
# Far above the rounding of coordinates on the unit sphere, far below a millimetre.
_SLACK = 1e-12


def _sine(p: str, q: str) -> str:
    """Half the chord, for structs or aliases with lat, lng and cos."""
    return f"""sqrt(pow(sin(radians({q}.lat - {p}.lat) / 2), 2D)
        + pow(sin(radians({q}.lng - {p}.lng) / 2), 2D) * {p}.cos * {q}.cos)"""


def _largest_sine(points: str) -> Column:
    """Largest half chord over all ordered pairs, as both directions may round apart."""
    return F.expr(f"""transform(
        array(transform({points}, p -> named_struct(
            'lat', p.lat, 'lng', p.lng, 'cos', cos(radians(p.lat))))),
        ps -> aggregate(ps, 0D, (best, p) -> greatest(best, aggregate(
            ps, 0D, (far, q) -> greatest(far, {_sine('p', 'q')})))))[0]""")


def _outermost(points: str) -> Column:
    """Of an array of (lat, lng) those that lie farthest in each direction and against it."""
    ends = ", ".join(
        f"{f}(transform(ps, p -> named_struct('d', {a} * p.x + {b} * p.y + {c} * p.z, 'p', p))).p"
        for a, b, c in _DIRECTIONS for f in ("array_min", "array_max"))
    return F.expr(f"""transform(
        array(transform({points}, p -> named_struct(
            'lat', p.lat, 'lng', p.lng, 'x', cos(radians(p.lat)) * cos(radians(p.lng)),
            'y', cos(radians(p.lat)) * sin(radians(p.lng)), 'z', sin(radians(p.lat))))),
        ps -> transform(array_distinct(array({ends})),
                        p -> named_struct('lat', p.lat, 'lng', p.lng)))[0]""")


def _many(parts: DataFrame, large: DataFrame) -> DataFrame:
    """``dataset, subscriber, events, _sine`` of days with many towers."""
    lat, lng = F.radians("lat"), F.radians("lng")
    xyz = {"x": F.cos(lat) * F.cos(lng), "y": F.cos(lat) * F.sin(lng), "z": F.sin(lat)}
    bounds = (large.select(*SUBSCRIBER_DAY, "events", _outermost("points").alias("_out"))
              .select(*SUBSCRIBER_DAY, "events", (2 * _largest_sine("_out")).alias("_low"))
              .withColumn("_power", F.floor(F.log2(F.greatest("_low", F.lit(1e-9))))))
    day = [*SUBSCRIBER_DAY, "events", "_low", "_power"]
    cubes = {f"c{n}": F.struct(*(
        F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_power") + side)).alias(c) for c in _XYZ))
        for n, side in enumerate(_SIDES)}
    points = (parts.select(*SUBSCRIBER_DAY, "points").join(bounds, SUBSCRIBER_DAY)
              .select(*day, F.inline("points")).withColumns(xyz).withColumns(cubes)
              .withColumn("p", F.struct(*CELL, F.cos(lat).alias("cos"))))

    # a day has at most some hundreds of the large cubes, and their pairs fit a row
    top = points.groupBy(*day).agg(F.collect_set("c0").alias("_cubes"))
    pairs = _reaching(top.withColumn("a", F.explode("_cubes")).withColumn("b", F.explode("_cubes"))
                      .drop("_cubes"), _SIDES[0])
    finer = points.select(*SUBSCRIBER_DAY, "c0", "c1").distinct()
    pairs = _reaching(_inside(_inside(pairs, finer, "a", "c0", "c1"), finer, "b", "c0", "c1"),
                      _SIDES[1])
    towers = points.select(*SUBSCRIBER_DAY, "c1", "p")
    pairs = _inside(_inside(pairs, towers, "a", "c1", "p"), towers, "b", "c1", "p")
    sine = F.greatest(F.expr(_sine("a", "b")), F.expr(_sine("b", "a")))
    return pairs.groupBy(*SUBSCRIBER_DAY, "events").agg(F.max(sine).alias("_sine"))


def _inside(pairs: DataFrame, cubes: DataFrame, side: str, outer: str, inner: str) -> DataFrame:
    """Cubes on one side of the pairs replaced by what is inside them."""
    finer = cubes.select(*SUBSCRIBER_DAY, F.col(outer).alias(side), F.col(inner).alias("_finer"))
    return (pairs.join(finer, [*SUBSCRIBER_DAY, side])
            .drop(side).withColumnRenamed("_finer", side))


def _reaching(pairs: DataFrame, side: int) -> DataFrame:
    """Pairs of cubes that can hold two points at least ``_low`` apart, each pair once."""
    size = F.pow(F.lit(2.0), F.col("_power") + side)

    def norm(sign: int) -> Column:
        total = F.lit(0.0)
        for c in _XYZ:
            middle = (F.col("a")[c] + F.lit(0.5)) + sign * (F.col("b")[c] + F.lit(0.5))
            total = total + middle * middle
        return F.sqrt(total) * size

    wide = F.lit(3.0 ** 0.5) * size  # two half diagonals
    opposite = F.sqrt(F.greatest(4 - F.col("_low") * F.col("_low"), F.lit(0.0))) + 1e-6
    return pairs.filter((F.col("a") <= F.col("b")) & (norm(-1) + wide >= F.col("_low") - _SLACK)
                        & (norm(1) - wide <= opposite))


def daily_ranges(events: DataFrame, few_towers: int = FEW_TOWERS,
                 buckets: int = BUCKETS) -> DataFrame:
    """``dataset, subscriber, haversine, events``: extent in km, rounded to two digits, and
    the number of rows. ``events`` may be events or visits; repeated towers do not matter."""
    parts = (events.groupBy(*SUBSCRIBER_DAY, spread_of(CELL, buckets).alias("_bucket"))
             .agg(F.collect_set(F.struct(*CELL)).alias("points"), F.count("*").alias("_n"))
             # always true: the counts stay in all uses of both tables, which thus are alike
             # up to their shuffles, and events are read once
             .filter("_n > 0"))
    size = F.size("points")
    days = (parts.groupBy(*SUBSCRIBER_DAY).agg(
        F.sum("_n").alias("events"), F.sum(size).alias("_towers"),
        F.flatten(F.collect_list(F.when(size <= few_towers, F.col("points"))
                                 .otherwise(_outermost("points")))).alias("points"))
        .filter("events > 0"))
    small = F.col("_towers") <= few_towers
    few = days.filter(small).select(*SUBSCRIBER_DAY, "events", _largest_sine("points").alias("_sine"))
    many = _many(parts, days.filter(~small))
    return few.unionByName(many).select(
        *SUBSCRIBER_DAY, F.round(chord_sine_to_km(F.col("_sine")), 2).alias("haversine"), "events")


def daily_extent(visits: DataFrame, few_towers: int = FEW_TOWERS,
                 buckets: int = BUCKETS) -> DataFrame:
    """``dataset, subscriber, haversine``: extent in km, rounded to two digits.

    ``visits`` may be events as well. A day with one tower has 0.0. The rounding is
    monotone, so rounding the largest distance equals taking the largest of the rounded ones.
    """
    return daily_ranges(visits, few_towers, buckets).drop("events")
