import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cellmob.functions import haversine, in_area, weighted_crowd, whole_km
from cellmob.operators.events import (
    drop_singletons, hour_frames, profile, profile_typed, reduce_events, unique_cells,
    unique_visits, within_radius)
from cellmob.schema import AIRPORT, RAW_EVENT, Area

NOON = dt.datetime(2024, 3, 1, 12, 30)
NAN = float("nan")


def raw(spark, *rows):
    """Rows of subscriber, timestamp, lat, lng."""
    return spark.createDataFrame(
        [(1, s, "", "", "", 0, t, "c", lat, lng) for s, t, lat, lng in rows], RAW_EVENT)


def test_dirty_rows_go(spark):
    good = ("7", NOON, 47.5, 19.0)
    bad = [("7", NOON, None, 19.0), ("7", NOON, 47.5, None), ("7", NOON, NAN, 19.0),
           ("7", NOON, 47.5, NAN), ("7", NOON, 0.0, 19.0), ("7", NOON, 47.5, 0.0),
           ("7", NOON, -1.0, 19.0), ("7", NOON, 47.5, -1.0), (None, NOON, 47.5, 19.0),
           ("7", None, 47.5, 19.0)]
    out = reduce_events(raw(spark, good, *bad))
    assert out.columns == ["dataset", "subscriber", "timestamp", "lat", "lng"]
    assert [tuple(r) for r in out.collect()] == [("03.01", *good)]


def test_bounds_can_be_lifted(spark):
    df = raw(spark, ("1", NOON, -33.9, -70.6), ("2", NOON, -33.9, NAN))
    assert reduce_events(df).count() == 0
    assert reduce_events(df, min_lat=None, min_lng=None).count() == 1


def test_same_date_of_two_years_is_one_day(spark):
    df = raw(spark, ("1", NOON, 47.5, 19.0), ("1", NOON.replace(year=2023), 47.5, 19.0))
    days = lambda **kw: {r.dataset for r in reduce_events(df, **kw).collect()}
    assert days() == {"03.01"}
    assert days(day_format="yyyy.MM.dd") == {"2023.03.01", "2024.03.01"}


def test_circle_compares_the_unrounded_distance(spark):
    north = lambda km: (AIRPORT.lat + math.degrees(km / 6371), AIRPORT.lng)
    cells = spark.createDataFrame([north(km) for km in (2.999, 3.001, 3.004)], "lat double, lng double")
    assert within_radius(cells, AIRPORT).count() == 1
    rim = spark.createDataFrame([north(3.0)], "lat double, lng double")
    km = rim.select(haversine(F.col("lat"), F.col("lng"), AIRPORT.lat, AIRPORT.lng)).first()[0]
    assert within_radius(rim, Area(AIRPORT.lat, AIRPORT.lng, km)).count() == 1


@pytest.mark.parametrize("area", [AIRPORT, Area(89.9, 10, 50), Area(0, 179.9, 300), Area(-45, -179.99, 20)])
def test_bounding_box_changes_nothing(spark, area):
    d = area.radius_km / 111
    cells = spark.range(4000).select(
        (F.lit(area.lat) + (F.rand(1) - 0.5) * 3 * d).alias("lat"),
        (F.lit(area.lng) + (F.rand(2) - 0.5) * 3 * d).alias("lng"))
    cells = cells.union(cells.select("lat", F.col("lng") + 360)).union(
        cells.select("lat", F.col("lng") - 360)).union(
        cells.select("lat", F.rand(3) * 360 - 180))
    exact = haversine(F.col("lat"), F.col("lng"), area.lat, area.lng) <= area.radius_km
    assert cells.filter(exact).count() > 0
    assert cells.filter(exact != in_area(area)).count() == 0


def test_singletons(spark):
    ev = reduce_events(raw(spark, ("1", NOON, 47.5, 19.0), ("2", NOON, 47.5, 19.0),
                           ("2", NOON, 47.6, 19.0), ("2", NOON.replace(day=2), 47.6, 19.0)))
    assert sorted((r.dataset, r.subscriber, r.lat) for r in drop_singletons(ev).collect()) == [
        ("03.01", "2", 47.5), ("03.01", "2", 47.6)]


def test_frames_keep_every_event(spark):
    ev = reduce_events(raw(spark, *[("1", NOON, 47.5, 19.0)] * 2, ("1", NOON, 47.6, 19.0)))
    assert hour_frames(ev).count() == 3
    assert hour_frames(ev).first().dataframe == 12
    assert unique_cells(ev).count() == unique_visits(ev).count() == 2


def test_profiles_agree(spark):
    ev = reduce_events(raw(spark, ("1", NOON, 47.5, 19.0), ("x", NOON, 47.75, 19.5)))
    text = {r.summary: r for r in profile(ev).collect()}
    assert "timestamp" not in profile(ev).columns
    for r in profile_typed(ev).collect():
        name = r["column"]
        assert text["count"][name] == str(r["count"])
        low = r["min_value"] if r["min_text"] is None else r["min_text"]
        assert text["min"][name] == str(low)
        if r["mean"] is not None:
            assert float(text["mean"][name]) == r["mean"]


def test_whole_km_rounds_halves_up(spark):
    df = spark.createDataFrame([(x,) for x in (0.49, 0.5, 1.5, 2.5)], "km double")
    assert [r[0] for r in df.select(whole_km("km")).collect()] == [0, 1, 2, 3]


def test_weighted_crowd_at_distance_zero(spark):
    df = spark.createDataFrame([(6, 1.5), (6, 0.0)], "crowd bigint, km double")
    assert [r[0] for r in df.select(weighted_crowd("crowd", "km")).collect()] == [4.0, None]
