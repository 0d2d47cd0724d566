import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain
from cellmob.operators import neighbours as N
from cellmob.operators.crowd import cell_crowd, knn_features, lag_crowd
from cellmob.operators.events import hour_frames, unique_cells
from cellmob.schema import EVENT

rng = np.random.default_rng(23)
CROWD = "dataset string, dataframe int, lat double, lng double, crowd bigint"


def cells(spark, lat, lng):
    return spark.createDataFrame(
        sorted({(float(a), float(b)) for a, b in zip(lat, lng)}), "lat double, lng double")


def layouts():
    n = 250
    yield "city", 47 + rng.random(n) * 0.4, 19 + rng.random(n) * 0.6
    yield "lattice", 47 + np.arange(n) % 16 * 0.02, 19 + np.arange(n) // 16 * 0.03
    yield "crowded", np.r_[47 + rng.random(200) * 1e-3, 46 + rng.random(40) * 3], \
        np.r_[19 + rng.random(200) * 1e-3, 17 + rng.random(40) * 5]
    yield "same_spot", np.r_[47 + np.arange(30) * 1e-6, 48], np.r_[np.full(30, 19.0), 20]
    yield "globe", np.degrees(np.arcsin(rng.random(n) * 2 - 1)), rng.random(n) * 360 - 180
    yield "date_line", rng.random(60) * 2 - 1, np.r_[rng.random(30) * -0.5 + 180, rng.random(30) * 0.5 - 180]
    yield "pole", 90 - rng.random(60), rng.random(60) * 360 - 180
    yield "axes", np.array([0, 0, 0, 0, 90, -90, 0.001]), np.array([0, 90, 180, -90, 0, 0, 0.001])


LAYOUTS = {name: (lat, lng) for name, lat, lng in layouts()}


def pairs(df):
    rows = [tuple(r) for r in df.select("lat", "lng", "oLat", "oLng", "haversine").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("k", [1, 3])
def test_nearest_equals_all_pairs(spark, layout, k):
    df = cells(spark, *LAYOUTS[layout])
    assert pairs(N.nearest_cells(df, k)) == plain.nearest(df, k)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_nearest_of_few_towers(spark, n):
    df = cells(spark, 47 + np.arange(n) * 0.1, 19 + np.arange(n) * 0.2)
    assert pairs(N.nearest_cells(df, 3)) == plain.nearest(df, 3)


def test_crowded_cubes_are_split(spark, monkeypatch):
    monkeypatch.setattr(N, "_HEAVY_CUBE", 5)
    df = cells(spark, *LAYOUTS["crowded"])
    assert pairs(N.nearest_cells(df, 3)) == plain.nearest(df, 3)


def crowd_table(spark, n=400):
    keys = {(f"01.{rng.integers(1, 4):02d}", int(rng.integers(0, 24)),
             float(rng.choice([46.99, 47.0, 47.3, 48.5])), float(rng.choice([18.5, 19.0, 19.2])))
            for _ in range(n)}
    return spark.createDataFrame([(*k, int(rng.integers(1, 9))) for k in sorted(keys)], CROWD)


def test_lag_in_bands_equals_one_window(spark):
    df = crowd_table(spark).cache()
    assert plain.rows(lag_crowd(df)) == plain.rows(plain.lagged(df))


def test_lag_in_one_city(spark):
    """All towers inside a degree, some at the rims of bands, days and hours with few rows."""
    rows = {("01.01" if i % 3 else "01.02", i % 5, 47.0 + i % 40 / 128, 19.0 + i // 40 * 0.01)
            for i in range(900)} | {("01.04", 7, 47.0, 19.0)}
    df = spark.createDataFrame([(*k, n) for n, k in enumerate(sorted(rows), 1)], CROWD).cache()
    assert plain.rows(lag_crowd(df)) == plain.rows(plain.lagged(df))


def test_lag_per_cell(spark):
    df = spark.createDataFrame([("01.01", 10, 47.0, 19.0, 5), ("01.01", 12, 47.0, 19.0, 7),
                                ("01.01", 11, 47.5, 19.0, 9)], CROWD)
    got = {(r.dataframe, r.lat): r.lastFrameCrowd for r in lag_crowd(df, "per_cell").collect()}
    assert got == {(10, 47.0): 0, (12, 47.0): 5, (11, 47.5): 0}
    with pytest.raises(ValueError):
        lag_crowd(df, "other")


def test_features_equal_plain_form(spark):
    crowd = crowd_table(spark).cache()
    near = N.nearest_cells(unique_cells(crowd), 3).cache()
    want = plain.features(crowd, near)
    got = knn_features(crowd, near)
    order = ["dataset", "dataframe", "lat", "lng", "crowd", "lastFrameCrowd",
             "knnMin", "knnSum", "knnAvg", "knnClosest"]
    assert got.count() > knn_features(crowd, near, dedup=True).count()
    assert dict(got.dtypes)["knnMin"] == dict(got.dtypes)["crowd"] == "bigint"
    assert sorted(map(tuple, got.select(order).collect())) == want
    assert sorted(map(tuple, knn_features(crowd, near, dedup=True).select(order).collect())) == sorted(set(want))


def test_absent_neighbour_and_farthest_as_closest(spark):
    hour = lambda h: dt.datetime(2024, 1, 1, h)
    a, b, c = (47.0, 19.0), (47.1, 19.0), (47.3, 19.0)
    ev = spark.createDataFrame(
        [("01.01", "1", hour(10), *a), ("01.01", "1", hour(12), *a), ("01.01", "1", hour(12), *a),
         ("01.01", "2", hour(12), *b), ("01.01", "3", hour(12), *c)], EVENT)
    crowd = cell_crowd(hour_frames(ev))
    assert {(r.dataframe, r.lat): r.crowd for r in crowd.collect()} == {
        (10, 47.0): 1, (12, 47.0): 2, (12, 47.1): 1, (12, 47.3): 1}
    got = knn_features(crowd, N.nearest_cells(unique_cells(ev), 3))
    at_a = got.filter((F.col("lat") == 47.0)).collect()
    assert len(at_a) == 2 and {r.dataframe for r in at_a} == {12}
    r = at_a[0]
    assert (r.crowd, r.lastFrameCrowd, r.knnMin, r.knnSum, r.knnAvg) == (2, 1, 1, 2, 1.0)
    assert r.knnClosest == 33.36
