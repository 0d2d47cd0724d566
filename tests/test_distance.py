import numpy as np
import pytest
from pyspark.sql import functions as F

import plain
from cellmob.operators import distance as D
from cellmob.operators import extent as E
from cellmob.operators.extent import daily_extent, daily_ranges

EXTENT = "dataset string, subscriber string, haversine double"
VISIT = "dataset string, subscriber string, lat double, lng double"
rng = np.random.default_rng(11)


def extents(spark, days):
    """``{day: values}`` to a table of one subscriber per value."""
    return spark.createDataFrame(
        [(d, str(i), float(v)) for d, vs in days.items() for i, v in enumerate(vs)], EXTENT)


@pytest.fixture(scope="module")
def some_extents(spark):
    return extents(spark, {f"01.{n:02d}": rng.choice([0.0, 0.5, 1.49, 2.5, 7.77, 7.78], n)
                           for n in (1, 2, 3, 4, 5, 9, 30)}).cache()


def points(n, kind):
    t = np.arange(n) * 2 * np.pi / n
    return {
        "cloud": (47 + rng.normal(size=n) * 0.2, 19 + rng.normal(size=n) * 0.3),
        "square": (47 + rng.random(n).round(2), 19 + rng.random(n).round(2)),
        "circle": (47 + 0.2 * np.sin(t), 19 + 0.3 * np.cos(t)),
        "meridian": (47 + np.arange(n) * 0.01, np.full(n, 19.0)),
        "parallel": (np.full(n, 47.0), 19 + np.arange(n) * 0.01),
        "grid": (47 + np.arange(n) // 20 * 0.01, 19 + np.arange(n) % 20 * 0.01),
        "continent": (10 + rng.random(n) * 50, 20 + rng.random(n) * 35),
        "globe": (rng.random(n) * 178 - 89, rng.random(n) * 358 - 179),
        "far_outlier": (np.r_[47 + rng.random(n - 1), 1.0], np.r_[19 + rng.random(n - 1), 178.0]),
    }[kind]


KINDS = ["cloud", "square", "circle", "meridian", "parallel", "grid", "continent", "globe",
         "far_outlier"]


@pytest.fixture(scope="module")
def large_days(spark):
    rows = set()
    for kind in KINDS:
        lat, lng = points(300, kind)
        rows |= {("01.01", kind, float(a), float(b)) for a, b in zip(lat, lng)}
    rows |= {("01.01", "small", 47.0 + i, 19.0) for i in range(5)} | {("01.02", "cloud", 47.0, 19.0)}
    return spark.createDataFrame(sorted(rows), VISIT).cache()


@pytest.mark.parametrize("few,buckets", [(64, 64), (16, 4), (2, 3), (299, 1), (10**6, 1)])
def test_reduction_keeps_the_extent(large_days, few, buckets):
    got = daily_extent(large_days, few_towers=few, buckets=buckets).collect()
    want = plain.extent(large_days)
    assert {(r.dataset, r.subscriber): r.haversine for r in got} == want and len(got) == len(want)


def very_large(n):
    t = np.arange(n) * np.pi / n
    return {
        "globe": np.c_[np.degrees(np.arcsin(rng.random(n) * 2 - 1)), rng.random(n) * 360 - 180],
        "arc": np.c_[47 + 0.2 * np.sin(t), 19 + 0.3 * np.cos(t)],
        "ring": np.c_[47 + 0.2 * np.sin(2 * t), 19 + 0.3 * np.cos(2 * t)],
        "city_and_one": np.r_[47 + rng.normal(size=(n - 1, 2)) * 0.05, [[-40.0, 170.0]]],
        "two_cities": np.r_[47 + rng.normal(size=(n // 2, 2)) * 0.05, [60, 10] + rng.normal(size=(n // 2, 2)) * 0.05],
    }


def test_very_large_days_of_any_shape(spark):
    days = {name: np.unique(x, axis=0) for name, x in very_large(20_000).items()}
    df = spark.createDataFrame([("01.01", name, float(a), float(b)) for name, x in days.items() for a, b in x], VISIT)
    got = daily_ranges(df)
    assert {r.subscriber: (r.haversine, r.events) for r in got.collect()} == {
        name: (plain.farthest(x), len(x)) for name, x in days.items()}


def test_a_row_of_a_large_day_stays_small(spark, monkeypatch):
    x = very_large(20_000)["globe"]
    df = spark.createDataFrame([("01.01", "a", float(a), float(b)) for a, b in x], VISIT)
    held = {}

    def many(parts, large):
        held.update(parts=parts, large=large)
        return real(parts, large)

    real = E._many
    monkeypatch.setattr(E, "_many", many)
    daily_ranges(df)
    size = F.max(F.size("points"))
    assert held["large"].agg(size).first()[0] <= E.BUCKETS * E.FEW_TOWERS
    assert held["parts"].agg(size).first()[0] <= 2 * 20_000 / E.BUCKETS


def test_weights_for_trails_are_event_counts(spark):
    rows = [("01.01", "a", 47.0, 19.0)] * 5 + [("01.01", "b", 47.0 + i % 90 * 0.01, 19.0) for i in range(300)]
    got = {r.subscriber: r.events for r in daily_ranges(spark.createDataFrame(rows, VISIT)).collect()}
    assert got == {"a": 5, "b": 300}


def test_extent_is_no_path_length(spark):
    day = [("01.01", "a", 47.0, 19.0), ("01.01", "a", 47.1, 19.0), ("01.01", "a", 47.05, 19.0),
           ("01.02", "a", 47.0, 19.0)]
    got = {r.dataset: r.haversine for r in daily_extent(spark.createDataFrame(day, VISIT)).collect()}
    assert got == {"01.01": 11.12, "01.02": 0.0}


@pytest.mark.parametrize("parts", [1, 3, 4, 10])
def test_quantiles_equal_ntile(some_extents, parts):
    got = D.distance_quantiles(some_extents, parts=parts)
    assert plain.rows(got) == plain.rows(plain.quantiles(some_extents, parts))


def test_quantiles_of_all_days(some_extents):
    one = some_extents.withColumn("dataset", F.lit("1"))
    got = D.distance_quantiles(some_extents, by_day=False)
    assert got.columns == ["quantile", "haversine"]
    assert plain.rows(got) == plain.rows(plain.quantiles(one).drop("dataset"))


def test_short_days_have_fewer_quantiles(spark):
    got = D.distance_quantiles(extents(spark, {"01.01": [1], "01.02": [3, 2], "01.03": []}))
    assert plain.rows(got) == [("01.01", 1.0, 1), ("01.02", 2.0, 1), ("01.02", 3.0, 2)]


def test_cume_dist_equals_window(some_extents):
    assert plain.rows(D.distance_cume_dist(some_extents)) == plain.rows(plain.cume_dist(some_extents))
    one = some_extents.withColumn("dataset", F.lit("1"))
    assert plain.rows(D.distance_cume_dist(some_extents, by_day=False)) == plain.rows(plain.cume_dist(one))


def test_metadata(spark):
    got = D.distance_metadata(extents(spark, {"01.01": [0, 1, 5]})).first()
    assert tuple(got) == ("01.01", 3, 0.0, 5.0, 2.0)


@pytest.mark.parametrize("k", [1, 2, 5, 100])
def test_longest_paths_keep_ties(some_extents, k):
    assert plain.rows(D.longest_paths(some_extents, k)) == plain.rows(plain.longest(some_extents, k))


def test_six_tie_at_the_top(spark):
    assert D.longest_paths(extents(spark, {"01.01": [9.5] * 6 + [9.49]}), 5).count() == 6
    assert D.longest_paths(extents(spark, {"01.01": [9.5] * 4 + [9.49] * 3}), 5).count() == 7
