import pytest
from pyspark.sql import functions as F

import plain
from cellmob.operators import skew as S


@pytest.fixture(scope="module")
def rows(spark):
    hot = spark.range(3000).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    rest = spark.range(3000).select((F.col("id") % 50).cast("string").alias("k"), F.col("id").alias("v"))
    return hot.union(rest).cache()


def keys(spark, *names):
    return spark.createDataFrame([(n, 3000 if n == "hot" else 60) for n in names], "k string, n bigint")


@pytest.mark.parametrize("join", [S.semi_join_spread, S.semi_join_selective])
def test_semi_joins_are_exact(spark, rows, join):
    some = keys(spark, "hot", "7", "8", "absent")
    want = rows.filter(F.col("k").isin("hot", "7", "8"))
    got = join(rows, some, ["k"], ["v"], "n", heavy_rows=1000)
    assert got.columns == rows.columns
    assert plain.rows(got) == plain.rows(want)
    assert join(rows, keys(spark, "absent"), ["k"], ["v"], "n").count() == 0


def test_hot_key_is_spread_evenly(rows):
    sizes = [r["count"] for r in rows.filter("k = 'hot'").groupBy(S.spread_of(["v"])).count().collect()]
    assert len(sizes) == S.SPREAD and max(sizes) < 3 * 3000 / S.SPREAD


def test_every_heavy_key_is_split_by_its_weight(spark):
    df = spark.createDataFrame([(f"k{i}", 10 + i % 7 * 10) for i in range(3000)] + [("top", 10_000)],
                               "k string, n bigint")
    parts = {r.k: r._parts for r in S.heavy_keys(df, ["k"], "n", heavy_rows=20).collect()}
    assert parts == {**{f"k{i}": -(-(10 + i % 7 * 10) // 20) for i in range(3000) if i % 7 > 1}, "top": 500}


def test_heavy_keys_are_few_by_proof(spark, monkeypatch):
    monkeypatch.setattr(S, "HEAVY_SHARES", 10)
    df = spark.createDataFrame([(f"k{i}", i) for i in range(100)], "k string, n bigint")
    got = S.heavy_keys(df, ["k"], "n", heavy_rows=1).collect()
    assert len(got) < 10 and sum(r._parts for r in got) < 20
    even = spark.createDataFrame([(f"k{i}", 5) for i in range(100)], "k string, n bigint")
    assert S.heavy_keys(even, ["k"], "n", heavy_rows=1).collect() == []


def test_rows_of_a_split_key_reach_all_its_parts(spark, rows):
    some = keys(spark, "hot", "7")
    heavy = S.heavy_keys(some, ["k"], "n", heavy_rows=300)
    split, copies = S.split_keys(rows, some.select("k"), heavy, ["k"], ["v"])
    sizes = {(r.k, r._spread): r["count"] for r in split.groupBy("k", "_spread").count().collect()}
    assert len([k for k in sizes if k[0] == "hot"]) == 10 and sizes["7", 0] == 60
    assert sorted(r._spread for r in copies.filter("k = 'hot'").collect()) == list(range(10))


def test_top_k_with_everything_tied(spark):
    df = spark.range(5000).select(F.lit("d").alias("g"), F.col("id").cast("string").alias("s"),
                                  F.lit(1.0).alias("v"))
    assert S.top_k_with_ties(df, "g", "v", 3, ["s"]).count() == 5000
