"""What the physical plans must and must not contain."""

import pytest

import __spark_entry__ as entry
from compare import reference_queries
from cellmob.operators.events import reduce_events
from cellmob.schema import AIRPORT, RAW_EVENT
from cellmob.sources import read_events_parquet

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in reference_queries(entry) if n in entry.oracle_sql()])
def test_no_pairs_and_no_python(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas", "InArrow"):
        assert bad not in text


def test_area_and_columns_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10000)
    spark.createDataFrame([], RAW_EVENT).write.parquet(str(tmp_path / "p"))
    text = plan(reduce_events(read_events_parquet(spark, str(tmp_path / "p")), AIRPORT))
    scan = text[text.index("PushedFilters"):]
    assert "GreaterThan(lat,0.0)" in scan and "IsNotNull(subscriber)" in scan
    assert "GreaterThanOrEqual(lat,47.4" in scan and "LessThanOrEqual(lng,19.2" in scan
    assert "ReadSchema: struct<subscriber:string,timestamp:timestamp,lat:double,lng:double>" in scan


def test_unordered_tables_are_not_in_one_task(spark):
    """Only totals, summed up per task before, meet in one task."""
    for name in ("daily_extent", "nearest_cells", "longest_paths", "airport_trails", "cell_crowd"):
        lines = plan(entry.queries()[name](spark, SF_DIR)).splitlines()
        below = [lines[i + 1] for i, x in enumerate(lines) if "Exchange SinglePartition" in x]
        assert all("HashAggregate(keys=[], functions=[partial_" in x for x in below)


def rows_read(spark, name):
    """Rows that all stages of a run of the query read from files, sampling included."""
    tracker, group = spark.sparkContext.statusTracker(), f"rows-of-{name}"
    spark.sparkContext.setJobGroup(group, name)
    entry.queries()[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(s).inputRecords() for s in stages
               if tracker.getStageInfo(s) is not None)


@pytest.mark.parametrize("name,times", [
    ("distance_metadata", 1), ("cell_crowd", 1), ("knn_features", 1), ("weighted_crowd", 1),
    ("feature_vectors", 3), ("evaluate", 1), ("split_by_key", 1), ("longest_path_trails", 2),
    ("airport_trails", 2), ("drop_singletons", 2)])
def test_events_are_read_so_many_times(spark, name, times):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    kept = 0
    if name == "longest_path_trails":  # the chosen days, read by the filter and by the join
        kept = 2 * entry.queries()["longest_paths"](spark, SF_DIR).count()
    assert rows_read(spark, name) <= times * events + kept
