import datetime as dt
import json

import pytest

from cellmob.operators.predict import MODELS
from cellmob.plans.pipeline import run
from cellmob.schema import RAW_EVENT
from cellmob.sources import FILE_PATTERN, read_events, read_events_parquet, write_csv, write_json
from cellmob.testdata.view import raw_events

HEADER = "callId;subscriber;ni;dt;TAC;eventType;timestamp;cellId;lat;lng"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a_msc_1.gps").write_text(
        HEADER + "\n1;007;n;d;t;2;2024-01-05 10:11:12;c1;47.5;19.25\n"
        "2;008;Győr;d;t;2;no time;c1;47.5;19.25\n", encoding="utf-8")
    (tmp_path / "b_msc_2.gps").write_text(HEADER + "\nx;9;n;d;t;2;2024-01-05 10:11:12;c1;;19.25\n")
    (tmp_path / "other.txt").write_text("nothing\n")
    return tmp_path


def test_read_files_by_pattern(spark, folder):
    for df in (read_events(spark, str(folder), FILE_PATTERN), read_events(spark, f"{folder}/{FILE_PATTERN}")):
        assert df.schema == RAW_EVENT
        got = {r.subscriber: r for r in df.collect()}
        assert set(got) == {"007", "008", "9"}
        assert got["007"].timestamp == dt.datetime(2024, 1, 5, 10, 11, 12) and got["007"].callId == 1
        assert got["008"].timestamp is None and got["008"].ni == "Győr"
        assert got["9"].callId is None and got["9"].lat is None and got["9"].lng == 19.25


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "x_msc_1.gps").write_text(
        "lng;lat;extra;" + HEADER.removesuffix(";lat;lng") + "\n19.0;47.0;?;1;s;;;;0;2024-01-05 10:11:12;c\n")
    r = read_events(spark, str(tmp_path)).first()
    assert (r.lat, r.lng, r.subscriber, r.cellId) == (47.0, 19.0, "s", "c")


def test_missing_and_shifted_columns_fail(spark, folder):
    (folder / "c").mkdir()
    (folder / "c" / "c_msc_1.gps").write_text("lat;lng\n1;2\n")
    with pytest.raises(ValueError, match="callId"):
        read_events(spark, str(folder / "c"))
    (folder / "c_msc_3.gps").write_text("lat;lng;" + HEADER.removesuffix(";lat;lng") + "\n1;2;3;s;;;;0;;c\n")
    with pytest.raises(Exception, match="header"):
        read_events(spark, str(folder), FILE_PATTERN).collect()


def test_parquet(spark, folder, tmp_path):
    df = read_events(spark, str(folder), FILE_PATTERN)
    df.write.parquet(str(tmp_path / "p"))
    assert sorted(read_events_parquet(spark, str(tmp_path / "p")).collect(), key=repr) == sorted(
        df.collect(), key=repr)


def test_writers(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "cast(id % 7 as double) as v").repartition(5)
    out = tmp_path / "out"
    for _ in range(2):  # the second replaces the first
        write_csv(df, str(out), order_by=["v", "id"], single_file=True)
    (part,) = out.glob("part-*")
    lines = part.read_text().splitlines()
    assert lines[0] == "id,v" and len(lines) == 101
    pairs = [(float(v), int(i)) for i, v in (line.split(",") for line in lines[1:])]
    assert pairs == sorted(pairs)
    write_csv(df, str(out))
    assert spark.read.csv(str(out), header=True).count() == 100
    write_json(df, str(out), single_file=True)
    (part,) = out.glob("part-*")
    assert json.loads(part.read_text().splitlines()[0]).keys() == {"id", "v"}


def test_results_by_day(spark, tmp_path):
    df = spark.range(20).selectExpr("id", "concat('01.0', id % 3) as dataset")
    write_csv(df, str(tmp_path / "c"), partition_by=["dataset"])
    write_json(df, str(tmp_path / "j"), partition_by=["dataset"])
    for folder, read in (("c", spark.read.option("header", True).csv), ("j", spark.read.json)):
        assert len(list((tmp_path / folder).glob("dataset=*"))) == 3
        assert read(str(tmp_path / folder / "dataset=01.01")).count() == 7


def test_run_writes_every_result(spark, tmp_path):
    raw = raw_events(spark, "/root/testdata/sf0.001")
    fitted = run(raw, str(tmp_path), models=["linear_regression"], single_file=True)
    lines = lambda name: sum(
        len(p.read_text().splitlines()) - 1 for p in (tmp_path / name).glob("part-*"))
    assert {n: lines(n) for n in ("cells", "metadata", "quantiles", "cume_dist", "longest_paths",
                                  "airport", "crowd")} == {
        "cells": 112, "metadata": 30, "quantiles": 120, "cume_dist": 257, "longest_paths": 497,
        "airport": 20, "crowd": 966}
    assert lines("prediction_details/linear_regression") == 10
    assert lines("prediction_residuals/linear_regression") > 0
    assert lines("prediction/linear_regression") == 6 and lines("profiles/original") == 5
    assert fitted.keys() == {"linear_regression"} <= MODELS.keys()
    with pytest.raises(ValueError):
        run(raw, str(tmp_path), parts=["nothing"])
