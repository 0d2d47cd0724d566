import pytest
from pyspark import StorageLevel

from cellmob.operators import holding


def test_persists_for_the_block(spark, monkeypatch):
    monkeypatch.setattr(holding, "shared_folder", lambda spark: None)
    with holding.hold(spark.range(10).selectExpr("id * 2 as v"), cut=True) as df:
        assert df.storageLevel.useMemory and df.count() == 10
    assert df.storageLevel == StorageLevel.NONE


def test_cut_writes_a_table(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(holding, "shared_folder", lambda spark: str(tmp_path))
    with holding.hold(spark.range(10).selectExpr("id * 2 as v"), cut=True) as df:
        assert sorted(r.v for r in df.collect()) == list(range(0, 20, 2))
        assert "FileScan parquet" in df._jdf.queryExecution().executedPlan().toString()
        assert len(list(tmp_path.glob("held-*/*.parquet"))) > 0
    assert list(tmp_path.iterdir()) == []


def test_nothing_is_left_after_an_error(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(holding, "shared_folder", lambda spark: str(tmp_path))
    with pytest.raises(RuntimeError):
        with holding.hold(spark.range(10), cut=True):
            raise RuntimeError
    with pytest.raises(Exception):
        with holding.hold(spark.range(10).selectExpr("raise_error('no') as v"), cut=True):
            pass
    assert list(tmp_path.iterdir()) == []


def test_kept_tables_are_read_until_released(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(holding, "shared_folder", lambda spark: str(tmp_path))
    df = holding.keep(spark.range(5).selectExpr("id + 1 as v"))
    assert sorted(r.v for r in df.union(df).collect()) == sorted([1, 2, 3, 4, 5] * 2)
    assert len(list(tmp_path.glob("kept-*/*.parquet"))) > 0
    holding.release()
    assert list(tmp_path.iterdir()) == []
