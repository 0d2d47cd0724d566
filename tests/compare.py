"""Runs registered queries next to their SQL and compares all rows exactly.

``python tests/compare.py /root/testdata/sf0.01 [query ...]``
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return con


def reference_queries(entry) -> list[str]:
    """Names of the queries that are not those of the llm subpackage."""
    return sorted(set(entry.queries()) - set([*entry.llm.QUERIES, "pipeline"] if entry.llm else []))


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def difference(df, con, sql):
    """None if both sides agree, else a text that says where they do not."""
    theirs = con.execute(sql)
    want = sorted_rows([d[0] for d in theirs.description], theirs.fetchall())
    got = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if want[0] != got[0]:
        return f"columns {got[0]} instead of {want[0]}"
    if len(want[1]) != len(got[1]):
        return f"{len(got[1])} rows instead of {len(want[1])}"
    types = [{type(v) for r in rows[:50] for v in (r[i],) if v is not None}
             for rows in (want[1], got[1]) for i in range(len(want[0]))]
    half = len(want[0])
    if types[:half] != types[half:]:
        return f"types {types[half:]} instead of {types[:half]}"
    for a, b in zip(want[1], got[1]):
        if a != b and repr(a) != repr(b):  # NaN equals nothing
            return f"row {b} instead of {a}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in sql:
                diff = difference(df, con, sql[name])
                text = "ok" if diff is None else "DIFFERS: " + diff
                bad += diff is not None
            else:
                text = f"{df.count()} rows, no SQL"
        except Exception as e:  # report and go on
            text, bad = f"FAILED: {str(e)[:600]}", bad + 1
        print(f"{name:32s} {time.time() - start:6.1f}s  {text}", flush=True)
    print("bad:", bad)
