"""Event records derived from the ``events`` test table.

The table has no coordinates, so each event is placed on one of 144 towers by integer
arithmetic and one final division; the same text runs in Spark and DuckDB and gives the
same doubles. About 3 % of the rows are dirty on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TOWER = "(user_id*7 + (hour(ts) {idiv} 6)*5 + event_id % 3) % 144"
_LAT = ("case when event_id % 97 = 0 then 0 when event_id % 103 = 0 then -1 else 1 end"
        " * (47380000 + (c % 12)*20000 + ((c*37)%11)*700) / cast(1000000 as double)")
_LNG = ("case when event_id % 101 = 0 then null"
        " else (18950000 + (c {idiv} 12)*30000 + ((c*53)%13)*900)"
        " / cast(1000000 as double) end")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``events`` as event records."""
    return (spark.read.parquet(f"{sf_dir}/events.parquet")
            .selectExpr("event_id", "user_id", "event_type", "ts",
                        _TOWER.format(idiv="div") + " as c")
            .selectExpr("cast(event_id as int) as callId",
                        "cast(user_id as string) as subscriber",
                        "'' as ni", "'' as dt", "event_type as TAC", "0 as eventType",
                        "ts as timestamp", "cast(c as string) as cellId",
                        _LAT + " as lat", _LNG.format(idiv="div") + " as lng"))


RAW_SQL = f"""
  select cast(event_id as integer) as callId, cast(user_id as varchar) as subscriber,
         '' as ni, '' as dt, event_type as TAC, 0 as eventType, ts as "timestamp",
         cast(c as varchar) as cellId, {_LAT} as lat, {_LNG.format(idiv="//")} as lng
  from (select event_id, user_id, event_type, ts, {_TOWER.format(idiv="//")} as c from events)
"""
