import datetime as dt

from cellmob.operators.arrivals import days_ending_within, last_events, trails_ending_within
from cellmob.schema import AIRPORT, EVENT

T = dt.datetime(2024, 1, 1, 8)
HOUR = dt.timedelta(hours=1)
THERE, TOWN = (AIRPORT.lat, AIRPORT.lng), (47.0, 19.0)


def events(spark, *rows):
    return spark.createDataFrame([("01.01", s, T + h * HOUR, *place) for s, h, place in rows], EVENT)


def test_last_event_breaks_ties_by_position(spark):
    ev = events(spark, ("a", 0, TOWN), ("a", 2, TOWN), ("a", 2, THERE), ("a", 1, TOWN))
    got = last_events(ev).first()
    assert (got.lat, got.lng, got.events) == (*THERE, 4)
    assert got.timestamp == T + 2 * HOUR


def test_trails(spark):
    ev = events(spark, ("ends", 0, TOWN), ("ends", 1, THERE), ("passes", 0, THERE),
                ("passes", 1, TOWN), ("single", 0, THERE))
    assert [r.subscriber for r in days_ending_within(ev).collect()] == ["ends"]
    assert {r.subscriber for r in days_ending_within(ev, min_events=1).collect()} == {"ends", "single"}
    assert sorted(tuple(r)[1:] for r in trails_ending_within(ev).collect()) == [
        ("ends", T, *TOWN), ("ends", T + HOUR, *THERE)]
