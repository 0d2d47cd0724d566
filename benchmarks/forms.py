"""Scale forms against plain forms on a larger and badly skewed table.

``python benchmarks/forms.py [copies]``: the events of sf0.1, each repeated ``copies``
times with its own subscribers and shifted towers; then every third event is given to one
subscriber on one day. For each operator: seconds of the library, and, where Spark windows
can state it (``tests/plain.py``), seconds of that form and whether the results are the same.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

import plain  # noqa: E402
from bench import session  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from cellmob.operators import distance as D  # noqa: E402
from cellmob.operators.crowd import cell_crowd, knn_features, lag_crowd  # noqa: E402
from cellmob.operators.events import (  # noqa: E402
    hour_frames, reduce_events, unique_cells, unique_visits)
from cellmob.operators.extent import daily_extent  # noqa: E402
from cellmob.operators.holding import hold  # noqa: E402
from cellmob.operators.neighbours import nearest_cells  # noqa: E402
from cellmob.testdata.view import raw_events  # noqa: E402


def skewed(spark, copies: int):
    raw = raw_events(spark, "/root/testdata/sf0.1").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    hot = F.pmod(F.xxhash64("callId", "copy"), F.lit(3)) == 0
    return raw.select(
        "callId", F.when(hot, "hot").otherwise(F.concat_ws("-", "copy", "subscriber"))
        .alias("subscriber"), "ni", "dt", "TAC", "eventType",
        F.when(hot, F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(15), F.hour("timestamp"),
                                         F.minute("timestamp"), F.second("timestamp")))
        .otherwise(F.col("timestamp")).alias("timestamp"), "cellId",
        (F.col("lat") + F.col("copy") * 0.0011).alias("lat"),
        (F.col("lng") + F.col("copy") % 7 * 0.0013).alias("lng"))


def timed(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main(copies: int) -> None:
    spark = session("8")
    with hold(reduce_events(skewed(spark, copies))) as events, \
            hold(unique_visits(events)) as visits, hold(daily_extent(visits)) as extents, \
            hold(unique_cells(events)) as cells, \
            hold(cell_crowd(hour_frames(events))) as crowd, \
            hold(nearest_cells(cells)) as near:
        for name, df in (("events", events), ("visits", visits), ("extents", extents),
                         ("towers", cells), ("crowd", crowd), ("neighbours", near)):
            print(f"{name:12s} {df.count():>12,d} rows", flush=True)
        # Other arguments than above, or the held results would be found and read.
        forms = {
            "extent": (None, lambda: daily_extent(visits, few_towers=63)),
            "quartiles": (lambda: plain.quantiles(extents),
                          lambda: D.distance_quantiles(extents)),
            "cume_dist": (lambda: plain.cume_dist(extents),
                          lambda: D.distance_cume_dist(extents)),
            "top k": (lambda: plain.longest(extents, 5), lambda: D.longest_paths(extents, 5)),
            "nearest": (None, lambda: nearest_cells(cells.repartition(8), 3)),
            "lag": (lambda: plain.lagged(crowd), lambda: lag_crowd(crowd)),
            "features": (None, lambda: knn_features(crowd, near)),
        }
        for name, (slow, fast) in forms.items():
            if len(sys.argv) > 2 and name not in sys.argv[2:]:
                continue
            if slow is None:  # the plain form is brute force on the driver
                print(f"{name:12s} library {min(timed(fast()) for _ in range(2)):7.2f}s", flush=True)
                continue
            times = [min(timed(f()) for _ in range(2)) for f in (slow, fast)]
            a, b = slow(), fast()
            b = b.select(*a.columns)
            same = a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
            print(f"{name:12s} plain {times[0]:7.2f}s  library {times[1]:7.2f}s  "
                  f"{'same' if same else 'DIFFERENT'}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 30)
