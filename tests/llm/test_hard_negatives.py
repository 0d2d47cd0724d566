"""Hard negatives against a sort of all rows per anchor and positive."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cellmob.llm import hard_negatives as H


def plain(rows, every, scale=256, positives=5, negatives=5, low=80, high=100):
    vectors = {}
    for i, x, label in sorted((r for r in rows if None not in r), key=repr):
        if all(v is not None and math.isfinite(v) for v in x):
            new = (label, [math.floor(scale * v) for v in x])
            vectors[i] = min(new, vectors.get(i, new))
    out = []
    for a, (label, x) in vectors.items():
        if a % every:
            continue
        def scored(same):
            return sorted((-sum(p * q for p, q in zip(x, y)), i) for i, (other, y) in vectors.items()
                          if i != a and (other == label) == same)
        other = scored(False)
        for p, i in scored(True)[:positives]:
            inside = [(s, j) for s, j in other if low * -p <= 100 * -s <= high * -p]
            for rank, (s, j) in enumerate(inside[:negatives], 1):
                out.append((a, i, rank, j, -p, -s))
    return sorted(out)


def vectors(spark, rows, parts=4):
    return spark.createDataFrame([(i, x, label, 1.0, 2) for i, x, label in rows],
                                 "vec_id long, embedding array<float>, label int, x double, slot long"
                                 ).repartition(parts)


def rows_of(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


def some(n, labels, width=6, seed=0):
    rng = random.Random(seed)
    return [(i, [rng.randrange(-3, 12) / 8 for _ in range(width)], rng.choice(labels)) for i in range(n)]


@pytest.mark.parametrize("labels", [[0, 1, 2], [0, 0, 0, 0, 1], [5]])
@pytest.mark.parametrize("block_bytes", [1 << 20, 500])
def test_equals_brute_force(spark, labels, block_bytes):
    rows = some(300, labels)
    got = H.mine(vectors(spark, rows), F.col("vec_id") % 20 == 0, block_bytes=block_bytes)
    want = plain(rows, 20)
    assert rows_of(got) == want and (len(want) > 0 or labels == [5])


def test_ranges_of_other_shares(spark):
    rows = some(200, [0, 1], seed=3)
    got = H.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0, positives=3, negatives=4, low=30, high=90)
    assert rows_of(got) == plain(rows, 10, positives=3, negatives=4, low=30, high=90)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = some(60, [0, 1], width=3) + [
        (None, [1.0, 1.0, 1.0], 0), (100, None, 0), (101, [1.0, None, 1.0], 0), (102, [nan, 1.0, 1.0], 0),
        (103, [1.0, inf, 1.0], 1), (104, [1.0, 1.0, 1.0], None), (105, [], 0), (106, [1.0], 1),
        (107, [9.0, 9.0, 9.0], 0), (108, [9.0, 9.0, 9.0], 1), (109, [9.0, 9.0, 9.0], 1), (110, [9.0] * 3, 0)]
    rows += rows[:5] + [(110, [8.0] * 3, 0), (110, [9.0] * 3, 1)]
    assert rows_of(H.mine(vectors(spark, rows), F.col("vec_id") % 5 == 0)) == plain(
        [(i, x and (x + [0.0] * 3)[:3], y) for i, x, y in rows], 5)


def test_empty_table(spark):
    assert rows_of(H.mine(vectors(spark, []), F.col("vec_id") % 5 == 0)) == []
    assert rows_of(H.mine(vectors(spark, some(9, [0, 1])), F.lit(False))) == []


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0], i % 2) if i % 3 else (i, [i / 90, 1.0], i % 2) for i in range(600)]
    assert rows_of(H.mine(vectors(spark, rows), F.col("vec_id") % 50 == 0)) == plain(rows, 50)


def test_suffix_merges_answer_all_positives():
    positives = [(1, 100), (2, 100), (3, 60), (4, 10), (5, -20)]
    assert H.slot_limits(p for _, p in positives) == [100, 60, 10]
    slots = {100: [(90, 7), (81, 8), (70, 9)], 60: [(60, 10), (59, 3), (30, 2)], 10: [(9, 30)]}
    got = list(H.answers(positives, slots, k=2))
    want = [(p, s, r, j, t) for p, s in positives[:2] for r, (t, j) in enumerate([(90, 7), (81, 8)], 1)]
    want += [(3, 60, 1, 10, 60), (3, 60, 2, 3, 59), (4, 10, 1, 30, 9)]
    assert got == want


def test_a_combiner_keeps_k_rows_of_a_slot():
    import numpy as np

    rng = np.random.default_rng(0)
    limits = np.array([[50, 20, H._LEAST], [30, H._LEAST, H._LEAST]])
    slots, seen = H.Slots(limits, np.array([5, 0]), 3), []
    for _ in range(20):
        a, ids, s = rng.integers(0, 2, 40), rng.integers(0, 10**6, 40), rng.integers(-9, 60, 40)
        slots.add(a, ids, s)
        seen += zip(a.tolist(), ids.tolist(), s.tolist())
    want = []
    for a, low, edges in ((0, 5, [(20, 50), (4, 20)]), (1, 0, [(-1, 30)])):
        for n, (least, most) in enumerate(edges):
            mine = sorted((-s, i) for x, i, s in seen if x == a and low <= s and least < s <= most)
            want += [(3 * a + n, i, -s) for s, i in mine[:3]]
    assert sorted(zip(slots.slot.tolist(), slots.ids.tolist(), slots.scores.tolist())) == sorted(want)
