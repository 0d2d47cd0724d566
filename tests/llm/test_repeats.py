"""Substring and suffix-array deduplication against brute force over all windows."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellmob.llm import repeats, substring, suffixes
from cellmob.llm.repeats import Powers, Unit


def covered(n, window, starts):
    out = np.zeros(n, bool)
    for s in starts:
        out[s:s + window] = True
    return out


def plain_words(rows, window):
    least = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[p:p + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = covered(len(w), window, [p for p in range(len(w) - window + 1) if i is not None
                                        and least[tuple(w[p:p + window])] < i])
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


def plain_bytes(rows, window):
    count = Counter()
    for i, t in rows:
        b = (t or "").encode()
        count.update(b[p:p + window] for p in range(len(b) - window + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = covered(len(b), window, [p for p in range(len(b) - window + 1)
                                        if count[b[p:p + window]] > 1])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((i, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("crowded", [512, 3])
@pytest.mark.parametrize("unit", [substring.WORDS, Unit(True, 12, 4, earlier=True)])
def test_words(frame, nasty, unit, crowded, monkeypatch):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    rows = [(i, t) for i, t, *_ in nasty]
    assert rows_of(substring.dedup(frame(nasty), unit)) == sorted(plain_words(rows, unit.window), key=repr)


@pytest.mark.parametrize("crowded", [512, 3])
@pytest.mark.parametrize("unit", [suffixes.BYTES, Unit(False, 30, 9, shallow=1)])
def test_bytes(frame, nasty, unit, crowded, monkeypatch):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    rows = [(i, t) for i, t, *_ in nasty]
    assert rows_of(suffixes.dedup(frame(nasty), unit)) == sorted(plain_bytes(rows, unit.window), key=repr)


def test_kept_contents(frame):
    long = " ".join(f"v{i}" for i in range(60))
    got = {r.doc_id: r.kept_text for r in substring.dedup(frame([(2, f"x {long} y"), (1, long)]), texts=True).collect()}
    assert got == {1: long, 2: "x y"}
    kept = {r.doc_id: bytes(r.kept) for r in suffixes.dedup(frame([(2, f"x {long} y"), (1, long)]), contents=True).collect()}
    assert kept == {1: b"", 2: b"x  y"}


@pytest.mark.parametrize("crowded", [512, 1])
@pytest.mark.parametrize("unit", [Unit(True, 12, 4, earlier=True), Unit(False, 30, 9, shallow=1)])
def test_of_copies_in_one_document_one_goes_on(frame, unit, crowded, monkeypatch):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    own = [f"{i * i * 7919 % 9973}" for i in range(200)]
    run, passage = ["x"] * 400, own[:20]
    long = own[40:60] + run + own[60:80] + (own[80:90] + passage + own[90:100]) * 3 + run
    rows = [(5, " ".join(long)), (2, " ".join(own[100:130] + passage + own[130:140])),
            (3, " ".join(own[140:150] + ["x"] * 15 + own[150:160])), (7, "x" * 3000 + "y" * 40 + "x" * 900)]
    made = []
    fragments = repeats._fragments
    monkeypatch.setattr(repeats, "_fragments", lambda docs, rest, unit: made.append(rest) or fragments(docs, rest, unit))
    dedup, plain = (substring.dedup, plain_words) if unit.words else (suffixes.dedup, plain_bytes)
    assert rows_of(dedup(frame(rows), unit)) == sorted(plain(rows, unit.window), key=repr)
    assert 0 < made[0].count() < 250


@pytest.mark.parametrize("crowded", [512, 1])
def test_rows_without_an_id_and_of_one_id(frame, crowded, monkeypatch):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    own = [f"{i * i * 7919 % 99991}" for i in range(1200)]
    one, two = own[:90], own[90:170]
    rows = [(i, " ".join(w)) for i, w in [
        (None, own[200:230] + one + own[230:260]), (None, own[260:270] + one), (4, one + own[300:330]),
        (4, own[330:400] + one), (4, own[400:580]), (9, own[580:600] + one + two), (9, two + own[600:690]),
        (9, two + own[600:690]), (None, own[700:800]), (None, own[700:800]), (2, own[800:830] + two)]]
    duck = duckdb.connect()
    duck.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    for operator, plain in ((substring, plain_words), (suffixes, plain_bytes)):
        window = 50 if operator is substring else 200
        want = sorted(plain(rows, window), key=repr)
        assert rows_of(operator.dedup(frame(rows))) == want
        assert sorted(duck.execute(operator.SQL).fetchall(), key=repr) == want


def test_empty(frame):
    assert substring.dedup(frame([])).collect() == []
    assert suffixes.dedup(frame([])).collect() == []


@given(st.lists(st.binary(min_size=0, max_size=60).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_each_window_has_one_anchor_and_equal_windows_equal_grams(texts):
    unit = Unit(words=False, window=9, gram=3)
    powers = Powers()
    symbols, starts = repeats.symbols_of(unit, texts, powers)
    text, at, first, last, h, _ = repeats.anchors_of(unit, symbols, starts, powers)
    seen, grams = [], {}
    for t, a, f, l, g in zip(text, at, first, last, h):
        for p in range(f, l + 1):
            assert p <= a <= p + unit.window - unit.gram
            seen.append((t, p))
            assert grams.setdefault(texts[t][p:p + unit.window], (a - p, g)) == (a - p, g)
    assert sorted(seen) == [(t, p) for t, b in enumerate(texts) for p in range(len(b) - unit.window + 1)]


def test_segments_of_a_long_text(monkeypatch):
    monkeypatch.setattr(repeats, "_SEGMENT", 500)
    unit, powers = Unit(words=False, window=40, gram=8), Powers()
    text = np.random.default_rng(1).integers(0, 4, 2600, np.uint8)
    _, at, first, last, *_ = repeats.anchors_of(unit, text, np.array([0, len(text)]), powers)
    windows = sorted(p for f, l in zip(first, last) for p in range(f, l + 1))
    assert windows == list(range(len(text) - unit.window + 1))


@given(st.integers(0, 2), st.lists(st.integers(0, 1), min_size=8, max_size=60))
@settings(max_examples=80, deadline=None)
def test_classes_are_the_sets_of_equal_windows(shallow, symbols):
    values, steps = np.array(symbols, np.uint64), np.arange(5)
    start = np.arange(len(values) - 4)
    group = start % 2
    want = {}
    for s in start:
        want.setdefault((group[s], tuple(values[s:s + 5])), set()).add(s)
    got = set()
    for window, number in repeats.classes(values, start, group, steps, shallow):
        for n in np.unique(number):
            got.add(frozenset(window[number == n].tolist()))
    assert got == {frozenset(int(x) for x in s) for s in want.values() if len(s) > 1}
