"""MinHash near-duplicates against all pairs; exact dedup against a dictionary."""

import hashlib
import random
import re

import pytest

from cellmob.llm import exact_dedup, minhash
from cellmob.llm.minhash import Likeness


def plain_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        g = {tuple(w[j:j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
        sets.setdefault(i, []).append(g)
    label = {i: i for i in sets if i is not None}
    ids = sorted(label)
    links = [(a, b) for a in ids for b in ids if a < b for x in sets[a] for y in sets[b]
             if x and y and 100 * len(x & y) >= percent * len(x | y)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {(i, len(g), label.get(i), i is None or label[i] == i) for i, gs in sets.items() for g in gs}


@pytest.mark.parametrize("block", [2048, 4])
@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80), (1, 60)])
def test_components(frame, nasty, words, percent, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    got = minhash.near_duplicates(frame(nasty), words, percent).select(
        "doc_id", "n_shingles", "component_id", "kept").collect()
    assert len(got) == len(nasty)
    assert {tuple(r) for r in got} == plain_components([(i, t) for i, t, *_ in nasty], words, percent)


def test_copies_that_are_alike_through_their_original_only(frame):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(2000)]
    base = [rng.choice(words) for _ in range(200)]
    rows = []
    for i in range(40):  # each misses its own words: 0.89 like the base, 0.78 like each other
        copy = list(base)
        for j in rng.sample(range(200), 4):
            copy[j] = f"own{i}-{j}"
        rows.append((i, " ".join(copy)))
    rows.append((99, " ".join(base)))
    got = minhash.near_duplicates(frame(rows), 3, 85).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == plain_components(rows, 3, 85)
    assert {r.component_id for r in got} == {0}


@pytest.mark.parametrize("shape", ["path", "random", "star", "none"])
def test_components_of_graphs(spark, shape):
    rng = random.Random(5)
    ids = rng.sample(range(10_000), 300)
    pairs = {"path": list(zip(ids, ids[1:])), "star": [(ids[7], x) for x in ids if x != ids[7]],
             "random": [tuple(rng.sample(ids, 2)) for _ in range(200)], "none": []}[shape]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    links = spark.createDataFrame(pairs, "a long, b long")
    got = minhash.components(links).collect()
    assert {r.rep: r.component for r in got} == label and len(got) == len(label)


def test_bands_follow_from_the_threshold():
    for percent in (50, 80, 85, 95, 100):
        like = Likeness(5, percent)
        missed = 2 * (1 - (percent / 100) ** minhash.ROWS) ** like.bands
        assert missed <= minhash.MISSED * 1.001
        assert 0 <= like.least_agreeing <= like.hashes


def test_pairs_exactly_at_a_low_threshold(frame):
    rows = []
    for i in range(30):
        common = [f"c{i}-{j}" for j in range(100)]
        rows += [(2 * i + k, " ".join(common + [f"own{i}-{k}-{j}" for j in range(50)])) for k in (0, 1)]
    got = minhash.near_duplicates(frame(rows), 1, 50).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i // 2 * 2 for i, _ in rows}


def test_keep_first(frame):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text), (2, text + " end"), (7, "other words"), (8, None), (9, "")]
    kept = minhash.keep_first(frame(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 7, 8, 9]
    assert kept.columns == frame(rows).columns


def test_one_row_of_each_group_stays(frame):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (1, text), (1, text + "  "), (None, text), (None, text + " "),
            (None, "no copy with an id"), (None, "no copy  with an id"), (None, "no copy  with an id"),
            (2, "one id"), (2, "two texts"), (2, "two texts")]
    exact = exact_dedup.keep_first(frame(rows))
    assert sorted(((r.doc_id, r.text) for r in exact.collect()), key=repr) == sorted(
        [(1, text + "  "), (None, "no copy  with an id"), (2, "one id"), (2, "two texts")], key=repr)
    assert exact.columns == frame(rows).columns
    near = minhash.keep_first(frame([*rows, (0, text + " end"), (None, text + " end end"), (None, None), (None, None)]))
    assert sorted(((r.doc_id, (r.text or "").replace("  ", " ")) for r in near.collect()), key=repr) == sorted(
        [(0, text + " end"), (None, "no copy with an id"), (2, "one id"), (2, "two texts"), (None, ""), (None, "")], key=repr)


def test_empty(frame):
    assert minhash.near_duplicates(frame([]), 3, 85).collect() == []
    assert exact_dedup.dedup(frame([])).collect() == []


def plain_exact(rows):
    groups = {}
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(key, []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for key, g in groups.items():
        keep = min(g)[3]
        digest = hashlib.sha256(key.encode()).hexdigest()
        out += [(i, keep, len(g), i == keep, digest) for *_, i in g]
    return sorted(out, key=repr)


def test_exact(frame, nasty):
    got = sorted(map(tuple, exact_dedup.dedup(frame(nasty)).collect()), key=repr)
    assert got == plain_exact([(i, t) for i, t, *_ in nasty])


@pytest.mark.parametrize("limit", [1, 300, 5000, 1 << 30])
def test_grace_spills_and_compares_contents(limit):
    rng = random.Random(2)
    contents = [bytes([i]) * rng.randrange(0, 90) for i in range(200)]
    # all hashes alike in most bits, some alike altogether: only the contents tell
    records = [(rng.choice([0, 1, -5]) << 59 if i % 3 else 7, c, len(c), k * 1000 + i, 1)
               for k in range(3) for i, c in enumerate(contents)]
    by_content = {}
    for h, c, n, d, _ in records:
        by_content.setdefault((h, c), []).append(d)
    got = list(exact_dedup.grace(records, limit))
    assert {(h, c): (d, n) for h, c, _, d, n in got} == {
        k: (min(v), len(v)) for k, v in by_content.items()}
    assert len(got) == len(by_content)
