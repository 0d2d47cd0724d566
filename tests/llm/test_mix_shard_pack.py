"""Mixing, sharding and packing: brute force, invariants and exact round trips."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellmob.llm import mixing, packing, prefix, sharding

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PLAIN, WORDS = Tokenizer.from_file(WORD_BPE), packing.WordTokens(WORD_BPE)


def plain_targets(sizes):
    """Targets by resharing the excess, source by source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, stopped, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in stopped]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            stopped.add(s)
            target[s] = 2.0 * sizes[s]
        left = 1.5 * sum(sizes.values()) - sum(target.values())


def name_of(marked):
    """The source behind mix's never-null name."""
    return None if marked == "1" else marked[1:]


def check_mix(rows, got):
    """The mix of (doc_id, text, lang, source) rows takes each source's target."""
    sizes, taken, want = Counter(), Counter(), Counter()
    for i, t, _, s in rows:
        n = len((t or "").encode().split())
        sizes[s] += n
        want[i, s, n] += 1
    targets = plain_targets(sizes)
    for r in got:
        s = name_of(r._source)
        want[r.doc_id, s, r.size] -= 1
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert not any(want.values())
    assert {s: taken[s] for s in sizes} == {s: int(targets[s] + 1e-9) for s in sizes}


def test_mix(frame, nasty):
    got = mixing.mix(frame(nasty)).collect()
    check_mix(nasty, got)
    again = mixing.mix(frame(nasty, 7))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got))


def test_a_source_with_most_words(frame):
    rows = [(i, "w " * (i % 9 + 1), "en", "hot" if i % 3 else f"s{i % 12}") for i in range(3000)]
    check_mix(rows + [(5000, "", "en", "no words")], mixing.mix(frame(
        rows + [(5000, "", "en", "no words")])).collect())


def one_id(n):
    """Rows that mostly lack an id, or share one, with few different sizes."""
    rows = [(None if i % 3 else 7, "w " * (i % 4 + 1), "en", "a") for i in range(n)]
    return rows + [(10 + i, f"x{i} " * (i % 7 + 1), "en", "ab"[i % 2]) for i in range(n // 3)]


def test_many_rows_of_one_id(frame, monkeypatch):
    monkeypatch.setattr(mixing, "_PART", 500)
    rows, parts, real = one_id(6000), [], mixing.running_total
    def watched(units, *more):
        parts.append(units.count())
        return real(units, *more)
    monkeypatch.setattr(mixing, "running_total", watched)
    check_mix(rows, mixing.mix(frame(rows)).collect())
    assert parts == [8 + 2000]  # what is sorted: one row for all alike


def check_repeated(rows, got):
    """Rows at a cut are taken whole or not: each source comes as near as its largest row."""
    sizes, taken, times = Counter(), Counter(), Counter(map(tuple, got))
    longest = Counter()
    for _, t, _, s in rows:
        n = len((t or "").encode().split())
        sizes[s] += n
        longest[s] = max(longest[s], n)
    for r in got:
        taken[r.source] += len(r.text.encode().split())
    for s, target in plain_targets(sizes).items():
        assert abs(taken[s] - target) <= longest[s] / 2 + 1
    known = Counter((i, t, lang, s) for i, t, lang, s in rows)
    for row, n in times.items():
        assert n <= 2 * known[row[0], row[1], row[2], row[3]]


def test_repeated(frame, nasty):
    docs = frame(nasty)
    mixed = mixing.repeated(docs)
    assert mixed.columns == docs.columns
    check_repeated(nasty, mixed.collect())
    assert mixing.repeated(frame([])).collect() == [] and mixing.mix(frame([])).collect() == []


def test_repeated_rows_alike_in_all_columns(frame):
    """A cut in the middle of equal rows takes some of them."""
    rows = [(5, "one two three", "en", "a")] * 700 + [(6, "four", "en", "b")] * 40 + [
        (7 + i, f"text {i}", "en", "c") for i in range(30)] + [(None, "", "en", "c")] * 50
    check_repeated(rows, mixing.repeated(frame(rows)).collect())
    check_repeated(one_id(900), mixing.repeated(frame(one_id(900))).collect())


def test_running_total(spark):
    rows = [(g, (k * 7919) % (1 << 60), k, k % 5) for g, n in (("a", 3000), ("b", 1), ("c", 40)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, id long, v long")
    got = prefix.running_total(df, "g", "k", ["id"], "v", "before").collect()
    want = {}
    for g, part in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        at = 0
        for _, k, i, v in sorted(part, key=lambda r: (r[1], r[2])):
            want[g, i] = at
            at += v
    assert {(r.g, r.id): r.before for r in got} == want and len(got) == len(rows)


# ---- sharding ------------------------------------------------------------------------------

@given(st.lists(st.integers(0, 40), max_size=80), st.integers(40, 90), st.sampled_from([None, 3]))
@settings(max_examples=80, deadline=None)
def test_best_fit_decreasing_equals_a_scan_of_all_bins(sizes, capacity, bins):
    got = sharding.best_fit_decreasing(list(enumerate(sizes)), capacity, bins)
    left, want = [capacity] * (bins or 0), {}
    for i, s in sorted(enumerate(sizes), key=lambda x: (-x[1], x[0])):
        fits = [(r, b) for b, r in enumerate(left) if r >= s]
        if fits:
            b = min(fits)[1]
        elif bins:
            b = max((r, b) for b, r in enumerate(left))[1]
        else:
            left.append(capacity)
            b = len(left) - 1
        left[b] -= s
        want[i] = b
    assert got == want


def check_shards(rows, got, shards, capacity):
    assert len(got) == len(rows)
    slots, load, homes = defaultdict(list), Counter(), defaultdict(set)
    group = Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        homes[r.text].add(r.shard)
        group[r.text] += r.size
    for s, x in slots.items():
        assert sorted(x) == list(range(len(x))) and 0 <= s < shards
    for t, x in homes.items():
        assert len(x) == 1 or group[t] > capacity
    return load


def test_shards(frame, nasty):
    rows = [r for r in nasty if len(r[1] or "") < 10_000] + [(1000 + i, "copy " * 20, "en", "a") for i in range(400)]
    rows += [(2000 + i, f"{i} " * (i % 50 + 20), "en", "a") for i in range(3000)]
    docs = frame(rows).select("doc_id", "text")
    placed = sharding.shard(docs, F.coalesce(F.octet_length("text"), F.lit(0)) + 16,
                            F.xxhash64("text"), shards=8)
    got = placed.collect()
    total = sum(len((t or "").encode()) + 16 for _, t, *_ in rows)
    load = check_shards(rows, got, 8, -(-total // 8))
    assert max(load.values()) - min(load.values()) < 0.02 * total / 8
    few = sharding.shard(docs, F.coalesce(F.octet_length("text"), F.lit(0)) + 16,
                         F.xxhash64("text"), capacity=total // 5).collect()
    load = check_shards(rows, few, 8, total // 5)
    assert len(load) <= 6 and max(load.values()) <= total // 5


def test_shards_of_few_groups_are_those_of_plain_best_fit(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, rng.randrange(1, 8000)) for i in range(900)] + [(900 + i, 700) for i in range(300)]
    total = sum(s for _, s in rows)
    docs = spark.createDataFrame(rows, "doc_id long, bytes long").repartition(3)
    for capacity in (8000, total // 7):
        got = sharding.shard(docs, F.col("bytes"), F.col("doc_id"), capacity=capacity).collect()
        load = Counter()
        for r in got:
            load[r.shard] += r.size
        plain = Counter()
        for i, b in sharding.best_fit_decreasing(rows, capacity).items():
            plain[b] += rows[i][1]
        assert load == plain and sorted((r.doc_id, r.size) for r in got) == rows
    monkeypatch.setattr(sharding, "BINS", 40)
    got = sharding.shard(docs, F.col("bytes"), F.col("doc_id"), capacity=8000).collect()
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert max(load.values()) <= 8000 and sorted(load) == list(range(len(load)))
    assert len(load) <= 1.05 * len(sharding.best_fit_decreasing(rows, 8000)) and sum(load.values()) == total
    got = sharding.shard(docs, F.col("bytes"), F.col("doc_id"), shards=90).collect()
    assert {r.shard for r in got} == set(range(90)) and len(got) == len(rows)


def test_small_capacities_hold(spark):
    """A capacity of 1/20,000 of all bytes: no shard above it, and few more than needed."""
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), (100 + F.col("id") % 37).alias("bytes"))
    total = docs.agg(F.sum("bytes")).first()[0]
    placed = sharding.shard(docs, F.col("bytes"), F.xxhash64("doc_id"), capacity=total // 20_000)
    load = [r[1] for r in placed.groupBy("shard").agg(F.sum("size")).collect()]
    assert sum(load) == total and max(load) <= total // 20_000 and len(load) < 20_000 * 1.1


def test_many_rows_of_one_id_and_text_are_spread(frame):
    docs = frame([(7, "same text", "en", "a")] * 4000 + [(None, None)] * 4000).select("doc_id", "text")
    placed = sharding.shard(docs, F.coalesce(F.octet_length("text"), F.lit(0)) + 16,
                            F.xxhash64("text"), shards=10).collect()
    rows = [(7, "same text")] * 4000 + [(None, None)] * 4000
    load = check_shards(rows, placed, 10, 4000 * 25 // 5)
    assert max(load.values()) < 1.2 * min(load.values()) and len(load) == 10


def test_no_rows_no_shards(frame):
    docs = frame([]).select("doc_id", "text")
    assert sharding.shard(docs, F.octet_length("text"), F.xxhash64("text"), shards=4).collect() == []


# ---- packing -------------------------------------------------------------------------------

def test_word_tokens_equal_the_tokenizer(nasty):
    plain, words = Tokenizer.from_file(WORD_BPE), packing.WordTokens(WORD_BPE)
    texts = [t for _, t, *_ in nasty if t is not None]
    texts += ["It's I'LL ó ΣΣ x̧́ <|endoftext|> a<|startoftext|>b", "　a  b\x85c\x1cd", "́ ́a", "12 3.4\n\n!? 0 00 a0b", "<|STARTOFTEXT|> A", "it's. x'. 'a', (b). c!). é.. ?! d.e. 1. ²: ...", "İI\u0307 Ⅷ ǅ ﬁ \u212a"]
    for t in texts:
        assert words(t.encode()).tolist() == plain.encode(t, add_special_tokens=False).ids


def test_pack_round_trip(frame, nasty):
    docs = frame(nasty)
    got = packing.pack(packing.pieces(docs, WORD_BPE, 64), 64, chunk=60).collect()
    plain, want = Tokenizer.from_file(WORD_BPE), Counter()
    for i, t, *_ in nasty:
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for n, s in enumerate(range(0, len(ids), 64)):
            part = ids[s:s + 64]
            want[i, n, s, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    chunks = len({s >> 32 for s in sequences})
    assert len(sequences) <= -(-sum(r.length for r in got) // 64) + 2 * chunks
    assert packing.pack(packing.pieces(frame([]), WORD_BPE)).collect() == []


@given(st.lists(st.integers(1, 30), max_size=40))
@settings(max_examples=100, deadline=None)
def test_search_keeps_pieces_and_never_adds_bins(lengths):
    first = packing.best_fit(lengths, 30)
    fills = lambda bins: sum(sum(lengths[i] for i in b) ** 2 for b in bins)
    before, n = fills(first), len(first)
    bins = packing.improve([list(b) for b in first], lengths, 30)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 30 for b in bins)
    assert len(bins) <= n and fills(bins) >= before


def test_search_empties_a_bin():
    lengths = [6, 3, 5, 5, 3, 2]  # (6 3) (5 5) (3 2): all fit no fewer; with room 12 two do
    bins = packing.improve([[0, 1], [2, 3], [4, 5]], lengths, 12)
    assert len(bins) == 2


@given(st.lists(st.text(alphabet="İiJHTWYjhΣσé̱̌̈̊̇́.,;:!?#&*$%|0a ", max_size=12), max_size=6))
@settings(max_examples=400, deadline=None)
def test_word_tokens_of_letters_and_marks_that_compose(texts):
    assert [x.tolist() for x in WORDS.texts([t.encode() for t in texts])] == [
        PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_tokens_of_capitals_before_marks():
    for t in ("DENİZCİ.", "GEMİCİ,", "İ!", "J̌", "xJ̌. ok", "H̱ T̈ W̊ Y̊", "ẞ. ǅ; ŉ"):
        assert WORDS(t.encode()).tolist() == PLAIN.encode(t, add_special_tokens=False).ids


def test_word_tokens_after_the_memory_was_emptied(monkeypatch):
    monkeypatch.setattr(packing, "_WORDS", 5)
    words = packing.WordTokens(WORD_BPE)
    for n in range(12):
        text = f"word{n} and. word{n + 1}! again"
        assert words(text.encode()).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def fewest(lengths, room):
    """The least number of bins, by trying all."""
    lengths = sorted(lengths, reverse=True)

    def fits(at, left):
        if at == len(lengths):
            return True
        for b in {x: i for i, x in enumerate(left)}.values():  # bins with as much left are alike
            if left[b] >= lengths[at]:
                left[b] -= lengths[at]
                if fits(at + 1, left):
                    return True
                left[b] += lengths[at]
        return False

    return next(n for n in range(len(lengths) + 1) if fits(0, [room] * n))


def test_search_comes_near_the_optimum():
    rng = random.Random(5)
    first = found = least = 0
    for _ in range(150):
        lengths = [rng.randint(3, 14) for _ in range(rng.randint(4, 11))]
        bins = packing.best_fit(lengths, 24)
        first += len(bins)
        found += len(packing.improve(bins, lengths, 24))
        least += fewest(lengths, 24)
    assert least <= found <= first and found - least <= 0.03 * least


def test_search_looks_at_all_bins():
    """Pieces of which three may or may not fit: what groups of bins would miss."""
    rng = random.Random(0)
    lengths = [rng.randint(1300, 1500) for _ in range(3000)]
    bins = packing.improve(packing.best_fit(lengths, 4096), lengths, 4096)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert len(bins) < 1215  # 1,248 by groups of 128 bins, 1,237 by groups of 512


def test_bins_of_many_small_pieces():
    rng = random.Random(1)
    lengths = [rng.randint(1, 9) for _ in range(9000)] + [4001] * 9
    bins = packing.improve(packing.best_fit(lengths, 4096), lengths, 4096)
    assert len(bins) <= -(-sum(lengths) // 4096) + 1
