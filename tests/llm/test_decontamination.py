"""Benchmark decontamination against a scan of all places."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellmob.llm import decontamination as D


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(docs, items, window):
    strings = {}
    for item, text in items:
        w = words_of(text)
        n = min(window, len(w))
        for at in range(len(w) - n + 1 if w else 0):
            strings.setdefault(tuple(w[at:at + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in {len(s) for s in strings}:
            for at in range(len(w) - n + 1):
                if (s := tuple(w[at:at + n])) in strings:
                    hit |= set(range(at, at + n))
                    found |= strings[s]
        found = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(found),
                    hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in items],
                                 "item_id long, text string, words string, doc_id long")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ITEMS = [(1, None), (2, ""), (3, "- ; -"), (4, "w1 W2, w3"), (5, "Once"), (None, "no id here at all"),
         (7, "w1 w2 w3"), (7, "a second text of item seven with some more than ten words in it"),
         (12, "ünï çödé w5 w6"), (30, "a a a a a a a a a a a a a a")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_equals_brute_force(spark, frame, nasty, block_bytes):
    docs = [(i, t) for i, t, *_ in nasty if len(t or "") < 50_000]
    docs += [(200, "ONCE-upon; w1\x00w2\nW3 w5ünï çödé w5 w6 w1 w2"), (201, "no ID here at ALL")]
    passages = [t.split() for i, t in docs if i and 11 <= i < 40]
    items = ITEMS + [(100 + n, " ".join(p[n:n + 4 + 2 * n])) for n, p in enumerate(passages)]
    items += items[-3:]
    got = D.decontaminate(frame([(i, t, "en", "a") for i, t in docs]), items_frame(spark, items),
                          block_bytes=block_bytes)
    assert rows_of(got) == plain(docs, items, D.WINDOW)


def test_long_texts_and_items(spark, frame, monkeypatch):
    monkeypatch.setattr(D, "_CHUNK", 500)
    monkeypatch.setattr(D, "_SEGMENT", 7)
    monkeypatch.setattr(D, "_PAIRS", 11)
    rng = random.Random(4)
    words = [f"v{i}" for i in range(50)]
    text = [rng.choice(words) for _ in range(4000)]
    docs = [(1, " ".join(text)), (2, "y" * 3000 + " " + " ".join(text[100:160])), (3, "v1")]
    items = [(1, " ".join(text[500:1100])), (2, " ".join(text[90:130])), (3, " ".join(words[:12]))]
    searcher = D.Searcher([tuple(r) for r in D.segments(items_frame(spark, items)).collect()])
    found = list(searcher.texts([t.encode() for _, t in docs]))
    want = plain(docs, items, D.WINDOW)
    assert [(n, len(hit), len(i)) for n, hit, i in found] == [tuple(r[1:4]) for r in want]


def test_empty_tables(spark, frame):
    none = items_frame(spark, [])
    assert D.decontaminate(frame([]), none).collect() == []
    assert rows_of(D.decontaminate(frame([(1, "some text")]), none)) == plain([(1, "some text")], [], 10)


def test_an_item_text_of_a_third_of_all_items(spark, frame):
    items = [(i, "the very same question asked of all models again and again today" if i % 3 else f"q {i}")
             for i in range(400)]
    docs = [(i, f"q {i} the very same question asked of all models again and again today") for i in range(30)]
    got = D.decontaminate(frame(docs), items_frame(spark, items))
    assert rows_of(got) == plain(docs, items, 10)


@given(st.lists(st.lists(st.integers(1, 4), min_size=3, max_size=3), min_size=1, max_size=6),
       st.lists(st.lists(st.integers(0, 4), max_size=40), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_shifts_miss_nothing(strings, texts):
    found = D.Strings(np.array(strings, np.int32), np.arange(len(strings)))
    words = np.array([w for t in texts for w in t], np.int32)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    end, string = found.find(words, starts)
    got = sorted((int(e), tuple(found.windows[s].tolist())) for e, s in zip(end, string))
    want = sorted({(int(starts[n]) + at + 2, tuple(t[at:at + 3])) for n, t in enumerate(texts)
                   for at in range(len(t) - 2) if t[at:at + 3] in strings})
    assert got == want


def test_impossible_positions_are_skipped(monkeypatch):
    """A text without words of the benchmark is left in steps of the longest shift."""
    strings = D.Strings(np.arange(1, 11, dtype=np.int32)[None], np.zeros(1, np.int64))
    looked, real = [], D.Strings._hash
    monkeypatch.setattr(D.Strings, "_hash", staticmethod(
        lambda words: looked.append(len(words[0])) or real(words)))
    strings.find(np.zeros(9 * 1000, np.int32), np.array([0, 9000]))
    assert sum(looked) < 9000 / 8
