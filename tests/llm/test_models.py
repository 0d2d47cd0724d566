"""Language and quality on held-out rows; top-k against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmob.llm import language, quality, queries, vectors_topk

SF_DIR = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    got = {r.doc_id: r for r in language.op5(spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang").collect()
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 3 == 1]
    assert len(got) == len(docs) and {d.doc_id for d in held} == {i for i, r in got.items() if r.held_out}
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_odd_texts(frame):
    docs = frame([(i, f"the {w} of and", "en") for i, w in enumerate(["house"] * 9)]
                 + [(20 + i, f"der {w} und die", "de") for i, w in enumerate(["haus"] * 9)]
                 + [(50, "x", None), (60, None, "fr"), (61, None, None)])
    model = language.train(docs)
    assert model.names == ["de", "en"]
    odd = frame([(1, None), (2, ""), (3, "123 € !"), (4, "der und " * 50_000), (5, "é"), (None, "the")])
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in language.predict(odd, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", True)] * 3
    assert got[4][0] == "de" and got[None][0] == "en" and got[5][0] in ("de", "en")
    kept = language.accepted(odd, model)
    assert kept.columns == odd.columns and not {1, 2, 3} & {r.doc_id for r in kept.collect()}
    assert language.predict(frame([]), model).collect() == []
    empty = language.train(frame([]))
    assert [r.lang_pred for r in language.predict(odd, empty).collect()] == ["und"] * 6


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    good = label == 1
    return (rank[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


def test_quality_of_held_out_documents(spark):
    # some hundred bad texts to learn from; the smaller tables have too few to judge by
    got = {r.doc_id: r for r in quality.op3(spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    held = [x for x in labels if zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert {x.doc_id for x in held} <= {i for i, r in got.items() if r.held_out}
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    assert auc(np.array([got[x.doc_id].score for x in held]), np.array([x.quality for x in held])) > 0.98


def test_quality_of_odd_texts(spark, frame):
    labels = "doc_id long, quality int, toxic int"
    docs = frame([(1, None), (2, ""), (3, "x" * 300_000), (4, "a"), (4, "a"), (None, "b")])
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (None, 1, 0), (4, None, 0)], labels)
    model = quality.train(docs, some)
    got = quality.score(docs, model).collect()
    assert len(got) == 6 and {r.score for r in got} == {2 / 3}
    none = quality.train(frame([]), spark.createDataFrame([], labels))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(frame([]), none).collect() == []


def plain_top(rows, asks, k):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            x = [int(np.floor(np.float64(np.float32(c)) * 64)) for c in v]
            vectors[i] = min(vectors.get(i, x), x)
    out = set()
    for q, x in vectors.items():
        if asks(q):
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in vectors.items() if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("shape", ["cloud", "clusters", "ties", "large"])
def test_top_k(spark, shape, monkeypatch):
    monkeypatch.setattr(vectors_topk, "BLOCK", 200)
    monkeypatch.setattr(vectors_topk, "GROUP", 16)
    monkeypatch.setattr(vectors_topk, "QUERIES", 30)
    monkeypatch.setattr(vectors_topk, "CHUNK", 7)
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (900, 8))
    if shape == "clusters":
        x = rng.normal(0, 8, (9, 8))[rng.integers(0, 9, 900)] + x / 10
    if shape == "ties":
        x = rng.integers(0, 2, (900, 8)).astype(float)
    if shape == "large":
        x = x * 1e6
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8),
             (None, [1.0] * 8), (2005, []), (2010, [3.0, 1.0]), rows[10], rows[10]]
    df = spark.createDataFrame([(i, v, "n") for i, v in rows], "vec_id long, embedding array<float>, x string")
    got = vectors_topk.top_k(df, F.col("vec_id") % 10 == 0, 20).collect()
    want = plain_top(rows, lambda i: i % 10 == 0, 20)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0]), (20, [2.0]), (3, [-1.0])], "vec_id long, embedding array<float>")
    got = vectors_topk.top_k(df, F.col("vec_id") % 20 == 0).collect()
    assert {tuple(r) for r in got} == {(0, 1, 20, 8192), (0, 2, 3, -4096), (20, 1, 0, 8192), (20, 2, 3, -8192)}
    assert vectors_topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_huge_products_saturate_alike():
    a = np.array([[2.0 ** 40, -3.0]])
    assert vectors_topk.inner(a, a).tolist() == [[(1 << 63) - 1]]
    b = np.array([[2.0 ** 30, 5.0]])
    assert vectors_topk.inner(b, b).tolist() == [[(1 << 60) + 25]]


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_letters_are_those_of_unicode():
    for text in ("½", "²", "①", "Ⅷ", "٣", "12 _ !", "", "́"):
        assert not language.has_letter(text.encode())
    for text in ("½ a", "é", "日", "ǅ", "ª", "Ⅷ ß"):
        assert language.has_letter(text.encode())


def test_rows_that_teach_are_bounded(frame, monkeypatch):
    """Many rows without an id, of one id, and alike; many labels."""
    monkeypatch.setattr(language, "SAMPLE", 20)
    monkeypatch.setattr(language, "LANGUAGES", 3)
    seen = []
    monkeypatch.setattr(language, "fit", lambda texts, langs: seen.append((texts, langs)))
    rows = [(None, f"no id {i}", "aa", "s") for i in range(300)] + [(7, f"one id {i}", "bb", "s") for i in range(300)]
    rows += [(i, "the same", "cc", "s") for i in range(200)] + [(9, "alike in all", "cc", "s")] * 200
    rows += [(i, f"rare {i}", f"r{i}", "s") for i in range(50)]
    language.train(frame(rows))
    language.train(frame(rows, 7))
    texts, langs = seen[0]
    assert Counter(langs) == {"aa": 20, "bb": 20, "cc": 20} and seen[0] == seen[1]
    assert len(set(zip(texts, langs))) > 40


def test_scores_of_kept_texts_are_calibrated(spark):
    """Texts of two languages that share most words: the mean score is the share that is right,
    and of right predictions hardly one is below the score that rejects."""
    rng = random.Random(3)
    letters = lambda i: "abcdefghij"[i // 10] + "klmnopqrst"[i % 10]
    common = [f"w{letters(i)}" for i in range(60)]
    def text(lang):
        own = [f"{lang}{letters(i)}x" for i in range(6)]
        return " ".join(rng.choice(own if rng.random() < 0.04 else common) for _ in range(25)).encode()
    langs = ["aa", "bb"] * 600
    model = language.fit([text(x) for x in langs], langs)
    new = ["aa", "bb"] * 500
    found = [model.predict(text(x)) for x in new]
    right = np.array([f[0] == x for f, x in zip(found, new)])
    scores = np.array([f[1] for f in found])
    assert 0.6 < right.mean() < 0.97 and abs(scores.mean() - right.mean()) < 0.1
    assert (scores[right] < model.least).mean() < 0.02
