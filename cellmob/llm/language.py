"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's subwords are its n-grams of two to four bytes, in lower case, with all that is
no letter made blank. Each is hashed to a row of an embedding table; the rows are averaged
and go through a linear softmax. Table and softmax are trained together by stochastic
gradient descent in numpy. On texts kept from training, a temperature is fitted that makes
the winner's probability a calibrated score, and a score below which texts are rejected.

The sample is bounded: of each of the ``LANGUAGES`` commonest labels the ``SAMPLE`` different
rows whose id and text have the least hashes, and of each ``SNIPPETS`` pieces spread over
the whole text. Predictions are of whole texts, of all rows.

Defined cases: a text that is null or holds no letter (Unicode category L: neither digits nor
fractions, superscripts or Roman numerals) is ``und`` with score 0; without any
labelled text so is every text; a document whose lang is null teaches nothing; repeated
rows are predicted alike, and teach once; rows without an id teach like others; an empty table gives an empty result; lang and text are read
for training, doc_id and text for predictions, and no other column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellmob.llm.arrow import arrow_schema, bytes_of, give_back, map_batches
from cellmob.llm.quality import remainder

BUCKETS = 1 << 15
WIDTH = 8
GRAMS = (2, 3, 4)
SAMPLE = 500  # texts per language
LANGUAGES = 256  # that are learned
SNIPPETS = 4
SNIPPET = 240  # bytes
EPOCHS = 6
BATCH = 32
RATE = 0.5
REJECTED = 0.001  # of the right predictions on texts kept from training
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_BLANK = np.arange(256, dtype=np.uint8)
for _b in range(128):
    _BLANK[_b] = ord(chr(_b).lower()) if chr(_b).isalpha() else 32
_SEGMENT = 1 << 16


def subwords(text: bytes) -> np.ndarray:
    """Rows of the table for the n-grams of some text."""
    b = _BLANK[np.frombuffer(b" " + text + b" ", np.uint8)].astype(np.uint32)
    code, found = b, []
    for n in range(2, max(GRAMS) + 1):
        code = code[:-1] | b[n - 1:] << np.uint32(8 * (n - 1))
        if n in GRAMS:
            mixed = (code ^ np.uint32(n * 0x9E3779)) * np.uint32(2654435761)
            found.append((mixed >> np.uint32(32 - 15)) & np.uint32(BUCKETS - 1))
    return np.concatenate(found)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    # the pattern also finds other numbers than decimal ones
    return any(m[0].isalpha() for m in _LETTER.finditer(text.decode("utf-8", "ignore")))


@dataclass
class Languages:
    names: list[str]
    table: np.ndarray  # BUCKETS x WIDTH
    weights: np.ndarray  # WIDTH x languages
    offset: np.ndarray
    temperature: float = 1.0
    least: float = 0.0  # texts with a lower score are rejected

    def logits(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(WIDTH), 0
        for at in range(0, len(text), _SEGMENT):
            rows = subwords(text[at:at + _SEGMENT])
            total += self.table[rows].sum(0, dtype=np.float64)
            n += len(rows)
        return (total / max(n, 1)) @ self.weights + self.offset

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if not self.names or not has_letter(text):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(text)[None] / self.temperature)[0]
        return self.names[p.argmax()], float(p.max())


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def snippets(text: bytes) -> list[bytes]:
    if len(text) <= SNIPPET:
        return [text]
    starts = np.linspace(0, len(text) - SNIPPET, SNIPPETS).astype(int)
    return [text[s:s + SNIPPET] for s in dict.fromkeys(starts.tolist())]


def fit(texts: list[bytes], langs: list[str], seed: int = 5) -> Languages:
    """A model; every fifth text is kept from training, for calibration."""
    names = sorted(set(langs))
    if not names:
        return Languages([], np.zeros((BUCKETS, WIDTH)), np.zeros((WIDTH, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    label = np.array([names.index(x) for x in langs])
    kept = np.arange(len(texts)) % 5 == 4
    rows, y = [], []
    for i in np.flatnonzero(~kept):
        for s in snippets(texts[i]):
            rows.append(subwords(s))
            y.append(label[i])
    y = np.array(y)
    # each language weighs the same, whatever its share of the sample
    weight = (len(y) / (len(names) * np.maximum(np.bincount(y, minlength=len(names)), 1)))[y]
    model = Languages(names, np.zeros((BUCKETS, WIDTH)),
                      rng.normal(0, 1, (WIDTH, len(names))), np.zeros(len(names)))
    steps = EPOCHS * -(-len(y) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            _descend(model, [rows[i] for i in order[at:at + BATCH]], y[order[at:at + BATCH]],
                     weight[order[at:at + BATCH]], RATE * (1 - step / steps))
            step += 1
    model.table = model.table.astype(np.float32)
    _calibrate(model, [texts[i] for i in np.flatnonzero(kept)], label[kept])
    return model


def _descend(model: Languages, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray,
             rate: float) -> None:
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mean = np.add.reduceat(model.table[flat], starts, axis=0) / sizes[:, None]
    grad = _softmax(mean @ model.weights + model.offset)
    grad[np.arange(len(y)), y] -= 1
    grad *= weight[:, None]
    back = grad @ model.weights.T
    model.weights -= rate / len(y) * mean.T @ grad
    model.offset -= rate / len(y) * grad.sum(0)
    # a row of the table moves by its share in each text; shares are small, the rate is not
    share = np.repeat(back / sizes[:, None] ** 0.5, sizes, axis=0)
    for d in range(WIDTH):
        model.table[:, d] -= rate * np.bincount(flat, share[:, d], BUCKETS)


def _calibrate(model: Languages, texts: list[bytes], label: np.ndarray) -> None:
    """Temperature by the likelihood of kept texts and their snippets; then the least score."""
    logits, truth = [], []
    for t, y in zip(texts, label):
        if has_letter(t):
            for s in [t, *snippets(t)]:
                logits.append(model.logits(s))
                truth.append(y)
    if not logits:
        return
    logits, truth = np.array(logits), np.array(truth)
    def loss(temperature: float) -> float:
        return -np.log(_softmax(logits / temperature)[np.arange(len(truth)), truth] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    p = _softmax(logits / model.temperature)
    right = p.max(1)[p.argmax(1) == truth]
    if len(right):
        model.least = float(min(np.quantile(right, REJECTED), 0.5))


def train(docs: DataFrame) -> Languages:
    """A model from ``docs`` (doc_id, text, lang)."""
    known = docs.where("lang is not null and text is not null").select(
        "lang", "text", F.xxhash64("doc_id", "text").alias("_hash"))
    common = (known.groupBy("lang").agg(F.count("*").alias("_rows"),
                                        F.approx_count_distinct("_hash").alias("_different"))
              .orderBy(F.desc("_rows"), "lang").limit(LANGUAGES).select("lang", "_different"))
    # of the different hashes a part that is expected to be some times as many as needed
    part = F.pmod("_hash", F.lit(1 << 30)) * F.col("_different") < F.lit(4 * SAMPLE << 30)
    known = known.join(F.broadcast(common), "lang").where(part)
    least = W.partitionBy("lang").orderBy("_hash")
    limits = (known.select("lang", "_hash").distinct()
              .withColumn("_place", F.row_number().over(least)).where(F.col("_place") <= SAMPLE)
              .groupBy("lang").agg(F.max("_hash").alias("_limit")))
    chosen = (known.join(F.broadcast(limits), "lang")  # a row per language, LANGUAGES at most
              .where(F.col("_hash") <= F.col("_limit")).dropDuplicates(["lang", "_hash"]))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(
        F.col("text"), (F.floor((F.length("text") - 1024) * i / 7) + 1).cast("int"), F.lit(1024)))
    # of a very long text, eight pieces spread over it come to the driver
    chosen = chosen.select("_hash", "lang", F.when(F.length("text") > 65536, F.array_join(
        pieces, " ")).otherwise(F.col("text")).alias("text"))
    rows = sorted(chosen.collect(), key=lambda r: (r.lang, r["_hash"]))
    return fit([r.text.encode() for r in rows], [r.lang for r in rows])


def predict(docs: DataFrame, model: Languages) -> DataFrame:
    """Per row: doc_id, lang_pred, score, rejected."""
    def predicted(batch: pa.RecordBatch) -> Iterator[dict]:
        found = [model.predict(t) for t in bytes_of(batch.column("text"))]
        yield {"doc_id": batch.column("doc_id"), "lang_pred": [x[0] for x in found],
               "score": [x[1] for x in found], "rejected": [_rejected(model, *x) for x in found]}

    return map_batches(docs.select("doc_id", "text"), predicted,
                       "doc_id long, lang_pred string, score double, rejected boolean")


def _rejected(model: Languages, name: str, score: float) -> bool:
    return name == UNKNOWN or score < model.least


def accepted(docs: DataFrame, model: Languages) -> DataFrame:
    """The rows of ``docs`` whose text is not rejected."""
    schema = arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            kept = [not _rejected(model, *model.predict(t)) for t in bytes_of(batch.column("text"))]
            yield batch.filter(pa.array(kept, pa.bool_())).cast(schema)

    return docs.mapInArrow(run, docs.schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(remainder("doc_id", 3) != 1))
    return predict(docs, model).select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
