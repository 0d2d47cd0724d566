"""Quality by compression.

Two zstandard dictionaries are built, from texts labelled good and from texts labelled
bad. A text is compressed with either, in blocks, so that the dictionaries count all through a
long text; the difference of the compressed sizes over the plain size becomes a probability by
monotone calibration on labelled texts which the dictionaries have not seen: texts that
both compress alike, such as endless repetitions, are judged by what such texts were.

The labelled sample is bounded: the ``SAMPLE`` rows per label with the least hash of their
id, none longer than ``SAMPLE_CHARS``. Scores are of whole texts, of all rows.

Defined cases: a null or empty text has the share of good rows in the sample as its score,
as the calibration knows nothing of it; without labels of both kinds every score is that
share (0.5 without labels); repeated rows are scored alike; an empty table gives an empty
result; of a table's columns only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmob.llm.arrow import bytes_of, map_batches

SAMPLE = 1500  # rows per label, at most
SAMPLE_CHARS = 50_000
BLOCK = 1024  # bytes compressed at once
DICTIONARY = 100_000  # bytes
LEVEL = 3
THRESHOLD = 0.3


@dataclass
class Quality:
    """Two dictionaries and the calibration; picklable, of some 200 kB."""

    good: bytes
    bad: bytes
    at: np.ndarray | None = None  # differences, ascending, and their probabilities
    known: np.ndarray | None = None
    prior: float = 0.5

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_both"}

    def _compressors(self):
        if "_both" not in self.__dict__:
            self._both = []
            for content in (self.good, self.bad):
                known = zstandard.ZstdCompressionDict(content)
                known.precompute_compress(level=LEVEL)
                self._both.append(zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=known, write_content_size=False,
                    write_checksum=False, write_dict_id=False))
        return self._both

    def difference(self, text: bytes) -> float:
        """Normalised: above 0 if the good dictionary compresses better."""
        good, bad = self._compressors()
        g = b = 0
        for block in _blocks(text):
            g += len(good.compress(block))
            b += len(bad.compress(block))
        return (b - g) / max(len(text), 1)

    def score(self, text: bytes | None) -> float:
        if not text or self.at is None:
            return self.prior
        return float(np.interp(self.difference(text), self.at, self.known))


def _blocks(text: bytes) -> Iterator[bytes]:
    for at in range(0, len(text), BLOCK):
        yield text[at:at + BLOCK]


def fit(good: list[bytes], bad: list[bytes], prior: float) -> Quality:
    """Dictionaries from two thirds of the texts, calibration on the rest.

    ``prior`` is the share of good rows among all labelled; the sample is weighted to it.
    """
    if len(good) < 3 or len(bad) < 3:
        return Quality(b"", b"", prior=prior)
    model = Quality(*(_dictionary([t for i, t in enumerate(texts) if i % 3]) for texts in (good, bad)),
                    prior=prior)
    x = np.array([model.difference(t) for texts in (good, bad) for t in texts[::3]])
    y = np.repeat([1.0, 0.0], [len(good[::3]), len(bad[::3])])
    w = np.where(y == 1, prior / y.sum(), (1 - prior) / (len(y) - y.sum())) * len(y)
    model.at, model.known = _monotone(x, y, w)
    return model


def _dictionary(texts: list[bytes]) -> bytes:
    blocks = [b for t in texts for b in _blocks(t)]
    size = min(DICTIONARY, max(256, sum(map(len, blocks)) // 4))
    try:
        return zstandard.train_dictionary(size, blocks, k=64, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few blocks to train on: their contents themselves
        return b"".join(blocks)[-DICTIONARY:]


def _monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising curve of least squares: neighbours that fall are pooled.

    Between points it is interpolated, and outside it rises on to 0 and 1, so that
    different differences keep different scores.
    """
    pools: list[list[float]] = []  # weight, mean of x, mean of y
    for i in np.lexsort((y, x)):
        pools.append([w[i], x[i], y[i]])
        while len(pools) > 1 and pools[-2][2] >= pools[-1][2]:
            (w1, x1, y1), (w2, x2, y2) = pools.pop(), pools.pop()
            pools.append([w1 + w2, (w1 * x1 + w2 * x2) / (w1 + w2), (w1 * y1 + w2 * y2) / (w1 + w2)])
    pool = np.array(pools)
    known = np.clip(pool[:, 2], 0.02, 0.98)
    return np.concatenate([[-1], pool[:, 1], [1]]), np.concatenate([[0], known, [1]])


def train(docs: DataFrame, labels: DataFrame) -> Quality:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality)."""
    known = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality")
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = dict(known.groupBy("quality").count().collect())
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    texts = docs.where(F.length("text").between(1, SAMPLE_CHARS)).select("doc_id", "text")
    sample = {}
    for label in (1, 0):
        # ids with the least hashes first, so that only a few texts are fetched
        chosen = known.where(F.col("quality") == label).select(
            "doc_id", F.xxhash64("doc_id").alias("_h")).orderBy("_h", "doc_id").limit(SAMPLE)
        rows = texts.join(F.broadcast(chosen), "doc_id").orderBy("_h", "doc_id", "text").limit(SAMPLE)
        sample[label] = [r.text.encode() for r in rows.select("text").collect()]
    return fit(sample[1], sample[0], prior)


def score(docs: DataFrame, model: Quality) -> DataFrame:
    """Per row: doc_id, score."""
    def scored(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"doc_id": batch.column(0),
               "score": [model.score(t) for t in bytes_of(batch.column(1))]}

    return map_batches(docs.select("doc_id", "text"), scored, "doc_id long, score double")


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % by


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = train(docs, labels.where(remainder("doc_id", 5) != 0))
    return score(docs, model).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
