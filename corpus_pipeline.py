"""A corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Its
result is to be written, and read again as the next one's docs: when the next stage begins,
the tables that this one wrote for itself are deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from cellmob.llm import exact_dedup, language, minhash, mixing, packing, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_own: list[scratch.Table] = []  # what the last stage wrote for itself


def _stage(function: Stage) -> Stage:
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.clear(_own)
        with scratch.recorded() as written:
            result = function(spark, docs, sf_dir)
        _own[:] = written
        return result

    return run_stage


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty."""
    return language.accepted(docs.select(*COLUMNS), language.train(docs))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest document of each group that differs in white space only."""
    return exact_dedup.keep_first(docs.select(*COLUMNS))


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8."""
    return minhash.keep_first(docs.select(*COLUMNS), words=5, percent=80)


@_stage
def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, up to twice."""
    return mixing.repeated(docs.select(*COLUMNS))


@_stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4,096 tokens."""
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))).drop("row")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("source_mixing", mixing_weights),
    ("best_fit_packing", sequences),
]

ORACLE_SQL = None  # no SQL for a fitted model, MinHash or best-fit packing


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[scratch.Table] = []
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            with scratch.recorded() as result:
                docs = scratch.written(docs, name)
            scratch.clear(before)  # the stage that read it has been written
            before = result
    return docs
