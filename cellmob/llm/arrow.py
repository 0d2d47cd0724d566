"""Small helpers for functions over Arrow batches."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from types import ModuleType

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

import cellmob.llm

# Functions go to the executors with their code, so these need not have this package.
cloudpickle.register_pickle_by_value(cellmob.llm)


def map_batches(df: DataFrame, per_batch: Callable[[pa.RecordBatch], Iterable[dict]],
                schema: str, keeps: bool = False) -> DataFrame:
    """``df.mapInArrow`` for a function that yields columns as a dict of lists or arrays. One
    that does not say it ``keeps`` something begins by giving back the worker's memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            give_back()
        for batch in batches:
            for columns in per_batch(batch):
                yield pa.RecordBatch.from_pydict(columns, schema=arrow)

    arrow = arrow_schema(schema)
    return df.mapInArrow(run, schema)


def worker_memory() -> dict:
    """What this Python worker keeps from one task to the next. Spark reuses its workers, but
    unpickles the functions of each task anew; only what is costly to make again and bounded
    in size belongs here."""
    name = "cellmob_worker_memory"
    return vars(sys.modules.setdefault(name, ModuleType(name))).setdefault("kept", {})


def give_back() -> None:
    """Other tasks of the worker need the room."""
    worker_memory().clear()


def arrow_schema(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def texts_of(column: pa.Array) -> list[str | None]:
    return column.to_pylist()


def bytes_of(column: pa.Array) -> list[bytes | None]:
    """The texts of a string column in UTF-8."""
    return column.cast(pa.binary()).to_pylist()
