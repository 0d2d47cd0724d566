"""Exact deduplication by Grace hashing.

Records are partitioned by a hash of their content: over tasks by the shuffle, and inside
a task into spill files, again and again by further bits of the hash, until the distinct
contents of a bucket fit an open-addressing table in memory, which compares complete
contents. A spill file lives only while its task works on it; a lost executor's tasks
start over from the shuffle. Each task of the scan does this first with its own rows, so
that of a group of copies, however large, at most one row per task is shuffled.

Defined cases: null text counts as empty; an empty table gives an empty result; repeated
rows are copies of each other and return one row each, all marked kept if their id is the
one that stays; rows without an id stay only if no copy has one; other columns are not read.
``keep_first`` chooses rows, not ids: of each group exactly one stays.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmob.llm.arrow import arrow_schema, give_back, map_batches, texts_of
from cellmob.llm.scratch import written

BLANKS = b" \t\n\x0b\x0c\r"
TABLE_BYTES = 64 << 20  # distinct contents held in memory at once
FAN_OUT = 16
_FLUSH_ROWS, _FLUSH_BYTES = 1024, 16 << 20

# a record: hash, content, and of the best row so far n_chars and doc_id, then the row count
Record = tuple[int, bytes, int, int | None, int]


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, BLANKS)


class ContentTable:
    """Open addressing with linear probing; a slot matches when the contents are equal."""

    def __init__(self, limit: int) -> None:
        self.limit, self.bytes = limit, 0
        self.entries: list[list] = []
        self.slots = [-1] * 1024

    def _find(self, h: int, content: bytes) -> int:
        mask, at = len(self.slots) - 1, h & (len(self.slots) - 1)
        while (e := self.slots[at]) >= 0:
            if self.entries[e][0] == h and self.entries[e][1] == content:
                break
            at = (at + 1) & mask
        return at

    def add(self, record: Record) -> bool:
        """False if the content is new and there is no room for it."""
        h, content, n_chars, doc, count = record
        at = self._find(h, content)
        if (e := self.slots[at]) >= 0:
            entry = self.entries[e]
            if better((n_chars, doc), (entry[2], entry[3])):
                entry[2], entry[3] = n_chars, doc
            entry[4] += count
            return True
        if self.entries and self.bytes + len(content) > self.limit:
            return False
        self.slots[at] = len(self.entries)
        self.entries.append(list(record))
        self.bytes += len(content) + 128
        if 2 * len(self.entries) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for i, x in enumerate(self.entries):
                self.slots[self._find(x[0], x[1])] = i
        return True


def better(a: tuple, b: tuple) -> bool:
    """More code points, then the smaller id; rows without an id come last."""
    return (a[0], a[1] is not None, -(a[1] or 0)) > (b[0], b[1] is not None, -(b[1] or 0))


def grace(records: Iterable[Record], limit: int = TABLE_BYTES, depth: int = 0) -> Iterator[Record]:
    """One record per distinct content. Contents that find no room in the table go to the
    spill file of their next hash bits, and each file is treated alike."""
    table = ContentTable(limit)
    with tempfile.TemporaryDirectory() as folder:
        files = [None] * FAN_OUT
        for record in records:
            if not table.add(record):
                bucket = record[0] >> (60 - 4 * (depth % 15)) & (FAN_OUT - 1)
                if files[bucket] is None:
                    files[bucket] = open(Path(folder, str(bucket)), "wb")
                pickle.dump(record, files[bucket], protocol=5)
        yield from (tuple(x) for x in table.entries)
        del table
        for bucket, file in enumerate(files):
            if file is not None:
                file.close()
                yield from grace(_spilled(Path(folder, str(bucket))), limit, depth + 1)


def _spilled(path: Path) -> Iterator[Record]:
    with open(path, "rb") as file:
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                break
    path.unlink()


_RECORD = "h long, content binary, n_chars long, keep_id long, n long"


def _reduce(records_of, df: DataFrame, schema: str, row) -> DataFrame:
    arrow = arrow_schema(schema)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        rows, held = [], 0
        for record in grace(r for batch in batches for r in records_of(batch)):
            rows.append(row(record))
            held += len(record[1])
            if len(rows) == _FLUSH_ROWS or held > _FLUSH_BYTES:
                yield packed(rows)
                rows, held = [], 0
        if rows:
            yield packed(rows)

    return df.mapInArrow(run, schema)


def _scanned(batch: pa.RecordBatch) -> Iterator[Record]:
    for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
        content = normalised(text)
        h = int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True)
        yield h, content, len(text or ""), doc, 1


def _shuffled(batch: pa.RecordBatch) -> Iterator[Record]:
    yield from zip(*(c.to_pylist() for c in batch.columns))


def content_groups(docs: DataFrame) -> DataFrame:
    """Per distinct normalised content: text_sha256, keep_id, group_size."""
    local = _reduce(_scanned, docs.select("doc_id", "text"), _RECORD, lambda r: r)
    dealt = local.repartition("h")
    return _reduce(_shuffled, dealt, "text_sha256 string, keep_id long, group_size long",
                   lambda r: (hashlib.sha256(r[1]).hexdigest(), r[3], r[4]))


def _digests(batch: pa.RecordBatch) -> Iterator[dict]:
    yield {"doc_id": batch.column(0), "text_sha256": [
        hashlib.sha256(normalised(t)).hexdigest() for t in texts_of(batch.column(1))],
        **{name: batch.column(name) for name in batch.schema.names[2:]}}


def _judged(docs: DataFrame, more: str = "") -> DataFrame:
    """What ``dedup`` returns, and the long columns named in ``more``."""
    groups = written(content_groups(docs), "groups")
    names = more.split()
    rows = map_batches(docs.select("doc_id", "text", *names), _digests, ", ".join(
        ["doc_id long, text_sha256 string", *(f"{x} long" for x in names)]))
    return rows.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", *names)


def dedup(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256. Of rows with
    equal normalised texts the one with most code points, then the smallest id is kept."""
    return _judged(docs)


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each group: of the rows with its kept id, which may be null,
    the one with most code points, then the first."""
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    sized = rows.select("doc_id", "text", "_row", F.coalesce(
        F.length("text"), F.lit(0)).cast("long").alias("_chars"))
    one = _judged(sized, "_row _chars").where("kept").groupBy("text_sha256").agg(
        F.min(F.struct((-F.col("_chars")).alias("_less"), "_row"))["_row"].alias("_row"))
    return rows.join(one.select("_row"), "_row", "left_semi").select(*docs.columns)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with n as (
  select doc_id, length(coalesce(text, '')) as n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents)
select doc_id, first_value(doc_id) over (w order by n_chars desc, doc_id) as keep_id,
       count(*) over w as group_size,
       doc_id is not distinct from first_value(doc_id) over (w order by n_chars desc, doc_id) as kept,
       text_sha256
from n window w as (partition by text_sha256)
"""
