"""Hard-negative mining by slot-decomposed selection.

A positive of an anchor asks for the best rows of other labels whose score lies between a
share of its own and its own. These ranges overlap, but their upper limits cut all scores
into disjoint *slots*: slot s is what lies above the next lower limit and not above limit s.
Each task keeps, per anchor and slot, the k best rows it has seen, so that of any number of
rows only these are shuffled; the same is done once more over the tasks. What lies below a
positive's upper limit are its own slot and all lower ones: merging the slots of an anchor
from the lowest to the highest answers all its positives, each merge keeping k rows. The
lower limit of a positive then only cuts off the end of its list.

Anchors are a stated set of queries against all rows. They are taken in blocks of bounded
size, which go to the tasks that hold the rows; rows are read once to find the positives
(one slot without a limit, same label) and once for the negatives.

Defined cases: a row whose id, label or vector is null, or whose vector holds a null or a
component that is not finite, takes no part; vectors of different lengths are filled up
with zeros; of rows that share an id the one with the least label, then the least vector,
counts; ties go to the smaller id; an anchor without another row of its label returns
nothing; with fewer rows than asked for, all are returned; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellmob.llm.arrow import arrow_schema, map_batches
from cellmob.llm.scratch import written
from cellmob.llm.vectors_topk import inner

POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100  # percent of the positive's score
ANCHOR_BYTES = 16 << 20  # of the anchors in one block, as doubles
_ROWS = 4096  # compared at once with so many anchors:
_ANCHORS = 256
_LEAST = -(1 << 63)
_MOST = (1 << 63) - 1


class Slots:
    """The k best rows per anchor and slot so far; a combiner that can be merged."""

    def __init__(self, limits: np.ndarray, least: np.ndarray, k: int) -> None:
        """``limits``: per anchor the upper limits of its slots, descending, filled up with
        the least integer; ``least``: the score below which no slot has a use for a row."""
        self.limits, self.least, self.k = limits, least, k
        self.worst = np.full(limits.size, _LEAST)
        self.slot = self.ids = self.scores = np.zeros(0, np.int64)

    def add(self, anchors: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        below = (self.limits[anchors] >= scores[:, None]) & (self.limits[anchors] > _LEAST)
        place = below.sum(1) - 1
        fits = (place >= 0) & (scores >= self.least[anchors])
        slot = anchors[fits] * self.limits.shape[1] + place[fits]
        ids, scores = ids[fits], scores[fits]
        fits = scores >= self.worst[slot]
        slot = np.concatenate([self.slot, slot[fits]])
        ids = np.concatenate([self.ids, ids[fits]])
        scores = np.concatenate([self.scores, scores[fits]])
        order = np.lexsort((ids, ~scores, slot))  # ~: the least integer has no negative
        slot, ids, scores = slot[order], ids[order], scores[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        last = rank == self.k - 1
        self.worst[slot[last]] = scores[last]
        kept = rank < self.k
        self.slot, self.ids, self.scores = slot[kept], ids[kept], scores[kept]


def ranges(scores: Iterable[int], low: int = LOW, high: int = HIGH) -> list[tuple[int, int]]:
    """The whole scores that each positive's negatives may have: least and greatest."""
    return [(-(-low * p // 100), high * p // 100) for p in scores]


def slot_limits(scores: Iterable[int], low: int = LOW, high: int = HIGH) -> list[int]:
    """The different upper limits of non-empty ranges, descending."""
    return sorted({b for a, b in ranges(scores, low, high) if a <= b}, reverse=True)


def answers(positives: list[tuple[int, int]], slots: dict[int, list[tuple[int, int]]],
            k: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> Iterator[tuple]:
    """(positive id, its score, rank, negative id, its score) of one anchor.

    ``positives`` are (id, score); ``slots`` has for each limit the k best (score, id) of
    its slot. Slots are merged from the lowest up, each merge being the answer for all
    positives with that upper limit, but for what lies below their lower limits.
    """
    merged: dict[int, list[tuple[int, int]]] = {}
    best: list[tuple[int, int]] = []
    for limit in reversed(slot_limits((p for _, p in positives), low, high)):
        best = sorted(best + slots.get(limit, []), key=lambda x: (-x[0], x[1]))[:k]
        merged[limit] = best
    for (positive, p), (least, most) in zip(positives, ranges((p for _, p in positives), low, high)):
        if least <= most:
            inside = [x for x in merged[most] if x[0] >= least]
            for rank, (score, row) in enumerate(inside, 1):
                yield positive, p, rank, row, score


# ---- over tables ------------------------------------------------------------------------

def _matrix(column: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Block:
    """Some anchors: ids, labels and vectors."""

    def __init__(self, table: pa.Table, width: int) -> None:
        table = table.combine_chunks().sort_by("vec_id")
        self.ids = table["vec_id"].to_numpy()
        self.labels = table["label"].to_numpy()
        self.x = _matrix(table["x"].combine_chunks(), width) if len(table) else np.zeros((0, width))


def _combined(rows: DataFrame, block: Block, limits: np.ndarray, least: np.ndarray, k: int,
              same: bool, width: int) -> DataFrame:
    """The k best rows of each task per anchor and slot: anchor, at (its place in the
    block), limit (of the slot), vec_id, score."""
    schema = "anchor long, at long, limit long, vec_id long, score long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = [Slots(limits[a:a + _ANCHORS], least[a:a + _ANCHORS], k)
                 for a in range(0, len(block.ids), _ANCHORS)]
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                x = _matrix(part.column(2), width)
                for n, found in enumerate(slots):
                    a = slice(n * _ANCHORS, (n + 1) * _ANCHORS)
                    scores = inner(block.x[a], x)
                    fits = (block.labels[a][:, None] == labels) == same
                    fits &= block.ids[a][:, None] != ids
                    fits &= scores >= np.maximum(
                        found.least, found.worst.reshape(limits[a].shape).min(1))[:, None]
                    fits &= scores <= found.limits[:, :1]
                    i, j = np.nonzero(fits)
                    if len(i):
                        found.add(i, ids[j], scores[i, j])
        for n, found in enumerate(slots):
            at, slot = np.divmod(found.slot, limits.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (
                block.ids[at + n * _ANCHORS], at + n * _ANCHORS, found.limits[at, slot],
                found.ids, found.scores)], schema=arrow)

    return rows.select("vec_id", "label", "x").mapInArrow(run, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("anchor", "limit").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _whole(x: Column, scale: int) -> Column:
    """floor(scale * x) as double; from 2**52 on a double is whole."""
    x = x.cast("double") * scale
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def mine(vectors: DataFrame, anchors: Column, scale: int = 256, positives: int = POSITIVES,
         negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         block_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """For each row of ``vectors`` (vec_id, embedding, label) for which ``anchors``, a
    condition on vec_id, holds, and each of its ``positives`` best rows of the same label:
    the ``negatives`` best rows of other labels that score between ``low`` and ``high``
    percent of the positive: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x.cast("double")) < float("inf")))
    rows = (vectors.where("vec_id is not null and label is not null and embedding is not null")
            .select("vec_id", F.col("label").cast("long").alias("label"), good.alias("_good"),
                    F.transform("embedding", lambda x: _whole(x, scale)).alias("x"))
            .where("_good").groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("_row")))
    rows = written(rows.select("vec_id", "_row.label", "_row.x", anchors.alias("_asks")), "vectors")
    width, asked = rows.agg(F.max(F.size("x")), F.count_if("_asks")).first()
    width = max(width or 0, 1)
    # blocks by hash hold some ``block_bytes`` each
    blocks = max(1, -(-asked * 8 * (width + 8 * positives) // block_bytes))
    found_positives, found_negatives = [], []
    for b in range(blocks):
        asks = rows.where("_asks").where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        block = Block(asks.select("vec_id", "label", "x").toArrow(), width)
        n = len(block.ids)
        near = written(_best(_combined(
            rows, block, np.full((n, 1), _MOST), np.full(n, _LEAST), positives, True, width),
            positives), "positives")
        # a block's anchors have at most so many positives each
        scores: list[list[int]] = [[] for _ in range(n)]
        for r in near.select("at", "score").collect():
            scores[r.at].append(r.score)
        limits, least = np.full((n, positives), _LEAST), np.full(n, _MOST)
        for i, known in enumerate(scores):
            edges = slot_limits(known, low, high)
            limits[i, :len(edges)] = edges
            least[i] = min((a for a, b in ranges(known, low, high) if a <= b), default=_MOST)
        found_positives.append(near.select("anchor", "vec_id", "score"))
        found_negatives.append(written(_best(_combined(
            rows, block, limits, least, negatives, False, width), negatives)
            .select("anchor", "limit", "vec_id", "score"), "negatives"))

    def all_of(parts: list[DataFrame]) -> DataFrame:
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    # bounded lists: so many positives, and so many rows per slot
    asked_for = all_of(found_positives).groupBy("anchor").agg(
        F.collect_list(F.struct("vec_id", "score")).alias("positives"))
    offered = all_of(found_negatives).groupBy("anchor").agg(
        F.collect_list(F.struct("limit", "score", "vec_id")).alias("slots"))

    def answered(batch: pa.RecordBatch) -> Iterator[dict]:
        out = {k: [] for k in _NAMES}
        for anchor, near, slotted in zip(*(c.to_pylist() for c in batch.columns)):
            slots: dict[int, list[tuple[int, int]]] = {}
            for x in slotted:
                slots.setdefault(x["limit"], []).append((x["score"], x["vec_id"]))
            near = [(x["vec_id"], x["score"]) for x in near]
            for p, p_score, rank, row, score in answers(near, slots, negatives, low, high):
                for k, v in zip(out, (anchor, p, rank, row, p_score, score)):
                    out[k].append(v)
        yield out

    return map_batches(asked_for.join(offered, "anchor").select("anchor", "positives", "slots"),
                       answered, _RESULT)


_RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
           "negative_score long")
_NAMES = [field.split()[0] for field in _RESULT.split(", ")]


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(x::double * 256)) as x
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
         list_dot_product(a.x, c.x)::bigint as score
  from v a join v c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from (
    select *, row_number() over (partition by anchor_id order by score desc, vec_id) as place
    from s where same) where place <= 5),
n as (
  select anchor_id, positive_id, positive_score, s.vec_id as negative_id,
         s.score as negative_score, (row_number() over (partition by anchor_id, positive_id
           order by s.score desc, s.vec_id))::int as rank
  from p join s using (anchor_id)
  where not same and 80 * positive_score <= 100 * s.score
    and 100 * s.score <= 100 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score
from n where rank <= 5
"""
