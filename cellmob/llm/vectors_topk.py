"""Exact top-k inner products by pivot-table elimination.

A vector gets a further component which makes all norms equal; then the largest inner
product is the smallest distance, and distances obey the triangle inequality. A table
holds the distances of every vector to many pivots. Candidates lie in blocks, and in a
block in groups of near neighbours, for which the table keeps the least and the greatest
distance to each pivot: for a query q, no member of a group is nearer than
``max over pivots of (d(q, p) - greatest, least - d(q, p))``. Groups are evaluated in the
order of these bounds until the best bound left is worse than the k-th result so far.

Blocks of queries meet blocks of candidates; a pair of blocks is one row. The pivots are
a bounded sample, all vectors are compared or eliminated by a proven bound, so results
are exact. Scores are computed in integers (in doubles while all sums are below 2**53).

Defined cases: a vector that is null, or holds a null or a component that is not finite,
takes no part, nor does a row without an id; vectors of different lengths are filled up
with zeros; of rows that share an id the least vector counts; ties go to the smaller id;
with fewer candidates than k, all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellmob.llm.arrow import arrow_schema
from cellmob.llm.scratch import written

K = 20
PIVOTS = 32
BLOCK = 4096  # candidates of a block
GROUP = 256  # candidates bounded together
QUERIES = 2048  # queries of a block
CHUNK = 128  # queries evaluated together
_EXACT = float(1 << 53)


def _matrix(rows: list, width: int) -> np.ndarray:
    """Whole numbers as doubles, or as Python integers if doubles can't hold the sums."""
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows, as 64-bit integers."""
    largest = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if largest < _EXACT:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], object).reshape(a.shape)
    other = np.array([[int(x) for x in row] for row in b], object).reshape(b.shape)
    bound = (1 << 63) - 1
    return np.clip(exact @ other.T, -bound - 1, bound).astype(np.int64)


class Space:
    """Pivots, and the square of a norm that none exceeds."""

    def __init__(self, pivots: np.ndarray, norm2: float) -> None:
        self.norm2 = norm2
        self.width = pivots.shape[1]
        self.pivots = self.lifted(pivots)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.norm2 - (x * x).sum(1), 0)
        return np.hstack([x, np.sqrt(rest)[:, None]])

    def table(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Distances to the pivots. A query has no further component: its norm is known."""
        y = np.hstack([x, np.zeros((len(x), 1))]) if query else self.lifted(x)
        d2 = (y * y).sum(1)[:, None] + (self.pivots ** 2).sum(1) - 2 * y @ self.pivots.T
        return np.sqrt(np.maximum(d2, 0))


class Block:
    """Candidates in groups of near neighbours, with bounds of their pivot distances."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, space: Space) -> None:
        table = space.table(x)
        nearest = table.argmin(1)
        order = np.lexsort((table[np.arange(len(x)), nearest], nearest)) if len(x) else []
        self.ids, self.x, table = ids[order], x[order], table[order]
        starts = np.arange(0, len(ids), GROUP)
        self.ends = np.append(starts[1:], len(ids))
        self.starts = starts
        self.least = np.minimum.reduceat(table, starts) if len(ids) else table
        self.greatest = np.maximum.reduceat(table, starts) if len(ids) else table

    def bounds(self, queries: np.ndarray, table: np.ndarray, norm2: float) -> np.ndarray:
        """Per query and group an upper bound of the inner product."""
        near = np.zeros((len(queries), len(self.starts)))
        for p in range(table.shape[1]):
            d = table[:, p, None]
            np.maximum(near, d - self.greatest[None, :, p], out=near)
            np.maximum(near, self.least[None, :, p] - d, out=near)
        q2 = (queries * queries).sum(1)[:, None]
        # |q|^2 + norm2 - 2 <q, x> is the squared distance; the slack covers rounding
        slack = 1e-9 * (q2 + norm2) + 1e-6
        return (q2 + norm2 - near ** 2) / 2 + slack


class Best:
    """The k best of each query of a chunk so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.n = k, n
        self.query = self.ids = self.scores = np.zeros(0, np.int64)
        self.worst = np.full(n, -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        query = np.concatenate([self.query, query])
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        # ~score instead of -score: the least integer has no negative
        order = np.lexsort((ids, ~scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        first = np.searchsorted(query, np.arange(self.n))
        rank = np.arange(len(query)) - first[query]
        kept = rank < self.k
        self.query, self.ids, self.scores = query[kept], ids[kept], scores[kept]
        full = (rank == self.k - 1)
        self.worst[query[full]] = scores[full]


def search(query_ids: np.ndarray, queries: np.ndarray, block: Block, space: Space, k: int,
           best: dict[int, Best]) -> None:
    """Add what ``block`` has to the results of a block of queries, chunk by chunk."""
    table = space.table(queries, query=True)
    order = np.argsort(table.argmin(1), kind="stable")  # chunks of queries with like bounds
    for c in range(0, len(order), CHUNK):
        rows = order[c:c + CHUNK]
        found = best.setdefault(c, Best(len(rows), k))
        bounds = block.bounds(queries[rows], table[rows], space.norm2)
        for g in np.argsort(-bounds.max(0, initial=-np.inf), kind="stable"):
            if bounds[:, g].max() < found.worst.min():
                if not (bounds >= found.worst[:, None]).any():
                    break  # what is left is no better than any k-th result
            active = np.flatnonzero(bounds[:, g] >= found.worst)
            bounds[:, g] = -np.inf
            if not len(active):
                continue
            s, e = block.starts[g], block.ends[g]
            scores = inner(queries[rows[active]], block.x[s:e])
            hit = scores >= found.worst[active][:, None]
            hit &= query_ids[rows[active]][:, None] != block.ids[s:e][None]
            i, j = np.nonzero(hit)
            found.add(active[i], block.ids[s:e][j], scores[i, j])


def _scaled(x: Column) -> Column:
    """floor(64 * x) as double; from 2**52 on a double is whole, and a long would overflow."""
    x = x.cast("double") * 64
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def top_k(vectors: DataFrame, queries: Column, k: int = K, pivots: int = PIVOTS) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding) for which ``queries`` holds, its k largest
    inner products with rows of another id: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    # of a number and an array only: no further column is read
    whole = (vectors.where("vec_id is not null and embedding is not null").select(
        "vec_id", F.transform("embedding", _scaled).alias("x"), F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)
                              & (F.abs(x.cast("double")) < float("inf"))).alias("_good"))
        .where("_good").groupBy("vec_id").agg(F.min("x").alias("x")))
    norm = F.aggregate("x", F.lit(0.0), lambda a, b: a + b * b)
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))
    table = written(whole.select("vec_id", "x", norm.alias("_norm2"), place.alias("_place"),
                                 queries.alias("_asks")), "vectors")
    n, norm2, width, asked = table.agg(
        F.count("*"), F.max("_norm2"), F.max(F.size("x")), F.count_if("_asks")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, 1)
    sample = table.orderBy("_place", "vec_id").limit(pivots).select("x").collect()
    space = Space(_matrix([r.x for r in sample], width), float(norm2))

    asks = _blocks(table.where("_asks"), QUERIES, max(asked, 1), width).select(
        F.col("block").alias("_q"), F.col("ids").alias("_qids"), F.col("x").alias("_qx"))
    blocks = _blocks(table, BLOCK, n, width)
    lots = -(-max(asked, 1) // QUERIES)
    # a lot of candidate blocks is searched by one task for one block of queries
    parts = max(1, -(-n // BLOCK) // 4)
    pairs = (blocks.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)).cast("array<long>")))
             .withColumn("_part", F.pmod("block", F.lit(parts)))
             .join(asks.withColumn("_part", F.explode(
                 F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>"))), ["_q", "_part"])
             .select("_q", "_part", "_qids", "_qx", "ids", "x"))
    found = pairs.mapInArrow(_searcher(space, width, k, arrow_schema(_FOUND)), _FOUND)
    return _merged(found, k)


_FOUND = "query_id long, vec_id long, score long"


def _blocks(table: DataFrame, rows: int, n: int, width: int) -> DataFrame:
    """Blocks of some ``rows`` vectors by hash: block, ids, x as packed doubles."""
    count = -(-n // rows)

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(list(pdf["x"]), width)
        return pd.DataFrame({"block": [int(pdf["_b"].iloc[0])],
                             "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
                             "x": [x.tobytes()]})

    return (table.withColumn("_b", F.pmod(F.xxhash64("vec_id"), F.lit(count)))
            .select("_b", "vec_id", "x").groupBy("_b")
            .applyInPandas(packed, "block long, ids binary, x binary"))


def _searcher(space: Space, width: int, k: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = None, {}
        for batch in batches:
            for at in range(batch.num_rows):
                q, _, qids, qx, ids, x = (c[at].as_py() for c in batch.columns)
                if asked is None or asked[0] != q:
                    if asked is not None:
                        yield from results(asked, best)
                    qm = np.frombuffer(qx, np.float64).reshape(-1, width)
                    asked, best = (q, np.frombuffer(qids, np.int64), qm), {}
                block = Block(np.frombuffer(ids, np.int64),
                              np.frombuffer(x, np.float64).reshape(-1, width), space)
                search(asked[1], asked[2], block, space, k, best)
        if asked is not None:
            yield from results(asked, best)

    def results(asked, best) -> Iterator[pa.RecordBatch]:
        _, query_ids, queries = asked
        order = np.argsort(space.table(queries, query=True).argmin(1), kind="stable")
        for c, b in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[order[c:c + CHUNK]][b.query]), pa.array(b.ids),
                 pa.array(b.scores)], schema=schema)

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of what the tasks found; each task's k per query are cut before the shuffle."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 64)) as x
  from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.x, c.x)::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank
  from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
