"""Near-duplicate detection by MinHash with tensored banding.

Two collections of short bands are computed per document, and every pair of a band of the
first with a band of the second makes a table key. So t * t tables need 2 * t bands, about
the square root of the minhashes that independent tables would take. Similar documents meet
in some table, unless they share no band of one collection; the number of bands follows
from the threshold, so that a pair exactly at it is missed with probability ``MISSED``.

1. Documents with equal sets of shingles become one class; its least id stands for it.
2. In each bucket all classes are held against two of its members: the least, and the one
   that meets most others. The connected components of the pairs whose minhashes agree in
   some degree are clusters: families of texts, mostly of a few.
3. Members of one bucket but different clusters are compared by minhashes, in the tasks
   that hold the bucket, and what can be similar joins its clusters.
4. The texts of a cluster meet, and an index from shingles to texts gives the exact sizes
   of all their intersections. Each task returns links that connect what is connected in
   it, not all links: their connected components are the same, and their number is below
   that of the texts.

Neither a bucket nor a cluster is gathered as a whole: its members fall into blocks of
limited size, and every pair of blocks is compared by one task.

Defined cases: a document without words, or with a null text, is linked with nothing; with
fewer words than a shingle the whole sequence is one shingle; rows without an id are
components of their own with a null id; rows that share an id share its component; an empty
table gives an empty result; only doc_id and text are read. ``keep_first`` takes every row
for a document of its own, whatever its id, and of each component exactly one row stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmob.llm.arrow import arrow_schema, bytes_of, map_batches
from cellmob.llm.repeats import Powers, mixed, word_symbols
from cellmob.llm.scratch import small, written

ROWS = 3  # minhashes of a band
MISSED = 1e-3
LOOSE = 0.5  # share of minhashes that agree in a cluster, or less if links need less
BLOCK = 2048  # classes of a bucket held by one task at a time
SHINGLES = 1_000_000  # of a cluster held by one task at a time
_TEXTS = 400_000  # shingles hashed at once

_U = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass(frozen=True)
class Likeness:
    """Shingles of ``words`` words, and at least ``percent`` of their union in common."""

    words: int
    percent: int

    @property
    def bands(self) -> int:
        missing = 1 - (self.percent / 100) ** ROWS
        return max(1, math.ceil(math.log(MISSED / 2) / math.log(missing))) if missing else 1

    @property
    def hashes(self) -> int:
        return 2 * self.bands * ROWS

    @property
    def least_agreeing(self) -> int:
        """Minhashes that agree in pairs worth comparing: four deviations below the mean."""
        j = self.percent / 100
        return math.floor(self.hashes * (j - 4 * math.sqrt(j * (1 - j) / self.hashes)))


def shingle_sets(texts: list[bytes | None], words: int, powers: Powers) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    symbols, starts = word_symbols([(t or b"").translate(_LOWER) for t in texts], powers)
    whole = np.zeros(max(len(symbols) - words + 1, 0), np.uint64)
    for i in range(words):
        whole = mixed(whole + symbols[i:len(symbols) - words + 1 + i]) if len(whole) else whole
    sets = []
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= words:
            sets.append(np.unique(whole[a:b - words + 1]))
        elif b > a:  # all words, in a way no full shingle is made
            one = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                one = mixed(one ^ mixed(symbols[i:i + 1] + _U(1)))
            sets.append(one)
        else:
            sets.append(symbols[:0])
    return sets


_SIGNED = "doc_id long, n long, one long, two long, minhash binary"


def signatures(docs: DataFrame, like: Likeness) -> DataFrame:
    """Per row: doc_id, size of its set, two hashes of the set, and the minhashes."""
    rng = np.random.default_rng(8)
    factors = rng.integers(0, 1 << 63, like.hashes, np.uint64) * _U(2) + _U(1)
    powers = Powers()

    def signed(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, texts = batch.column(0), bytes_of(batch.column(1))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < 6 * _TEXTS):
                size += len(texts[end] or b"")
                end += 1
            yield {"doc_id": ids.slice(at, end - at),
                   **_signed(shingle_sets(texts[at:end], like.words, powers), factors)}
            at = end

    return map_batches(docs.select("doc_id", "text"), signed, _SIGNED)


def _signed(sets: list[np.ndarray], factors: np.ndarray) -> dict:
    sizes = np.array([len(s) for s in sets])
    some = np.flatnonzero(sizes)
    out = np.zeros((len(sets), len(factors)), np.uint32)
    one, two = np.zeros((2, len(sets)), np.uint64)
    one, two = one.astype(np.uint64), two.astype(np.uint64)
    if len(some):
        flat = np.concatenate([sets[i] for i in some])
        starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        one[some] = np.add.reduceat(mixed(flat), starts)
        two[some] = np.add.reduceat(mixed(flat ^ _U(0x5851F42D4C957F2D)), starts)
        for j, factor in enumerate(factors):
            x = flat * factor
            out[some, j] = np.minimum.reduceat(x ^ (x >> _U(32)), starts) >> _U(32)
    return {"n": sizes, "one": one.view(np.int64), "two": two.view(np.int64),
            "minhash": [row.tobytes() for row in out]}


def bucket_keys(classes: DataFrame, like: Likeness) -> DataFrame:
    """A row per class and table: bucket, rep."""
    t, h = like.bands, like.hashes

    def keys(batch: pa.RecordBatch) -> Iterator[dict]:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            found = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32)
            found = found.reshape(-1, 2, t, ROWS).astype(np.uint64)
            bands = np.zeros(found.shape[:3], np.uint64)
            for r in range(ROWS):
                bands = mixed(bands * _U(3) + found[..., r] + _U(r + 1))
            pairs = mixed(bands[:, 0, :, None] * _U(5) + bands[:, 1, None, :]
                          + np.arange(t * t, dtype=np.uint64).reshape(t, t))
            yield {"bucket": pairs.reshape(-1).view(np.int64),
                   "rep": np.repeat(part.column(0).to_numpy(), t * t)}

    return map_batches(classes.select("rep", "minhash"), keys, "bucket long, rep long")


def _alike(like: Likeness, n1, n2, m1: np.ndarray, m2: np.ndarray) -> np.ndarray:
    """Which pairs can be links, by sizes (exact) and by agreeing minhashes."""
    sizes = 100 * np.minimum(n1, n2) >= like.percent * np.maximum(n1, n2)
    return sizes & ((m1 == m2).sum(-1) >= like.least_agreeing)


def related(pairs: DataFrame, classes: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) of which at least ``LOOSE`` of the minhashes agree, or as many as links
    need where that is less."""
    least = min(LOOSE * like.hashes, like.least_agreeing)
    side = lambda x: classes.select(
        F.col("rep").alias(x), F.col("minhash").alias(f"m_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "m_a", "m_b")

    def agreeing(batch: pa.RecordBatch) -> Iterator[dict]:
        m1, m2 = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32)
                  .reshape(-1, like.hashes) for i in (2, 3))
        kept = (m1 == m2).sum(1) >= least
        yield {"a": batch.column(0).to_numpy()[kept], "b": batch.column(1).to_numpy()[kept]}

    return written(map_batches(both, agreeing, "a long, b long"), "related")


def _in_block_pairs(members: DataFrame, blocks: Column) -> DataFrame:
    """``members`` with x and y: every pair of blocks of a bucket or cluster has all rows of
    both, so that each two members meet."""
    mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    return (members.withColumns({"_mine": mine, "_other": F.explode(
        F.sequence(F.lit(0), blocks - 1))})
        .withColumns({"x": F.least("_mine", "_other"), "y": F.greatest("_mine", "_other")})
        .drop("_mine", "_other"))


def confirmed(labels: DataFrame, classes: DataFrame, docs: DataFrame, like: Likeness) -> DataFrame:
    """Links (a, b) that connect all texts of a cluster which are connected by links.

    ``labels`` has the cluster of each class as ``component``."""
    members = labels.join(classes.select("rep", "n"), "rep")
    sizes = members.groupBy("component").agg(
        F.ceil(F.sum("n") / SHINGLES).cast("int").alias("_blocks"))
    members = written(members.join(sizes, "component"), "clusters")
    texts = docs.select("doc_id", "text").join(
        small(members.withColumnRenamed("rep", "doc_id")), "doc_id")
    # of rows which share an id each may make a link for all of them
    dealt = (_in_block_pairs(texts.withColumnRenamed("doc_id", "rep"), F.col("_blocks"))
             .select(F.col("component").alias("bucket"), "x", "y", "rep", "n", "text"))
    schema, powers = arrow_schema("a long, b long"), Powers()

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            rep = group.column(3).to_numpy()
            sets = shingle_sets(bytes_of(group.column(5)), like.words, powers)
            a, b = _forest(rep, sets, like.percent)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                             schema=schema)

    ordered = dealt.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return written(ordered.mapInArrow(linked, "a long, b long").distinct(), "links")


def _forest(rep: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list, list]:
    """Links between texts whose sets are similar enough, as few as connect them."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((owner, flat))
    owner_by_shingle, sorted_ = owner[order], flat[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    begins = np.append(np.flatnonzero(new), len(flat))
    shingle = np.empty(len(flat), np.int64)
    shingle[order] = np.cumsum(new) - 1
    ends = np.cumsum(sizes)
    parent = np.arange(len(sets))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a, b = [], []
    for i in range(1, len(sets)):
        mine = shingle[ends[i] - sizes[i]:ends[i]]
        low, high = begins[mine], begins[mine + 1]
        held = np.flatnonzero(high - low > 1)
        low, count = low[held], (high - low)[held]
        # all members which hold one of these shingles, a place for each
        at = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        common = np.bincount(owner_by_shingle[at], minlength=i)[:i]
        for j in np.flatnonzero((100 * common >= percent * (sizes[:i] + sizes[i] - common))
                                & (common > 0)):
            p, q = root(i), root(j)
            if p != q:
                parent[max(p, q)] = min(p, q)
                if rep[i] != rep[j]:
                    a.append(int(rep[i]))
                    b.append(int(rep[j]))
    return a, b


def components(links: DataFrame) -> DataFrame:
    """(rep, component): per node of the links the least node that it is connected with.

    In each round a node takes the label of its least neighbour, three steps up. Links then
    become links of labels, those inside a label vanish, and what is left, mostly little,
    is treated alike. At least half of the nodes of every component vanish in a round.
    """
    edges, labels = written(links.select("a", "b"), "edges"), None
    while True:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(near.groupBy(F.col("a").alias("rep")).agg(
            F.least(F.min("b"), F.first("a")).alias("component")), "up")
        step = up.select(F.col("rep").alias("component"), F.col("component").alias("_next"))
        for _ in range(2):
            up = up.join(step, "component").select("rep", F.col("_next").alias("component"))
        up = written(up, "labels")
        label = lambda x: up.select(F.col("rep").alias(x), F.col("component").alias(f"_{x}"))
        edges = written(edges.join(label("a"), "a").join(label("b"), "b").where("_a <> _b").select(
            F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
        labels = up if labels is None else written(
            labels.join(up.select(F.col("rep").alias("component"), F.col("component").alias("_next")),
                        "component", "left")
            .select("rep", F.coalesce("_next", "component").alias("component")), "labels")
        if edges.isEmpty():
            return labels


def _across(members: DataFrame, classes: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b) of one bucket but different clusters that can be similar."""
    members = (_in_block_pairs(members, F.ceil(F.col("size") / BLOCK).cast("int"))
               .join(classes.select("rep", "n", "minhash"), "rep")
               .select("bucket", "x", "y", "rep", "component", "n", "minhash"))
    schema = arrow_schema("a long, b long")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            rep, comp, n = (group.column(i).to_numpy() for i in (3, 4, 5))
            m = np.frombuffer(b"".join(group.column(6).to_pylist()), np.uint32).reshape(-1, like.hashes)
            order = np.argsort(n, kind="stable")
            rep, comp, n, m = rep[order], comp[order], n[order], m[order]
            found = [rep[:0], ], [rep[:0]]
            for i in range(len(rep)):  # sizes ascend: only the next ones can be alike
                end = np.searchsorted(n, n[i] * 100 // like.percent, "right")
                j = np.arange(i + 1, end)
                j = j[comp[j] != comp[i]]
                j = j[_alike(like, n[i], n[j], m[i], m[j])]
                found[0].append(np.minimum(rep[i], rep[j]))
                found[1].append(np.maximum(rep[i], rep[j]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).astype(np.int64)) for x in found], schema=schema)

    return (members.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
            .mapInArrow(compare, "a long, b long").distinct())


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (bucket, x, y), a table for each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            if a == b:
                continue
            if last is not None and last != tuple(keys[a]):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = tuple(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def near_duplicates(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    like = Likeness(words, percent)
    docs = docs.select("doc_id", "text")
    signed = written(signatures(docs, like), "signed")
    classes = written(signed.where("n > 0 and doc_id is not null").groupBy("one", "two", "n").agg(
        F.min("doc_id").alias("rep"), F.first("minhash").alias("minhash")), "classes")

    keys = bucket_keys(classes, like)
    # totals are written apart, so that joins with them shuffle both sides, and Spark can
    # split a hot bucket
    several = written(keys.groupBy("bucket").agg(
        F.count("*").alias("size"), F.min("rep").alias("_low")).where("size > 1"), "several")
    members = written(keys.join(several, "bucket"), "members")
    meets = members.groupBy("rep").agg(F.sum("size").alias("_meets"))
    most = written(members.where("size > 2").join(meets, "rep").groupBy("bucket").agg(
        F.max(F.struct("_meets", (-F.col("rep")).alias("_minus"))).alias("_top")), "most")
    stars = members.select("rep", F.col("_low").alias("_star")).unionByName(
        members.join(most, "bucket").select("rep", (-F.col("_top._minus")).alias("_star")))
    pairs = (stars.where("rep <> _star").select(
        F.least("rep", "_star").alias("a"), F.greatest("rep", "_star").alias("b")).distinct())
    pairs = related(pairs, classes, like)
    clusters = components(pairs)

    placed = (members.where("size > 2").join(clusters, "rep", "left")
              .withColumn("component", F.coalesce("component", "rep")))
    open_ = written(placed.groupBy("bucket").agg(
        F.min("component").alias("_a"), F.max("component").alias("_b"))
        .where("_a < _b").select("bucket"), "open")
    left = written(placed.join(open_, "bucket").select("bucket", "rep", "size", "component"), "open")
    more = written(_across(left, classes, like), "across")
    if not more.isEmpty():
        clusters = components(pairs.unionByName(more))
    labels = components(confirmed(clusters, classes, docs, like))

    known = classes.join(labels, "rep", "left").select(
        "one", "two", "n", F.coalesce("component", "rep").alias("component_id"))
    alone = signed.where("n = 0 or doc_id is null").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    rows = (signed.where("n > 0 and doc_id is not null").join(known, ["one", "two", "n"])
            .select("doc_id", F.col("n").alias("n_shingles"), "component_id")
            .unionByName(alone))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` of each component: the one of least id, null last, then the first."""
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), words, percent)
    named = found.select(F.col("doc_id").alias("_row"), "component_id").join(
        rows.select("_row", "doc_id"), "_row")
    one = named.groupBy("component_id").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("_null"), "doc_id", "_row"))["_row"].alias("_row"))
    return rows.join(one.select("_row"), "_row", "left_semi").select(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, words=3, percent=85)


SQL = r"""
with recursive w as (
  select doc_id, coalesce(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+'), []) as w
  from documents),
s as materialized (
  select distinct doc_id, md5(array_to_string(w[i:i + 2], ' ')) as g
  from w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as r(i) where len(w) > 0),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
l as materialized (
  select x.doc_id as a, y.doc_id as b
  from s x join s y on x.g = y.g and x.doc_id <> y.doc_id
    join n p on p.doc_id = x.doc_id join n q on q.doc_id = y.doc_id
  where 100 * least(p.n, q.n) >= 85 * greatest(p.n, q.n)
  group by x.doc_id, y.doc_id, p.n, q.n
  having 100 * count(*) >= 85 * (p.n + q.n - count(*))),
c as (
  select doc_id, doc_id as c from w
  union
  select l.b, c.c from c join l on l.a = c.doc_id)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id,
       w.doc_id = m.component_id as kept
from w left join n using (doc_id)
  join (select doc_id, min(c) as component_id from c group by doc_id) m using (doc_id)
"""
