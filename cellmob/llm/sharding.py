"""Sharding by best-fit decreasing.

Groups of rows with equal texts are indivisible. Sorted by size, the largest first, each
enters the bin with the tightest remaining capacity that still holds it, found through a
balanced tree. Groups of one size are alike to that rule, so what is packed is a histogram
of sizes: once a bin is the tightest for a size it stays so until it is full, and takes a
run of groups at once, the same bins as one by one. Groups then find their run by their
rank among those of their size. Sizes over 8,192 bytes are rounded up by less than 1/4,096,
which keeps a histogram at 4,096 sizes for each doubling, however many groups there are;
no shard can exceed its capacity by it. Above 32,768 bins, groups are dealt by hash to parts
with as many bins each, packed apart.

A group that exceeds a whole bin cannot stay whole; only such groups are cut, by hash, into
parts of an eighth of a bin.

Defined cases: a null text has 16 bytes and is equal to other null texts only; repeated
rows are rows of one group; rows of one id, or of none, are cut like any others; a row above
the capacity has a shard of its own; an empty table gives an empty result. Slots, and the
parts of a cut group, follow the order in which the files are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmob.llm.prefix import random_key, running_total
from cellmob.llm.scratch import small, written

LARGE = 1 << 16  # rows of a group of more than 1 / LARGE of all bytes are not shuffled by it
BINS = 1 << 15  # bins that are packed together
_BLOCK = 64  # ranks that find their run together


class CapacityTree:
    """Bins ordered by remaining capacity, then number: a treap."""

    def __init__(self) -> None:
        self._root: list | None = None  # [key, priority, left, right]

    @staticmethod
    def _priority(key: tuple[int, int]) -> int:
        return (key[0] * 0x9E3779B97F4A7C15 ^ key[1] * 0xC2B2AE3D27D4EB4F) % (1 << 61) * 31 % 1000003

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, remaining: int, bin_: int) -> None:
        key = (remaining, bin_)
        left, right = self._split(self._root, key)
        self._root = self._merge(self._merge(left, [key, self._priority(key), None, None]), right)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the bin of least remaining capacity of at least ``size``."""
        left, right = self._split(self._root, (size, -1))
        found, node = None, right
        while node is not None:
            found, node = node[0], node[2]
        if found is not None:
            one, right = self._split(right, (found[0], found[1] + 1))
        self._root = self._merge(left, right)
        return found

    def roomiest(self) -> tuple[int, int]:
        """Take out the bin of most remaining capacity."""
        node = self._root
        while node[3] is not None:
            node = node[3]
        key = node[0]
        self._root, _ = self._split(self._root, key)
        return key


def best_fit_runs(sizes: Iterable[tuple[int, int]], capacity: int,
                  bins: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(size, from, to, bin) for a histogram of (size, count): of the items of this size,
    numbered from 0, those before ``to`` enter the bin. With ``bins`` their number is fixed,
    and what fits nowhere enters the roomiest; without, a new bin opens for it, and may
    exceed the capacity only if the item does."""
    tree, opened = CapacityTree(), bins or 0
    for b in range(opened):
        tree.add(capacity, b)
    for size, count in sorted(sizes, reverse=True):
        at = 0
        while at < count:
            found = tree.tightest(size)
            if found is None and bins:
                found = tree.roomiest()
            if found is None:
                found, opened = (capacity, opened), opened + 1
            fit = max(1, min(count - at, found[0] // size)) if size else count - at
            tree.add(found[0] - fit * size, found[1])
            yield size, at, at + fit, found[1]
            at += fit


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int,
                        bins: int | None = None) -> dict[int, int]:
    """Bin of each (item, size), see :func:`best_fit_runs`."""
    items = iter(sorted(sizes, key=lambda x: (-x[1], x[0])))
    runs = best_fit_runs(Counter(s for _, s in sizes).items(), capacity, bins)
    return {next(items)[0]: b for _, start, end, b in runs for _ in range(start, end)}


def _rounded_up(size: Column, room: int) -> Column:
    """``size`` with its 13 leading bits, rounded up, but not above ``room`` by that."""
    low = F.greatest(F.lit(0), F.length(F.bin(size)) - 13)
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), low)
    up = F.ceil(size / unit).cast("long") * unit
    return F.when(size <= room, F.least(up, F.lit(room))).otherwise(up)


def _bins_of(units: DataFrame, room: int, total: int, shards: int | None) -> DataFrame:
    """``shard`` of each of ``units`` (_unit, never null, and _bytes, not above total)."""
    bins = shards or math.ceil(total / room)
    parts = max(1, math.ceil(bins / BINS))
    units = written(units.withColumns({
        "_part": F.pmod(F.xxhash64("_unit"), F.lit(parts)).cast("int"),
        "_size": _rounded_up(F.col("_bytes"), room)})
        .withColumns({"_alike": F.concat_ws(":", "_part", "_size"), "_order": random_key("_unit"),
                      "_one": F.lit(1).cast("long")}), "units")

    def packed(sizes: pd.DataFrame) -> pd.DataFrame:
        part = int(sizes["_part"].iloc[0])
        counted = list(zip(sizes["_size"].tolist(), sizes["_count"].tolist()))
        fixed, capacity = None, room
        if shards:
            fixed = shards // parts + (part < shards % parts)
            capacity = max(1, math.ceil(sum(s * n for s, n in counted) / fixed))
        runs = pd.DataFrame(best_fit_runs(counted, capacity, fixed),
                            columns=["_size", "_from", "_to", "_bin"], dtype="int64")
        return runs.assign(_part=part)

    runs = written(units.groupBy("_part", "_size").agg(F.count("*").alias("_count"))
                   .groupBy("_part").applyInPandas(
                       packed, "_size long, _from long, _to long, _bin long, _part int"), "runs")
    before, offsets = 0, []
    for part, last in sorted(runs.groupBy("_part").agg(F.max("_bin")).collect()):  # a row per part
        offsets.append((part, before))
        before += last + 1 if not shards else shards // parts + (part < shards % parts)
    offsets = F.broadcast(units.sparkSession.createDataFrame(
        offsets or [(0, 0)], "_part int, _before long"))
    runs = (runs.join(offsets, "_part")
            .withColumn("_block", F.explode(F.sequence(
                F.floor(F.col("_from") / _BLOCK), F.floor((F.col("_to") - 1) / _BLOCK))))
            .select("_part", "_size", "_block", "_from", "_to",
                    (F.col("_before") + F.col("_bin")).alias("shard")))
    ranked = running_total(units, "_alike", "_order", ["_unit"], "_one", "_rank")
    return (ranked.withColumn("_block", F.floor(F.col("_rank") / _BLOCK))
            .join(runs, ["_part", "_size", "_block"])
            .where("_from <= _rank and _rank < _to").select("_unit", "_hot", "shard"))


def shard(docs: DataFrame, size: Column, group: Column, shards: int | None = None,
          capacity: int | None = None) -> DataFrame:
    """``docs`` with size, shard (from 0) and slot (gapless from 0 in each shard).

    Give the number of shards for sizes near equal, or the capacity for as few as needed.
    ``group`` is a long that is equal for rows which belong together.
    """
    # the place in the file tells rows of one id and text apart; written, it stays
    sized = written(docs.withColumns({
        "size": size, "_group": F.coalesce(group, F.lit(0)),
        "_key": random_key("doc_id", F.monotonically_increasing_id())}), "sized")
    groups = written(sized.groupBy("_group").agg(F.sum("size").alias("_bytes")), "groups")
    total = groups.agg(F.sum("_bytes")).first()[0] or 0
    room = capacity or max(1, math.ceil(total / (shards or 1)))

    # at most LARGE rows, and one for each bin
    hot = small(written(
        groups.where((F.col("_bytes") * LARGE >= total) | (F.col("_bytes") > room))
        .select("_group", F.when(F.col("_bytes") > room, F.ceil(
            F.lit(8) * F.col("_bytes") / room)).otherwise(1).cast("long").alias("_cuts")), "hot"))
    rows = sized.join(hot, "_group", "left").withColumn("_unit", F.when(
        F.col("_cuts") > 1, F.xxhash64("_group", F.pmod("_key", "_cuts"))).otherwise(F.col("_group")))
    cut = rows.where("_cuts > 1").groupBy("_unit").agg(F.sum("size").alias("_bytes"))
    units = (groups.join(hot, "_group", "left").where("coalesce(_cuts, 1) = 1")
             .select(F.col("_group").alias("_unit"), "_bytes", F.col("_cuts").isNotNull().alias("_hot"))
             .unionByName(cut.withColumn("_hot", F.lit(True))))
    placed = written(_bins_of(units, room, total, shards), "placed")
    of_hot = small(written(placed.where("_hot").drop("_hot"), "placed"))
    both = (rows.where("_cuts is not null").join(of_hot, "_unit")
            .unionByName(rows.where("_cuts is null").join(placed.where("not _hot").drop("_hot"), "_unit")))
    sharded = written(both.drop("_unit", "_cuts", "_group").withColumn("_one", F.lit(1)), "sharded")
    return (running_total(sharded, "shard", "_key", ["doc_id"], "_one", "slot")
            .drop("_key", "_one"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    thin = docs.select(
        "doc_id", F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_octets"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("_hash"))
    placed = shard(thin, F.col("_octets") + 16, F.col("_hash"), shards=40)
    return placed.select("doc_id", "size", F.coalesce("text_crc32", F.lit(0)).alias("text_crc32"),
                         F.lit("bytes").alias("law"), F.col("shard").cast("int"),
                         F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
