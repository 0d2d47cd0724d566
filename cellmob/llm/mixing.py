"""Mixing sources to target weights.

Documents get hash-random keys and are range-sorted by them within each source.
Distributed running totals of their sizes then say which documents lie before the cut at
the source's exact budget; whole epochs come first when the budget exceeds the source.
DataFrame functions only.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its
own, the last; an empty table gives an empty result; repeated rows count each for itself,
and so do rows without an id; other columns of the table are not read by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellmob.llm.prefix import random_key, running_total
from cellmob.llm.scratch import small, written

WEIGHTS = (3, 1, 2)
_PART = 1 << 16  # rows alike that one task gives back


def words(text: str = "text") -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """Per source of ``units`` (_source, never null, and _words): source_size, target.

    Sources in order of code points, null last, get the weights in turn and divide
    ``share`` times all words by them. A target stops at ``most`` times its source's size;
    the excess is divided again among the others until no target is above.
    """
    by_source = written(
        units.groupBy("_source").agg(F.sum("_words").alias("source_size"))
        .repartitionByRange("_source").sortWithinPartitions("_source")
        .withColumn("_at", F.monotonically_increasing_id()), "sources")
    # the upper bits of _at are the range, the lower ones the place in it
    ranges = by_source.groupBy(F.shiftright("_at", 33).alias("_range")).agg(
        F.count("*").alias("_count"))
    ranges = ranges.select("_range", F.coalesce(
        F.sum("_count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)),
        F.lit(0)).alias("_before"))  # a row per range
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)),
                          (place % len(weights) + 1).cast("int"))
    table = written(
        by_source.withColumn("_range", F.shiftright("_at", 33)).join(ranges, "_range")
        .select("_source", "source_size", weight.cast("double").alias("_weight"))
        .withColumn("_most", F.lit(most) * F.col("source_size")), "weights")

    total = table.agg(F.sum("source_size")).first()[0] or 0
    per_weight, stopped = 0.0, None
    while True:  # each round stops at least one more source, or ends
        over = F.lit(False) if stopped is None else F.col("_most") <= per_weight * F.col("_weight")
        n, kept, left = table.agg(
            F.count_if(over), F.sum(F.when(over, F.col("_most"))),
            F.sum(F.when(~over, F.col("_weight")))).first()
        if n == stopped or not left:
            break
        stopped, per_weight = n, (share * total - (kept or 0.0)) / left
    return table.select("_source", "source_size", F.least(
        F.col("_most"), F.lit(per_weight) * F.col("_weight")).alias("target"))


def _source(source: str = "source") -> Column:
    """Never null and in the order of sources: a mark before the name, a later one for null."""
    name = F.col(source)
    return F.when(name.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), name))


def _placed(rows: DataFrame, ties: list[str], weights: tuple[int, ...], share: float,
            most: float) -> DataFrame:
    """Per unit of ``rows`` (_source, size, _key and ``ties``): the same, n (its rows),
    source_size, target, epochs (how often all of the source is taken), and left (how much
    of the unit's n * size words the last epoch takes).

    Rows alike in all of these are one unit, so that many rows of one id, or of none, are
    one row before anything is sorted."""
    units = written(rows.groupBy("_source", "_key", "size", *ties).agg(F.count("*").alias("n"))
                    .withColumn("_words", F.col("n") * F.col("size")), "units")
    targets = written(source_targets(units, weights, share, most), "targets")
    placed = running_total(units, "_source", "_key", [*ties, "size"], "_words", "_before")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = F.greatest(F.lit(0), F.least(
        F.col("_words"), budget - epochs * F.col("source_size") - F.col("_before")))
    return written(placed.join(small(targets), "_source").select(
        "_source", "_key", "size", *ties, "n", "source_size", "target",
        epochs.cast("long").alias("epochs"), left.cast("long").alias("left")), "placed")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5,
        most: float = 2.0, size: Column | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, source (never null: with a 0 before it, or 1 for null) as
    ``_source``, size, source_size, target, taken.

    ``taken`` is the number of words the mix takes of it: its size times the whole epochs,
    plus what lies before the cut in the last one. The taken words of a source add up to
    its target, rounded down.
    """
    rows = docs.select("doc_id", _source().alias("_source"),
                       (words() if size is None else size).alias("size"),
                       random_key(F.col("doc_id")).alias("_key"))
    units = _placed(rows, ["doc_id"], weights, share, most)
    # many equal rows are dealt to tasks in parts before they become rows again
    parts = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_PART).cast("long"))
    many = (units.where(F.col("n") > _PART).withColumn("_from", F.explode(parts))
            .repartition("_key", "_from")
            .withColumn("_to", F.least(F.col("_from") + _PART, F.col("n"))))
    few = units.where(F.col("n") <= _PART).withColumns(
        {"_from": F.lit(0).cast("long"), "_to": F.col("n")})
    row = F.explode(F.sequence(F.col("_from"), F.col("_to") - 1))
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(
        F.col("size"), F.col("left") - F.col("_row") * F.col("size")))
    return few.unionByName(many).withColumn("_row", row).select(
        "doc_id", "_source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def repeated(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: each row as many times as its whole size is taken.
    The one row at a source's cut counts if the larger part of it is taken; rows without
    words are never taken.

    Only keys and sizes are sorted and shuffled. A source's cut is one place in the order of
    its rows, which is broadcast, and decides for each row where it is read. Rows that are
    equal in all columns (by a 64-bit hash, within one id) share a place: of those at a cut,
    one row stands for as many as are taken.
    """
    rows = docs.select(
        F.struct(*docs.columns).alias("_doc"), _source().alias("_source"), "text",
        random_key(F.col("doc_id")).alias("_key"), F.xxhash64(*docs.columns).alias("_hash"))
    units = _placed(rows.select("_source", words().alias("size"), "_key", "_hash"), ["_hash"],
                    WEIGHTS, 1.5, 2.0)
    whole = F.when(F.col("size") > 0, F.floor(
        (2 * F.col("left") + F.col("size")) / (2 * F.col("size")))).otherwise(0).cast("long")
    place = F.struct("_key", "_hash")
    cuts = small(written(units.withColumn("_whole", whole).groupBy("_source").agg(
        F.max("epochs").alias("_epochs"),
        F.max(F.when(F.col("_whole") > 0, F.struct("_key", "_hash", "_whole", "n"))).alias("_last"))
        .select("_source", "_epochs", F.struct("_last._key", "_last._hash").alias("_cut"),
                F.coalesce("_last._whole", F.lit(0)).alias("_whole"),
                F.coalesce("_last.n", F.lit(0)).alias("_rows")), "cuts"))
    worded = rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).join(cuts, "_source")
    at_cut = place == F.col("_cut")
    more = F.when(F.col("_rows") == 0, False).when(
        at_cut, F.col("_whole") == F.col("_rows")).otherwise(place < F.col("_cut"))
    taken = worded.withColumn("_times", F.col("_epochs") + more.cast("int"))
    split = (F.col("_whole") > 0) & (F.col("_whole") < F.col("_rows"))
    if not cuts.where(split).isEmpty():  # some of several equal rows
        taken = taken.unionByName(
            worded.where(split & at_cut).dropDuplicates(["_source"])  # a row per source
            .withColumn("_times", F.col("_whole")))
    return (taken.where("_times > 0")
            .withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
            .select("_doc.*"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).drop("_source").withColumn("target", F.round("target", 6))


SQL = r"""
with sized as (
  select doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         coalesce(('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint, 0) as k
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
         [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w
  from sized group by source),
l as (
  select *, (1.5 * sum(source_size) over () - 2.0 * coalesce(sum(source_size) over (o
               rows between unbounded preceding and 1 preceding), 0))
            / sum(w) over (o rows between current row and unbounded following) as per
  from s window o as (order by 2.0 * source_size / w, source nulls last)),
t as (
  select source, source_size,
         least(2.0 * source_size, w * (select max(per) from l where per * w <= 2.0 * source_size)) as target
  from l),
p as (
  select d.*, t.source_size, t.target, floor(t.target)::bigint as budget,
         coalesce(sum(size) over (partition by d.source order by k, doc_id, size
                  rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from sized d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, round(target, 6) as target,
       (case when source_size > 0 then (budget // source_size) * size + greatest(0, least(size,
          budget - (budget // source_size) * source_size - before)) else 0 end)::bigint as taken
from p
"""
