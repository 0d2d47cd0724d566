"""Suffix-array deduplication of bytes by deep-shallow sorting.

Suffixes are sorted to the depth of a window: first a multikey sort to a shallow depth,
eight bytes a pass, then blind tries order the groups which still are together, and which
share a long prefix: their nodes keep only the depth at which members differ, and skip
what they share. Neighbours with a common prefix of a window's length are repeats. Only
the suffixes around anchors that occur more than once are sorted. See ``repeats``.

Defined cases: a null text is empty; texts shorter than a window keep all; a window counts
that starts anywhere else, in the same text too, and overlaps count; a row without an id,
or with the id of another, is a document like any other; an empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from cellmob.llm.repeats import Unit, removed_runs, without_repeats

BYTES = Unit(words=False, window=200, gram=32, shallow=3)


def dedup(docs: DataFrame, unit: Unit = BYTES, contents: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and, if asked for, kept)."""
    def finish(text: bytes, spans) -> tuple:
        runs, kept, at = removed_runs(spans, unit.window, len(text)), [], 0
        for start, end in runs:
            kept.append(text[at:start])
            at = end
        joined = b"".join([*kept, text[at:]])
        row = len(text), len(text) - len(joined), len(runs), hashlib.sha256(joined).hexdigest()
        return (*row, joined) if contents else row

    return without_repeats(
        docs, unit, finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        + ", kept binary" * contents)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with d as (
  select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
s as (
  select r, i, md5(substr(x, 2 * i + 1, 400)) as h
  from d, unnest(range(0, len(x) // 2 - 199)) as u(i)),
f as (select h from s group by h having count(*) > 1),
hit as (select r, i, lag(i) over (partition by r order by i) as previous
        from s semi join f using (h)),
runs as (
  select r, min(i) as a, max(i) + 200 as b
  from (select *, count(*) filter (where previous is null or i > previous + 200)
          over (partition by r order by i) as run from hit)
  group by r, run),
cuts as (
  select r, a, b, lag(b, 1, 0) over (partition by r order by a) as before from runs),
k as (
  select d.doc_id, d.x, count(c.a) as n_spans, coalesce(sum(c.b - c.a), 0) as n_removed,
         coalesce(string_agg(substr(d.x, (2 * c.before + 1)::bigint, (2 * (c.a - c.before))::bigint), '' order by c.a), '')
           || substr(d.x, (2 * coalesce(max(c.b), 0) + 1)::bigint) as kept
  from d left join cuts c using (r) group by r, d.doc_id, d.x)
select doc_id, (len(x) // 2)::bigint as n_bytes, n_removed::bigint as n_removed,
       n_spans::bigint as n_spans, sha256(unhex(kept)) as kept_sha256
from k
"""
