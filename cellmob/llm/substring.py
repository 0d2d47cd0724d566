"""Substring deduplication of words by anchors and tries of fixed depth.

This is not a partition of all suffixes by prefixes of variable length. Windows of fifty
words are partitioned by their anchor, the gram of ten words of least hash, which may lie
anywhere in the window; stretches that are equal as a whole are decided by 64-bit hashes.
Each task compares the windows of its grams by tries that branch by words, all groups a
level at a time, down to the depth of a window: they find equal windows, not maximal
repeats. A gram with too many different surroundings is not divided by longer prefixes:
hashes of blocks of 16, 4 and 1 of its windows are counted. See ``repeats``.

Defined cases: a null text has no words; texts shorter than a window keep all; repeats
inside one document stay, since no document with a smaller id holds them; rows without an
id keep all, and count for no other; rows that share an id remove nothing of each other,
and each loses only what its own text repeats; an empty table gives an empty result; only doc_id and text
are read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from cellmob.llm.repeats import Unit, removed_runs, without_repeats

WORDS = Unit(words=True, window=50, gram=10, earlier=True)


def kept_words(text: bytes, spans, window: int) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = text.split()
    runs, kept, at = removed_runs(spans, window, len(words)), [], 0
    for start, end in runs:
        kept += words[at:start]
        at = end
    return kept + words[at:], len(words)


def dedup(docs: DataFrame, unit: Unit = WORDS, texts: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (and, if asked for, kept_text)."""
    def finish(text: bytes, spans) -> tuple:
        kept, n = kept_words(text, spans, unit.window)
        joined = b" ".join(kept)
        row = n, n - len(kept), hashlib.sha256(joined).hexdigest()
        return (*row, joined.decode()) if texts else row

    return without_repeats(docs, unit, finish, "n_words long, n_removed long, kept_sha256 string"
                           + ", kept_text string" * texts)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
s as (
  select r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h
  from d, unnest(range(1, len(w) - 48)) as u(i)),
f as (select h, min(doc_id) as least from s group by h having min(doc_id) < max(doc_id)),
x as (
  select distinct r, i + j as at
  from (select r, i, lead(i) over (partition by r order by i) as next
        from s join f using (h) where doc_id > least), unnest(range(50)) as o(j)
  where next is null or i + j < next),
k as (
  select d.doc_id, len(w) as n_words, count(x.at) as n_removed,
         coalesce(string_agg(w[p], ' ' order by p) filter (where x.at is null), '') as kept
  from d left join lateral unnest(range(1, len(d.w) + 1)) as u(p) on true
    left join x on x.r = d.r and x.at = p
  group by d.r, d.doc_id, d.w)
select doc_id, n_words::bigint as n_words, n_removed::bigint as n_removed,
       sha256(kept) as kept_sha256
from k
"""
