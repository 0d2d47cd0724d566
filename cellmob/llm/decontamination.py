"""Benchmark decontamination by Wu-Manber search over words.

A window of so many consecutive words of a benchmark item is a search string. Words become
numbers of the benchmark's vocabulary, equal numbers being equal words, and 0 a word that
no item has. A *shift table*, indexed by a hash of the last words under the search window,
says how far the window can move before it could match; only where it says nothing are
looked up, in buckets by the hashes of their last and first words, the strings that could
end there, and these are compared word by word. Many windows move at once, each over a
stretch of some positions. Strings of different lengths have tables of their own, so that
one short item does not shorten all shifts.

Items are cut into segments of bounded size which overlap by a window, and dealt into
blocks of bounded size; each block is searched for in all documents. One block, the usual
case, is a single pass without a shuffle.

Defined cases: a null or empty text has no words, and an item without words has no windows;
an item with fewer words than a window is one window; rows of one item_id are one item; a
benchmark row without an id hits words but is not counted or listed; repeated documents
have a row each; an empty table gives an empty result, an empty benchmark none hit; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmob.llm.arrow import bytes_of, map_batches
from cellmob.llm.scratch import written

WINDOW = 10
BLOCK = 2  # words hashed for a shift
STRETCH = 128  # positions that one of the moving windows covers
ITEMS_BYTES = 4 << 20  # of segments in one block of the benchmark
_SEGMENT = 2048  # windows of a segment
_CHUNK = 1 << 20  # bytes of text split into words at once
_PAIRS = 1 << 18  # candidates compared at once

_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57
              else 32 for b in range(256))


def split_words(text: bytes | None) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, in lists of bounded size."""
    if not text:
        return
    text = text.translate(_WORD)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + _CHUNK)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


# ---- the search -------------------------------------------------------------------------

class Strings:
    """Search strings of one length: shift table, and buckets by last and first words."""

    def __init__(self, windows: np.ndarray, items: np.ndarray) -> None:
        self.length = m = windows.shape[1]
        self.block = min(BLOCK, m)
        rows = np.ascontiguousarray(windows).view(f"V{4 * m}").ravel()
        _, first, same = np.unique(rows, return_index=True, return_inverse=True)
        self.windows = windows[first]
        listed = items >= 0
        pairs = np.unique(np.stack([same[listed], items[listed]], 1), axis=0).reshape(-1, 2)
        key = self._ends(self.windows)
        order = np.argsort(key, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs[:, 0] = place[pairs[:, 0]]
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.windows, key = self.windows[order], key[order]
        self.items = pairs[:, 1]
        self.item_start = np.searchsorted(pairs[:, 0], np.arange(len(order) + 1))
        self.keys, starts = np.unique(key, return_index=True)
        self.bucket_start = np.append(starts, len(key))
        bits = min(24, max(10, int(8 * len(order)).bit_length()))
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, m - self.block + 1, np.uint8)
        for end in range(self.block, m + 1):
            h = self._hash(self.windows[:, end - self.block:end].T) & self.mask
            np.minimum.at(self.shift, h, np.uint8(m - end))

    @staticmethod
    def _hash(words) -> np.ndarray:
        h = np.zeros(len(words[0]), np.uint64)
        for w in words:
            h = (h ^ w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def _ends(self, windows: np.ndarray) -> np.ndarray:
        last, first = windows[:, -self.block:], windows[:, :self.block]
        return self._hash([*last.T, *first.T])

    def find(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, string) of all occurrences in the texts that begin at ``starts`` (one entry
        more than texts); ``end`` is the place of the last word."""
        m, none = self.length, np.zeros(0, np.int64)
        # stretches of places where an occurrence may end
        first, last = starts[:-1] + m - 1, starts[1:]
        parts = np.maximum(-(-(last - first) // STRETCH), 0)
        text = np.repeat(np.arange(len(parts)), parts)
        within = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = first[text] + within * STRETCH
        limit = np.minimum(at + STRETCH, last[text])
        ends = []
        while len(at):
            h = self._hash([words[at - k] for k in range(self.block - 1, -1, -1)]) & self.mask
            step = self.shift[h]
            ends.append(at[step == 0])
            at = at + np.maximum(step, 1)
            inside = at < limit
            at, limit = at[inside], limit[inside]
        ends = np.concatenate(ends) if ends else none
        if not len(ends):
            return none, none
        key = self._hash([words[ends - k] for k in range(self.block - 1, -1, -1)]
                         + [words[ends - m + 1 + k] for k in range(self.block)])
        bucket = np.searchsorted(self.keys, key)
        bucket[bucket == len(self.keys)] = 0
        known = self.keys[bucket] == key
        ends, bucket = ends[known], bucket[known]
        sizes = self.bucket_start[bucket + 1] - self.bucket_start[bucket]
        found = [(none, none)]
        total = np.cumsum(sizes)
        for low in range(0, int(total[-1]) if len(total) else 0, _PAIRS):
            pair = np.arange(low, min(low + _PAIRS, int(total[-1])))
            i = np.searchsorted(total, pair, side="right")
            string = self.bucket_start[bucket[i]] + pair - (total[i] - sizes[i])
            end = ends[i]
            equal = np.ones(len(pair), bool)
            for k in range(m):
                equal &= words[end - m + 1 + k] == self.windows[string, k]
            found.append((end[equal], string[equal]))
        return (np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))


class Searcher:
    """The strings of one block of the benchmark."""

    def __init__(self, segments: list[tuple[str | None, str]], window: int = WINDOW) -> None:
        self.ids = sorted({i for i, _ in segments if i is not None})
        number = {i: n for n, i in enumerate(self.ids)}
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[int, list[np.ndarray]] = {}
        items: dict[int, list[np.ndarray]] = {}
        for item, text in segments:
            words = text.encode().split(b" ")
            known = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
                              for w in words], np.int32)
            m = min(window, len(known))
            windows.setdefault(m, []).append(np.lib.stride_tricks.sliding_window_view(known, m))
            items.setdefault(m, []).append(np.full(len(known) - m + 1, number.get(item, -1)))
        self.strings = [Strings(np.concatenate(windows[m]), np.concatenate(items[m]))
                        for m in sorted(windows)]

    def texts(self, texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per text: number of words, places of the words hit, numbers of the items found."""
        held, sizes, n = [], [], 0
        for text in texts:
            size = 0
            for words in split_words(text):
                held.append(np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32,
                                        len(words)))
                size += len(words)
            sizes.append(size)
            n += size
            if n > _CHUNK // 4:
                yield from self._search(held, sizes)
                held, sizes, n = [], [], 0
        yield from self._search(held, sizes)

    def _search(self, held: list[np.ndarray], sizes: list[int]):
        if not sizes:
            return
        words = np.concatenate(held) if held else np.zeros(0, np.int32)
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        edges = np.zeros(len(words) + 1, np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        for strings in self.strings:
            end, string = strings.find(words, starts)
            np.add.at(edges, end - strings.length + 1, 1)
            np.add.at(edges, end + 1, -1)
            text = np.searchsorted(starts, end, side="right") - 1
            seen = np.unique(text * len(strings.windows) + string)
            text, string = np.divmod(seen, len(strings.windows))
            count = strings.item_start[string + 1] - strings.item_start[string]
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            item = strings.items[np.repeat(strings.item_start[string], count) + place]
            pairs.append(np.stack([np.repeat(text, count), item], 1))
        hit = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
        pairs = np.unique(np.concatenate(pairs), axis=0)
        cut = np.searchsorted(hit, starts)
        mine = np.searchsorted(pairs[:, 0], np.arange(len(sizes) + 1))
        for n, size in enumerate(sizes):
            yield (size, hit[cut[n]:cut[n + 1]] - starts[n], pairs[mine[n]:mine[n + 1], 1])


# ---- over tables ------------------------------------------------------------------------

def segments(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item`` (its id as text) and ``words`` of overlapping segments of all items."""
    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        out = {"item": [], "words": []}
        for item, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
            words = [w for part in split_words(text) for w in part]
            for at in range(0, max(len(words) - window + 1, min(len(words), 1)), _SEGMENT):
                out["item"].append(item)
                out["words"].append(b" ".join(words[at:at + _SEGMENT + window - 1]).decode())
        yield out

    return map_batches(items.select(F.col("item_id").cast("string"), "text"), cut,
                       "item string, words string").distinct()


_RESULT = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
           "contaminated boolean")


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                  block_bytes: int = ITEMS_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, for the windows of ``items`` (item_id, text)."""
    parts = written(segments(items, window), "segments")
    size = parts.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))

    def searcher(b: int) -> Searcher:  # of some ``block_bytes``, by hash
        return Searcher([tuple(r) for r in parts.where(block == b).collect()], window)

    if blocks == 1:
        return map_batches(docs.select("doc_id", "text"), _whole(searcher(0)), _RESULT)
    rows = written(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row")),
                   "rows")
    found = [written(map_batches(rows.select("_row", "text"), _partly(searcher(b)), _PART), "hits")
             for b in range(blocks)]
    merged = found[0]
    for more in found[1:]:
        merged = merged.unionByName(more)
    merged = merged.groupBy("_row").applyInPandas(
        _merge, "_row long, n_hit long, n_items long, items_sha256 string")
    counted = map_batches(rows.select("doc_id", "text", "_row"), _counted,
                          "doc_id long, n_words long, _row long")
    zero = F.lit(0).cast("long")
    return counted.join(merged, "_row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.lit(_digest([]))).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"))


def _whole(searcher: Searcher):
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        out = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
        for size, hit, items in searcher.texts(bytes_of(batch.column(1))):
            values = (size, len(hit), len(items), _digest([searcher.ids[i] for i in items]),
                      len(hit) > 0)
            for k, v in zip(out, values):
                out[k].append(v)
        yield {"doc_id": batch.column(0), **out}

    return run


# what one block finds: words hit, as packed 64-bit places, and items
_PART = "_row long, hit binary, items array<string>"


def _partly(searcher: Searcher):
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        out = {"_row": [], "hit": [], "items": []}
        for row, (_, hit, items) in zip(batch.column(0).to_pylist(),
                                        searcher.texts(bytes_of(batch.column(1)))):
            if len(hit):
                out["_row"].append(row)
                out["hit"].append(hit.astype("<i8").tobytes())
                out["items"].append([searcher.ids[i] for i in items])
        yield out

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """The blocks' findings on one document."""
    hit = np.unique(np.concatenate([np.frombuffer(x, "<i8") for x in pdf["hit"]]))
    items = sorted(set().union(*pdf["items"]))
    return pd.DataFrame({"_row": pdf["_row"].iloc[:1], "n_hit": [len(hit)],
                         "n_items": [len(items)], "items_sha256": [_digest(items)]})


def _counted(batch: pa.RecordBatch) -> Iterator[dict]:
    yield {"doc_id": batch.column(0), "_row": batch.column(2), "n_words": [
        sum(map(len, split_words(t))) for t in bytes_of(batch.column(1))]}


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                         spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
i as (
  select item_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
iw as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[p:p + 9], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p
        from i where len(w) > 0)),
dw as (
  select r, n, p, array_to_string(w[p:p + n - 1], ' ') as win
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as p
        from d cross join (select distinct n from iw) where len(w) >= n)),
found as (select r, p, dw.n, item_id from dw join iw on dw.win = iw.win and dw.n = iw.n),
hit as (
  select r, count(distinct place) as n_hit
  from (select r, unnest(range(p, p + n)) as place from (select distinct r, p, n from found))
  group by r),
items as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as listed
  from (select distinct r, item_id::varchar as item from found where item_id is not null)
  group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
       coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(listed, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (r) left join items using (r)
"""
