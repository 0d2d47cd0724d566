"""Repeated windows of bytes or words in a corpus, found through anchors.

A *window* is so many consecutive symbols of one text. Hashing or sorting every window of
a corpus would shuffle many times its size, so windows are represented by anchors: the
anchor of a window is its short gram of least hash. Equal windows have equal grams at equal
places, and neighbouring windows mostly share their anchor, so there is one for some eighty
bytes. What is shuffled first are anchors: a hash of the gram, and a hash of the *stretch*
of text which all windows of that anchor cover.

1. A gram that occurs once has no repeated window; it goes.
2. Of stretches that are equal as a whole, all windows repeat. No text is needed for them,
   and of any number of copies, in one text or in many, one stands for all from here on.
   Where only windows of earlier documents count, copies inside the first document are its
   *twins*: what is found in the one that stands is gone from them too.
3. The stretches that are left, those at the edges of repeated passages, are fetched from
   the texts. All that share a gram meet in one task, which compares their windows; see
   ``classes``. A gram with more than ``CROWDED`` different stretches (a passage which occurs
   in very many surroundings) is not gathered: blocks of its windows are hashed and counted
   by an aggregation, which combines them before the shuffle, and only the blocks in which
   a repeat begins or ends are cut into smaller ones; see ``_counted``.

A row is told by two longs: ``doc``, by which documents are compared, and ``row``, which
tells rows of one ``doc`` apart. Rows alike in both have equal texts, and so equal repeats.

Equal 64-bit hashes of gram and stretch, taken together, count as equal texts in 2, two
64-bit hashes do for crowded grams, and step 3 compares the symbols themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmob.llm.arrow import arrow_schema, bytes_of, map_batches
from cellmob.llm.scratch import written

CROWDED = 512
BLOCKS = (16, 4, 1)  # windows of the blocks that crowded grams are cut into
_BATCH = 1 << 18  # symbols hashed at once; a longer text is cut into overlapping segments
_SEGMENT = 1 << 20
_FRAGMENTS = 3000  # compared at once

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Unit:
    """What a symbol is, how many make a window, and how many a gram."""

    words: bool
    window: int
    gram: int
    # words of the comparison before tries or trees are built, see classes()
    shallow: int = 0
    # False: a window counts that occurs anywhere else; True: in an earlier document
    earlier: bool = False


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


class Powers:
    """Powers of the base and of its inverse, modulo 2**64, as many as were needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", _BACK)):
                factors = np.full(n, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))
        return self.up[:n], self.down[:n]


class Rolling:
    """Hashes of any part of a sequence of symbols, by differences of running sums."""

    def __init__(self, symbols: np.ndarray, powers: Powers) -> None:
        up, self.down = powers.of(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[:-1], out=self.sums[1:])

    def part(self, start, end) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def grams(self, k: int) -> np.ndarray:
        return (self.sums[k:] - self.sums[:-k]) * self.down[:len(self.sums) - k]


def word_symbols(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word, and where each text's words start (one entry more than texts)."""
    found, starts, total = [], [0], 0
    for group in _batches(texts):
        data = np.frombuffer(b" " + b" ".join(group) + b" ", np.uint8)
        blank = _SPACE[data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        first, last = edge[::2], edge[1::2]
        hashes = Rolling(_BYTE[data], powers).part(first, last) + (last - first).astype(np.uint64)
        found.append(mixed(hashes))
        ends = np.cumsum([len(t) + 1 for t in group])
        starts.extend((total + np.searchsorted(first, ends)).tolist())
        total += len(first)
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.array(starts)


def _batches(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts by batches of limited size; a long text is a batch of its own."""
    batch, size = [], 0
    for t in texts:
        if batch and size + len(t) > _BATCH:
            yield batch
            batch, size = [], 0
        batch.append(t)
        size += len(t)
    if batch:
        yield batch


def symbols_of(unit: Unit, texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Bytes or word hashes of some texts in a row, and where each text starts."""
    if unit.words:
        return word_symbols(texts, powers)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), starts


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:len(x) - (width - done)], x[width - done:]) if width > done else x


def anchors_of(unit: Unit, symbols: np.ndarray, starts: np.ndarray,
               powers: Powers) -> tuple[np.ndarray, ...]:
    """(text, at, first, last, gram hash, stretch hash) of each anchor: the windows that
    start at ``first`` to ``last`` have their gram of least hash at ``at``."""
    parts = []
    step = _SEGMENT if len(symbols) > 2 * _SEGMENT else max(len(symbols), 1)
    for begin in range(0, max(len(symbols), 1), step):
        end = min(len(symbols), begin + step + unit.window - 1)
        if end - begin < unit.window:
            continue
        piece = symbols[begin:end]
        rolling = Rolling(piece if unit.words else _BYTE[piece], powers)
        grams = mixed(rolling.grams(unit.gram))
        # the place in the low bits: of equal hashes the first is least
        key = (grams & _U(~((1 << 24) - 1) & (1 << 64) - 1)) | np.arange(len(grams), dtype=np.uint64)
        least = _sliding_least(key, unit.window - unit.gram + 1)
        inside = np.zeros(len(least) + 1, np.int32)
        low = np.clip(starts[:-1] - begin, 0, len(least))
        high = np.clip(starts[1:] - begin - unit.window + 1, low, len(least))
        np.add.at(inside, low, 1)
        np.add.at(inside, high, -1)
        window = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        if not len(window):
            continue
        place = (least[window] & _U((1 << 24) - 1)).astype(np.int64)
        cut = np.flatnonzero(place[1:] != place[:-1])
        first = window[np.concatenate([[0], cut + 1])]
        last = window[np.concatenate([cut, [len(window) - 1]])]
        at = place[np.concatenate([[0], cut + 1])]
        shape = (at - first).astype(np.uint64) * _U(0x1F3D5B79) + (last - first).astype(np.uint64)
        stretch = mixed(rolling.part(first, last + unit.window) + mixed(shape))
        text = np.searchsorted(starts, first + begin, "right") - 1
        base = starts[text] - begin
        parts.append((text, at - base, first - base, last - base, grams[at], stretch))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


_ANCHOR = "h long, stretch long, doc long, row long, at long, first long, last long"


def anchors(docs: DataFrame, unit: Unit) -> DataFrame:
    powers = Powers()

    def found(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        texts = bytes_of(batch.column(2))
        at = 0
        for group in _batches(texts):
            symbols, starts = symbols_of(unit, group, powers)
            text, place, first, last, h, stretch = anchors_of(unit, symbols, starts, powers)
            if len(text):
                yield {"h": h.view(np.int64), "stretch": stretch.view(np.int64),
                       "doc": ids[at + text], "row": rows[at + text], "at": place, "first": first, "last": last}
            at += len(group)

    return map_batches(docs, found, _ANCHOR)


# ---- comparison of windows ---------------------------------------------------------------

def classes(values: np.ndarray, start: np.ndarray, group: np.ndarray, steps: np.ndarray,
            shallow: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sets of equal windows: pairs of (windows, number of the set of each).

    Window i belongs to ``group[i]`` and its contents are ``values[start[i] + steps]``; only
    windows of one group are compared. The first ``shallow`` values are sorted by multikey
    passes: each pass sorts the groups by one value and cuts them where it differs. What
    still is together then shares a long prefix. Such groups become tries which skip what
    all members share: a node looks for the first value in which a member differs from the
    first member (a string depth, the label of the edge above is never read again), then
    branches by the value at that depth. All groups advance together, a level at a time.
    A node which reaches the full depth is a set of equal windows: a deep node.
    """
    window = np.argsort(group, kind="stable")
    group = group[window]
    window, group = _several(window, group)
    for step in steps[:shallow]:
        if not len(window):
            return []
        window, group = _branch(window, group, values[start[window] + step])
    found, depth = [], np.full(len(window), min(shallow, len(steps)))
    while len(window):
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(first, len(group)))
        head, here = np.repeat(start[window[first]], size), start[window]
        common, active = depth.copy(), np.flatnonzero(depth < len(steps))
        while len(active):
            step = steps[common[active]]
            active = active[values[here[active] + step] == values[head[active] + step]]
            common[active] += 1
            active = active[common[active] < len(steps)]
        node = np.repeat(np.minimum.reduceat(common, first), size)
        deep = node == len(steps)
        if deep.any():
            found.append((window[deep], group[deep]))
        window, group, node = window[~deep], group[~deep], node[~deep]
        if len(window):
            order_depth = np.empty(len(start), np.int64)
            order_depth[window] = node + 1
            window, group = _branch(window, group, values[start[window] + steps[node]])
            depth = order_depth[window]
    return found


def _branch(window: np.ndarray, group: np.ndarray, value: np.ndarray):
    order = np.lexsort((value, group))
    window, group, value = window[order], group[order], value[order]
    new = np.concatenate([[0], (group[1:] != group[:-1]) | (value[1:] != value[:-1])])
    return _several(window, np.cumsum(new))


def _several(window: np.ndarray, group: np.ndarray):
    """Without groups of one member."""
    if not len(group):
        return window, group
    new = np.concatenate([[True], group[1:] != group[:-1], [True]])
    alone = new[1:] & new[:-1]
    return window[~alone], group[~alone]


def _spans(unit: Unit, h, doc, row, at, first, last, contents: list[bytes]):
    """(h, doc, row, at, first, last) of the repeated windows of some fragments."""
    lengths = last - first + 1
    fragment = np.repeat(np.arange(len(h)), lengths)
    place = np.arange(len(fragment)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    if unit.words:
        values = np.frombuffer(b"".join(contents), np.uint64)
        offset = np.cumsum([0] + [len(c) // 8 for c in contents])[:-1]
        steps = np.arange(unit.window)
    else:  # eight bytes at each place; the last ones of a window may overlap
        data = np.frombuffer(b"".join(contents) + b"\0" * 8, np.uint8).astype(np.uint64)
        values = data[:-7].copy()
        for i in range(1, 8):
            values |= data[i:len(data) - 7 + i] << _U(8 * i)
        offset = np.cumsum([0] + [len(c) for c in contents])[:-1]
        steps = np.append(np.arange(0, unit.window - 8, 8), unit.window - 8)
    # windows are equal only with equal grams at equal places
    key = np.stack([np.unique(h, return_inverse=True)[1][fragment], (at - first)[fragment] - place])
    group = key[0] * (unit.window + 1) + key[1]
    sets = classes(values, offset[fragment] + place, group, steps, unit.shallow)
    repeated = np.zeros(len(fragment), bool)
    for window, number in sets:
        if unit.earlier:
            begins = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
            size = np.diff(np.append(begins, len(number)))
            least = np.repeat(np.minimum.reduceat(doc[fragment[window]], begins), size)
            window = window[doc[fragment[window]] > least]
        repeated[window] = True
    hit = np.flatnonzero(repeated)
    if not len(hit):
        return h[:0], doc[:0], row[:0], at[:0], first[:0], last[:0]
    cut = (hit[1:] != hit[:-1] + 1) | (fragment[hit[1:]] != fragment[hit[:-1]])
    begin, end = hit[np.concatenate([[True], cut])], hit[np.concatenate([cut, [True]])]
    of = fragment[begin]
    return h[of], doc[of], row[of], at[of], first[of] + place[begin], first[of] + place[end]


# ---- the Spark job -------------------------------------------------------------------------

_FRAGMENT = ("h long, doc long, row long, at long, first long, last long, crowded boolean, "
             "content binary")
_SPAN = "h long, doc long, row long, at long, first long, last long"
_PLACE = ["h", "doc", "row", "at"]


def _decided(docs: DataFrame, unit: Unit) -> DataFrame:
    """Anchors whose stretch repeats as a whole (``whole``), is to be compared (``rest``: one
    for each gram and stretch), or is a twin of the one at ``stands`` in the same document."""
    found = anchors(docs, unit)
    # written apart, so that the join shuffles both sides, and Spark can split a hot key
    several = written(found.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1").select("h"), "grams")
    found = written(found.join(several, "h"), "anchors")

    stretches = written(found.groupBy("h", "stretch").agg(
        F.count("*").alias("_copies"), F.min(F.struct("doc", "row", "at")).alias("stands")),
        "stretches")
    grams = written(stretches.groupBy("h").agg(F.count("*").alias("_different")), "grams")
    stretches = stretches.join(grams, "h")
    whole = F.col("doc") > F.col("stands.doc") if unit.earlier else F.col("_copies") > 1
    several, first = F.col("_different") > 1, F.col("doc") == F.col("stands.doc")
    one = F.struct("doc", "row", "at") == F.col("stands")
    twin = several & first & ~one if unit.earlier else F.lit(False)
    return written(
        found.join(stretches, ["h", "stretch"])
        .withColumns({"whole": whole, "rest": one & several, "twin": twin,
                      "crowded": F.col("_different") > CROWDED})
        .where("whole or rest or twin")
        .select(*_PLACE, "first", "last", "whole", "rest", "twin", "stands", "crowded"),
        "decided")


def _fragments(docs: DataFrame, rest: DataFrame, unit: Unit) -> DataFrame:
    """The stretches to compare, with their contents."""
    powers = Powers()

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        out = {k.split()[0]: [] for k in _FRAGMENT.split(", ")}
        for doc, row, text, parts in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                bytes_of(batch.column(2)), batch.column(3).to_pylist()):
            content = word_symbols([text], powers)[0].tobytes() if unit.words else text
            wide = 8 if unit.words else 1
            for p in parts:
                if (p["last"] + unit.window) * wide > len(content):
                    continue  # of another text that is told by the same two longs
                for k in ("h", "at", "first", "last", "crowded"):
                    out[k].append(p[k])
                out["doc"].append(doc)
                out["row"].append(row)
                out["content"].append(content[p["first"] * wide:(p["last"] + unit.window) * wide])
        yield out

    asked = rest.groupBy("doc", "row").agg(F.collect_set(F.struct(
        "h", "at", "first", "last", "crowded")).alias("_parts"))
    # rows alike in doc and row are read once; the join shuffles by the same two columns
    joined = docs.dropDuplicates(["doc", "row"]).join(asked, ["doc", "row"]).select(
        "doc", "row", "text", "_parts")
    return written(map_batches(joined, cut, _FRAGMENT), "fragments")


def _compared(fragments: DataFrame, unit: Unit) -> DataFrame:
    """Spans of repeated windows, the fragments of a gram compared in one task."""
    schema = arrow_schema(_SPAN)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_gram(batches):
            found = _spans(
                unit, *(rows.column(i).to_numpy() for i in range(6)), rows.column("content").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=schema)

    ordered = fragments.repartition("h").sortWithinPartitions("h")
    return ordered.mapInArrow(compare, _SPAN)


def _by_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by gram in tables of some thousand rows; none divides a gram."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, _FRAGMENTS):
            held.append(batch.slice(at, _FRAGMENTS))
            if sum(b.num_rows for b in held) < _FRAGMENTS:
                continue
            table = pa.Table.from_batches(held)
            h = table.column("h").to_numpy()
            end = int(np.searchsorted(h, h[-1]))  # the last gram may go on
            if end:
                yield table.slice(0, end).combine_chunks()
                held = table.slice(end).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_BLOCK = f"i1 long, i2 long, o1 long, o2 long, {_SPAN}"


def _blocks(fragments: DataFrame, unit: Unit, size: int) -> DataFrame:
    """The windows in ``ranges`` of each fragment, in blocks of ``size``: hashes of what all
    windows of such a block have in common (i1, i2), and of all that they cover (o1, o2)."""
    powers = Powers()

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        for h, doc, row, at, start, content, ranges in zip(*(c.to_pylist() for c in batch.columns)):
            symbols = np.frombuffer(content, np.uint64) if unit.words else _BYTE[
                np.frombuffer(content, np.uint8)]
            # blocks by the distance from window to gram, the same in all texts
            window = np.concatenate([np.arange(r["first"], r["last"] + 1) for r in ranges])
            block = (at - window) // size
            edge = np.flatnonzero((block[1:] != block[:-1]) | (window[1:] != window[:-1] + 1))
            first = window[np.concatenate([[0], edge + 1])]
            last = window[np.concatenate([edge, [len(window) - 1]])]
            near = (at - last) // size * size
            inner = at - near - start, at - near - size + 1 + unit.window - start
            outer = first - start, last + unit.window - start
            shape = [mixed(((at - x).astype(np.uint64) << _U(20)) + (at - y).astype(np.uint64))
                     for x, y in ((at - near, at - near), (first, last))]
            place = {k: np.full(len(first), x) for k, x in zip(_PLACE, (h, doc, row, at))}
            out = {**place, "first": first, "last": last}
            for n, values in ((1, symbols), (2, mixed(symbols + _U(1)))):
                rolling = Rolling(values, powers)
                for name, (x, y), kind in (("i", inner, shape[0]), ("o", outer, shape[1])):
                    out[f"{name}{n}"] = mixed(rolling.part(x, y) + kind).view(np.int64)
            yield out

    rows = fragments.select(*_PLACE, F.col("first").alias("start"), "content", "ranges")
    return written(map_batches(rows, cut, _BLOCK), "blocks")


def _counted(fragments: DataFrame, unit: Unit) -> DataFrame:
    """Spans of repeated windows of crowded grams, by counting hashes of blocks of windows.

    If all that a block covers repeats, so do all its windows; if what they have in common
    does not, none does; the blocks between are cut into smaller ones, down to one window.
    Of blocks that are equal one goes on with them, since others may share a part of it.
    """
    least, most = F.min("doc").alias("_least"), F.max("doc").alias("_most")
    several = "_most > _least" if unit.earlier else "_n > 1"
    repeats = F.col("doc") > F.col("_least") if unit.earlier else F.col("_n") > 1
    spans = None
    fragments = fragments.withColumn("ranges", F.array(F.struct("first", "last")))
    # what a block's windows have in common must hold the gram
    for size in (b for b in BLOCKS if b <= unit.window - unit.gram + 1):
        blocks = _blocks(fragments, unit, size)
        common = written(blocks.groupBy("i1", "i2").agg(
            F.count("*").alias("_n"), least, most, (F.min("o1") < F.max("o1")).alias("_differ"))
            .where(several).select("i1", "i2", "_differ"), "common")
        covered = written(blocks.groupBy("o1", "o2").agg(
            F.count("*").alias("_n"), least, most).where("_n > 1"), "covered")
        some = written(
            blocks.join(common, ["i1", "i2"]).join(covered, ["o1", "o2"], "left")
            .withColumn("_whole", F.coalesce(repeats, F.lit(False)))
            .withColumn("_open", F.col("_differ") & F.coalesce(F.col("doc") == F.col("_least"), F.lit(True)))
            .select(*_PLACE, "first", "last", "_whole", "_open"), "blocks")
        found = some.where("_whole").select(*_PLACE, "first", "last")
        spans = found if spans is None else spans.unionByName(found)
        if size > 1:
            open_ = some.where("_open").groupBy(*_PLACE).agg(
                F.collect_set(F.struct("first", "last")).alias("ranges"))
            fragments = fragments.drop("ranges").join(open_, _PLACE).withColumn(
                "ranges", F.array_sort("ranges"))
    return spans


def _with_twins(spans: DataFrame, twins: DataFrame) -> DataFrame:
    """``spans``, and those of the twins at the same distance from their grams."""
    if twins.isEmpty():
        return spans
    moved = twins.select("h", "stands.*", F.col("row").alias("_row"),
                         (F.col("at") - F.col("stands.at")).alias("_by"))
    return spans.unionByName(spans.join(moved, _PLACE).select(
        "h", "doc", F.col("_row").alias("row"), (F.col("at") + F.col("_by")).alias("at"),
        (F.col("first") + F.col("_by")).alias("first"),
        (F.col("last") + F.col("_by")).alias("last")))


def repeated_spans(docs: DataFrame, unit: Unit) -> DataFrame:
    """Per document with repeated windows: doc, row, and ``spans``, an array of (first, last)
    starts of windows which may overlap and come in no order.

    ``docs`` has doc, row and text and no nulls.
    """
    decided = _decided(docs, unit)
    fragments = _fragments(docs, decided.where("rest"), unit)
    spans = _compared(fragments.where("not crowded"), unit)
    if not fragments.where("crowded").isEmpty():
        spans = spans.unionByName(_counted(fragments.where("crowded"), unit))
    if unit.earlier:
        spans = _with_twins(written(spans, "spans"), decided.where("twin"))
    spans = decided.where("whole").select("doc", "row", "first", "last").unionByName(
        spans.select("doc", "row", "first", "last"))
    return spans.groupBy("doc", "row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def removed_runs(spans: list[dict] | None, window: int, length: int) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of what the windows cover, in order."""
    runs: list[list[int]] = []
    for first, last in sorted((s["first"], s["last"]) for s in spans or ()):
        end = min(last + window, length)
        if first >= length:
            break
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([first, end])
    return [(a, b) for a, b in runs]


def without_repeats(docs: DataFrame, unit: Unit, finish: Callable[[bytes, list], tuple],
                    schema: str) -> DataFrame:
    """Per row of ``docs``: doc_id, and what ``finish`` makes of the text in UTF-8 and the
    spans of its repeated windows; ``schema`` names these columns. Null text is empty."""
    text = F.coalesce("text", F.lit(""))
    keys = [F.coalesce("doc_id", F.lit(0)), F.xxhash64(text)]
    if not unit.earlier:  # no order of documents: what is compared spreads rows without an id
        keys.reverse()
    docs = docs.select("doc_id", text.alias("text"), keys[0].alias("doc"), keys[1].alias("row"))
    whole = docs.where("text <> ''" + " and doc_id is not null" * unit.earlier)
    spans = repeated_spans(whole.select("doc", "row", "text"), unit)
    if unit.earlier:  # rows without an id come after no document
        docs = docs.withColumn("doc", F.when(F.col("doc_id").isNotNull(), F.col("doc")))
    names = [c.split()[0] for c in schema.split(", ")]

    def finished(batch: pa.RecordBatch) -> Iterator[dict]:
        rows = [finish(t, s) for t, s in zip(bytes_of(batch.column(1)), batch.column(2).to_pylist())]
        yield {"doc_id": batch.column(0), **dict(zip(names, map(list, zip(*rows))))} if rows else {
            "doc_id": [], **{n: [] for n in names}}

    joined = docs.join(spans, ["doc", "row"], "left").select("doc_id", "text", "spans")
    return map_batches(joined, finished, f"doc_id long, {schema}")
