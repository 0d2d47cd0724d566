"""Best-fit packing of documents into token sequences, improved by local search.

Texts become token ids in the scan tasks; only longer documents are cut. What is packed
are lengths, so no ids are shuffled. Pieces are dealt into chunks of some 32,000 by a hash
of their id, each packed by one task: best fit in decreasing order, then a search among
underfull bins that moves a piece, or exchanges one for one or two for one, whenever it
increases the squared fill, until bins empty. A chunk ends with about one underfull bin,
so the sequences exceed the optimum by about one in some thousands.

Defined cases: a null text is an empty one, a document of the end id alone; repeated rows
are packed each for itself; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmob.llm.arrow import bytes_of, map_batches, worker_memory
from cellmob.llm.scratch import written

LENGTH = 4096
END = 1
CHUNK = 32_000  # pieces packed together
_WORDS = 1_000_000  # of which a worker remembers the ids
_TOGETHER = 500
_CHUNK = 1 << 18  # bytes of text whose words are looked up together
_BETWEEN = b"0"  # a word of one token
_MARKS = b".,;:!?#&*$%|"
# small Latin letters only, which lowering and composing leave as they are
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


class WordTokens:
    """Ids of whole texts, computed once per distinct word.

    Only for tokenizers which lower letters and drop white space before they split, so that
    the ids of a text are those of its words in turn, and keep runs of letters together. New
    words are encoded many at a time, a digit between them; those of small Latin letters skip
    the steps that would change nothing in them. The memory of words is emptied when full.

    Letters of a text without other characters than ASCII are lowered before its words are
    looked up, so that a word has one entry. In other texts the tokenizer does it: it
    composes letters and marks first, and some small letters compose where capitals do not.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._tokenizer, self._merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self._merges.normalizer = None
        self._merges.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._between, = self._tokenizer.encode(_BETWEEN.decode(), add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self._known: dict[bytes, int] = {}  # word to its place in _start and _size
        self._start, self._size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self._pool, self._used = np.zeros(4096, "<u4"), 0

    def __call__(self, text: bytes) -> np.ndarray:
        return next(self.texts([text]))

    def texts(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        words: list[bytes] = []
        counts, held = [], 0
        for text in texts:
            # "<|" may begin a special token, in which case counts
            own = (text.lower() if text.isascii() and b"<|" not in text else text).split()
            words += own
            counts.append(len(own))
            held += len(text)
            if held > _CHUNK:
                yield from self._gathered(words, counts)
                words, counts, held = [], [], 0
        yield from self._gathered(words, counts)

    def _gathered(self, words: list[bytes], counts: list[int]) -> Iterator[np.ndarray]:
        place = np.fromiter(map(self._known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            if len(self._known) + len(new) > _WORDS:
                self._forget()
                missing, new = slice(None), words
            self._learn(set(new))
            place[missing] = list(map(self._known.__getitem__, new))
        ids, before = self._gather(place)
        ends = np.append(before, len(ids))[np.cumsum(counts, dtype=np.int64)] if counts else []
        at = 0
        for end in ends:
            yield ids[at:end]
            at = end

    def _gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words in turn, and where those of each begin."""
        size = self._size[place]
        before = np.cumsum(size) - size
        at = np.repeat(self._start[place] - before, size) + np.arange(size.sum())
        return self._pool[at], before

    def _put(self, words: list[bytes], ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """New words, whose ids are those from ``start`` to ``end``."""
        n, more = len(self._known), len(words)
        if n + more > len(self._start):
            self._start, self._size = (np.append(x, np.zeros(n + more, np.int64))
                                       for x in (self._start, self._size))
        if self._used + len(ids) > len(self._pool):
            self._pool = np.append(self._pool, np.zeros(self._used + len(ids), "<u4"))
        self._pool[self._used:self._used + len(ids)] = ids
        self._start[n:n + more], self._size[n:n + more] = start + self._used, end - start
        self._known.update(zip(words, range(n, n + more)))
        self._used += len(ids)

    def _learn(self, words: set[bytes]) -> None:
        """A word is split off the marks at its end, which are tokens of their own, so that
        it need not be encoded again for each of them. It must end in an ASCII letter or
        digit, which nothing is composed with."""
        known, whole, parts, todo = self._known, [], [], set()
        for word in words:
            core = word.rstrip(_MARKS)
            if core != word and core[-1:].isalnum() and b"<|" not in word:
                whole.append(word)
                parts += (core, word[len(core):])
            else:
                todo.add(word)
        # a core ends in no mark, and marks have no core: neither is split itself
        todo.update(part for part in parts if part not in known)
        plain, odd = [], []
        for word in todo:
            (plain if _PLAIN.fullmatch(word) else odd).append(word)
        self._encode(plain, self._merges)
        self._encode([w for w in odd if _BETWEEN not in w and b"<|" not in w], self._tokenizer)
        for word in odd:
            if word not in known:
                ids = self._ids(word, self._tokenizer)
                self._put([word], ids, np.zeros(1, np.int64), np.full(1, len(ids)))
        if whole:
            ids, before = self._gather(np.array([known[x] for x in parts]))
            self._put(whole, ids, before[::2], np.append(before[2::2], len(ids)))

    def _encode(self, words: list[bytes], tokenizer) -> None:
        for at in range(0, len(words), _TOGETHER):
            some = words[at:at + _TOGETHER]
            ids = self._ids((b" " + _BETWEEN + b" ").join(some), tokenizer)
            ends = np.flatnonzero(ids == self._between)
            self._put(some, ids, np.append(0, ends + 1), np.append(ends, len(ids)))

    @staticmethod
    def _ids(text: bytes, tokenizer) -> np.ndarray:
        found, = tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)
        return np.array(found.ids, "<u4")


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, and ``row``, a hash of its text."""
    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        kept = worker_memory()
        tokens = kept.get(path) or WordTokens(path)
        kept[path] = tokens
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "row")}
        texts = [t or b"" for t in bytes_of(batch.column(1))]
        for doc, ids in zip(batch.column(0).to_pylist(), tokens.texts(texts)):
            ids = np.append(ids, np.uint32(end)).astype("<u4")
            for n, start in enumerate(range(0, len(ids), length)):
                part = ids[start:start + length]
                crc = zlib.crc32(part.tobytes())
                for k, v in zip(out, (doc, n, start, len(part), crc, crc)):
                    out[k].append(v)
        yield out

    return map_batches(docs.select("doc_id", "text"), cut, _PIECE, keeps=True)


# ---- packing of one chunk ---------------------------------------------------------------

def best_fit(lengths: list[int], room: int) -> list[list[int]]:
    """Bins of indices: each length, the longest first, into the fullest bin that holds it."""
    by_left: list[list[list[int]]] = [[] for _ in range(room + 1)]
    lefts: list[int] = []  # the remaining capacities that occur, sorted
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[i]
        at = bisect_left(lefts, size)
        if at == len(lefts):
            target, left = [], room
            bins.append(target)
        else:
            left = lefts[at]
            target = by_left[left].pop()
            if not by_left[left]:
                lefts.pop(at)
        target.append(i)
        left -= size
        if not by_left[left]:
            insort(lefts, left)
        by_left[left].append(target)
    return bins


class Underfull:
    """Underfull bins, found by what they could take.

    For each size, the gaps of the bins that hold a piece of it, or two pieces which have it
    together, are kept in order; ``reach[t]`` is the largest piece that can go where ``t``
    is taken away. Pieces of one size are interchangeable, so that a bin has fewer than
    ``room`` such sizes, however many pieces it holds.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], room: int) -> None:
        self.room, self.lengths = room, lengths
        self.pieces: list[dict[int, list[int]]] = []
        self.fill: list[int] = []
        for members in bins:
            mine: dict[int, list[int]] = {}
            for i in members:
                mine.setdefault(lengths[i], []).append(i)
            self.pieces.append(mine)
            self.fill.append(sum(lengths[i] for i in members))
        self.gaps: list[tuple[int, int]] = []  # (gap, bin)
        self.holders: list[list[tuple[int, int]]] = [[] for _ in range(room + 1)]
        self.reach = np.full(room + 1, -1, np.int64)

    def _sums(self, b: int) -> dict[int, tuple[int, ...]]:
        """What can be taken out of a bin: one piece, else two."""
        sizes = sorted(self.pieces[b])
        out = {}
        for n, x in enumerate(sizes):
            for y in sizes[n:]:
                if y > x or len(self.pieces[b][x]) > 1:
                    out[x + y] = (x, y)
        out.update((x, (x,)) for x in sizes)
        return out

    def enter(self, b: int) -> None:
        gap = self.room - self.fill[b]
        if 0 < gap < self.room:
            insort(self.gaps, (gap, b))
            for t in self._sums(b):
                insort(self.holders[t], (gap, b))
                self.reach[t] = t + self.holders[t][-1][0]

    def leave(self, b: int) -> None:
        gap = self.room - self.fill[b]
        if 0 < gap < self.room:
            del self.gaps[bisect_left(self.gaps, (gap, b))]
            for t in self._sums(b):
                held = self.holders[t]
                del held[bisect_left(held, (gap, b))]
                self.reach[t] = t + held[-1][0] if held else -1

    def shift(self, source: int, target: int, size: int) -> None:
        """A piece of ``size`` goes from one bin to another; neither is entered."""
        mine = self.pieces[source][size]
        self.pieces[target].setdefault(size, []).append(mine.pop())
        if not mine:
            del self.pieces[source][size]
        self.fill[source] -= size
        self.fill[target] += size

    def give(self, donor: int) -> bool:
        """One step that takes from ``donor``, which is not entered, and increases the squared
        fill: a piece moves to the bin it fills best, else one goes for what is shortest."""
        fill = self.fill[donor]
        for size in sorted(self.pieces[donor], reverse=True):
            at = bisect_left(self.gaps, (size, -1))
            if at < len(self.gaps):
                b = self.gaps[at][1]
                if self.fill[b] + size > fill:
                    self.leave(b)
                    self.shift(donor, b, size)
                    self.enter(b)
                    return True
        best = None
        for size in self.pieces[donor]:
            for t in np.flatnonzero(self.reach[:size] >= size).tolist():
                gain = size - t
                if best and gain <= best[0]:
                    break
                held = self.holders[t]
                b = held[bisect_left(held, (gain, -1))][1]  # the fullest with room for it
                if self.fill[b] + gain > fill:
                    best = (gain, size, t, b)
                    break
        if best is None:
            return False
        _, size, t, b = best
        self.leave(b)
        back = self._sums(b)[t]
        self.shift(donor, b, size)
        for x in back:
            self.shift(b, donor, x)
        self.enter(b)
        return True


def improve(bins: list[list[int]], lengths: list[int], room: int) -> list[list[int]]:
    """Moves and exchanges between all underfull bins that increase the squared fill.

    The emptiest bin gives first: a piece moves to the bin it fills best; else a piece goes
    for a shorter one, or for two that are shorter together. It is done when it is empty or
    nothing helps. Rounds over all bins go on until one empties none. Each step increases
    the sum of squared fills, so the search ends.
    """
    state = Underfull(bins, lengths, room)
    order = [b for b in range(len(bins)) if 0 < state.fill[b] < room]
    for b in order:
        state.enter(b)
    while order:
        emptied = False
        for donor in sorted(order, key=lambda b: (state.fill[b], b)):
            state.leave(donor)
            while state.fill[donor] and state.give(donor):
                pass
            emptied |= not state.fill[donor]
            state.enter(donor)
        order = [b for b in order if 0 < state.fill[b] < room]
        if not emptied:
            break
    return [[i for held in mine.values() for i in held] for mine in state.pieces if mine]


def pack(parts: DataFrame, room: int = LENGTH, chunk: int = CHUNK) -> DataFrame:
    """``parts`` (doc_id, piece, length, and more) with sequence_id and offset."""
    parts = written(parts, "pieces")
    chunks = max(1, -(-parts.count() // chunk))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "row"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].tolist()
        bins = improve(best_fit(lengths, room), lengths, room)
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for n, members in enumerate(bins):
            at = 0
            for i in members:
                sequence[i], offset[i] = n, at
                at += lengths[i]
        return pdf.assign(sequence_id=pdf["_chunk"].astype("int64") * (1 << 32) + sequence,
                          offset=offset).drop(columns="_chunk")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    dealt = parts.withColumn("_chunk", F.pmod(
        F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(chunks)))
    return dealt.groupBy("_chunk").applyInPandas(one, f"{schema}, sequence_id long, offset long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json"))).drop("row")
