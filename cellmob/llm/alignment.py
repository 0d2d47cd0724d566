"""Alignment of the tokens of two tokenizers over a corpus.

Documents are grouped by their full texts, so that each distinct text is tokenised and
aligned once, however many documents hold it; the number of these is its multiplicity.
Byte offsets at which tokens of both tokenizers end cut a text into groups, and all pairs
of one token of each inside a group are links. An id pair's count is the number of
documents in which it is linked: pairs are counted per distinct text, weighted by the
text's multiplicity, with partial sums before the shuffle. The counts then go back to the
texts: those of the commonest pairs, a table of bounded size, are broadcast; links of other
pairs, which are the rare ones, are joined by a shuffle. At last the measures of the texts
are joined to the documents by the digest of the text.

Defined cases: a null or empty text has no tokens, nor has one that a tokenizer does not
give back byte by byte (it may lack a character, or read one as another): such rows have
zeros and an empty ``groups_sha256``; repeated rows are documents of their own and count each;
rows without an id count and are returned; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmob.llm.arrow import arrow_schema
from cellmob.llm.scratch import written

COMMON = 1 << 19  # pairs whose counts are broadcast
_CHUNK = 1 << 18  # bytes of text aligned together
_DENSE = 4096  # links of a group beyond which its ids are counted before they are paired


# ---- tokenizers -------------------------------------------------------------------------

def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for
    themselves, the others, in turn, from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = sorted(set(range(256)) - set(plain))
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(other)}}


class ByteLevel:
    """Ids of a byte-level BPE vocabulary, special strings being plain text.

    The merges of such a vocabulary are ranked by id, so that a rank encoder, which is some
    four times faster, gives the same ids; a text that it refuses goes to the tokenizer
    itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._plain = Tokenizer.from_file(path)
        self._plain.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocabulary = json.loads(self._plain.to_str())["model"]["vocab"]
        # an entry with other characters is no bytes of a text, such as a special token
        entries = {t: i for t, i in self._plain.get_vocab().items()}
        self.entries = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            self.entries[i] = (bytes(map(alphabet.__getitem__, token))
                               if alphabet.keys() >= set(token) else token.encode())
        special = set(entries) - set(vocabulary) | {
            t["content"] for t in json.loads(self._plain.to_str())["added_tokens"]}
        ranks = {self.entries[i]: i for t, i in vocabulary.items() if t not in special}
        self._ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks,
                                        special_tokens={})

    def __call__(self, texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            try:
                out.append(self._ranks.encode_ordinary(text))
            except Exception:  # its splitting pattern gave up, on a very long run
                out.append(self._plain.encode(text, add_special_tokens=False).ids)
        return out


class Pieces:
    """Ids of a sentencepiece model, which puts a space before the text."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_file=path)
        self.entries = []
        for i in range(self._model.vocab_size()):
            piece = self._model.id_to_piece(i)
            self.entries.append(bytes([int(piece[3:-1], 16)]) if self._model.is_byte(i)
                                else piece.replace("▁", " ").encode())

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


# ---- alignment --------------------------------------------------------------------------

class Aligner:
    """Measures of texts whose tokens of both kinds spell the same bytes."""

    def __init__(self, a: list[bytes], b: list[bytes]) -> None:
        self.a, self.b = a, b
        self.length_a = np.array([len(x) for x in a], np.int64)
        self.length_b = np.array([len(x) for x in b], np.int64)
        # a token's text in the digest ends with what follows it: 2 * id + (last of its group)
        self._texts = [f"{i}{end}".encode() for n, last in ((len(a), "|"), (len(b), ";"))
                       for i in range(n) for end in (",", last)]

    def spelled(self, ids_a: list[int], ids_b: list[int], text: bytes) -> bool:
        return (b"".join(map(self.a.__getitem__, ids_a)) == text
                and b"".join(map(self.b.__getitem__, ids_b)) == text)

    def __call__(self, a: list[list[int]], b: list[list[int]]):
        """Per text n_a, n_b, n_groups, n_links, digest; and of all texts the links as
        (text, pair, number of links), where pair is id a times the size of b plus id b."""
        size_a, size_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        ids_a, ids_b = (np.fromiter((i for x in ids for i in x), np.int64, n.sum())
                        for ids, n in ((a, size_a), (b, size_b)))
        end_a, end_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        # tokens that end a group, and each token's group
        place = np.searchsorted(end_b, end_a)
        last_a = end_b[place] == end_a
        last_b = np.zeros(len(ids_b), bool)
        last_b[place[last_a]] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        groups = int(last_a.sum())
        in_a, in_b = (np.bincount(g, minlength=groups) for g in (group_a, group_b))
        text_a = np.repeat(np.arange(len(a)), size_a)
        text = text_a[last_a]
        n_groups = np.bincount(text, minlength=len(a))
        n_links = np.zeros(len(a), np.int64)
        np.add.at(n_links, text, in_a * in_b)
        links = self._links(ids_a, ids_b, group_a, group_b, in_a, in_b, text)
        digests = self._digests(ids_a, ids_b, group_a, group_b, in_a, in_b, last_a, last_b,
                                np.cumsum(size_a + size_b))
        return size_a, size_b, n_groups, n_links, digests, links

    def _links(self, ids_a, ids_b, group_a, group_b, in_a, in_b, text):
        sparse = in_a * in_b <= _DENSE
        each = np.where(sparse[group_a], in_b[group_a], 0)
        i = np.repeat(np.arange(len(ids_a)), each)
        start = np.cumsum(in_b) - in_b
        j = start[group_a[i]] + np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each)
        width = len(self.b)
        pairs, texts = [ids_a[i] * width + ids_b[j]], [text[group_a[i]]]
        weights = [np.ones(len(i), np.int64)]
        start_a = np.cumsum(in_a) - in_a
        for g in np.flatnonzero(~sparse):  # of equal ids one stands for all
            x, nx = np.unique(ids_a[start_a[g]:start_a[g] + in_a[g]], return_counts=True)
            y, ny = np.unique(ids_b[start[g]:start[g] + in_b[g]], return_counts=True)
            pairs.append((x[:, None] * width + y).ravel())
            weights.append((nx[:, None] * ny).ravel())
            texts.append(np.full(len(x) * len(y), text[g]))
        pair, weight, text = np.concatenate(pairs), np.concatenate(weights), np.concatenate(texts)
        key = text * (len(self.a) * width) + pair
        if len(pairs) == 1:
            key, weight = np.unique(key, return_counts=True)
        else:
            key, same = np.unique(key, return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, same, weight)
            weight = total
        text, pair = np.divmod(key, len(self.a) * width)
        return text, pair, weight

    def _digests(self, ids_a, ids_b, group_a, group_b, in_a, in_b, last_a, last_b, ends):
        out = np.empty(len(ids_a) + len(ids_b), np.int64)
        out[np.arange(len(ids_a)) + (np.cumsum(in_b) - in_b)[group_a]] = 2 * ids_a + last_a
        out[np.arange(len(ids_b)) + np.cumsum(in_a)[group_b]] = (
            2 * len(self.a) + 2 * ids_b + last_b)
        texts = list(map(self._texts.__getitem__, out.tolist()))
        found, at = [], 0
        for end in ends.tolist():
            spelled = b"".join(texts[at:end])[:-1]
            found.append(hashlib.sha256(spelled).hexdigest() if spelled else "")
            at = end
        return found


def chunks(texts: list[str], size: int = _CHUNK) -> Iterator[tuple[int, int]]:
    at, held = 0, 0
    for n, text in enumerate(texts):
        held += len(text)
        if held > size:
            yield at, n + 1
            at, held = n + 1, 0
    if at < len(texts):
        yield at, len(texts)


# ---- over tables ------------------------------------------------------------------------

_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def aligned_texts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per distinct non-empty text: id, key (its digest), n (its documents), n_a, n_b, n_groups,
    n_links, groups_sha256, and links, an array of (pair, links)."""
    texts = (docs.where("length(text) > 0").groupBy("text").agg(F.count("*").alias("n"))
             .select(F.monotonically_increasing_id().alias("id"), _digest_of(F.col("text")).alias("key"),
                     "n", "text"))
    schema = ("id long, key binary, n long, n_a long, n_b long, n_groups long, n_links long, "
              "groups_sha256 string, links array<struct<pair: long, links: long>>")
    arrow = arrow_schema(schema)
    kept: dict[str, object] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept["a"], kept["b"] = ByteLevel(path_a), Pieces(path_b)
            kept["aligner"] = Aligner(kept["a"].entries, kept["b"].entries)
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for at, end in chunks(texts):
                yield _aligned(batch.slice(at, end - at), texts[at:end], kept, arrow)

    return texts.mapInArrow(run, schema)


def _aligned(batch: pa.RecordBatch, texts: list[str], kept: dict, arrow: pa.Schema) -> pa.RecordBatch:
    a, b = kept["a"]([" " + t for t in texts]), kept["b"](texts)
    for n, text in enumerate(texts):
        if not kept["aligner"].spelled(a[n], b[n], b" " + text.encode()):
            a[n], b[n] = [], []
    *numbers, digests, (text, pair, weight) = kept["aligner"](a, b)
    offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
    entry = arrow.field("links").type
    links = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
        [pa.array(pair), pa.array(weight)], fields=list(entry.value_type)), type=entry)
    return pa.RecordBatch.from_arrays(
        [*(batch.column(i) for i in range(3)), *map(pa.array, numbers), pa.array(digests), links],
        schema=arrow)


def pair_counts(texts: DataFrame, width: int) -> DataFrame:
    """pair, count (documents that hold it linked), best (if none of its a-id is higher)."""
    counts = written(texts.select("n", F.explode("links.pair").alias("pair")).groupBy("pair")
                     .agg(F.sum("n").alias("count")), "pairs")
    first = F.floor(F.col("pair") / width)
    highest = counts.groupBy(first.alias("_a")).agg(F.max("count").alias("_most"))
    # a row per id of the vocabulary
    return (counts.withColumn("_a", first).join(F.broadcast(highest), "_a")
            .select("pair", "count", (F.col("count") == F.col("_most")).alias("best")))


def _least_common(counts: DataFrame, most: int) -> int:
    """A count that at most ``most`` pairs reach, from a histogram of some hundred bins."""
    bins = sorted(counts.groupBy(F.floor(F.log2("count") * 8).alias("bin")).agg(
        F.count("*").alias("n"), F.min("count").alias("least")).collect(), key=lambda r: -r.bin)
    least, total = (1 << 62), 0
    for r in bins:
        total += r.n
        if total > most:
            break
        least = r.least
    return least


def align(docs: DataFrame, path_a: str, path_b: str, common: int = COMMON) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256."""
    from sentencepiece import SentencePieceProcessor

    width = SentencePieceProcessor(model_file=path_b).vocab_size()
    docs = docs.select("doc_id", "text")
    texts = written(aligned_texts(docs, path_a, path_b), "aligned")
    counts = written(pair_counts(texts, width), "counts")
    least = _least_common(counts, common)
    links = texts.select("id", F.inline("links"))
    sums = (F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
            F.sum(F.col("links") * F.col("count")).alias("count_sum"))
    often = F.broadcast(counts.where(F.col("count") >= least))  # at most ``common`` rows
    rare = counts.where(F.col("count") < least)
    found = links.join(often, "pair").groupBy("id").agg(*sums)
    if not rare.isEmpty():
        found = found.unionByName(
            links.join(often, "pair", "left_anti").join(rare, "pair").groupBy("id").agg(*sums))
        found = found.groupBy("id").agg(F.sum("n_best").alias("n_best"),
                                        F.sum("count_sum").alias("count_sum"))
    measures = texts.drop("links", "n").join(found, "id", "left")
    keyed = docs.select("doc_id", _digest_of(F.coalesce("text", F.lit(""))).alias("key"))
    zero = F.lit(0).cast("long")
    return keyed.join(measures, "key", "left").select(
        "doc_id", *(F.coalesce(c, zero).alias(c) for c in (*_NUMBERS, "n_best", "count_sum")),
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                 public_tokenizers.path("byte_bpe_50k.json"),
                 public_tokenizers.path("piece_bpe_32k.model"))
