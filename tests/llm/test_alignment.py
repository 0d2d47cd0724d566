"""Alignment of two tokenizers against a plain count over all documents."""

import hashlib
import json
import random
from collections import Counter
from functools import cache

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cellmob.llm import alignment as A

BYTES, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
plain_bytes = Tokenizer.from_file(BYTES)
plain_bytes.encode_special_tokens = True
plain_pieces = SentencePieceProcessor(model_file=PIECES)
fast, pieces = A.ByteLevel(BYTES), A.Pieces(PIECES)


ALPHABET = A.byte_alphabet()


@cache
def spelled_a(i):
    return bytes(ALPHABET[c] for c in plain_bytes.id_to_token(i))


@cache
def spelled_b(i):
    piece = plain_pieces.id_to_piece(i)
    if plain_pieces.is_byte(i):
        return bytes([int(piece[1:-1], 16)])
    return piece.replace("▁", " ").encode()


def tokens_of(text):
    """The groups of a text: lists of its a-ids and b-ids."""
    a = plain_bytes.encode(" " + (text or ""), add_special_tokens=False).ids
    b = plain_pieces.encode(text or "")
    want = b" " + (text or "").encode()
    if not text or b"".join(map(spelled_a, a)) != want or b"".join(map(spelled_b, b)) != want:
        return []
    groups, x, y, a, b = [([], [])], 0, 0, a[::-1], b[::-1]
    while a or b:
        if x <= y and a:
            groups[-1][0].append(a.pop())
            x += len(spelled_a(groups[-1][0][-1]))
        else:
            groups[-1][1].append(b.pop())
            y += len(spelled_b(groups[-1][1][-1]))
        if x == y:
            groups.append(([], []))
    return groups[:-1]


def plain_align(rows):
    groups = {t: tokens_of(t) for _, t in rows}
    links = {t: Counter((i, j) for a, b in g for i in a for j in b) for t, g in groups.items()}
    count = Counter(pair for _, t in rows for pair in links[t])
    most = {}
    for (i, _), n in count.items():
        most[i] = max(n, most.get(i, 0))
    out = []
    for doc, t in rows:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups[t])
        out.append((doc, sum(len(a) for a, _ in groups[t]), sum(len(b) for _, b in groups[t]),
                    len(groups[t]), sum(links[t].values()),
                    sum(n for p, n in links[t].items() if count[p] == most[p[0]]),
                    sum(n * count[p] for p, n in links[t].items()),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        "groups_sha256").collect()), key=repr)


ODD = [(1, "<|endoftext|> and <s> </s> <0x41> plain"), (2, "two  spaces\n\n\ttab"), (3, "a▁b"),
       (4, "日本語 \U0001f600\U0001f600\U0001f600 é"), (5, "x" * 3000), (6, " leading"), (7, "\x00\x01"),
       (8, "\U0001f9ff" * 400), (9, "don't I'll WE'RE"), (None, "no id"), (10, "é" * 700), (11, "1234567 ½²")]


def test_align_equals_brute_force(frame, nasty):
    rows = [(i, t) for i, t, *_ in nasty if len(t or "") < 20_000] + ODD
    got = A.align(frame([(i, t, "en", "a") for i, t in rows]), BYTES, PIECES)
    assert rows_of(got) == plain_align(rows)


@pytest.mark.parametrize("common", [0, 40])
def test_rare_pairs_are_joined(frame, common):
    rng = random.Random(1)
    words = [f"w{i}é" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(40)] * 2
    got = A.align(frame([(i, t, "en", "a") for i, t in rows]), BYTES, PIECES, common=common)
    assert rows_of(got) == plain_align(rows)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in rows]
    assert rows_of(A.op11(spark, folder)) == plain_align(rows)


def test_empty_table(frame):
    assert A.align(frame([]), BYTES, PIECES).collect() == []
    got = A.align(frame([(1, None), (2, "")]), BYTES, PIECES)
    assert rows_of(got) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_a_text_in_most_documents(frame):
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(600)]
    got = A.align(frame([(i, t, "en", "a") for i, t in rows]), BYTES, PIECES)
    assert rows_of(got) == plain_align(rows)


@given(st.lists(st.text(max_size=40) | st.text(alphabet=" \n\tab'1é½İ日́\U0001f600<|>", max_size=80),
                max_size=5))
@settings(max_examples=300, deadline=None)
def test_rank_encoder_equals_the_tokenizer(texts):
    want = [x.ids for x in plain_bytes.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert fast([" " + t for t in texts]) == want


@pytest.mark.parametrize("text", [" " * 300_000, "\n " * 100_000, "x" * 100_000, "!" * 100_000])
def test_long_runs(text):
    assert fast([text]) == [plain_bytes.encode(text, add_special_tokens=False).ids]


def test_groups_of_many_tokens(monkeypatch):
    """Equal ids of a large group are counted before they are paired: same links."""
    rng = random.Random(2)
    a, b = [b"a", b"aa", b"aaa"], [b"aa", b"aaaaa", b"a"]
    texts_a = [[rng.randrange(3) for _ in range(40)] for _ in range(6)]
    texts_b = []
    for ids in texts_a:  # others of the same length, so that all spell the same bytes
        left, mine = sum(len(a[i]) for i in ids), []
        while left:
            mine.append(rng.choice([j for j in range(3) if len(b[j]) <= left]))
            left -= len(b[mine[-1]])
        texts_b.append(mine)
    whole = A.Aligner(a, b)(texts_a, texts_b)
    monkeypatch.setattr(A, "_DENSE", 2)
    dense = A.Aligner(a, b)(texts_a, texts_b)
    assert whole[4] == dense[4] and whole[3].tolist() == dense[3].tolist()
    for x, y in zip(whole[5], dense[5]):
        assert x.tolist() == y.tolist()


def test_vocabulary_files_are_what_the_tokenizers_say():
    assert len(fast.entries) == plain_bytes.get_vocab_size()
    assert len(pieces.entries) == plain_pieces.vocab_size()
    assert all(fast.entries[i] == spelled_a(i) for i in range(0, 50_000, 97))
    assert json.loads(open(BYTES).read())["model"]["type"] == "BPE"


def test_other_columns_are_not_read(frame):
    df = A.align(frame([(1, "text")]).withColumn("links", F.lit(3)).withColumn("key", F.lit("x")), BYTES, PIECES)
    assert df.count() == 1
