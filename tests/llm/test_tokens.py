"""Token counts against plain longest match, byte-level BPE against the public library."""

from __future__ import annotations

import base64
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from stationweave.llm import byte_bpe, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "Hello  world's  42 cats!\n\n\tnaïve 日本語 😀 of the thnterble",
    "", None, " ", "\n\n\n", "a" * 5000, "ab" * 3000 + " " * 200, "!!!???###$$$%%%", "<|endoftext|>", "é" * 300,
    "thththth onblereon ###&&& \x00\x7f", "x" * 60 + "the" * 40,
]


def longest_match(pieces, word):
    text, n = b" " + word, 0
    while text:
        size = max((k for k in range(1, len(text) + 1) if text[:k] in pieces), default=0)
        if not size:
            return 1
        text, n = text[size:], n + 1
    return n


def test_counter_equals_longest_match():
    rng = random.Random(5)
    for _ in range(60):
        pieces = {bytes(rng.choices(b" abc", k=rng.randint(1, 5))) for _ in range(12)}
        counter = token_counts.PieceCounter(pieces)
        for _ in range(60):
            word = bytes(rng.choices(b"abc", k=rng.randint(0, 12)))
            assert counter.count(word) == longest_match(pieces, word)


def test_count_tokens(spark, docs):
    got = token_counts.count_tokens(docs(list(enumerate(TEXTS))).withColumn("n_words", F.lit("clash")), RANKS)
    assert got.columns == ["doc_id", "text", "lang", "note", "n_words", "n_tokens"]
    pieces = set(token_counts.read_pieces(RANKS))
    for row in got.collect():
        words = (row.text or "").encode().split()
        assert (row.n_words, row.n_tokens) == (len(words), sum(longest_match(pieces, w) if len(w) < 400 else token_counts.PieceCounter(pieces).count(w) for w in words))
    assert token_counts.count_tokens(docs([]), RANKS).count() == 0


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_pieces_equal_library(library):
    encoder = byte_bpe.Encoder(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    rng = random.Random(7)
    for alphabet in ("abcdeinorst", "ab", "thein ", "éàüñ", "日本😀x", "#$%& \n", "0123"):
        for _ in range(150):
            text = "".join(rng.choices(alphabet, k=rng.randint(0, 80)))
            assert encoder.encode(text).tolist() == library.encode_ordinary(text)


def test_columns_equal_library_and_round_trip(docs, library):
    df = docs([*enumerate(TEXTS), (0, TEXTS[0])]).withColumn("ids", F.lit("clash"))
    coded = byte_bpe.decode(byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS)
    assert coded.count() == len(TEXTS) + 1
    for row in coded.collect():
        assert row.ids == library.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode()
    assert byte_bpe.encode(docs([]), RANKS, public_tokenizers.PATTERN).count() == 0
