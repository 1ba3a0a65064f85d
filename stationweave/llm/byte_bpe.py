"""Byte-level BPE: exact encoding by longest matches with backtracking, and decoding.

All tokens that start at each byte come from one Aho-Corasick pass over the piece, with bytes
mapped to Latin-1 characters. Tokens are taken longest first; a neighbour is accepted only if the
merges would really leave the two side by side, which is worked out once per pair of tokens and
remembered. A position that proves a dead end is never entered again, so the work is linear.
"""

from __future__ import annotations

import base64
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import any_names, as_bytes, lists, modest_batches

# Pieces and token pairs that a worker remembers; a full memory starts anew. Longer pieces are not kept.
REMEMBERED = 150_000
REMEMBERED_LENGTH = 32


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class Encoder(dict):
    """Remembers the ids of short pieces, by piece, as the bytes of 32-bit numbers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.size = [len(token) for token in self.bytes_of]
        self.split = regex.compile(pattern).findall
        self.shorter = [-1] * len(self.bytes_of)  # the longest token that a token starts with
        self.matches = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.shorter[rank] = next((ranks[token[:i]] for i in range(len(token) - 1, 0, -1) if token[:i] in ranks), -1)
            self.matches.add_word(token.decode("latin-1"), rank)
        self.matches.make_automaton()
        self.pairs: dict[int, bool] = {}

    def merged(self, text: bytes) -> list[bytes]:
        """The merges themselves, lowest rank first. Only for the bytes of two tokens."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            ranked = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            known = [(rank, i) for i, rank in enumerate(ranked) if rank is not None]
            if not known:
                break
            i = min(known)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges of the two tokens' bytes end with exactly these two."""
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        a, b = self.bytes_of[left], self.bytes_of[right]
        known = self.pairs[left << 32 | right] = self.merged(a + b) == [a, b]
        return known

    def backtrack(self, piece: bytes) -> list[int]:
        size, shorter, pairs = self.size, self.shorter, self.pairs
        if len(piece) <= REMEMBERED_LENGTH:
            # Mostly the longest matches from the left fit as they are.
            left, covered, path = -1, 0, []
            for _, rank in self.matches.iter_long(piece.decode("latin-1")):
                if left >= 0:
                    known = pairs.get(left << 32 | rank)
                    if not (self.fits(left, rank) if known is None else known):
                        break
                left = rank
                covered += size[rank]
                path.append(rank)
            if covered == len(piece):
                return path
        longest = [-1] * (len(piece) + 1)
        for last, rank in self.matches.iter(piece.decode("latin-1")):
            longest[last + 1 - size[rank]] = rank  # of equal starts the longest ends, and comes, last
        path = []
        dead: set[int] = set()
        at, left, token = 0, -1, longest[0]
        while at < len(piece):
            while token >= 0:
                if at + size[token] not in dead:
                    if left < 0:
                        break
                    known = pairs.get(left << 32 | token)
                    if self.fits(left, token) if known is None else known:
                        break
                token = shorter[token]
            if token >= 0:
                path.append(token)
                at += size[token]
                left, token = token, longest[at]
                continue
            # A start of the piece has one encoding only, so nothing further left can help here.
            dead.add(at)
            if not path:
                raise ValueError("the vocabulary lacks a byte of the text")
            token = path.pop()
            at -= size[token]
            left, token = path[-1] if path else -1, shorter[token]
        return path

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(raw)
        ids = array("i", self.backtrack(raw) if rank is None else (rank,)).tobytes()
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.split(text))), np.int32)


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(ranks: dict[bytes, int], pattern: str) -> Encoder:
    key = hash(frozenset(ranks.items())), pattern
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


@any_names
def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """All columns, and `ids` (array<int>, added or replaced): the token ids of each text.

    path is the rank file on the driver, whose size is the tokenizer's; pattern splits a text into
    the pieces that are encoded separately. With `decoded`, a column of that name has the bytes that
    the ids stand for, from the same pass. Null and empty texts get an empty array and empty bytes.
    """
    modest_batches(df.sparkSession)
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.BinaryType())] * bool(decoded)

    @F.arrow_udf(T.StructType(fields))
    def encoded(texts: pa.Array) -> pa.Array:
        encoder = _encoder(ranks.value, pattern)
        bytes_of = encoder.bytes_of.__getitem__
        found, back = [np.zeros(0, np.int32)], []
        for value in texts:
            found.append(encoder.encode(value.as_py().decode("utf-8", "replace")))
            if decoded:
                back.append(b"".join(map(bytes_of, found[-1].tolist())))
        columns = [lists(np.concatenate(found), np.array([len(x) for x in found[1:]], np.int64), pa.int32())]
        if decoded:
            columns.append(pa.array(back, pa.binary()))
        return pa.StructArray.from_arrays(columns, names=[f.name for f in fields])

    names = {ids: "_coded.ids"} | ({decoded: "_coded.decoded"} if decoded else {})
    kept = [f"`{c}`" for c in df.columns if c not in names and c != "_coded"]
    return df.withColumn("_coded", encoded(as_bytes(text))).select(*kept, *(F.col(at).alias(c) for c, at in names.items()))


@any_names
def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns, and `out` (binary, added or replaced): the bytes of the token ids. Null ids give empty bytes."""
    modest_batches(df.sparkSession)
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf("binary")
    def decoded(columns: pa.Array) -> pa.Array:
        bytes_of = {rank: token for token, rank in ranks.value.items()}.__getitem__
        ends, flat = columns.offsets.to_pylist(), columns.values.to_pylist()
        return pa.array([b"".join(map(bytes_of, flat[a:b])) for a, b in zip(ends, ends[1:])], pa.binary())

    return df.withColumn(out, decoded(F.coalesce(ids, F.array().cast("array<int>"))))
