"""Token counts by linear longest match: how many word pieces a greedy tokenizer makes of each text.

The vocabulary becomes a trie with failure links. A node knows how many pieces are certain once no
further byte fits (its popped pieces) and the node that stands for what is left over, so a word is
read once, byte by byte, and only a number is kept.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import any_names, as_bytes, modest_batches

# Words whose counts a worker remembers between texts; a full memory starts anew.
REMEMBERED = 200_000


class PieceCounter:
    """Counts pieces of single words. A word is read behind one space, so that pieces which begin
    with a space start words and the others continue them. A word with bytes that no piece covers
    counts as one unknown piece."""

    def __init__(self, pieces: Iterable[bytes]):
        self.children: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.popped: list[int] = [0]
        final = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                below = self.children[node].get(byte)
                if below is None:
                    below = self.children[node][byte] = len(final)
                    self.children.append({})
                    self.link.append(-1)
                    self.popped.append(0)
                    final.append(False)
                node = below
            if node:
                final[node] = True
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for byte, below in self.children[node].items():
                queue.append(below)
                if final[below]:
                    self.link[below], self.popped[below] = 0, 1
                    continue
                at, count = self.link[node], self.popped[node]
                while at >= 0 and byte not in self.children[at]:
                    count += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[below], self.popped[below] = self.children[at][byte], count

    def count(self, word: bytes) -> int:
        children, link, popped = self.children, self.link, self.popped
        node = total = 0
        for byte in b" " + word:
            below = children[node].get(byte)
            while below is None:
                if link[node] < 0:
                    return 1
                total += popped[node]
                node = link[node]
                below = children[node].get(byte)
            node = below
        while node:
            if link[node] < 0:
                return 1
            total += popped[node]
            node = link[node]
        return total


class _Memory(dict):
    def __init__(self, counter: PieceCounter):
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[word] = self.counter.count(word)
        return n


def read_pieces(path: str) -> list[bytes]:
    """Pieces of a rank file: one base64 piece and its rank a line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


_COUNTERS: dict[int, _Memory] = {}


def _memory(pieces: tuple[bytes, ...]) -> _Memory:
    key = hash(pieces)
    if key not in _COUNTERS:
        _COUNTERS[key] = _Memory(PieceCounter(pieces))
    return _COUNTERS[key]


@any_names
def count_tokens(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """All columns, with n_words and n_tokens (long) added or replaced.

    vocabulary is the path of a rank file on the driver; its size is that of the tokenizer, never of
    the data. Words are runs of other bytes than the six ASCII white spaces. Null and empty texts
    have no words and no tokens. Repeated rows are counted each; an empty table stays empty.
    """
    modest_batches(df.sparkSession)
    raw = df.sparkSession.sparkContext.broadcast(tuple(read_pieces(vocabulary)))

    @F.arrow_udf("struct<n_words: long, n_tokens: long>")
    def counted(texts: pa.Array) -> pa.Array:
        memory = _memory(raw.value)
        n_words, n_tokens = [], []
        for value in texts.to_pylist():
            words = value.split()
            n_words.append(len(words))
            n_tokens.append(sum(map(memory.__getitem__, words)))
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["n_words", "n_tokens"])

    kept = [c for c in df.columns if c not in ("n_words", "n_tokens", "_counts")]
    return df.withColumn("_counts", counted(as_bytes(text))).select(*(f"`{c}`" for c in kept), "_counts.n_words", "_counts.n_tokens")
