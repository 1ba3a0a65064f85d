"""Conversations as token ids with a loss mask, and the way back.

Names and texts are encoded each by itself, so no token spans a mark, and the marks are ids of their own
that no text can produce. In the text form a mark is a control string; where a text has such a string, an
escape character after its first one keeps the two apart, and taking it out again restores any text.

Rows are dealt by ranges of (conversation, turn), so a conversation that holds most rows is split over
tasks. Each task lays its tokens out in rows of bounded length, with the loss mask from prefix sums over
the ends of learned segments. Only conversations cut by a range, at most one between two tasks, need the
token counts of earlier ranges, which one small join adds.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from . import byte_bpe
from .common import lists, modest_batches, settle, small


@dataclass(frozen=True)
class Template:
    """Marks of a conversation. turns are (role, opening, closing); a role that isn't named is written out.

    One opening may be empty: that role's texts start right after the mark before.
    """

    begin: str = "<s>"
    turns: tuple[tuple[str, str, str], ...] = (
        ("system", "[SYSTEM_PROMPT]", "[/SYSTEM_PROMPT]"),
        ("user", "[INST]", "[/INST]"),
        ("assistant", "", "</s>"),
    )
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    learned: tuple[str, ...] = ("assistant",)
    escape: str = "\\"

    def __post_init__(self):
        marks = self.controls
        heads = {m[0] for m in marks}
        if len(set(marks)) < len(marks) or min(map(len, marks)) < 2 or sum(not opening for _, opening, _ in self.turns) > 1:
            raise ValueError("control strings are distinct and of two characters at least; one opening may be empty")
        if len(self.escape) != 1 or any(self.escape in m or heads & set(m[1:]) for m in marks):
            raise ValueError("a control string has its first character, like every other's, at its start only, and no escape character")

    @property
    def controls(self) -> list[str]:
        """All control strings; the reserved id of one is its place here after the first reserved id."""
        return [self.begin, *(m for _, opening, closing in self.turns for m in (opening, closing) if m), *self.other]

    def _found(self, between: str) -> str:
        """A pattern of a control string's first character, with its rest ahead behind `between`."""
        tails: dict[str, list[str]] = {}
        for mark in self.controls:
            tails.setdefault(mark[0], []).append(re.escape(mark[1:]))
        escape = re.escape(self.escape)
        return "|".join(f"{re.escape(head)}(?={escape}{between}(?:{'|'.join(rest)}))" for head, rest in tails.items())

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, f"({self._found('*')})", "$1" + re.sub(r"([\\$])", r"\\\1", self.escape))

    def restored(self, text: str) -> str:
        return re.sub(f"({self._found('+')}).", r"\1", text, flags=re.DOTALL)


class _Layout:
    """Lays the segments of conversations out in rows of at most `length` tokens."""

    def __init__(self, length: int):
        self.length, self.rows = length, []
        self.key, self.some, self.edge = None, False, True
        self._start(None)

    def _start(self, key) -> None:
        self.key, self.at, self.held, self.ids, self.spans = key, 0, 0, [], []

    def turn(self, key, ids: np.ndarray, learned: tuple[int, int] | None) -> None:
        if not self.some or key != self.key:
            if self.some:
                self._emit(last=True)
                self.edge = False
            self._start(key)
            self.some = True
        if learned:
            self.spans.append((self.at + self.held + learned[0], self.at + self.held + learned[1]))
        self.ids.append(ids)
        self.held += len(ids)
        while self.held > self.length:
            self._emit(last=False)

    def _emit(self, last: bool) -> None:
        joined = np.concatenate(self.ids)
        taken = joined[: self.length]
        # +1 where a learned segment starts, -1 behind it: the running sum is the mask.
        ends = np.zeros(len(taken) + 1, np.int32)
        for start, end in self.spans:
            a, b = (min(max(x - self.at, 0), len(taken)) for x in (start, end))
            ends[a] += 1
            ends[b] -= 1
        self.rows.append((self.key, self.at, taken, np.cumsum(ends[:-1]) > 0, last, self.edge))
        self.at += len(taken)
        self.held -= len(taken)
        self.ids = [joined[self.length :]] if self.held else []
        self.spans = [s for s in self.spans if s[1] > self.at]

    def close(self) -> None:
        if self.some:
            self.edge = True
            self._emit(last=True)


def format_conversations(
    df: DataFrame,
    path: str,
    pattern: str,
    template: Template = Template(),
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    length: int = 8192,
    reserved: int | None = None,
) -> DataFrame:
    """(conv, start, ids, loss, whole): token rows of at most `length` tokens, and one more for the begin mark.

    The rows of a conversation, put one after the other by start (long, the place of the first token), are its
    token ids (array<int>) and loss mask (array<boolean>, true for the text of learned roles, marks excluded).
    whole says that a row has all of its conversation. Byte-pair ranks come from path, pieces from pattern;
    marks are the ids from `reserved` on, by default those after the highest rank.

    Rows stand by turn, ties by role, then by the text's md5 sum, nulls first; repeated rows are turns each.
    Null texts and roles are empty ones, null conversations are one conversation. Other columns are ignored,
    whatever their names. An empty table has no rows.
    """
    modest_batches(df.sparkSession)
    reserved = max(byte_bpe.read_ranks(path).values()) + 1 if reserved is None else reserved
    mark = {m: reserved + i for i, m in enumerate(template.controls)}
    # Row-wise in turn order; equal rows are told apart by where they were read, so ranges can split them too.
    given = df.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    ).withColumn("sum", F.md5(F.col("text").cast("binary"))).withColumn("read", F.monotonically_increasing_id())
    order = ["conv", "turn", "role", "sum", "read"]
    ranged = given.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text")

    spoken = F.when(~F.col("role").isin(*[r for r, _, _ in template.turns]), template.escaped(F.col("role"))).otherwise("")
    marked = ranged.select("conv", "role", spoken.alias("spoken"), template.escaped(F.col("text")).alias("text"))
    coded = byte_bpe.encode(byte_bpe.encode(marked, path, pattern, "text", "ids"), path, pattern, "spoken", "names")
    kind = T.StructType([
        T.StructField("conv", dict((f.name, f.dataType) for f in given.schema)["conv"]), T.StructField("at", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("loss", T.ArrayType(T.BooleanType())), T.StructField("last", T.BooleanType()), T.StructField("edge", T.BooleanType()), T.StructField("range", T.IntegerType()),
    ])
    known = {r: ([mark[a]] if a else [], mark[b]) for r, a, b in template.turns}
    opening, middle, closing = (mark[m] for m in template.other)
    learned = set(template.learned)

    def laid(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, place = _Layout(length), None

        def out(of: pa.Schema) -> pa.RecordBatch:
            rows, layout.rows = layout.rows, []
            key, at, ids, loss, last, edge = zip(*rows)
            sizes = np.array([len(x) for x in ids], np.int64)
            columns = [pa.array(key, of.field("conv").type), pa.array(at, pa.int64()), lists(np.concatenate(ids), sizes, pa.int32()), lists(np.concatenate(loss), sizes, pa.bool_())]
            columns += [pa.array(last, pa.bool_()), pa.array(edge, pa.bool_()), pa.array([place] * len(rows), pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=kind.names)

        for batch in batches:
            keys, roles = batch.column("conv").to_pylist(), batch.column("role").to_pylist()
            places = batch.column("range")
            texts, names = ((c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column("ids"), batch.column("names")))
            for i, (key, speaker) in enumerate(zip(keys, roles)):
                body = texts[1][texts[0][i] : texts[0][i + 1]]
                if speaker in known:
                    before, after = np.array(known[speaker][0], np.int32), known[speaker][1]
                else:
                    before, after = np.concatenate([[opening], names[1][names[0][i] : names[0][i + 1]], [middle]]).astype(np.int32), closing
                span = (len(before), len(before) + len(body)) if speaker in learned else None
                layout.turn(key, np.concatenate([before, body, [after]]).astype(np.int32), span)
            if batch.num_rows:
                place = places[0].as_py()
            if layout.rows:
                yield out(batch.schema)
            schema = batch.schema
        layout.close()
        if layout.rows:
            yield out(schema)

    stored = settle(coded.select("conv", "role", "ids", "names", F.spark_partition_id().alias("range")).mapInArrow(laid, kind))

    # Tokens in earlier ranges. Only the first and last conversation of a range can be in two of them, and
    # the last row of each is marked.
    by_range = stored.where("edge").groupBy("conv", "range").agg(F.max(F.col("at") + F.size("ids")).alias("n"))
    whole = Window.partitionBy("conv")
    before = F.coalesce(F.sum("n").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    cut, _ = small(by_range.select("conv", "range", before.alias("before"), F.count("*").over(whole).alias("pieces")).where("pieces > 1").withColumnsRenamed({"conv": "cut_conv", "range": "cut_range"}))
    met = stored.join(cut, F.col("conv").eqNullSafe(F.col("cut_conv")) & (F.col("range") == F.col("cut_range")), "left")

    start = F.col("at") + F.coalesce("before", F.lit(0))
    first = start == 0
    return met.select(
        F.col("conv").alias(conv),
        F.when(first, F.lit(0)).otherwise(start + 1).cast("long").alias("start"),
        F.when(first, F.concat(F.array(F.lit(mark[template.begin]).cast("int")), "ids")).otherwise(F.col("ids")).alias("ids"),
        F.when(first, F.concat(F.array(F.lit(False)), "loss")).otherwise(F.col("loss")).alias("loss"),
        (first & F.col("last") & F.col("pieces").isNull()).alias("whole"),
    )


class _Reading:
    """One conversation as it is read back token by token, with hashes instead of its texts."""

    def __init__(self):
        self.turns = self.characters = self.learned = 0
        self.said, self.masked = sha256(), sha256()
        self.role: str | None = None
        self.name, self.text, self.loss = [], [], []


def read_back(df: DataFrame, path: str, template: Template = Template(), conv: str = "conv_id", reserved: int | None = None) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from the ids and masks of format_conversations.

    turns_sha256 is over role, line feed, text and line feed of each turn, loss_* over all text under the mask,
    one after the other, formatted_chars counts the code points of the text form. Whole conversations are read
    where they are; the rows of others are brought together by start, and read one after the other, no more
    than one text being held, since a hash can't be taken in parts.
    """
    ranks = df.sparkSession.sparkContext.broadcast(byte_bpe.read_ranks(path))
    reserved = max(ranks.value.values()) + 1 if reserved is None else reserved
    marks = dict(enumerate(template.controls, reserved))
    opens = {a: r for r, a, _ in template.turns if a}
    silent = next((r for r, a, _ in template.turns if not a), None)
    opening, middle, _ = template.other
    kind = T.StructType([
        T.StructField("conv", df.schema[conv].dataType), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    ])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {rank: token for token, rank in ranks.value.items()}

        def text_of(ids: list[np.ndarray]) -> str:
            return b"".join([bytes_of[i] for part in ids for i in part.tolist()]).decode("utf-8")

        def learn(now: _Reading) -> None:
            if now.loss:
                text = template.restored(text_of(now.loss))
                now.learned += len(text)
                now.masked.update(text.encode("utf-8"))
                now.loss = []

        def control(now: _Reading, string: str) -> None:
            now.characters += len(string)
            if string == template.begin:
                return
            if string in opens:
                now.role = opens[string]
            elif string == opening:
                now.role = None
            elif string == middle:
                whole = text_of(now.text)
                now.characters += len(whole)
                now.role = template.restored(whole)
            else:
                whole = text_of(now.text)
                now.characters += len(whole)
                now.said.update(f"{now.role}\n{template.restored(whole)}\n".encode())
                now.turns += 1
                now.role = silent
            now.text = []

        def take(now: _Reading, ids: np.ndarray, loss: np.ndarray) -> None:
            special = ids >= reserved
            # Stretches without a mark and with one mask; a learned text ends where its mask does.
            turns = np.flatnonzero((special[1:] | special[:-1]) | (loss[1:] != loss[:-1])) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(ids)]):
                if loss[a]:
                    now.loss.append(ids[a:b])
                else:
                    learn(now)
                if special[a]:
                    control(now, marks[int(ids[a])])
                else:
                    now.text.append(ids[a:b])

        def out(done: list[tuple], of: pa.Schema) -> pa.RecordBatch:
            keys, read = zip(*done)
            columns = [pa.array(keys, of.field("conv").type), pa.array([r.turns for r in read], pa.int64()), pa.array([r.said.hexdigest() for r in read]), pa.array([r.learned for r in read], pa.int64())]
            columns += [pa.array([r.masked.hexdigest() for r in read]), pa.array([r.characters for r in read], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=kind.names)

        key = now = None
        for batch in batches:
            done = []
            ids, loss = batch.column("ids"), batch.column("loss")
            edges, tokens, masks = ids.offsets.to_pylist(), ids.values.to_numpy(), loss.values.to_numpy(zero_copy_only=False)
            shift = loss.offsets[0].as_py() - edges[0]
            for i, (one, start) in enumerate(zip(batch.column("conv").to_pylist(), batch.column("start").to_pylist())):
                if start == 0:
                    if now:
                        learn(now)
                        done.append((key, now))
                    key, now = one, _Reading()
                    now.role = silent
                a, b = edges[i], edges[i + 1]
                take(now, tokens[a:b], masks[a + shift : b + shift])
            schema = batch.schema
            if done:
                yield out(done, schema)
        if now:
            learn(now)
            yield out([(key, now)], schema)

    rows = df.select(F.col(f"`{conv}`").alias("conv"), "start", "ids", "loss", "whole")
    apart = rows.where("not whole").repartition("conv").sortWithinPartitions("conv", "start")
    columns = ["conv", "start", "ids", "loss"]
    found = [part.select(*columns).mapInArrow(read, kind) for part in (rows.where("whole"), apart)]
    return found[0].union(found[1]).withColumnRenamed("conv", conv)
