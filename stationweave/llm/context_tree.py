"""Language-model scores by context-tree weighting over bytes.

The next byte is a path of eight binary decisions. Each decision has a tree of contexts, from none to
the last `depth` bytes; a node holds Krichevsky-Trofimov counts of its context, and its weighted
probability mixes its own estimate with that of all deeper contexts, half and half. What a text is
given is the mixture along its contexts under the training counts; where a context was never seen
with a decision, the mixture ends at the deepest one that was.

Counts, trees and the probability of every byte in every context that occurs are made by Spark,
dealt by the last three bytes of context; only nodes above that depth are aggregated across them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import any_names, as_bytes, modest_batches, settle

CELL = 3  # bytes of context by which the work on deep contexts is dealt


@dataclass(frozen=True)
class ContextTree:
    """depth: bytes of context, 3 to 7. block: entries of the tables that a task holds at a time when
    it scores; a larger model is scored in several passes. piece: bytes that are counted at once."""

    depth: int = 5
    block: int = 2_000_000
    piece: int = 4_000_000


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, after shifting small arguments up."""
    x = np.array(x, float)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift[low] -= np.log(x[low])
        x[low] += 1
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def kt_log(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - np.log(np.pi) - log_gamma(a + b + 1.0)


def weigh(a: np.ndarray, b: np.ndarray, deeper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weighted log probability, weight of the node's own estimate), given the sum over its children."""
    own = kt_log(a, b)
    mixed = np.log(0.5) + np.logaddexp(own, deeper)
    return mixed, np.exp(np.minimum(0.0, np.log(0.5) + own - mixed))


def joined(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, start of each text, symbols of each text): every symbol behind its `depth` bytes of
    context. A text's last symbol is its end, a zero byte; before its first stand zero bytes."""
    pad = b"\0" * depth
    raw = np.frombuffer(pad + pad.join([*texts, b""]), np.uint8)
    n = len(raw) - depth
    grams = np.zeros(n, np.int64)
    for i in range(depth + 1):
        grams <<= 8
        grams |= raw[i : i + n]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + depth - 1)[:-1]])
    return grams, starts, sizes


def symbols(texts: list[bytes], depth: int) -> np.ndarray:
    """Grams of all texts, without those of the padding."""
    grams, starts, sizes = joined(texts, depth)
    keep = np.zeros(len(grams) + 1, np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, starts + sizes, -1)
    return grams[np.cumsum(keep[:-1]) > 0]


def decisions(grams: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, bit) of the step-th binary decision about each gram's last byte; a node is a one and the bits before."""
    byte = grams & 255
    return (1 << step) | (byte >> (8 - step)), (byte >> (7 - step)) & 1


def node_keys(grams: np.ndarray, node: np.ndarray, depth: int) -> np.ndarray:
    return (((grams >> 8) & ((1 << (8 * depth)) - 1)) << 8) | node


class Levels:
    """Nodes of one part of the trees, from depth CELL down, by sorted key."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int):
        seen = counts > 0
        grams, counts = grams[seen], counts[seen].astype(float)
        self.depth = depth
        self.key, self.zeros, self.ones, self.weight = {}, {}, {}, {}
        mixed = None
        for d in range(depth, CELL - 1, -1):
            keys, zeros, ones = [], [], []
            for step in range(8):
                node, bit = decisions(grams, step)
                keys.append(node_keys(grams, node, d))
                zeros.append(counts * (1 - bit))
                ones.append(counts * bit)
            self.key[d], place = np.unique(np.concatenate(keys), return_inverse=True)
            size = len(self.key[d])
            self.zeros[d] = np.bincount(place, np.concatenate(zeros), size)
            self.ones[d] = np.bincount(place, np.concatenate(ones), size)
            if mixed is None:
                mixed, self.weight[d] = kt_log(self.zeros[d], self.ones[d]), np.ones(size)
            else:
                below = self.key[d + 1]
                above = ((below >> 8) & ((1 << (8 * d)) - 1)) << 8 | (below & 255)
                mixed, self.weight[d] = weigh(self.zeros[d], self.ones[d], np.bincount(np.searchsorted(self.key[d], above), mixed, size))
        self.mixed = mixed

    def find(self, d: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.key[d]):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        place = np.minimum(np.searchsorted(self.key[d], keys), len(self.key[d]) - 1)
        return place, self.key[d][place] == keys

    def descend(self, d: int, keys: np.ndarray, stop, alpha, beta) -> tuple:
        """The mixture one level further: stop if no deeper node follows, else alpha + beta * what follows."""
        place, there = self.find(d, keys)
        if not len(self.key[d]):
            return stop, stop, np.zeros(len(keys))
        estimate = (self.ones[d][place] + 0.5) / (self.zeros[d][place] + self.ones[d][place] + 1)
        weight = self.weight[d][place]
        return (
            np.where(there, alpha + beta * estimate, stop),
            np.where(there, alpha + beta * weight * estimate, stop),
            np.where(there, beta * (1 - weight), 0.0),
        )


def _columns(batches, names) -> list[np.ndarray]:
    whole = [b for b in batches if b.num_rows]
    return [np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in whole]) if whole else np.zeros(0) for n in names]


def _counted(docs: DataFrame, rules: ContextTree) -> DataFrame:
    """(kind, key, n): kind 0 grams of all texts with their training counts, kind 1 word hashes of training texts."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(place, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

    def out(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], names=["kind", "key", "n"])

    def count(batches):
        grams: list = []
        words: list = []
        texts: dict[bool, list[bytes]] = {True: [], False: []}
        held = size = 0

        def take():
            for train, some in texts.items():
                if some:
                    keys, n = np.unique(symbols(some, rules.depth), return_counts=True)
                    grams.append((keys, n.astype(np.int64) if train else np.zeros(len(keys), np.int64)))
                    if train:
                        hashes = np.fromiter((h for t in some for h in map(xxhash.xxh64_intdigest, t.split())), np.uint64)
                        words.append(tuple(np.unique(hashes, return_counts=True)))
                    some.clear()

        for batch in batches:
            for train, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts[train].append(value.lower())
                size += len(value)
                if size >= rules.piece:
                    take()
                    size = 0
                    held += 1
                    if held % 8 == 0:
                        yield out(0, *merged(grams))
                        if words:
                            yield out(1, *merged(words))
                        grams.clear()
                        words.clear()
        take()
        if grams:
            yield out(0, *merged(grams))
        if words:
            yield out(1, *merged(words))

    return docs.select("train", "text").mapInArrow(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _upper(cells: DataFrame) -> DataFrame:
    """(cell, node, stop, alpha, beta): the mixture above every node of depth CELL."""

    @F.arrow_udf("struct<mixed: double, weight: double, estimate: double>")
    def weighed(a: pa.Array, b: pa.Array, deeper: pa.Array) -> pa.Array:
        a, b, deeper = (x.to_numpy(zero_copy_only=False).astype(float) for x in (a, b, deeper))
        mixed, weight = weigh(a, b, deeper)
        return pa.StructArray.from_arrays([pa.array(mixed), pa.array(weight), pa.array((b + 0.5) / (a + b + 1))], names=["mixed", "weight", "estimate"])

    below, levels = cells.select(F.col("cell").alias("context"), "node", "zeros", "ones", "mixed"), {}
    for d in range(CELL - 1, -1, -1):
        context = F.col("context").bitwiseAND(F.lit((1 << (8 * d)) - 1)).alias("context")
        sums = below.groupBy(context, "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("mixed").alias("deeper"))
        levels[d] = settle(sums.withColumn("w", weighed("zeros", "ones", "deeper")).select("context", "node", "zeros", "ones", "w.*"))
        below = levels[d]

    seen = F.col("zeros") + F.col("ones") > 0
    top = None
    for d in range(CELL):
        level = levels[d].select("context", "node", seen.alias("seen"), "weight", "estimate")
        if top is None:
            base = level.withColumns({"stop0": F.lit(0.5), "alpha0": F.lit(0.0), "beta0": F.lit(1.0)})
        else:
            above = F.col("context").bitwiseAND(F.lit((1 << (8 * (d - 1))) - 1))
            base = level.withColumn("_above", above).join(top.toDF("_above", "node", "stop0", "alpha0", "beta0"), ["_above", "node"])
        e, w, alpha, beta = F.col("estimate"), F.col("weight"), F.col("alpha0"), F.col("beta0")
        top = base.select(
            "context",
            "node",
            F.when(F.col("seen"), alpha + beta * e).otherwise(F.col("stop0")).alias("stop"),
            F.when(F.col("seen"), alpha + beta * w * e).otherwise(F.col("stop0")).alias("alpha"),
            F.when(F.col("seen"), beta * (1 - w)).otherwise(F.lit(0.0)).alias("beta"),
        )
    above = F.col("cell").bitwiseAND(F.lit((1 << (8 * (CELL - 1))) - 1))
    return cells.select("cell", "node", above.alias("context")).join(top, ["context", "node"]).select("cell", "node", "stop", "alpha", "beta")


def _log_probabilities(counts: DataFrame, rules: ContextTree) -> DataFrame:
    """(key, value): log10 of the probability of each gram's last byte behind the others."""
    cell = F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * CELL)) - 1)).alias("cell")
    grams = counts.where("kind = 0").select(cell, "key", "n")

    def up(batches):
        keys, n = _columns(batches, ("key", "n"))
        if len(keys):
            # Nodes of grams that training lacks count too, with nothing in them.
            levels = Levels(keys, n, rules.depth)
            every = np.unique(np.concatenate([node_keys(keys, decisions(keys, s)[0], CELL) for s in range(8)]))
            place, there = levels.find(CELL, every)
            known = [np.where(there, x[place], 0.0) if len(x) else np.zeros(len(every)) for x in (levels.zeros[CELL], levels.ones[CELL], levels.mixed)]
            yield pa.RecordBatch.from_arrays([pa.array(every >> 8), pa.array(every & 255), *map(pa.array, known)], names=["cell", "node", "zeros", "ones", "mixed"])

    cells = settle(grams.repartition("cell").mapInArrow(up, "cell long, node long, zeros double, ones double, mixed double"))
    nothing = [F.lit(None).cast("double").alias(c) for c in ("stop", "alpha", "beta")]
    both = grams.select("cell", "key", "n", F.lit(False).alias("upper"), *nothing).unionByName(
        _upper(cells).select("cell", F.shiftleft("cell", 8).bitwiseOR(F.col("node")).alias("key"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("upper"), "stop", "alpha", "beta")
    )

    def down(batches):
        keys, n, upper, *linear = _columns(batches, ("key", "n", "upper", "stop", "alpha", "beta"))
        if not len(keys):
            return
        upper = upper.astype(bool)
        order = np.argsort(keys[upper])
        above, linear = keys[upper][order], [x[upper][order].astype(float) for x in linear]
        keys, n = keys[~upper], n[~upper]
        levels = Levels(keys, n, rules.depth)
        total = np.zeros(len(keys))
        for step in range(8):
            node, bit = decisions(keys, step)
            place = np.searchsorted(above, node_keys(keys, node, CELL))
            stop, alpha, beta = (x[place] for x in linear)
            for d in range(CELL, rules.depth + 1):
                stop, alpha, beta = levels.descend(d, node_keys(keys, node, d), stop, alpha, beta)
            total += np.log10(np.where(bit == 1, stop, 1 - stop))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total)], names=["key", "value"])

    return both.repartition("cell").mapInArrow(down, "key long, value double")


class Table:
    """Sorted-free lookup of 64-bit keys: open addressing in arrays, of a size set by the number of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(2 * len(keys) + 1).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values, self.full = np.zeros(size, np.int64), np.zeros(size, values.dtype), np.zeros(size, bool)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = ~self.full[slot]
            taken, first = np.unique(slot[free], return_index=True)
            chosen = left[free][first]
            self.keys[taken], self.values[taken], self.full[taken] = keys[chosen], values[chosen], True
            stay = np.ones(len(left), bool)
            stay[np.flatnonzero(free)[first]] = False
            left, slot = left[stay], (slot[stay] + 1) & (size - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value or 0, whether there) of each key."""
        slot = self._slots(keys)
        same = (self.keys[slot] == keys) & self.full[slot]
        values = np.where(same, self.values[slot], self.values.dtype.type(0))
        todo = np.flatnonzero(~same & self.full[slot])
        at = slot[todo]
        while len(todo):
            at = (at + 1) & (len(self.keys) - 1)
            hit = (self.keys[at] == keys[todo]) & self.full[at]
            values[todo[hit]] = self.values[at[hit]]
            same[todo[hit]] = True
            on = ~hit & self.full[at]
            todo, at = todo[on], at[on]
        return values, same


class Block:
    """Tables of a block of the model, built where they are first used: only keys and values travel."""

    def __init__(self, *parts: tuple[np.ndarray, np.ndarray]):
        self.parts, self.tables = parts, ()

    def get(self) -> tuple[Table, ...]:
        if self.parts:
            self.tables, self.parts = tuple(Table(*p) for p in self.parts), ()
        return self.tables


def _sums(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
    return total[starts + sizes] - total[starts]


def _part(frame: DataFrame, i: int, n: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    rows = frame.where(F.pmod(F.xxhash64("key"), F.lit(n)) == i).toArrow()
    return rows.column("key").to_numpy().astype(np.int64), rows.column("value").to_numpy().astype(kind)


@any_names
def score(docs: DataFrame, train: "F.Column", text: str = "text", rules: ContextTree = ContextTree()) -> DataFrame:
    """All columns, with n_tokens, n_known, train_tokens (long), base_score and score (double) added or replaced.

    train says of each row whether the model learns from it (null: it doesn't). A-Z is lower-cased.
    score is log10 of the model's probability of the text's bytes and its end; base_score adds up
    log10((c + 0.1) / (N + 0.1 (V + 1))) over the words, parted by ASCII white space, and one end,
    from the counts c of the training tokens. n_known counts the tokens with c > 0, train_tokens is N.

    A null text is an empty one. Repeated rows are learnt and scored each. Without any training row
    all bytes are equally likely. An empty table stays empty. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [f"`{c}`" for c in docs.columns if c not in added]
    learnt = docs.select(F.coalesce(train, F.lit(False)).alias("train"), as_bytes(text).alias("text"))
    counts = settle(_counted(learnt, rules))
    ends = learnt.where("train").count()
    words = counts.where("kind = 1")
    n_words, n_distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = n_words + ends, n_distinct + (ends > 0)
    seen = settle(_log_probabilities(counts, rules))
    known = words.select("key", F.col("n").alias("value"))
    parts = max(1, -(-max(seen.count(), n_distinct) // rules.block))
    least = np.log10(0.1) - np.log10(n + 0.1 * (v + 1))

    def scored(i: int):
        shared = spark.sparkContext.broadcast(Block(_part(seen, i, parts, np.float32), _part(known, i, parts, np.float64)))

        @F.arrow_udf(T.StructType([T.StructField(c, k) for c, k in zip(("n_tokens", "n_known", "base", "score"), (T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()))]))
        def of(texts: pa.Array) -> pa.Array:
            grams, counted = shared.value.get()
            columns: list[list[np.ndarray]] = [[], [], [], []]
            values = [t.lower() for t in texts.to_pylist()]
            at = 0
            while at < len(values):
                upto, size = at, 0
                while upto < len(values) and size < rules.piece // 2:
                    size += len(values[upto])
                    upto += 1
                some = values[at:upto]
                at = upto
                keys, starts, sizes = joined(some, rules.depth)
                columns[3].append(_sums(grams.find(keys)[0], starts, sizes))
                words = [t.split() for t in some]
                n_words = np.array([len(w) for w in words], np.int64)
                first = np.concatenate([[0], np.cumsum(n_words)[:-1]])
                c, there = counted.find(np.fromiter((h for w in words for h in map(xxhash.xxh64_intdigest, w)), np.uint64).view(np.int64))
                columns[0].append(n_words)
                columns[1].append(_sums(there, first, n_words))
                columns[2].append(_sums(np.log10((c.astype(float) + 0.1) / 0.1), first, n_words))
            whole = [np.concatenate([np.zeros(0), *x]) for x in columns]
            return pa.StructArray.from_arrays([pa.array(whole[0].astype(np.int64) + 1), pa.array(whole[1].astype(np.int64)), *map(pa.array, whole[2:])], names=["n_tokens", "n_known", "base", "score"])

        return of, shared

    rows = docs.select(*kept, as_bytes(text).alias("_text"))
    # A text's parts add up, each once: rows of the same text may differ in the last digits of a part, which depend on what is summed before them.
    each = None
    for i in range(parts):
        of, shared = scored(i)
        part = rows.select(F.md5("_text").alias("_digest"), of("_text").alias("s"))
        one = settle(part.groupBy("_digest").agg(*[F.max(f"s.{c}").alias(c) for c in ("n_tokens", "n_known", "base", "score")]))
        shared.destroy()  # the driver holds one block at a time
        each = one if each is None else each.union(one)
    whole = each.groupBy("_digest").agg(F.struct(F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score")).alias("_s"))
    found = rows.withColumn("_digest", F.md5("_text")).join(whole, "_digest")
    end = np.log10((ends + 0.1) / 0.1)
    return found.select(
        *kept,
        F.col("_s.n_tokens").alias("n_tokens"),
        (F.col("_s.n_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("_s.base") + F.lit(float(end)) + F.col("_s.n_tokens") * F.lit(float(least))).alias("base_score"),
        F.col("_s.score").alias("score"),
    )
