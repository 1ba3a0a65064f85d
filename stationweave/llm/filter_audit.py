"""What each filter of a chain removes in every order of the chain, by decision diagrams.

Spark counts documents by part and by the set of filters they fail, at most 2^n rows a part. From
these a part's decision diagram is built: one level a filter, an edge for passing and one for failing,
the documents below each node as its weight. Swapping two neighbouring levels changes nothing but these
two levels, and a walk over all orders by such swaps visits each order once. In a diagram whose levels
stand in the order of the chain, the path of passing edges is the chain: the weight left on it is kept,
what its failing edges lead to is removed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import let, settle

GAP = r"[\x20\x09-\x0D]+"  # what separates words
MAX_FILTERS = 7  # the result has n! * n rows a part

TEXT_FILTERS = ("A", "B", "C", "D", "E")


class Node:
    """A function of the filters from its level on; equal functions of one level are one node."""

    __slots__ = ("passing", "failing", "weight")

    def __init__(self, passing: Node | None, failing: Node | None, weight: tuple[int, ...]):
        self.passing, self.failing, self.weight = passing, failing, weight


class Diagram:
    """Counts of failure masks as a diagram without skipped levels; `order` names the filter of each level."""

    def __init__(self, n: int, counts: dict[int, tuple[int, ...]], width: int):
        self.order = list(range(n))
        ends = {w: Node(None, None, w) for w in {(0,) * width, *counts.values()}}
        below = [ends[counts.get(mask, (0,) * width)] for mask in range(1 << n)]
        self.levels: list[list[Node]] = [[] for _ in range(n)]
        # Bit i of a mask is filter i, so halving a table by its highest bit leaves the filters above it.
        for level in reversed(range(n)):
            known: dict[tuple[int, int], Node] = {}
            half = 1 << level
            below = [self._node(known, below[m], below[m + half]) for m in range(half)]
            self.levels[level] = list(known.values())
        self.root = below[0]

    @staticmethod
    def _node(known: dict[tuple[int, int], Node], passing: Node, failing: Node) -> Node:
        key = id(passing), id(failing)
        if key not in known:
            known[key] = Node(passing, failing, tuple(map(sum, zip(passing.weight, failing.weight))))
        return known[key]

    def swap(self, level: int) -> None:
        """Exchange the filters of a level and the next one. Upper nodes stay the same functions, so none above changes."""
        known: dict[tuple[int, int], Node] = {}
        for node in self.levels[level]:
            a, b = node.passing, node.failing
            node.passing = self._node(known, a.passing, b.passing)
            node.failing = self._node(known, a.failing, b.failing)
        self.levels[level + 1] = list(known.values())
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def failing(self, level: int) -> int:
        """Documents that fail the filter of a level, whatever else they fail: over all paths to each node of it."""
        paths = {id(self.root): (self.root, 1)}
        for _ in range(level):
            following: dict[int, tuple[Node, int]] = {}
            for node, n in paths.values():
                for child in (node.passing, node.failing):
                    following[id(child)] = child, following.get(id(child), (child, 0))[1] + n
            paths = following
        return sum(n * node.failing.weight[0] for node, n in paths.values())

    def path(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...], int]]:
        """Along the passing edges: filter, weight kept, weight removed, documents that fail this filter only."""
        node = self.root
        for at in self.order:
            alone = node.failing
            while alone.passing is not None:
                alone = alone.passing
            yield at, node.passing.weight, node.failing.weight, alone.weight[0]
            node = node.passing


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places of the n! - 1 neighbour swaps that lead through every order once: the last one runs to and fro between orders of the others."""
    if n < 2:
        return
    others = adjacent_swaps(n - 1)
    places = range(n - 1)
    for turn in range(factorial(n - 1)):
        yield from places if turn % 2 else reversed(places)
        step = next(others, None)
        if step is not None:
            # The runner stands at the left end after an even turn, and the others are one further right.
            yield step + 1 - turn % 2


def audit(df: DataFrame, filters: Sequence[str], part: str, tallies: Sequence[str] = (), n: str | None = None) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <tally>_lost…, shapley), n! * n rows for each part.

    filters are names of boolean columns that are true where a row fails; null counts as passing. A row of
    the result is about the filter at place `step` (from 1) of `filter_order`, its names joined: kept and
    removed rows of the part, rows that fail it but were removed before, rows that fail it alone, rows with
    each boolean column of tallies among the removed (null as false), and `removed` summed over all orders
    in which the filter may stand. n, where given, is a column of row counts. Null parts are one part of
    their own. Rows are counted as often as they stand there; a part that is absent has no rows, so an empty
    table gives none. Other columns are ignored, whatever their names.
    """
    if not 1 <= len(filters) <= MAX_FILTERS:
        raise ValueError(f"an audit takes 1 to {MAX_FILTERS} filters")
    size, width = len(filters), 1 + len(tallies)

    def flag(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`"), F.lit(False))

    mask = sum((F.when(flag(f), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0)).cast("int")
    rows = (F.col(f"`{n}`") if n else F.lit(1)).cast("long")
    weights = [rows.alias("w0"), *(F.when(flag(t), rows).otherwise(0).alias(f"w{i}") for i, t in enumerate(tallies, 1))]
    masked = df.select(F.col(f"`{part}`").alias("part"), mask.alias("mask"), *weights)
    sums = [F.sum(f"w{i}").alias(f"w{i}") for i in range(width)]
    counts = masked.groupBy("part", "mask").agg(*sums)

    lost = [f"{t}_lost" for t in tallies]
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost, "shapley"]
    names = list(filters)

    def steps(group: pd.DataFrame) -> pd.DataFrame:
        key = group["part"].iloc[0]
        table = {int(r[0]): tuple(map(int, r[1:])) for r in group[["mask", *(f"w{i}" for i in range(width))]].itertuples(index=False)}
        diagram = Diagram(size, table, width)
        failing = [diagram.failing(i) for i in range(size)]
        out, shapley = [], [0] * size
        swaps = adjacent_swaps(size)
        while True:
            order = "".join(names[i] for i in diagram.order)
            for step, (at, kept, removed, alone) in enumerate(diagram.path(), 1):
                out.append([key, order, step, kept[0], removed[0], failing[at] - removed[0], alone, *removed[1:], at])
                shapley[at] += removed[0]
            place = next(swaps, None)
            if place is None:
                break
            diagram.swap(place)
        for row in out:
            row[-1] = shapley[row[-1]]
        return pd.DataFrame(out, columns=columns)

    kind = dict(masked.dtypes)["part"]
    schema = f"part {kind}, filter_order string, step int, " + ", ".join(f"`{c}` long" for c in columns[3:])
    return counts.groupBy("part").applyInPandas(steps, schema)


def text_failures(docs: DataFrame, part: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, doc_id, A, B, C, D, E, n): equal rows counted once, with what they fail.

    A: under 200 words; B: under half of the words differ; C: over 2 % of the characters are `[A-Z]`; D: a
    character of `[#$%&*|]`; E: a smaller doc_id has the same text. Null texts are empty; an empty text has
    no words, so it fails A and not B. A null doc_id is no smaller one and has none below it, so it never
    fails E and no text fails E by it. Texts are told apart by a 128-bit digest. n counts the repeated rows
    of a part with one doc_id and one text. An empty table stays empty; other columns are ignored.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    words = F.array_remove(F.split(whole, GAP), "")
    sizes = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("kinds")))
    capitals = F.length(whole) - F.length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    read = docs.select(
        F.col(f"`{part}`").alias("part"), F.col(f"`{doc_id}`").alias("doc_id"), F.unhex(F.md5(whole.cast("binary"))).alias("digest"),
        sizes.alias("words"), (100 * capitals > 2 * F.length(whole)).alias("C"), whole.rlike(r"[#$%&*|]").alias("D"),
    )
    judged = read.select("part", "doc_id", "digest", (F.col("words.n") < 200).alias("A"), (100 * F.col("words.kinds") < 50 * F.col("words.n")).alias("B"), "C", "D")
    stored = settle(judged.groupBy(*judged.columns).agg(F.count("*").alias("n")))

    # A text's rows are alike but for E, and all with a doc_id fail it except those with the least one. The
    # join is on both, so a text that most rows share meets in no task.
    first = stored.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    named = stored.where("doc_id is not null").join(first, ["digest", "doc_id"], "left").withColumn("E", F.col("first").isNull())
    nameless = stored.where("doc_id is null").withColumn("E", F.lit(False))
    columns = ["part", "doc_id", *TEXT_FILTERS, "n"]
    return named.select(*columns).union(nameless.select(*columns))


def with_labels(failures: DataFrame, labels: DataFrame, **tallies: Column) -> DataFrame:
    """The rows of text_failures with boolean columns from labels (doc_id, …): whether any label row of the doc_id meets the condition.

    Documents without label rows, or with a null doc_id, get false. Repeated label rows repeat no document.
    """
    rows = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(t) for t, c in tallies.items()))
    named = failures.where("doc_id is not null").join(rows, "doc_id", "left").fillna(False, list(tallies))
    nameless = failures.where("doc_id is null").select("*", *(F.lit(False).alias(t) for t in tallies))
    return named.unionByName(nameless)
