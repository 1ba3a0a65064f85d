"""A Merkle manifest of a table: a leaf for each row, a tree for each group, and a tree over the groups.

Leaves are numbered in their group by a distributed count, and 2^12 of them in a row are a superblock. A
first grouping brings each superblock to its top node; the tops are leaves of the next, 4,096 times smaller
round, until every group is at its root. On the way back a superblock is cogrouped with the one outer row
it needs, the siblings between its top and the root, and one task finishes its inner levels, joins the two
parts of every proof and folds it. No task ever sees more than a superblock.

A node is the sha256 of the hex texts of one or two nodes; the last of an odd row is hashed alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import settle
from .ordering import numbered

BLOCK_BITS = 12

# Steps of a proof: the sibling's side and its hex text, or that there is none.
LEFT, RIGHT, ALONE = "l", "r", "."

RESULT = ("place", "leaf", "subroot", "root", "proof", "folded_root", "verified")


def _hash(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def field(value: Column) -> Column:
    """A value as it enters a leaf: `-` for null, else its length in UTF-8 bytes, `:` and its text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def fold(node: str, steps: Sequence[str]) -> str:
    """The root that a leaf and the steps of its proof lead to."""
    for step in steps:
        side, other = step[0], step[1:]
        node = _hash(other + node if side == LEFT else node + other)
    return node


def _height(size: int) -> int:
    return (size - 1).bit_length()


def _levels(nodes: list[str], height: int) -> list[list[str]]:
    levels = [nodes]
    for _ in range(height):
        row = levels[-1]
        levels.append([_hash("".join(row[i : i + 2])) for i in range(0, len(row), 2)])
    return levels


def _steps(levels: list[list[str]], at: int) -> list[str]:
    """Siblings from place `at` up to the top; a superblock starts at an even place on all its levels but the top."""
    out = []
    for row in levels[:-1]:
        other = at ^ 1
        out.append(ALONE if other >= len(row) else (LEFT if at & 1 else RIGHT) + row[other])
        at >>= 1
    return out


def _inner(block: pd.DataFrame, bits: int) -> tuple[pd.DataFrame, list[list[str]]]:
    block = block.sort_values("place", kind="stable")
    return block, _levels(block["node"].tolist(), min(bits, _height(int(block["size"].iloc[0]))))


def _outer(nodes: DataFrame, bits: int) -> DataFrame:
    """(tree, place, steps, top) for nodes (tree, place, size, node), settled: the way from each node to the top of its tree."""
    if (nodes.agg(F.max("size")).first()[0] or 0) <= 1:
        return settle(nodes.select("tree", "place", F.lit("").alias("steps"), F.col("node").alias("top")))
    blocks = nodes.withColumn("block", F.shiftright("place", bits))

    def reduced(block: pd.DataFrame) -> pd.DataFrame:
        first = block.iloc[0]
        _, levels = _inner(block, bits)
        return pd.DataFrame({"tree": [first["tree"]], "place": [first["block"]], "size": [-(-int(first["size"]) // (1 << bits))], "node": [levels[-1][0]]})

    tops = settle(blocks.groupBy("tree", "block").applyInPandas(reduced, "tree string, place long, size long, node string"))
    above = _outer(tops, bits).withColumnRenamed("place", "block")

    def joined(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block, levels = _inner(block, bits)
        rest, top = outer["steps"].iloc[0], outer["top"].iloc[0]
        steps = [" ".join([*_steps(levels, i), *rest.split()]) for i in range(len(block))]
        return pd.DataFrame({"tree": block["tree"], "place": block["place"], "steps": steps, "top": top})

    out = blocks.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(joined, "tree string, place long, steps string, top string")
    return settle(out)


def manifest(df: DataFrame, columns: Sequence[str], key: str, group: str, presented: Mapping[str, Column] | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """(key, group, place, leaf, subroot, root, proof, folded_root, verified) for every row of df.

    A leaf is the sha256 of the named columns, in their order (see `field`). In each group the leaves stand by
    key, null first, rows with equal keys by leaf; equal leaves are interchangeable. The tops of the groups,
    null first, then by the bytes of their text, are the leaves of the root's tree. proof (array<string>) has
    one step a level up to the root: `l` or `r` and the sibling's hex text, or `.` where there is none.

    presented gives columns as a reader claims them to be, instead of those of df; folded_root is what
    the leaf made of them and the proof lead to, and verified says whether that is the root. Repeated rows
    are leaves each. An empty table has no rows. Other columns are ignored, whatever their names; null and
    empty values have different leaves. key and group may have any type that casting to text and back keeps;
    they can't be called like a column of the result.
    """
    if len({key, group, *RESULT}) < 2 + len(RESULT):
        raise ValueError(f"key and group need names of their own, apart from {', '.join(RESULT)}")
    claimed = dict(presented or {})
    named = {c: F.col(f"`{c}`") for c in columns}
    own, told = leaf(list(named.values())), leaf([claimed.get(c, named[c]) for c in columns])
    # Hashes only from here on, the claimed one where it differs. Stored, since finding ranges reads them once more.
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{group}`").alias("part"), own.alias("node"), told.alias("told"))
    rows = settle(rows.select("*", field(F.col("part")).alias("tree")).withColumn("told", F.nullif("told", "node")))
    leaves = numbered(rows, "tree", [F.col("part").cast("string"), F.col("id"), F.col("node")])
    blocks = leaves.withColumn("block", F.shiftright("place", bits))

    def reduced(block: pd.DataFrame) -> pd.DataFrame:
        first = block.iloc[0]
        _, levels = _inner(block, bits)
        return pd.DataFrame({"tree": [first["tree"]], "part": [first["part"]], "place": [first["block"]], "size": [-(-int(first["size"]) // (1 << bits))], "node": [levels[-1][0]]})

    needed = blocks.select("tree", "block", F.col("part").cast("string").alias("part"), "place", "size", "node")
    tops = settle(needed.groupBy("tree", "block").applyInPandas(reduced, "tree string, part string, place long, size long, node string"))
    within = _outer(tops.drop("part"), bits)

    # One row a group: its top is a leaf of the last tree.
    groups = within.where("place = 0").join(tops.where("place = 0").select("tree", "part"), "tree").select("tree", "part", F.col("top").alias("node"))
    over = numbered(groups.select(F.lit("all").alias("one"), "*"), "one", [F.col("part")])
    upper = _outer(over.select(F.col("one").alias("tree"), "place", "size", "node"), bits).select("place", F.col("steps").alias("rest"), F.col("top").alias("root"))
    roots = over.select("tree", "place").join(upper, "place").drop("place")
    outer = within.join(roots, "tree").select("tree", F.col("place").alias("block"), F.concat_ws(" ", "steps", "rest").alias("steps"), F.col("top").alias("subroot"), "root")

    def finished(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block, levels = _inner(block, bits)
        rest, root = outer["steps"].iloc[0].split(), outer["root"].iloc[0]
        proofs = [_steps(levels, i) + rest for i in range(len(block))]
        folded = [fold(told or node, proof) for node, told, proof in zip(block["node"], block["told"], proofs)]
        made = {"id": block["id"], "part": block["part"], "place": block["place"], "leaf": block["node"], "subroot": outer["subroot"].iloc[0]}
        return pd.DataFrame({**made, "root": root, "proof": proofs, "folded_root": folded, "verified": [f == root for f in folded]})

    # As text, since pandas would turn whole numbers beside a null into floats.
    carried = blocks.select("tree", "block", "place", "size", "node", "told", F.col("id").cast("string").alias("id"), F.col("part").cast("string").alias("part"))
    schema = "id string, part string, place long, leaf string, subroot string, root string, proof array<string>, folded_root string, verified boolean"
    out = carried.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(finished, schema)
    kinds = dict(rows.dtypes)
    return out.select(F.col("id").cast(kinds["id"]).alias(key), F.col("part").cast(kinds["part"]).alias(group), *RESULT)
