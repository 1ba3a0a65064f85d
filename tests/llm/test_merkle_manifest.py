"""The manifest against a tree built by hand."""

from __future__ import annotations

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from stationweave.llm import merkle_manifest
from stationweave.llm.common import remainder

COLUMNS = ["doc_id", "lang", "text"]


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The root, and for each node its siblings with their sides; None where it has none."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            other = place ^ 1
            paths[i].append(None if other >= len(nodes) else (place & 1, nodes[other]))
            at[i] = place >> 1
        nodes = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = {}
    for g in order:
        inner[g] = sorted(groups[g]), *climb([x[2] for x in sorted(groups[g])])
    root, upper = climb([inner[g][1] for g in order])
    out = {}
    for place, g in enumerate(order):
        members, top, paths = inner[g]
        for (known, key, own), path in zip(members, paths):
            steps = ["." if s is None else "rl"[s[0]] + s[1] for s in path + upper[place]]
            out.setdefault((key if known else None, g, own), []).append((top, root, steps))
    return out


@pytest.mark.parametrize("n, bits", [(1, 2), (2, 2), (37, 1), (100, 2), (260, 3), (90, 12)])
def test_proofs(spark, docs, n, bits):
    rng = random.Random(n)
    rows = [(i, f"text {i} é" if i % 7 else ("" if i % 2 else None), rng.choice(["en", "en", "en", "de", "fr", "ü", "", None])) for i in rng.sample(range(10**15), n)]
    if n > 50:
        rows += [rows[0], rows[0], (None, "x", "en"), (None, "x", None), (None, None, "en"), (rows[1][0], "other text", rows[1][2])]
    df = docs(rows).withColumn("leaf", F.lit("clash")).withColumn("tree", F.lit(1)).withColumn("_range", F.lit(2)).withColumn("place", F.lit(0))
    got = merkle_manifest.manifest(df, COLUMNS, "doc_id", "lang", bits=bits).collect()
    want = by_hand([(k, lang, t) for k, t, lang in rows])
    assert len(got) == len(rows)
    found = {}
    for r in got:
        assert r.verified and r.folded_root == r.root == merkle_manifest.fold(r.leaf, r.proof)
        found.setdefault((r.doc_id, r.lang, r.leaf), []).append((r.subroot, r.root, r.proof))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}


def test_tampered_rows_fail(docs):
    rows = [(i, f"t{i}", "en" if i % 3 else None) for i in range(60)]
    changed = F.when(remainder("doc_id", 7) == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    got = merkle_manifest.manifest(docs(rows).withColumn("bad", remainder("doc_id", 7) == 0), COLUMNS, "doc_id", "lang", {"text": changed}, bits=2)
    want = docs(rows).select("doc_id", (remainder("doc_id", 7) == 0).alias("bad")).collect()
    verified = {r.doc_id: r.verified for r in got.collect()}
    assert {r.doc_id: not r.bad for r in want} == verified and not all(verified.values())
    for r in got.collect():
        assert merkle_manifest.fold(r.leaf, r.proof) == r.root


def test_edges(docs):
    assert merkle_manifest.manifest(docs([]), COLUMNS, "doc_id", "lang").count() == 0
    one = merkle_manifest.manifest(docs([(5, "a" * 2_000_000, None)]), COLUMNS, "doc_id", "lang").first()
    assert one.root == one.leaf == one.subroot == leaf((5, None, "a" * 2_000_000)) and one.proof == [] and one.verified
    with pytest.raises(ValueError):
        merkle_manifest.manifest(docs([]).withColumnRenamed("lang", "root"), ["doc_id"], "doc_id", "root")
