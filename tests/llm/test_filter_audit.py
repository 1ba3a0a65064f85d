"""The audit against applying each chain of filters to the rows, one after the other."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from stationweave.llm import filter_audit


def by_hand(rows, names, tallies):
    """rows: (part, failures by name, flags by tally)."""
    out, shapley = [], Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations(names):
            left = own
            for step, name in enumerate(order, 1):
                gone = [r for r in left if r[1][name]]
                left = [r for r in left if not r[1][name]]
                alone = sum(r[1][name] and sum(r[1].values()) == 1 for r in own)
                shapley[part, name] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), sum(r[1][name] for r in own) - len(gone), alone, *(sum(r[2][t] for r in gone) for t in tallies), name])
    return sorted(([*r[:-1], shapley[r[0], r[-1]]] for r in out), key=str)


@pytest.mark.parametrize("names", ["X", "XY", "PQRS"])
def test_every_order(spark, names):
    rng = random.Random(len(names))
    rows = [(rng.choice(["a", "b", None]), {f: rng.random() < 0.4 for f in names}, {"good": rng.random() < 0.5}) for _ in range(300)] + [("c", dict.fromkeys(names, False), {"good": True})] * 4
    df = spark.createDataFrame([(p, *f.values(), g["good"], 7, 8) for p, f, g in rows], f"source string, {', '.join(f'{x} boolean' for x in names)}, good boolean, mask int, w0 int")
    got = filter_audit.audit(df, list(names), "source", ["good"])
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "shapley"]
    assert sorted((list(r) for r in got.collect()), key=str) == by_hand(rows, names, ["good"])


def test_diagram_after_any_swaps():
    rng = random.Random(3)
    for _ in range(40):
        n = rng.randint(1, 5)
        counts = {rng.randrange(1 << n): (rng.randint(0, 3), rng.randint(0, 2)) for _ in range(rng.randint(0, 12))}
        diagram = filter_audit.Diagram(n, counts, 2)
        for _ in range(20 if n > 1 else 0):
            diagram.swap(rng.randrange(n - 1))
        passed = 0
        for level, (at, kept, removed, alone) in enumerate(diagram.path()):
            value = lambda wanted: tuple(sum(w[k] for m, w in counts.items() if wanted(m)) for k in (0, 1))
            assert removed == value(lambda m: not m & passed and m >> at & 1)
            passed |= 1 << at
            assert kept == value(lambda m: not m & passed) and alone == counts.get(1 << at, (0, 0))[0]
            assert diagram.failing(level) == value(lambda m: m >> at & 1)[0]


def failures(text, copy):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), copy


def test_text_failures_and_labels(spark):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(250))
    texts = [long, long + " #", "AB " + long, ("a b " * 150), None, "", "É é\x0b\x0cx", long, "X" * 30 + long, "w " * 500_000, " \t\n", "|"]
    rows = [(i % len(texts) if i < 30 else i, texts[i % len(texts)], f"s{i % 2}" if i % 5 else None) for i in range(60)] + [(None, long, "s1"), (None, "", None), (-1, "", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("A", F.lit("clash")).withColumn("digest", F.lit(1))
    got = filter_audit.text_failures(df).collect()
    least = {}
    for k, t, _ in rows:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    want = Counter((s, k, *failures(t, k is not None and k > least[t or ""])) for k, t, s in rows)
    found = Counter()
    for r in got:
        found[(r.part, r.doc_id, r.A, r.B, r.C, r.D, r.E)] += r.n
    assert found == want

    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (3, None, 1), (4, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    labelled = filter_audit.with_labels(filter_audit.text_failures(df), labels, good=F.col("quality") == 1, toxic=F.col("toxic") == 1).collect()
    assert sum(r.n for r in labelled) == len(rows)
    assert {r.doc_id for r in labelled if r.good} == {0, 4} and {r.doc_id for r in labelled if r.toxic} == {0, 3}


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    failing = filter_audit.text_failures(empty)
    assert failing.count() == 0 and filter_audit.audit(failing, filter_audit.TEXT_FILTERS, "part", n="n").count() == 0
    for wrong in ([], list("ABCDEFGH")):
        with pytest.raises(ValueError):
            filter_audit.audit(failing, wrong, "part")
    nulls = spark.createDataFrame([("p", None, True), ("p", None, None)], "source string, X boolean, Y boolean")
    assert {(r.filter_order, r.step, r.kept) for r in filter_audit.audit(nulls, ["X", "Y"], "source").collect()} == {("XY", 1, 2), ("XY", 2, 1), ("YX", 1, 1), ("YX", 2, 1)}
