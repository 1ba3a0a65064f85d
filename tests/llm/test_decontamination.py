"""Winnowed decontamination against looking for every window."""

from __future__ import annotations

import random
import re

import pytest

from stationweave.llm import common, decontamination

FOLD = str.maketrans(common.UPPER, common.LOWER)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def by_hand(text, items):
    w, hit, ids = words(text), set(), set()
    for key, item in items:
        v = words(item)
        n = min(10, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                if key is not None:
                    ids.add(str(key))
    return len(w), len(hit), sorted(ids)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "é", "日本", "İx", "ΣΑΣ"]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([10, 11, 16, 40])))) for i in range(25)]
    items += [(30, "w1 w2 w3"), (31, "w9"), (32, ""), (33, None), (34, "..."), (35, items[0][1]), (None, " ".join(say(30))), (36, "a a a a a a a a a a a a a"), (0, "w5 w6 w7 w8 w9 w10 w11")]
    docs = []
    for i in range(150):
        w = say(rng.choice([0, 3, 9, 10, 60, 200]))
        if i % 3 == 0:
            v = words(rng.choice(items)[1])
            a = rng.randrange(len(v)) if v else 0
            w[len(w) // 2 : len(w) // 2] = [x.upper() if x.isascii() else x for x in v[a : a + rng.choice([9, 10, 12, 100])]]
        docs.append((i, rng.choice([" ", ", ", "\n", "--"]).join(w)))
    docs += [(200, None), (201, ""), (202, "a " * 300), (0, docs[0][1]), (None, docs[3][1]), (203, items[3][1] + " " + items[3][1])]
    return docs, items


def check(spark, docs, data):
    rows, items = data
    found = decontamination.contaminate(docs(rows).selectExpr("*", "note AS n_hit"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_words, r.n_hit, r.item_ids) == by_hand(r.text, items), r
        assert r.n_items == len(r.item_ids)


def test_equals_by_hand(spark, docs, data):
    check(spark, docs, data)


def test_equals_by_hand_without_broadcast(spark, docs, data, monkeypatch):
    monkeypatch.setattr(common.small, "__defaults__", (0,))
    check(spark, docs, data)


def test_clean_and_empty_tables(spark, docs, data):
    rows, items = data
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = decontamination.clean(docs(rows), bench)
    assert clean.columns == ["doc_id", "text", "lang", "note"]
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(k) for k, t in rows if not by_hand(t, items)[1])
    assert decontamination.contaminate(docs([]), bench).count() == 0
    assert decontamination.clean(docs(rows), bench.limit(0)).count() == len(rows)
