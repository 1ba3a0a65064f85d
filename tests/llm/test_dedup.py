"""Near duplicates and repeated passages against comparing everything with everything."""

from __future__ import annotations

import os
import random
import time
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationweave.llm import common, components as components_module, near_dedup, substring_dedup
from stationweave.llm.components import connected_components as components_of


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    size = min(size, len(w))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()


def components(rows, size, threshold):
    sets = [(k, shingle_set(t, size)) for k, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, len(s), least.get(find(i)) if s else k) for i, (k, s) in enumerate(sets)]


def corpus():
    """Copies, a ladder of edits around the threshold, one large group, short, empty and null texts."""
    rng = random.Random(4)
    rows, key = [], 0
    for _ in range(12):
        base = words(rng, rng.choice([30, 80, 200]))
        for edits in (0, 0, 1, 2, 3, 4, 6, 9):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"x{rng.random()}"
            rows.append((key := key + 1, " ".join(w)))
    hot = words(rng, 60)
    for i in range(120):
        w = list(hot)
        w[rng.randrange(60)] = f"y{i}"
        rows.append((key := key + 1, "  ".join(w).upper() if i % 2 else "\n".join(w)))
    rows += [(key + i, t) for i, t in enumerate(["", None, " \n", "one", "ONE", "one two", "a b c", "a b c", "a b c d"], 1)]
    rows += [(rows[0][0], rows[0][1]), (None, rows[3][1]), (None, "nobody has this"), (5000, "z " * 3000), (5001, "z " * 2500)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size, threshold", [(3, 85), (5, 80)])
def test_components_equal_all_pairs(docs, size, threshold):
    rows = corpus()
    got = near_dedup.near_duplicates(docs(rows).withColumn("kept", F.lit("clash")), size=size, threshold=threshold).collect()
    order = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=order) == sorted(components(rows, size, threshold), key=order)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_crossing_links_between_groups(docs):
    """Two groups that meet only through members that are not their bands' first."""
    rng = random.Random(9)
    for seed in range(3):
        base = words(rng, 100)
        rows = []
        for i in range(40):  # a chain: each differs from the one before in two words
            base = list(base)
            for _ in range(2):
                base[rng.randrange(100)] = f"c{seed}{i}{rng.random()}"
            rows.append((rng.randrange(10**6), " ".join(base)))
        got = near_dedup.near_duplicates(docs(rows), size=3, threshold=85).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(components(rows, 3, 85))


def test_same_result_without_broadcast(docs, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(common.small, "__defaults__", (0,))
    got = near_dedup.near_duplicates(docs(rows), size=3, threshold=85).collect()
    assert sorted((r.component_id or -1) for r in got) == sorted((c or -1) for _, _, c in components(rows, 3, 85))


@pytest.mark.parametrize("looks", [0, 10**9])
def test_torn_bands_give_all_links(docs, monkeypatch, looks):
    """Several groups that share most words: their bands hold many components, some of them linked by one pair only."""
    monkeypatch.setattr(near_dedup, "LOOKS", looks)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rng = random.Random(11)
    base, rows = words(rng, 60), []
    for group in range(6):
        own = list(base)
        for i in range(2 + group * 2):
            own[(i * 7) % 60] = f"g{group}x{i}"
        for copy in range(8):
            text = list(own)
            for i in rng.sample(range(60), copy % 4):
                text[i] = f"c{group}x{copy}x{i}"
            rows.append((len(rows), " ".join(text)))
    rows += [(100 + i, " ".join(words(rng, 30))) for i in range(10)]
    want = components(rows, 3, 80)
    got = near_dedup.near_duplicates(docs(rows), size=3, threshold=80).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: least for k, _, least in want}


def test_one_stray_among_near_copies_is_compared_once_with_each(spark):
    member = F.concat(F.lit("c"), F.col("id")).cast("binary").alias("cls")
    labelled = spark.range(5001).select(F.lit(7).cast("long").alias("band"), member, F.when(F.col("id") == 9, F.lit(b"s")).otherwise(F.lit(b"p")).alias("part"))
    torn = near_dedup._torn(labelled)
    assert near_dedup._looks(torn) == (5001, 5001)
    odd = F.array(*[F.lit(0).cast("long")] * (near_dedup.BITS // 64))
    sketch = F.struct(odd.alias("odd"), F.lit(9).alias("samples"), F.lit(9).cast("long").alias("n_shingles"), F.array(F.lit(7).cast("long")).alias("bands"))
    sketched = labelled.select("cls", sketch.alias("sketch"))
    pairs = near_dedup._crossing(torn, labelled, sketched, 80).collect()
    assert len(pairs) == 5000 and all(b"c9" in (bytes(x), bytes(y)) for x, y in pairs)


def test_components_of_a_hub_with_many_edges(spark):
    edges = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    got = components_of(edges)
    assert got.count() == 3000 and got.select("component").distinct().collect()[0][0] == 0


@pytest.mark.parametrize("few", [0, 10**6])
def test_components_by_broadcast_and_by_shares(spark, monkeypatch, few):
    monkeypatch.setattr(components_module, "FEW", few)
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(500, 540)] + [(3, i) for i in range(600, 640)]
    edges = [(a, b) for a, b in edges if a != b]
    least = {x: x for e in edges for x in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = components_of(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == least


def test_a_step_of_few_edges_shuffles_little(spark, tmp_path):
    """Every shuffle leaves files of each of its tasks; with the nodes broadcast, only aggregations shuffle."""
    spark.range(1, 50).selectExpr("id + 1 as u", "id as v").write.parquet(str(tmp_path / "edges"))
    edges = spark.read.parquet(str(tmp_path / "edges"))
    steps = [components_module._small_star(components_module._large_star(edges, few), few) for few in (True, False)]
    broadcast, dealt = (step._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for step in steps)
    assert 2 * broadcast < dealt


def test_near_duplicates_leave_no_texts_in_the_shared_folder(spark, docs, monkeypatch):
    made = []
    monkeypatch.setattr(common, "settle", lambda df, f=common.settle: made.append(f(df)) or made[-1])
    near_dedup.near_duplicates(docs(corpus()), size=3, threshold=85).count()
    texts = [df for df in made if "text" in df.columns]
    assert texts and not any(os.path.exists(f.removeprefix("file:")) for df in texts for f in df.inputFiles())


def test_deduplicate_keeps_one(docs):
    rows = corpus()
    kept = near_dedup.deduplicate(docs(rows)).collect()
    want = {c for _, n, c in components(rows, 5, 80) if n and c is not None}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None and (r.text or "").split()) == sorted(want)
    assert [r.text for r in kept if r.doc_id is None] == ["nobody has this"]
    assert sum(not (r.text or "").split() for r in kept) == 3  # texts without words are no duplicates
    assert kept[0].__fields__ == ["doc_id", "text", "lang", "note"]


def test_empty_table(docs):
    assert near_dedup.near_duplicates(docs([])).count() == 0
    assert near_dedup.deduplicate(docs([])).count() == 0
    assert substring_dedup.repeated_passages(docs([])).count() == 0
    assert substring_dedup.cut_repeats(docs([])).count() == 0


def test_odd_sketches_keep_similar_and_drop_others(spark):
    rng = random.Random(1)
    rows = []
    for n in (40, 150, 600, 4000, 30000):
        for share in (0.4, 0.6, 0.7, 0.75, 0.85, 0.86, 0.9, 0.97):
            for _ in range(6):
                common_words, own = words(rng, int(n * share), 10**9), max(1, int(n * (1 - share) / 2))
                pair = []
                for _ in range(2):
                    found = near_dedup.shingles(" ".join(common_words + words(rng, own, 10**9)).encode(), 1)
                    _, _, odd, samples = near_dedup._sketch(found)
                    pair.append((odd.tolist(), samples, len(found)))
                rows.append((n, len(common_words) / (len(common_words) + 2 * own), *pair))
    kind = "struct<odd: array<long>, samples: int, n_shingles: long>"
    df = spark.createDataFrame(rows, f"n int, exact double, x {kind}, y {kind}")
    got = df.select("n", "exact", near_dedup._alike(85).alias("alike")).collect()
    assert all(r.alike for r in got if r.exact >= 0.85)
    assert not any(r.alike for r in got if r.exact < 0.71 and r.n >= 150)


# Passages


def planted():
    rng = random.Random(8)
    shared, fuzzy, short = words(rng, 70), words(rng, 90), words(rng, 40)
    changed = [w if i % 9 else f"e{i}" for i, w in enumerate(fuzzy)]
    del changed[31], changed[60]
    rows = [(i, " ".join(words(rng, 60) + shared + words(rng, 50))) for i in range(1, 7)]
    rows += [(10, " ".join(words(rng, 30) + fuzzy + words(rng, 30))), (11, " ".join(words(rng, 80) + changed + words(rng, 10)))]
    rows += [(i, " ".join(words(rng, 60) + short + words(rng, 60))) for i in (20, 21)]
    rows += [(30, rows[0][1]), (31, " ".join(short)), (32, " ".join(short)), (40, None), (41, ""), (42, "same " * 500), (43, " ".join(words(rng, 300))), (30, rows[0][1])]
    rows += [(50, " ".join(shared + words(rng, 20) + shared))]
    return rows, shared


def test_passages(docs):
    rows, shared = planted()
    got = substring_dedup.repeated_passages(docs(rows)).collect()
    groups = [{1, 2, 3, 4, 5, 6, 30, 50}, {10, 11}]
    assert {r.doc_id for r in got} | {r.other_id for r in got} == groups[0] | groups[1]
    assert all(any({r.doc_id, r.other_id} <= g for g in groups) for r in got)
    assert [(r.doc_id, r.other_id, r.start, r.end) for r in got if r.copy] == [(30, 1, 0, 180)]
    texts = {k: (t or "").split() for k, t in rows}
    for r in got:
        assert r.end - r.start >= 50 and r.equal >= 0.8 * (r.end - r.start)
        if not r.copy and r.doc_id in groups[0]:
            assert set(shared) <= set(texts[r.doc_id][max(0, r.start - 3) : r.end + 3])
    fuzzy = [r for r in got if r.doc_id in groups[1]]
    assert len(fuzzy) == 1 and {fuzzy[0].end - fuzzy[0].start, fuzzy[0].other_end - fuzzy[0].other_start} <= set(range(84, 94))


def test_cut_repeats(docs):
    rows, shared = planted()
    df = docs(rows).withColumn("n_chars", F.length("text").cast("long"))
    left = substring_dedup.cut_repeats(df).collect()
    texts = {r.doc_id: r.text for r in left}
    before = dict(rows)
    assert sum(" ".join(shared[3:-3]) in (t or "") for t in texts.values()) == 1
    assert 30 not in texts  # a copy of 1
    for k in (20, 21, 31, 32, 40, 41, 42, 43):
        assert texts[k] == before[k]
    assert sorted(len((texts[k] or "").split()) < len(before[k].split()) for k in (10, 11)) == [False, True]
    assert all(r.n_chars == len(r.text) for r in left if r.text is not None)


def test_no_plan_runs_python_twice(docs, monkeypatch):
    """A filter on a function's result was pushed below it and ran it again, in workers of its own."""
    plans = []

    def plan(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(substring_dedup, "settle", lambda df, f=common.settle: f(plan(df)))
    plan(substring_dedup.cut_repeats(docs(planted()[0])))
    assert any("ArrowEvalPython" in p for p in plans) and max(p.count("ArrowEvalPython") for p in plans) == 1


def test_chains_equal_trying_all(spark):
    rng = random.Random(6)
    for _ in range(150):
        anchors = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(rng.randint(1, 14))})
        best = {}
        for a, b in anchors:
            best[a, b] = 5 + max([0.0] + [best[x, y] - 0.3 * (a - x + b - y) for x, y in best if x < a and y < b])
        chain = substring_dedup.chains(anchors, 5, 0.3, 1000)[0]
        score = 5 * len(chain) - sum(0.3 * (c - a + d - b) for (a, b), (c, d) in zip(chain, chain[1:]))
        assert score == pytest.approx(max(best.values()))
        assert sorted(sum(substring_dedup.chains(anchors, 5, 0.3, 1000), [])) == anchors


def test_seeds_are_shared_by_equal_stretches():
    rng = random.Random(10)
    for _ in range(50):
        stretch = words(rng, 14)
        found = []
        for _ in range(2):
            text = " ".join(words(rng, rng.randint(20, 60)) + stretch + words(rng, rng.randint(20, 60)))
            found.append(set(substring_dedup.seeds(substring_dedup.word_hashes(text.encode()), 5, 10)[0].tolist()))
        assert found[0] & found[1]


@pytest.mark.parametrize("gaps", [(31, 31), (80, 80), (95, 95), (0, 60), (60, 0)])
def test_two_passages_of_one_pair(docs, gaps):
    """Two exact passages stand far enough apart that the stretch over both isn't similar."""
    rng = random.Random(sum(gaps))
    p, q = words(rng, 60, 10**9), words(rng, 60, 10**9)
    own = [(words(rng, 30, 10**9), words(rng, gap, 10**9), words(rng, 30, 10**9)) for gap in gaps]
    rows = [(i, " ".join([*a, *p, *b, *q, *c])) for i, (a, b, c) in enumerate(own)]
    got = substring_dedup.repeated_passages(docs(rows)).collect()
    cut = [g for g in got if not g.copy]
    of = own[cut[0].doc_id]
    covered = {i for g in cut for i in range(g.start, g.end)}
    at = 30 + 60 + len(of[1])
    assert covered >= {*range(30, 90), *range(at, at + 60)}
    left = next(r.text for r in substring_dedup.cut_repeats(docs(rows)).collect() if r.doc_id == cut[0].doc_id).split()
    assert not set(left) & {*p, *q}


def ordered(spark, texts):
    """The texts in the order in which passages are kept: by their hash."""
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return [r.text for r in df.orderBy(F.xxhash64(F.col("text").cast("binary"))).collect()]


def arranged(spark, make, want):
    """Variants of texts, made with different own words, until their order is the wanted one."""
    for seed in range(200):
        texts = make(random.Random(seed))
        if [texts.index(t) for t in ordered(spark, texts)] in want:
            return texts
    raise AssertionError("no variant in the wanted order")


def test_template_around_a_passage(spark, docs):
    """A heading and a footer of one text frame a passage of another: the frame alone is too short."""
    rng = random.Random(21)
    head, foot, body = words(rng, 30, 10**9), words(rng, 30, 10**9), words(rng, 60, 10**9)

    def make(own):
        a, b, c = (lambda n: words(own, n, 10**9)), words(own, 20, 10**9), words(own, 20, 10**9)
        return [" ".join(t) for t in (head + a(60) + foot + a(40), a(40) + body + a(40), b + head + body + foot + c)]

    texts = arranged(spark, make, ([0, 1, 2], [1, 0, 2]))
    got = substring_dedup.repeated_passages(docs(list(enumerate(texts)))).collect()
    assert [(r.doc_id, r.other_id) for r in got] == [(2, 1)]
    assert got[0].start <= 50 and got[0].end >= 110


def test_passage_whose_seeds_stand_in_earlier_texts(spark, docs):
    """Two texts that come first hold half a passage each; the two that hold all of it still meet."""
    rng = random.Random(33)
    p = words(rng, 60, 10**9)

    def make(own):
        parts = p[:30], p[25:], p, p
        return [" ".join(words(own, 30, 10**9) + part + words(own, 40, 10**9)) for part in parts]

    texts = arranged(spark, make, ([0, 1, 2, 3], [1, 0, 2, 3], [0, 1, 3, 2], [1, 0, 3, 2]))
    got = substring_dedup.repeated_passages(docs(list(enumerate(texts)))).collect()
    assert [{r.doc_id, r.other_id} for r in got] == [{2, 3}]
    assert got[0].start <= 30 and got[0].end >= 90
    left = {r.doc_id: r.text for r in substring_dedup.cut_repeats(docs(list(enumerate(texts)))).collect()}
    assert sum(not set(p) & set(t.split()) for t in left.values()) == 1


@pytest.mark.parametrize("framed", [False, True])
def test_changed_passage_whose_seeds_stand_in_earlier_texts(spark, docs, framed):
    """As above, with changed words, so that no long stretch is equal; framed: earlier texts have any two of its seeds near each other."""
    rng = random.Random(34)
    p = words(rng, 70, 10**9)
    q = [w if i % 12 != 11 else f"e{i}" for i, w in enumerate(p)]

    def make(own):
        gap = words(own, 30, 10**9)
        parts = [p[:40], p[30:]] + [p[:20] + gap + p[50:], p[18:62], p[20:32] + gap + p[60:]] * framed + [p, q]
        return [" ".join(words(own, 30, 10**9) + part + words(own, 40, 10**9)) for part in parts]

    n = 5 if framed else 2
    texts = arranged(spark, make, [[*first, *last] for first in permutations(range(n)) for last in ((n, n + 1), (n + 1, n))])
    got = substring_dedup.repeated_passages(docs(list(enumerate(texts)))).collect()
    assert [{r.doc_id, r.other_id} for r in got] == [{n, n + 1}]
    assert got[0].start <= 30 and got[0].end >= 97
    left = {r.doc_id: r.text for r in substring_dedup.cut_repeats(docs(list(enumerate(texts)))).collect()}
    assert sum(len(left[i].split()) <= 73 for i in (n, n + 1)) == 1


def test_changed_passage_at_places_that_seeds_have_again(spark, docs):
    """The first text has all seeds of the passage before it, in another order."""
    rng = random.Random(35)
    p = words(rng, 70, 10**9)
    q = [w if i % 12 != 11 else f"e{i}" for i, w in enumerate(p)]
    pieces = [p[i : i + 14] for i in range(0, 70, 5)]

    def make(own):
        before = [w for piece in reversed(pieces) for w in piece + words(own, 2, 10**9)]
        return [" ".join(before + words(own, 120, 10**9) + p + words(own, 30, 10**9)), " ".join(words(own, 30, 10**9) + q + words(own, 40, 10**9))]

    texts = arranged(spark, make, ([0, 1],))
    got = substring_dedup.repeated_passages(docs(list(enumerate(texts)))).collect()
    assert [(r.doc_id, r.other_id) for r in got] == [(1, 0)] and got[0].start <= 30 and got[0].end >= 97


def test_texts_that_only_share_a_run_of_a_word_do_not_meet(spark, docs, monkeypatch):
    """Each of them would meet every earlier one; the two that go on alike beside the run still do."""
    rng = random.Random(37)
    p = words(rng, 30, 10**9)
    rows = [(i, " ".join(words(rng, 40, 10**9) + ["that"] * 30 + words(rng, 40, 10**9))) for i in range(40)]
    rows += [(i, " ".join(words(rng, 40, 10**9) + ["that"] * 30 + [*p[:12], f"e{i}", *p[13:]] + words(rng, 40, 10**9))) for i in (50, 51)]
    settle, met = substring_dedup.settle, []

    def counted(df):
        out = settle(df)
        if out.columns == ["x", "y"]:
            met.append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "settle", counted)
    got = substring_dedup.repeated_passages(docs(rows)).collect()
    assert [{r.doc_id, r.other_id} for r in got] == [{50, 51}] and got[0].start <= 40 and got[0].end >= 100
    assert sum(met) <= 50


def test_thinned_runs():
    value, place = np.array([7, 5, 5, 5, 5, 5, 5, 5, 9, 5], np.uint64), np.array([1, 3, 4, 5, 6, 7, 8, 9, 12, 20])
    assert place[substring_dedup.thinned(value, place)].tolist() == [1, 3, 7, 9, 12, 20]
    hashes = np.array([1, 2, 3, 3, 3, 4], np.uint64)
    assert [x.tolist() for x in substring_dedup.runs(hashes)] == [[0, 1, 2, 2, 2, 5], [1, 2, 5, 5, 5, 6]]
    assert len(substring_dedup.beside(hashes, 2, 5, 24)) == 3 and substring_dedup.beside(np.array([3, 3, 3, 3, 1, 3, 3, 3], np.uint64), 5, 8, 24) is None


def test_neighbours_equal_trying_all():
    rng = random.Random(36)
    rules = substring_dedup.Passages()
    for size in (0, 1, 5, 60) * 20:
        place = np.array(sorted(rng.randrange(400) for _ in range(size)), np.int32)
        fit, open_ = (np.array([rng.random() < 0.3 for _ in range(size)], bool) for _ in range(2))
        i, j = substring_dedup.neighbours(place, fit, open_, rules)
        want = [(a, b) for a in range(size) for b in range(a, size) if 13 <= place[b] - place[a] <= 126 and (fit[a] or fit[b]) and open_[a : b + 1].any()]
        assert list(zip(i.tolist(), j.tolist())) == want


def test_grams_are_equal_for_equal_stretches():
    rng = random.Random(34)
    a, b = words(rng, 90), words(rng, 70)
    b[10:65] = a[31:86]
    x, y = (substring_dedup.grams(substring_dedup.word_hashes(" ".join(w).encode()), 50) for w in (a, b))
    assert len(x) == 41 and len(y) == 21
    assert {(int(i), int(j)) for i in range(41) for j in range(21) if x[i] == y[j]} == {(31 + k, 10 + k) for k in range(6)}


def test_bound_of_a_step_is_never_below_its_score():
    rng = random.Random(8)
    spared = 0
    for size in (3, 8, 30, 500) * 200:
        a, b = (np.array([rng.randrange(size) for _ in range(rng.randrange(1, 25))], np.uint64) for _ in range(2))
        score, most = substring_dedup._step(a.tobytes(), b.tobytes())[2], substring_dedup._at_most(a.tolist(), b.tolist())
        assert score <= most
        spared += most < 3
    assert spared > 300


def test_pairs_are_dealt_in_waves(spark, docs, monkeypatch):
    """What a step shuffles at once doesn't grow with its pairs, and the rows are the same."""
    rng = random.Random(41)
    p, line = words(rng, 70, 10**9), words(rng, 30, 10**9)
    rows = [(i, " ".join(words(rng, 30, 10**9) + line + words(rng, 40, 10**9) + p[:60] + words(rng, 10, 10**9))) for i in range(12)]
    rows += [(i, " ".join(words(rng, 30, 10**9) + p + words(rng, 20, 10**9))) for i in range(12, 15)]
    want = sorted(map(tuple, substring_dedup.repeated_passages(docs(rows)).collect()))
    dealt = []
    attach = substring_dedup.attach
    monkeypatch.setattr(substring_dedup, "attach", lambda pairs, *args: dealt.append(pairs.count()) or attach(pairs, *args))
    monkeypatch.setattr(substring_dedup, "WAVE_PAIRS", 30)
    monkeypatch.setattr(substring_dedup, "WAVE_CHAINED", 30)
    assert sorted(map(tuple, substring_dedup.repeated_passages(docs(rows)).collect())) == want and len(want) >= 14
    assert max(dealt) <= 60 and sum(dealt) > 80  # a text's pairs stay together


def test_shuffle_files_go_when_their_plan_is_done(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}

    others = shuffled()
    common.settle(spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).count())
    made = shuffled() - others
    until = time.time() + 30
    while made & shuffled() and time.time() < until:
        common.sweep(spark)
        time.sleep(0.5)
    assert made and not made & shuffled()
