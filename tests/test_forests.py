"""Trees against searching every cut, and forests of groups against growing each by itself."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationweave.operators import forests, trees
from stationweave.operators.forests import apply_forest, apply_forests, fill_forests, fit_forests
from stationweave.operators.trees import ForestSpec, grow, grow_forest


def error(y, w):
    mean = (y * w[:, None]).sum(0) / w.sum()
    return (w[:, None] * (y - mean) ** 2).sum()


def by_hand(x, y, w, depth, least, level=0):
    """The cut with the least squared error left, over all features and all neighbouring values."""
    value = (y * w[:, None]).sum(0) / w.sum()
    if len({tuple(r) for r in y}) == 1 or len(y) < 2 or level == depth:
        return value
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:]):
            left = x[:, f] <= (a + b) / 2
            if min(left.sum(), (~left).sum()) >= least:
                e = error(y[left], w[left]) + error(y[~left], w[~left])
                if best is None or e < best[0] - 1e-9:
                    best = e, f, (a + b) / 2
    if best is None:
        return value
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], *(by_hand(x[s], y[s], w[s], depth, least, level + 1) for s in (left, ~left))


def down(tree, row):
    while len(tree) == 4 and isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("n, features, targets, depth, least", [(1, 1, 1, None, 1), (40, 2, 1, None, 1), (90, 3, 2, None, 1), (90, 2, 3, 3, 1), (80, 2, 1, None, 7)])
def test_best_cuts(n, features, targets, depth, least):
    rng = np.random.default_rng(n + depth if depth else n)
    x, y = rng.integers(0, 9, (n, features)).astype(float), rng.normal(size=(n, targets))
    spec = ForestSpec("random_forest", max_depth=depth, min_samples_leaf=least)
    bags = [(np.arange(n), np.ones(n))] + [(np.flatnonzero(k), k[k > 0]) for k in (np.bincount(rng.integers(0, n, n), minlength=n) for _ in range(3))]
    for tree, (rows, weights) in zip(grow(x, y, spec, bags, [1, 2, 3, 4]), bags):
        want = by_hand(x[rows], y[rows], weights.astype(float), depth, least)
        assert tree.predict(x[rows]) == pytest.approx(np.array([down(want, r) for r in x[rows]]))


def test_random_cuts():
    """One cut a feature between the node's least and greatest value, wherever it falls; the best feature of these is cut."""
    rng = np.random.default_rng(3)
    n = 300
    x, y = rng.normal(size=(n, 3)), rng.normal(size=(n, 2))
    spec = ForestSpec("extra_trees")
    grown = grow(x, y, spec, [(np.arange(n), np.ones(n))] * 400, range(400))
    shares = []
    for tree in grown:
        f, cut = tree.feature[0], tree.cut[0]
        shares.append((cut - x[:, f].min()) / np.ptp(x[:, f]))
        assert tree.predict(x) == pytest.approx(y)  # grown to the end
    assert 0 <= min(shares) < 0.1 and 0.9 < max(shares) <= 1 and len(set(shares)) > 390
    paths = trees._mixed(np.arange(400, dtype=np.uint64))
    for i, tree in enumerate(grown[:50]):
        cuts = [x[:, f].min() + np.ptp(x[:, f]) * trees._uniform(paths[i : i + 1], f)[0] for f in range(3)]
        left = [x[:, f] <= c for f, c in enumerate(cuts)]
        errors = [error(y[s], np.ones(s.sum())) + error(y[~s], np.ones((~s).sum())) for s in left]
        assert tree.feature[0] == int(np.argmin(errors)) and tree.cut[0] == pytest.approx(cuts[tree.feature[0]])


def test_numbers_of_a_path_are_even():
    u = np.concatenate([trees._uniform(trees._mixed(np.arange(20_000, dtype=np.uint64)), k) for k in range(3)])
    assert abs(np.histogram(u, 20, (0, 1))[0] / len(u) - 0.05).max() < 0.004 and abs(np.corrcoef(u[:20_000], u[20_000:40_000])[0, 1]) < 0.03


def test_few_features_a_node():
    rng = np.random.default_rng(1)
    x, y = np.column_stack([np.ones(200), rng.normal(size=(200, 4))]), rng.normal(size=(200, 1))
    for kind in trees.KINDS:
        found = grow_forest(x, y, ForestSpec(kind, max_features=1), range(60))
        roots = np.bincount([t.feature[0] for t in found], minlength=5)
        assert roots[0] == 0 and (roots[1:] > 4).all()  # a constant one can't be looked at, the others get their turn
    assert [ForestSpec("extra_trees", max_features=m).features(9) for m in (None, 1.0, 0.5, 2, 99, "sqrt", "log2")] == [9, 9, 4, 2, 9, 3, 3]


def rows_of(spark, groups, partitions=3):
    rows = [(k, [float(v) for v in a], [float(v) for v in b]) for k, (x, y) in groups.items() for a, b in zip(x, y)]
    return spark.createDataFrame(rows, "key string, x array<double>, y array<double>").repartition(partitions).persist()


def test_groups_are_fitted_as_if_alone(spark, monkeypatch):
    rng = np.random.default_rng(2)
    groups = {k: (rng.normal(size=(n, f)), rng.normal(size=(n, 2))) for k, n, f in (("a", 150, 2), ("b", 1, 1), ("ü", 60, 3), ("", 40, 2))}
    specs = [ForestSpec("random_forest", 9), ForestSpec("extra_trees", 5, 7, max_depth=4)]
    rows = rows_of(spark, groups)
    monkeypatch.setattr(forests, "BLOCK_ROWS", 25)  # several blocks and shares
    found = fit_forests(rows, specs)
    assert found.groupBy("key", "fit").count().count() == 8 and found.count() == 4 * 14
    asked = rows.unionByName(spark.createDataFrame([("none", [1.0], [2.0, 3.0])], rows.schema)).persist()
    got = apply_forests(asked, found, specs, 2).collect()
    assert len(got) == 252 and [r.predictions for r in got if r.key == "none"] == [None]
    for r in got:
        if r.key != "none":
            x, y = groups[r.key]
            want = np.concatenate([np.mean([t.predict(np.array([r.x])) for t in _alone(r.key, x, y, s)], 0)[0] for s in specs])
            assert r.predictions == pytest.approx(list(want))
    one = rows.where("key = 'a'")
    mine = found.where("key = 'a'")
    small = {tuple(r.x): r.p for r in apply_forest(one, mine, specs, 2, out="p").collect()}
    monkeypatch.setattr(forests, "BROADCAST_BYTES", 0)
    large = {tuple(r.x): r.p for r in apply_forest(one, mine, specs, 2, out="p").collect()}
    assert small.keys() == large.keys() and all(small[k] == pytest.approx(large[k]) for k in small)
    again = fit_forests(rows_of(spark, {"a": groups["a"]}, 7), specs)
    assert {(r.fit, r.tree, tuple(r.cut)) for r in again.collect()} == {(r.fit, r.tree, tuple(r.cut)) for r in mine.collect()}


_GROWN: dict = {}


def _alone(key, x, y, spec):
    if (key, spec) not in _GROWN:
        _GROWN[key, spec] = grow_forest(x, y, spec, range(spec.n_estimators), crc32(key.encode()))
    return _GROWN[key, spec]


def test_large_group_is_drawn_by_tree(spark):
    """Beyond max_rows every tree has rows of its own, and together they see the group."""
    n = 3000
    x = np.arange(n, dtype=float)[:, None]
    rows = rows_of(spark, {"hot": (x, x * 2), "small": (x[:50], x[:50])})
    spec = ForestSpec("extra_trees", 20, max_rows=300)
    found = fit_forests(rows, [spec])
    sizes = {}
    for r in found.collect():
        sizes.setdefault(r.key, []).append(sum(f < 0 for f in r.feature))
    assert sizes["small"] == [50] * 20 and len(sizes["hot"]) == 20 and all(200 < s < 400 for s in sizes["hot"])
    got = apply_forests(rows.where("key = 'hot'"), found, [spec], 1).select(F.max(F.abs(F.get("predictions", F.lit(0)) - F.get("y", F.lit(0))))).first()[0]
    assert got < 60


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([], "key string, x array<double>, y array<double>")
    found = fit_forests(empty, [ForestSpec("extra_trees")])
    assert found.count() == 0 and apply_forests(empty, found, [ForestSpec("extra_trees")], 1).count() == 0


def test_filling_equals_fitting_and_applying(spark, monkeypatch):
    """Small groups meet their rows without a stored model, large ones by packs of trees; the values are the same."""
    rng = np.random.default_rng(8)
    groups = {k: (rng.normal(size=(n, 2)), rng.normal(size=(n, 2))) for k, n in (("a", 150), ("b", 1), ("ü", 400), ("unasked", 30))}
    specs = [ForestSpec("random_forest", 9), ForestSpec("extra_trees", 5, 7, max_depth=4)]
    known = rows_of(spark, groups)
    asked = known.where("key <> 'unasked'").unionByName(spark.createDataFrame([("none", [1.0, 2.0], [2.0, 3.0])], known.schema)).persist()
    monkeypatch.setattr(forests, "TASK_ROWS", 200 * 14)
    want = {(r.key, *r.x): r.predictions for r in apply_forests(asked, fit_forests(known, specs), specs, 2).collect()}
    for least in (1000, 0):  # two of three groups, then none of them in one task
        monkeypatch.setattr(forests, "LEAST_ROWS", least or 1)
        monkeypatch.setattr(forests, "BLOCK_ROWS", least or 25)
        monkeypatch.setattr(forests, "PACK_BYTES", 20_000)
        filled, stored = fill_forests(known, asked, specs, 2)
        got = {(r.key, *r.x): r.predictions for r in filled.collect()}
        assert got.keys() == want.keys() and len(got) == 552 and got["none", 1.0, 2.0] is None
        assert all(v is None or v == pytest.approx(want[k]) for k, v in got.items())
        assert len(stored) == 2


def test_no_model_is_stored_for_small_groups(spark):
    x = np.arange(40, dtype=float)[:, None]
    known = rows_of(spark, {f"s{i}": (x, x) for i in range(5)})
    filled, stored = fill_forests(known, known, [ForestSpec("random_forest", 3)], 1)
    assert filled.count() == 200 and len(stored) == 1 and "feature" not in stored[0].columns


def test_rows_go_to_few_packs_of_trees(spark, monkeypatch):
    """A row of a group with many shares goes to as many tasks as the model has packs, not to one for each share."""
    x = np.arange(2000, dtype=float)[:, None]
    rows = rows_of(spark, {"hot": (x, x)})
    spec = ForestSpec("extra_trees", 20, max_rows=300)
    found = fit_forests(rows, [spec])
    assert found.select("share").distinct().count() == 20
    dealt, spread = [], forests._spread
    monkeypatch.setattr(forests, "_spread", lambda side, *args: dealt.append(side) or spread(side, *args))
    for size, packs in ((forests.PACK_BYTES, 1), (50_000, 7)):
        monkeypatch.setattr(forests, "PACK_BYTES", size)
        dealt.clear()
        assert apply_forests(rows, found, [spec], 1).where("predictions is not null").count() == 2000
        assert dealt[0].count() <= 2000 * packs


def test_trees_see_all_rows_of_a_large_group(spark):
    """Without max_rows a tree is fitted on every row of its group, however many there are, also where it is applied at once."""
    n = 60_000
    row = F.col("id").cast("double")
    rows = spark.range(n).select(F.lit("hot").alias("key"), F.array(row).alias("x"), F.array(row * 2).alias("y")).persist()
    spec = ForestSpec("extra_trees", 2)
    found = fit_forests(rows, [spec])
    assert [sum(f < 0 for f in r.feature) for r in found.collect()] == [n, n]
    filled, _ = fill_forests(rows, rows.where("x[0] >= 100 and x[0] < 400"), [spec], 1)
    got = {r.x[0]: r.predictions for r in filled.collect()}
    assert got == {float(k): [2.0 * k] for k in range(100, 400)}


def test_a_bound_holds_for_its_own_spec(spark):
    n = 2000
    x = np.arange(n, dtype=float)[:, None]
    rows = rows_of(spark, {"hot": (x, x), "small": (x[:50], x[:50])})
    found = fit_forests(rows, [ForestSpec("extra_trees", 3, max_rows=200), ForestSpec("extra_trees", 2), ForestSpec("extra_trees", 1, max_rows=200)])
    leaves = {(r.key, r.fit, r.tree): sum(f < 0 for f in r.feature) for r in found.collect()}
    assert len(leaves) == 12 and {k[1] for k, v in leaves.items() if v == n} == {1}
    assert all(v == 50 for k, v in leaves.items() if k[0] == "small") and all(100 < v < 300 for k, v in leaves.items() if k[0] == "hot" and k[1] != 1)


def test_cuts_by_values_and_by_places_are_equal():
    """Nodes with fewer values than copies are cut by counts of values, others by sorted copies; a feature's values don't change the tree."""
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(0, 4, 300), rng.normal(size=300).round(1), rng.integers(0, 40, 300)]).astype(float)
    y = rng.normal(size=(300, 2)).round(1)
    for spec in (ForestSpec("random_forest", 6), ForestSpec("random_forest", 6, min_samples_leaf=4), ForestSpec("random_forest", 6, max_features=2)):
        by_both = grow_forest(x, y, spec, range(6))
        rows = [trees._Level._best_of_values, trees._Level._best_of_places]
        for one in rows:
            trees._Level._best_of_values = trees._Level._best_of_places = one
            try:
                alone = grow_forest(x, y, spec, range(6))
            finally:
                trees._Level._best_of_values, trees._Level._best_of_places = rows
            assert all((a.feature == b.feature).all() and (a.cut == b.cut).all() and a.value == pytest.approx(b.value) for a, b in zip(by_both, alone))


def test_many_trees_take_few_passes(monkeypatch):
    """A level of all trees is sorted once for its children and once for each feature with many values, not once a feature and more."""
    sorts = []
    one = trees._Copies.sorted
    monkeypatch.setattr(trees._Copies, "sorted", lambda self, node, copy: sorts.append(len(copy)) or one(self, node, copy))
    rng = np.random.default_rng(6)
    x, y = np.column_stack([rng.normal(size=500), rng.integers(0, 9, 500)]), rng.normal(size=(500, 1))
    grown = grow_forest(x, y, ForestSpec("random_forest", 40), range(40))
    most = max(sum(1 for _ in _depths(t)) for t in grown)
    assert sum(sorts) < 1.6 * 40 * 320 * most and len(sorts) < 3 * most


def _depths(tree):
    """The levels of a tree."""
    nodes = [0]
    while nodes:
        yield len(nodes)
        nodes = [c for n in nodes if tree.feature[n] >= 0 for c in (tree.left[n], tree.left[n] + 1)]
