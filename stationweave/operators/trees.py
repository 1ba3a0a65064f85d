"""Regression trees on arrays: best cuts or random cuts, several targets, many trees grown together.

All trees of a call grow level by level, so the work of a level is a few passes over arrays, however
many nodes it has. A random number belongs to a tree, a node's path and a feature, so a tree is the
same whatever trees it grows with.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields
from math import log2
from typing import Any

import numpy as np

# Names and default parameters of the built-in forests.
KINDS = ("random_forest", "extra_trees")
TREES, SEED = 100, 42

# Parameters that steer threads and logging only.
_WITHOUT_EFFECT = {"n_jobs", "verbose"}


@dataclass(frozen=True)
class ForestSpec:
    """A forest under the usual parameter names.

    `max_rows`, where given, bounds the rows that one tree of one group is fitted on; of a larger group every tree
    draws that many of its own. Without it a tree is fitted on all rows of its group.
    """

    kind: str
    n_estimators: int = TREES
    random_state: int = SEED
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    max_features: Any = None
    max_samples: Any = None
    bootstrap: bool | None = None
    max_rows: int | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown forest {self.kind!r}")
        if (self.max_depth is not None and self.max_depth < 1) or min(self.n_estimators, self.min_samples_leaf, 1 if self.max_rows is None else self.max_rows) < 1 or self.min_samples_split < 2:
            raise ValueError("trees, depth, leaves and rows are at least 1, rows to split at least 2")
        self.features(1)

    @classmethod
    def of(cls, kind: str, params: dict[str, Any] | None = None) -> ForestSpec:
        given = {k: v for k, v in (params or {}).items() if k not in _WITHOUT_EFFECT}
        unknown = set(given) - {f.name for f in fields(cls)} | ({"kind"} & set(given))
        if unknown:
            raise ValueError("unsupported forest parameters: " + ", ".join(sorted(unknown)))
        seed = given.get("random_state", SEED)
        given["random_state"] = int(seed[0] if isinstance(seed, (list, tuple)) else SEED if seed is None else seed)
        return cls(kind, **given)

    @property
    def draws(self) -> bool:
        """Whether a tree draws its rows with replacement."""
        return self.kind == "random_forest" if self.bootstrap is None else self.bootstrap

    def features(self, n: int) -> int:
        """How many features a node looks at."""
        m = self.max_features
        if m in (None, "auto", "all"):
            return n
        if m in ("sqrt", "log2"):
            return max(1, int(n**0.5 if m == "sqrt" else log2(n)))
        if isinstance(m, bool) or not isinstance(m, (int, float)) or m <= 0 or (isinstance(m, float) and m > 1):
            raise ValueError(f"max_features is {m!r}")
        return min(n, m) if isinstance(m, int) else max(1, int(m * n))

    def sample(self, n: int) -> int:
        """How many of n rows a tree draws."""
        if self.max_samples is None:
            return n
        return min(n, self.max_samples) if isinstance(self.max_samples, int) else max(1, round(n * self.max_samples))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Each 64-bit number spread over all its bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def _uniform(paths: np.ndarray, use: int) -> np.ndarray:
    """A number in [0, 1) for each node path and use."""
    with np.errstate(over="ignore"):
        return (_mixed(paths + np.uint64(0x9E3779B97F4A7C15) * np.uint64(use + 1)) >> np.uint64(11)).astype(np.float64) / (1 << 53)


@dataclass
class Tree:
    """Nodes from the root on: the feature (-1 in a leaf), the cut up to which rows go left, the left child, before the right one, and a leaf's values."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray, roots: np.ndarray | None = None) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if roots is None else roots.copy()
        rows = np.arange(len(x))
        while True:
            feature = self.feature[at[rows]]
            inner = feature >= 0
            if not inner.any():
                return self.value[at]
            rows, feature = rows[inner], feature[inner]
            node = at[rows]
            at[rows] = self.left[node] + (x[rows, feature] > self.cut[node])


def predict_sum(trees: Sequence[Tree], x: np.ndarray) -> np.ndarray:
    """Sums of the trees' values for each row; many small trees go down together."""
    total = np.zeros((len(x), trees[0].value.shape[1]))
    step = max(1, TOGETHER // max(1, len(x)))
    for start in range(0, len(trees), step):
        some = trees[start : start + step]
        sizes = np.array([len(t.feature) for t in some])
        roots = np.cumsum(sizes) - sizes
        shifted = [t.left + root for t, root in zip(some, roots)]
        forest = Tree(*(np.concatenate(c) for c in ([t.feature for t in some], [t.cut for t in some], shifted, [t.value for t in some])))
        total += forest.predict(np.tile(x, (len(some), 1)), np.repeat(roots, len(x))).reshape(len(some), len(x), -1).sum(0)
    return total


class _Copies:
    """The rows of all bags, bag by bag, in the order of the first feature: of each its weight, its targets, its rank in every
    feature, and its place in the order of every other one. What a level sorts are such places, beside their nodes in one number."""

    def __init__(self, ranked: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bags: Sequence[tuple[np.ndarray, np.ndarray]]):
        row = np.concatenate([b[0] for b in bags])
        bag = np.repeat(np.arange(len(bags)) * np.int64(len(y)), [len(b[0]) for b in bags])
        self.n = len(row)
        self.bits = int(self.n).bit_length()
        self.values, ranks = zip(*ranked)
        order = self.sorted(bag + ranks[0][row], np.arange(self.n))[0]
        row = row[order]
        self.weight = np.concatenate([b[1] for b in bags])[order].astype(np.float64)
        self.own = [y[row, t] for t in range(y.shape[1])]
        self.ranks = np.concatenate([rank[row] for rank in ranks])
        self.order, self.place = [None], [None]
        for f in range(1, len(ranks)):
            order = self.sorted(bag + self.rank(f), np.arange(self.n))[0].astype(np.int32)
            place = np.empty(self.n, np.int32)
            place[order] = np.arange(self.n, dtype=np.int32)
            self.order.append(order)
            self.place.append(place)

    def rank(self, feature: int) -> np.ndarray:
        return self.ranks[feature * self.n : (feature + 1) * self.n]

    def sorted(self, node: np.ndarray, copy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """copies by node and then by themselves, and their nodes. Numbers are sorted faster than places of numbers."""
        packed = (node << self.bits) | copy
        packed.sort()
        return packed & np.int64((1 << self.bits) - 1), packed >> self.bits


@dataclass
class _Cuts:
    """A cut of each node by one feature: the error it saves (-inf: there is none), the feature's value and rank up to which copies go left, and these copies' number, mass and sums."""

    gain: np.ndarray
    cut: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    mass: np.ndarray
    sums: np.ndarray

    @classmethod
    def none(cls, n: int, targets: int) -> _Cuts:
        return cls(np.full(n, -np.inf), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros((n, targets)))

    def put(self, nodes: np.ndarray, gain: np.ndarray, cut: np.ndarray, rank: np.ndarray, count: np.ndarray, mass: np.ndarray, sums: np.ndarray) -> None:
        self.gain[nodes], self.cut[nodes], self.rank[nodes], self.count[nodes], self.mass[nodes], self.sums[nodes] = gain, cut, rank, count, mass, sums


def _middle(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    middle = low / 2 + high / 2
    return np.where(middle < high, middle, low)


class _Level:
    """The copies in the nodes of a level that are cut, node by node, in the order of the first feature."""

    def __init__(self, copies: _Copies, copy: np.ndarray, count: np.ndarray, mass: np.ndarray, sums: np.ndarray, scale: np.ndarray):
        self.copies, self.copy, self.count, self.mass, self.sums, self.scale = copies, copy, count, mass, sums, scale
        self.first = np.cumsum(count) - count
        self.node = np.repeat(np.arange(len(count)), count)
        self.weight = copies.weight.take(copy)
        self.mean = sums / mass[:, None]
        # From a node's own mean, its sums end at zero.
        self.wy = [(own.take(copy) - np.repeat(self.mean[:, t], count)) * self.weight for t, own in enumerate(copies.own)]
        self.level = (sums * sums).sum(1) / mass

    def gain(self, mass: np.ndarray, sums: Sequence[np.ndarray], rest: np.ndarray) -> np.ndarray:
        """What a cut takes off the squared errors of all targets together, as a share of the node's mass, by mass and sums on the left."""
        return sum(s * s for s in sums) / (mass * rest)

    def nearly(self, top: np.ndarray) -> np.ndarray:
        """A little below the largest gain. Sums differ in their last digits with what is summed beside them; the first cut of equal ones counts."""
        return top - 1e-9 * (np.abs(top + self.level) + self.scale)

    def _found(self, out: _Cuts, nodes: np.ndarray, gain: np.ndarray, feature: int, rank: np.ndarray, next_rank: np.ndarray, count: np.ndarray, mass: np.ndarray, sums: Sequence[np.ndarray]) -> None:
        values = self.copies.values[feature]
        own = np.stack(sums, 1) + mass[:, None] * self.mean[nodes]
        out.put(nodes, gain * self.mass[nodes], _middle(values[rank], values[next_rank]), rank, count, mass, own)

    def best_cut(self, feature: int, least: int) -> _Cuts:
        """The cut of each node between neighbouring values that saves most."""
        out = _Cuts.none(len(self.count), len(self.wy))
        if len(self.count) * len(self.copies.values[feature]) <= len(self.copy):
            self._best_of_values(out, feature, least)
        else:
            self._best_of_places(out, feature, least)
        return out

    def _best_of_places(self, out: _Cuts, feature: int, least: int) -> None:
        c = self.copies
        if feature:
            at = c.order[feature].take(c.sorted(self.node, c.place[feature].take(self.copy))[0])
            weight = c.weight.take(at)
            wy = [(own.take(at) - np.repeat(self.mean[:, t], self.count)) * weight for t, own in enumerate(c.own)]
        else:
            at, weight, wy = self.copy, self.weight, self.wy
        rank = c.rank(feature).take(at)
        # Places behind which a cut may lie; the last copy of a node and those of equal values aren't.
        fits = rank[1:] != rank[:-1]
        fits[self.first[1:] - 1] = False
        if least > 1:
            before = np.arange(1, len(rank)) - np.repeat(self.first, self.count)[:-1]
            fits &= (before >= least) & (np.repeat(self.count, self.count)[:-1] - before >= least)
        places = np.flatnonzero(fits)
        if not len(places):
            return
        node = self.node.take(places)
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        there, many = node[starts], np.diff(starts, append=len(node))
        first = self.first[there]
        total = np.cumsum(weight)
        before = total[first] - weight[first]
        total = total.take(places)
        mass, rest = total - np.repeat(before, many), np.repeat(before + self.mass[there], many) - total
        # The nodes before end a little off zero.
        sums = [total.take(places) - np.repeat(total[first] - v[first], many) for v, total in ((v, np.cumsum(v)) for v in wy)]
        gain = self.gain(mass, sums, rest)
        top = np.maximum.reduceat(gain, starts)
        good = np.flatnonzero(gain >= np.repeat(self._least(top, there), many))
        node = node.take(good)
        good = good[np.concatenate([[True], node[1:] != node[:-1]])]
        i = places[good]
        self._found(out, there, top, feature, rank[i], rank[i + 1], i + 1 - first, mass[good], [s[good] for s in sums])

    def _best_of_values(self, out: _Cuts, feature: int, least: int) -> None:
        """As _best_of_places, if there are fewer values in all nodes than copies: these needn't be sorted."""
        n, k = len(self.count), len(self.copies.values[feature])
        key = self.copies.rank(feature).take(self.copy) + np.repeat(np.arange(n) * k, self.count)
        count = np.bincount(key, minlength=n * k).reshape(n, k)
        here, column = count > 0, np.arange(k)
        before = np.cumsum(count, 1)
        fits = here & (before >= least) & (self.count[:, None] - before >= max(1, least))
        mass = np.cumsum(np.bincount(key, self.weight, n * k).reshape(n, k), 1)
        sums = [np.cumsum(np.bincount(key, v, n * k).reshape(n, k), 1) for v in self.wy]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, self.gain(mass, sums, self.mass[:, None] - mass), -np.inf)
        top = gain.max(1)
        there = np.flatnonzero(top > -np.inf)
        gain, top = gain[there], top[there]
        rank = (gain >= self._least(top, there)[:, None]).argmax(1)
        after = np.where(here[there] & (column > rank[:, None]), column, k).min(1)
        self._found(out, there, top, feature, rank, after, before[there, rank], mass[there, rank], [s[there, rank] for s in sums])

    def _least(self, top: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """nearly() for gains that are shares of the mass of some nodes."""
        return top - 1e-9 * (np.abs(top * self.mass[nodes] + self.level[nodes]) + self.scale[nodes]) / self.mass[nodes]

    def random_cut(self, feature: int, paths: np.ndarray, least: int) -> _Cuts:
        """A cut of each node anywhere between its least and greatest value."""
        c, n = self.copies, len(self.count)
        rank = c.rank(feature).take(self.copy)
        low, high = (c.values[feature][end(rank, self.first)] for end in (np.minimum.reduceat, np.maximum.reduceat))
        u = _uniform(paths, feature)
        cut = low * (1 - u) + high * u
        cut = np.where(cut < high, cut, low)
        upto = np.searchsorted(c.values[feature], cut, "right") - 1
        left = rank <= np.repeat(upto, self.count)
        mass, sums = np.bincount(self.node, self.weight * left, n), [np.bincount(self.node, wy * left, n) for wy in self.wy]
        count = np.bincount(self.node, left, n).astype(np.int64)
        there = np.flatnonzero((low < high) & (count >= least) & (self.count - count >= least))
        out = _Cuts.none(n, len(sums))
        gain = self.gain(mass[there], [s[there] for s in sums], self.mass[there] - mass[there]) * self.mass[there]
        own = np.stack(sums, 1) + mass[:, None] * self.mean
        out.put(there, gain, cut[there], upto[there], count[there], mass[there], own[there])
        return out


def _mixed_values(own: Sequence[np.ndarray], count: np.ndarray, n: int) -> np.ndarray:
    """Which nodes have copies with different targets, for targets node by node."""
    out, last = np.zeros(n, bool), np.cumsum(count)[:-1] - 1
    for y in own:
        differs = y[1:] != y[:-1]
        differs[last] = False
        out |= np.logical_or.reduceat(np.append(differs, False), np.append(0, last + 1))
    return out


def _ranked(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(values, rank of each row's) of each feature."""
    found = (np.unique(x[:, f], return_inverse=True) for f in range(x.shape[1]))
    return [(values, rank.astype(np.int32)) for values, rank in found]


def grow(x: np.ndarray, y: np.ndarray, spec: ForestSpec, bags: Sequence[tuple[np.ndarray, np.ndarray]], seeds: Sequence[int]) -> list[Tree]:
    """One tree for each bag of (row numbers, weights)."""
    middle, scale = _middles(y)
    return _grow(_ranked(x), y - middle, spec, bags, seeds, np.tile(middle, (len(bags), 1)), np.full(len(bags), scale))


def _middles(y: np.ndarray) -> tuple[np.ndarray, float]:
    """The means of targets, and their mean square from there."""
    middle = y.mean(0)
    return middle, float(((y - middle) ** 2).sum(1).mean())


def _grow(ranked: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, spec: ForestSpec, bags: Sequence[tuple[np.ndarray, np.ndarray]], seeds: Sequence[int], middle: np.ndarray, scale: np.ndarray) -> list[Tree]:
    """One tree for each bag of rows, which may be from several groups. y is counted from the group's means, so that sums of squares
    keep their digits; middle and scale have these means and the mean square for each bag."""
    n_features, targets = len(ranked), y.shape[1]
    copies = _Copies(ranked, y, bags)
    copy, count = np.arange(copies.n), np.array([len(b[0]) for b in bags])
    bag = np.repeat(np.arange(len(bags)), count)
    mass = np.bincount(bag, copies.weight, len(bags))
    sums = np.stack([np.bincount(bag, copies.weight * own, len(bags)) for own in copies.own], 1)
    tree, paths = np.arange(len(bags)), _mixed(np.array(seeds, np.uint64))
    looked_at = spec.features(n_features)
    leaf = np.empty(copies.n, np.int64)
    made, depth, nodes = 0, 0, []
    while len(tree):
        n = len(tree)
        split = count >= max(spec.min_samples_split, 2 * spec.min_samples_leaf)
        if spec.max_depth is not None and depth >= spec.max_depth:
            split[:] = False
        if split.any():
            split &= _mixed_values([own.take(copy) for own in copies.own], count, n)
        feature, cut, left = np.full(n, -1, np.int32), np.zeros(n), np.full(n, -1, np.int64)
        if split.any():
            tried, level = np.flatnonzero(split), _Level(copies, _in(copy, split, count), count[split], mass[split], sums[split], scale[tree[split]])
            if spec.kind == "extra_trees":
                found = [level.random_cut(f, paths[split], spec.min_samples_leaf) for f in range(n_features)]
            else:
                found = [level.best_cut(f, spec.min_samples_leaf) for f in range(n_features)]
            gains = np.stack([c.gain for c in found])
            if looked_at < n_features:
                # A feature that can't be cut doesn't count as looked at.
                turn = np.stack([_uniform(paths[split], n_features + f) for f in range(n_features)])
                turn[gains == -np.inf] = 2
                gains[np.argsort(np.argsort(turn, 0), 0) >= looked_at] = -np.inf
            top = gains.max(0)
            good = top > -np.inf
            best = (gains >= level.nearly(np.where(good, top, 0.0))).argmax(0)
            split[tried] = good
            chosen = best[good], np.flatnonzero(good)
            of = {c: np.stack([getattr(f, c) for f in found])[chosen] for c in ("cut", "rank", "count", "mass", "sums")}
            feature[split], cut[split] = chosen[0], of["cut"]
            left[split] = made + n + 2 * np.arange(len(chosen[0]))
        nodes.append((tree, feature, cut, left))
        if not split.all():
            ends = np.flatnonzero(~split)
            leaf[_in(copy, ~split, count)] = np.repeat(made + ends, count[ends])
        made, depth = made + n, depth + 1
        if not split.any():
            break

        copy, whole = (level.copy if good.all() else _in(level.copy, good, level.count)), count[split]
        at = np.repeat(chosen[0] * copies.n, whole) + copy
        child = np.repeat(2 * np.arange(len(whole)), whole) + (copies.ranks.take(at) > np.repeat(of["rank"], whole))
        # Copies keep their order on each side.
        copy = copies.sorted(child, copy)[0]
        count, mass, sums = (_both(of[c], c_[split]) for c, c_ in (("count", count), ("mass", mass), ("sums", sums)))
        tree = np.repeat(tree[split], 2)
        with np.errstate(over="ignore"):
            paths = _mixed(np.repeat(paths[split], 2) * np.uint64(2) + np.tile(np.array([1, 2], np.uint64), len(whole)))
    mass = np.bincount(leaf, copies.weight, made)
    with np.errstate(invalid="ignore"):
        value = np.stack([np.bincount(leaf, copies.weight * own, made) / mass for own in copies.own], 1)
    owner, feature, cut, left = (np.concatenate(parts) for parts in zip(*nodes))
    value = np.where(feature[:, None] < 0, value + middle[owner], 0.0)
    # Nodes tree by tree; a child's place is counted within its tree.
    order, sizes = np.argsort(owner, kind="stable"), np.bincount(owner, minlength=len(bags))
    ends = np.cumsum(sizes)
    within = np.empty(len(owner), np.int64)
    within[order] = np.arange(len(owner)) - np.repeat(ends - sizes, sizes)
    feature, cut, value, left = feature[order], cut[order], value[order], left[order]
    left = np.where(feature >= 0, within[left], -1)
    return [Tree(feature[a:b], cut[a:b], left[a:b], value[a:b].reshape(b - a, targets)) for a, b in zip(ends - sizes, ends)]


def _in(copy: np.ndarray, nodes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The copies that lie in these nodes."""
    return copy if nodes.all() else copy.take(np.flatnonzero(np.repeat(nodes, count)))


def _both(left: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """What left and right children have, one after the other."""
    return np.stack([left, whole - left], 1).reshape(2 * len(left), *left.shape[1:])


# Row copies that grow together: a level's steps are shared by all of them. More need more memory and aren't faster.
TOGETHER = 200_000


def grow_forest(x: np.ndarray, y: np.ndarray, spec: ForestSpec, numbers: Sequence[int], salt: int = 0) -> list[Tree]:
    """The trees of these numbers."""
    return [tree for _, tree in growing([(x, y, salt)], spec, [numbers])]


def growing(groups: Sequence[tuple[np.ndarray, np.ndarray, int]], spec: ForestSpec, numbers: Sequence[Sequence[int]]) -> Iterator[tuple[int, Tree]]:
    """(group, tree) of the trees of these numbers of each group of (x, y, salt), in order. Trees of small groups grow together.

    Rows are put in order first, so a forest doesn't depend on how they arrive. All groups have equally many features and targets.
    """
    packs: list[list[int]] = []
    room = 0
    for g, (x, _, _) in enumerate(groups):
        if room <= 0:
            packs.append([])
            room = TOGETHER
        packs[-1].append(g)
        room -= len(x) * len(numbers[g])
    for pack in packs:
        yield from _growing([groups[g] for g in pack], spec, [[(g, number) for number in numbers[g]] for g in pack])


def _growing(groups: Sequence[tuple[np.ndarray, np.ndarray, int]], spec: ForestSpec, wanted: Sequence[Sequence[tuple[int, int]]]) -> Iterator[tuple[int, Tree]]:
    xs, ys, middles, scales, firsts = [], [], [], [], np.cumsum([0, *(len(x) for x, _, _ in groups)])
    for x, y, _ in groups:
        order = np.lexsort(np.concatenate([y, x], 1).T)
        middle, scale = _middles(y[order])
        xs.append(x[order])
        ys.append(y[order] - middle)
        middles.append(middle)
        scales.append(scale)
    ranked, y = _ranked(np.concatenate(xs)), np.concatenate(ys)
    del xs, ys
    bags, seeds, of, copies = [], [], [], 0

    def grown() -> Iterator[tuple[int, Tree]]:
        at = [i for i, _ in of]
        trees = _grow(ranked, y, spec, bags, seeds, np.stack([middles[i] for i in at]), np.array([scales[i] for i in at]))
        return zip([g for _, g in of], trees)

    for i, (x, _, salt) in enumerate(groups):
        n, first = len(x), int(firsts[i])
        size = spec.sample(n)
        for g, number in wanted[i]:
            if copies and copies + n > TOGETHER:
                yield from grown()
                bags, seeds, of, copies = [], [], [], 0
            draw = np.random.default_rng([spec.random_state & 0xFFFFFFFF, number, salt & 0xFFFFFFFF])
            if spec.draws:
                times = np.bincount(draw.integers(0, n, size), minlength=n)
                rows = np.flatnonzero(times)
                bags.append((rows + first, times[rows]))
            else:
                rows = np.arange(n) if size == n else np.sort(draw.choice(n, size, replace=False))
                bags.append((rows + first, np.ones(len(rows))))
            seeds.append(int(draw.integers(0, 1 << 63)))
            of.append((i, g))
            copies += n
    if bags:
        yield from grown()
