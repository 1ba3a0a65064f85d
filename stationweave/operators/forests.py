"""Forests of any number of groups, fitted and applied in one plan.

A group's trees are dealt over tasks: every task gets all of the group's rows, packed into blocks, and grows
some of its trees to the end. How many copies of a large group that takes follows from the cores, not from its size.
Only where a spec asks for `max_rows`, each tree of a larger group draws its own rows where they lie.
A fitted forest is a table with one row a tree. It is applied to the rows of many groups by meeting them
in blocks, each with some of the trees of its group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stationweave.operators.trees import TOGETHER, ForestSpec, Tree, grow_forest, growing, predict_sum
from stationweave.session import materialise, release

# Row copies that one task grows, rows that meet some of the trees in one task, and of a few groups, if there are tasks left.
TASK_ROWS = 2_000_000
# Copies of a group that its work may ask for; more are made only to use the cluster.
COPIES = 8
BLOCK_ROWS, LEAST_ROWS = 200_000, 20_000
# Trees that meet rows in one task.
PACK_BYTES = 48 << 20
# A model up to this size goes to all tasks; a larger one meets its rows by a shuffle.
BROADCAST_BYTES = 64 << 20

TREE_SCHEMA = "key string, share int, fit int, tree int, feature array<int>, cut array<double>, left array<int>, value array<double>"


def _most(specs: Sequence[ForestSpec]) -> Column:
    """The least bound on a tree's rows that a spec asks for, null if none does."""
    return F.lit(min((s.max_rows for s in specs if s.max_rows is not None), default=None)).cast("long")


def _shares(n: Column, units: int, groups: int, specs: Sequence[ForestSpec], spark: SparkSession) -> Column:
    """Tasks of a group: one for each tree where rows are drawn, else by the work there is, up to COPIES, and two a core, if there are fewer groups than that."""
    parallel = -(-2 * spark.sparkContext.defaultParallelism // max(1, groups))
    by_work = F.greatest(F.lit(parallel), F.least(F.ceil(n * units / TASK_ROWS), F.lit(COPIES)))
    return F.when(n > _most(specs), units).otherwise(F.least(F.lit(units), by_work)).cast("int")


_BLOCK_SCHEMA = "key string, n int, row binary, x binary, y binary"


def _packed(rows: DataFrame) -> DataFrame:
    """Rows (key, and any of row long, x array<double>, y array<double>) in blocks of one key, whose numbers are bytes: a block is copied and sorted as one row."""
    names = [c for c in ("row", "x", "y") if c in rows.columns]

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").dictionary_encode()
            of = keys.indices.to_numpy()
            order = np.argsort(of, kind="stable")
            sizes = np.bincount(of, minlength=len(keys.dictionary))
            ends = np.cumsum(sizes)
            blocks = {"key": keys.dictionary, "n": pa.array(sizes, pa.int32())}
            for name in ("row", "x", "y"):
                if name not in names:
                    blocks[name] = pa.nulls(len(sizes), pa.binary())
                    continue
                column = batch.column(name).take(pa.array(order))
                flat = column if name == "row" else column.flatten()
                at = ends if name == "row" else column.offsets.to_numpy()[ends] - column.offsets[0].as_py()
                numbers = flat.to_numpy(zero_copy_only=False)
                blocks[name] = pa.array([part.tobytes() for part in np.split(numbers, at[:-1])], pa.binary())
            yield pa.RecordBatch.from_pydict(blocks)

    return rows.select("key", *names).mapInArrow(pack, _BLOCK_SCHEMA)


def _unpacked(table: pa.Table, name: str) -> np.ndarray:
    """A column of _packed blocks, with a row for each packed one."""
    parts = [np.frombuffer(block.as_buffer(), np.int64 if name == "row" else np.float64) for block in table.column(name)]
    whole = np.concatenate(parts)
    return whole if name == "row" else whole.reshape(sum(table.column("n").to_pylist()), -1)


def _numbers(specs: Sequence[ForestSpec], shares: int, share: int) -> list[list[int]]:
    """The trees of each spec that one of a group's tasks grows. Trees are numbered through all specs, and every `shares`-th one is this task's."""
    out, first = [], 0
    for spec in specs:
        out.append([k for k in range(spec.n_estimators) if (first + k) % shares == share])
        first += spec.n_estimators
    return out


def fit_forests(rows: DataFrame, specs: Sequence[ForestSpec]) -> DataFrame:
    """The trees of every group and spec for rows (key string, x array<double>, y array<double>), stored: TREE_SCHEMA.

    `fit` is the spec's place in specs, `share` the task that grew a tree. rows are read several times, so they
    should be stored. Rows of a group have equally many numbers, and none of them is null.
    """
    spark = rows.sparkSession
    bounds = list(dict.fromkeys(s.max_rows for s in specs))
    if len(bounds) > 1:
        # A bound holds for the specs that ask for it only.
        places = [[i for i, s in enumerate(specs) if s.max_rows == bound] for bound in bounds]
        fitted = [fit_forests(rows, [specs[i] for i in at]) for at in places]
        named = [trees.withColumn("fit", F.get(F.array(*map(F.lit, at)), F.col("fit"))) for trees, at in zip(fitted, places)]
        out = materialise(reduce(DataFrame.unionByName, named))
        for trees in fitted:
            release(trees)
        return out
    units = sum(s.n_estimators for s in specs)
    sizes = materialise(rows.groupBy("key").agg(F.count("*").alias("n")))
    most = bounds[0]
    shares = sizes.withColumn("shares", _shares(F.col("n"), units, sizes.count(), specs, spark)).withColumnRenamed("n", "size")
    work = shares.agg(F.sum("shares"), F.sum(F.least(F.col("size"), _most(specs)) * units)).first()
    every = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    whole = rows if most is None else rows.join(shares.where(F.col("size") <= most).select("key"), "key", "left_semi")
    dealt = _packed(whole).join(shares, "key").select("key", every, "shares", "n", "x", "y")
    if most is not None:
        large = rows.withColumn("row", F.monotonically_increasing_id()).join(shares.where(F.col("size") > most), "key").select("*", every)
        luck = F.pmod(F.xxhash64("key", "row", "x", "y", "share"), F.lit(1 << 30)) / float(1 << 30)
        drawn = large.where(luck < most / F.col("size")).select("key", "share", "shares", "x", "y")
        packed = drawn.select(F.concat_ws(":", "share", "shares", "key").alias("key"), "x", "y")
        parts = F.split("key", ":", 3)
        dealt = dealt.unionByName(_packed(packed).select(parts[2].alias("key"), parts[0].cast("int").alias("share"), parts[1].cast("int").alias("shares"), "n", "x", "y"))
    plan = list(specs)

    def grown(key: tuple, table: pa.Table) -> pa.Table:
        group, share = key[0].as_py(), key[1].as_py()
        x, y = (_unpacked(table, c) for c in ("x", "y"))
        numbers, salt = _numbers(plan, table.column("shares")[0].as_py(), share), crc32(group.encode())
        out = [(fit, k, tree) for fit, spec in enumerate(plan) for k, tree in zip(numbers[fit], grow_forest(x, y, spec, numbers[fit], salt))]
        return _trees_table(group, share, out)

    return materialise(_spread(dealt, ["key", "share"], *work).groupBy("key", "share").applyInArrow(grown, TREE_SCHEMA))


def _spread(rows: DataFrame, keys: list[str], tasks: int | None, work: int | None) -> DataFrame:
    """rows dealt by the keys into as many partitions as the work asks for; their bytes, by which partitions would be merged, say little."""
    return rows.repartition(_tasks(rows.sparkSession, tasks, work), *keys)


def _tasks(spark: SparkSession, tasks: int | None, work: int | None) -> int:
    wanted = max(2 * spark.sparkContext.defaultParallelism, -(-int(work or 0) // TASK_ROWS))
    return max(1, min(int(tasks or 0), wanted))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _trees_table(group: str, share: int, trees: Sequence[tuple[int, int, Tree]]) -> pa.Table:
    def listed(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        values = np.concatenate(parts) if parts else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(kind.to_pandas_dtype()), kind))

    columns = {
        "key": pa.array([group] * len(trees), pa.string()), "share": pa.array([share] * len(trees), pa.int32()),
        "fit": pa.array([f for f, _, _ in trees], pa.int32()), "tree": pa.array([k for _, k, _ in trees], pa.int32()),
        "feature": listed([t.feature for *_, t in trees], pa.int32()), "cut": listed([t.cut for *_, t in trees], pa.float64()),
        "left": listed([t.left for *_, t in trees], pa.int32()), "value": listed([t.value.ravel() for *_, t in trees], pa.float64()),
    }
    return pa.table(columns)


def _trees_of(table: pa.Table) -> Iterator[tuple[int, Tree]]:
    """(fit, tree) of a table's rows, without copies of the nodes."""
    for batch in table.to_batches():
        fits = batch.column("fit").to_pylist()
        lists = {c: (batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in ("feature", "cut", "left", "value")}
        for i, fit in enumerate(fits):
            feature, cut, left, value = (values[ends[i] : ends[i + 1]] for ends, values in lists.values())
            yield fit, Tree(feature, cut, left, value.reshape(len(feature), -1))


def _totals(table: pa.Table, x: np.ndarray, fits: int, targets: int) -> np.ndarray:
    """Sums of the trees' values by row, fit and target."""
    out = np.zeros((len(x), fits, targets))
    for fit, tree in _trees_of(table):
        out[:, fit] += tree.predict(x)
    return out


def _tree_bytes() -> Column:
    return F.size("feature") * 16 + F.size("value") * 8


def model_bytes(trees: DataFrame) -> int:
    found = trees.agg(F.sum(_tree_bytes())).first()[0]
    return int(found or 0)


def apply_forest(rows: DataFrame, trees: DataFrame, specs: Sequence[ForestSpec], targets: int, x: str = "x", out: str = "predictions") -> DataFrame:
    """rows with `out` (array<double>): the values of each fit's targets, one fit after the other, by the forest of one group.

    A model that is counted to fit goes to the tasks as a whole; of a larger one the trees meet the rows in shares.
    """
    if model_bytes(trees) > BROADCAST_BYTES:
        key = trees.select("key").first()[0]
        return apply_forests(rows.withColumn("__key", F.lit(key)), trees, specs, targets, "__key", x, out).drop("__key")
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(trees.drop("key", "share").toArrow().sort_by([("fit", "ascending"), ("tree", "ascending")]))
    counts = np.array([s.n_estimators for s in specs])[None, :, None]

    @F.arrow_udf("array<double>")
    def predicted(values: pa.Array) -> pa.Array:
        n = len(values)
        matrix = values.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))
        means = _totals(shared.value, matrix, len(specs), targets) / counts
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(specs) * targets), pa.array(means.ravel()))

    return rows.withColumn(out, predicted(F.col(x)))


def apply_forests(rows: DataFrame, trees: DataFrame, specs: Sequence[ForestSpec], targets: int, key: str = "key", x: str = "x", out: str = "predictions") -> DataFrame:
    """As apply_forest, for rows of many groups; rows of a group without a forest get null.

    The rows of a group are cut into blocks and its trees into packs, and each block meets each pack in a task
    of its own, so neither a group with most rows nor a large forest is ever held whole. A pack has as many trees
    as fit PACK_BYTES, so a row goes to few tasks. rows are read twice, so they should be stored.
    """
    numbered = rows.withColumn("__row", F.monotonically_increasing_id())
    whole = _values(numbered.select("__row", F.col(key).alias("__group"), F.col(x).alias("__x")), trees, specs, targets, out)
    return numbered.join(whole, "__row", "left").drop("__row")


def _values(asked: DataFrame, trees: DataFrame, specs: Sequence[ForestSpec], targets: int, out: str) -> DataFrame:
    """(__row, out) of the rows (__row, __group, __x) whose group has trees."""
    spark = asked.sparkSession
    units = sum(s.n_estimators for s in specs)
    model = trees.groupBy(F.col("key").alias("__group")).agg((F.max("share") + 1).alias("__shares"), F.sum(_tree_bytes()).alias("__bytes"))
    sizes = asked.groupBy("__group").agg(F.count("*").alias("__n"))
    counted = materialise(sizes.join(model, "__group"))
    # Smaller blocks, if there are fewer groups than cores.
    parallel = -(-2 * spark.sparkContext.defaultParallelism // max(1, counted.count()))
    blocks = F.greatest(F.ceil(F.col("__n") / BLOCK_ROWS), F.least(F.ceil(F.col("__n") / LEAST_ROWS), F.lit(parallel)))
    packs = F.least(F.col("__shares"), F.ceil(F.col("__bytes") / PACK_BYTES))
    plan = counted.select("__group", "__n", blocks.cast("int").alias("__blocks"), F.greatest(packs, F.lit(1)).cast("int").alias("__packs"))
    block = F.pmod(F.xxhash64("__row"), F.col("__blocks")).cast("int").alias("__block")
    met = asked.join(plan, "__group").select("__group", "__row", "__x", block, F.explode(F.sequence(F.lit(0), F.col("__packs") - 1)).alias("__pack"))
    every = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__block")
    pack = (F.col("share") % F.col("__packs")).alias("__pack")
    copies = trees.join(plan, F.col("key") == F.col("__group")).select("__group", pack, every, "fit", "feature", "cut", "left", "value")
    width = len(specs) * targets

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _sums_table(pa.array([], pa.int64()), np.zeros((0, width)))
        return _sums_table(left.column("__row").combine_chunks(), _totals(right, _matrix(left.column("__x")), len(specs), targets) / _counts(specs))

    keys = ["__group", "__pack", "__block"]
    total = plan.agg(F.sum(F.col("__blocks") * F.col("__packs")), F.sum(F.col("__n") * units)).first()
    met, copies = (_spread(side, keys, *total) for side in (met, copies))
    return _added(met.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(summed, _SUMS_SCHEMA), width, out)


def fill_forests(known: DataFrame, rows: DataFrame, specs: Sequence[ForestSpec], targets: int, key: str = "key", x: str = "x", out: str = "predictions") -> tuple[DataFrame, list[DataFrame]]:
    """(apply_forests(rows, fit_forests(known, specs), …), stored frames to release), without models.

    A group's trees and rows meet where the trees are grown: these are applied and dropped, which spares storing and
    dealing models that are far larger than the groups. A group that is too much work for one task is dealt to several,
    each with all its rows and some of its trees; only their sums are stored. A group with more rows than a spec bounds a
    tree's to is fitted and applied in shares. known and rows are read several times, so they should be stored.
    """
    spark = known.sparkSession
    units = sum(s.n_estimators for s in specs)
    asked = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("__m"))
    plan = materialise(known.groupBy("key").agg(F.count("*").alias("__n")).join(asked, "key"))
    drawn = F.coalesce(F.col("__n") > _most(specs), F.lit(False))
    alone = ~drawn & (F.col("__n") * units <= TASK_ROWS) & (F.col("__m") <= LEAST_ROWS)
    dealt = ~drawn & ~alone
    work = (F.col("__n") + F.col("__m")) * units
    few, work, several, dealt_work, many = plan.agg(F.count_if(alone), F.sum(F.when(alone, work)), F.count_if(dealt), F.sum(F.when(dealt, work)), F.count_if(drawn)).first()
    numbered = rows.withColumn("__row", F.monotonically_increasing_id())
    wanted = numbered.select("__row", F.col(key).alias("key"), F.col(x).alias("__x"))
    # Only groups with rows to fill are fitted, each by its size in one of three ways.
    of = lambda frame, which: frame.join(plan.where(which).select("key"), "key", "left_semi")
    parts, stored, fits = [], [plan], list(specs)
    if few:

        def made(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return _sums_table(pa.array([], pa.int64()), np.zeros((0, len(fits) * targets)))
            asked = dict(_groups(right, "__x", "__row"))
            groups = [(group, (x, y, *asked[group])) for group, (x, y) in _groups(left, "x", "y") if group in asked]
            rows, sums = [], []
            for width in {x.shape[1] for _, (x, *_) in groups}:
                some = [(group, parts) for group, parts in groups if parts[0].shape[1] == width]
                rows += [row for _, (*_, row) in some]
                sums += _grown_sums([(group, x, y, to) for group, (x, y, to, _) in some], fits, [range(s.n_estimators) for s in fits])
            return _sums_table(pa.array(np.concatenate([np.zeros(0, np.int64), *rows])), np.concatenate([np.zeros((0, len(fits), targets)), *sums]))

        # Many small groups in a call, which grow together; some calls a task.
        calls = F.pmod(F.xxhash64("key"), F.lit(max(1, 4 * _tasks(spark, few, work)))).alias("call")
        sides = (_spread(of(side, alone).select("*", calls), ["call"], few, work) for side in (known.select("key", "x", "y"), wanted))
        left, right = (side.groupBy("call") for side in sides)
        parts.append(left.cogroup(right).applyInArrow(made, _SUMS_SCHEMA).select("__row", F.col("__sums").alias(out)))
    if several:
        shares = plan.where(dealt).select("key", _shares(F.col("__n"), units, several, specs, spark).alias("shares"))
        every = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")

        def summed(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return _sums_table(pa.array([], pa.int64()), np.zeros((0, len(fits) * targets)))
            numbers = _numbers(fits, left.column("shares")[0].as_py(), key[1].as_py())
            x, y = _unpacked(left, "x"), _unpacked(left, "y")
            return _sums_table(pa.array(_unpacked(right, "row")), _grown_sums([(key[0].as_py(), x, y, _unpacked(right, "x"))], fits, numbers)[0])

        both = _packed(of(known, dealt)), _packed(of(wanted, dealt).select("key", F.col("__row").alias("row"), F.col("__x").alias("x")))
        tasks = shares.agg(F.sum("shares")).first()[0]
        # Only one side keeps `shares`: two frames can't be told apart by a column that they have in common.
        copies = (_spread(side.join(shares, "key").select("key", every, *columns), ["key", "share"], tasks, dealt_work) for side, columns in zip(both, (("shares", "n", "x", "y"), ("n", "row", "x"))))
        left, right = (side.groupBy("key", "share") for side in copies)
        stored.append(materialise(_added(left.cogroup(right).applyInArrow(summed, _SUMS_SCHEMA), len(specs) * targets, out)))
        parts.append(stored[-1])
    if many:
        trees = fit_forests(of(known, drawn), specs)
        stored.append(trees)
        parts.append(_values(of(wanted, drawn).withColumnRenamed("key", "__group"), trees, specs, targets, out))
    if not parts:
        return rows.withColumn(out, F.lit(None).cast("array<double>")), stored
    return numbered.join(reduce(DataFrame.unionByName, parts), "__row", "left").drop("__row"), stored


def _groups(table: pa.Table, *columns: str) -> Iterator[tuple[str, list[np.ndarray]]]:
    """(key, columns) of each key of a table: lists of numbers as matrices, numbers as they are."""
    keys = table.column("key").combine_chunks().dictionary_encode()
    at = np.argsort(keys.indices.to_numpy(), kind="stable")
    ends = np.cumsum(np.bincount(keys.indices.to_numpy(), minlength=len(keys.dictionary)))
    sorted_ = table.select(columns).take(pa.array(at))
    for group, first, end in zip(keys.dictionary.to_pylist(), [0, *ends], ends):
        part = sorted_.slice(first, end - first)
        yield group, [_matrix(c) if pa.types.is_list(c.type) else c.to_numpy() for c in part.columns]


def _grown_sums(groups: Sequence[tuple[str, np.ndarray, np.ndarray, np.ndarray]], specs: Sequence[ForestSpec], numbers: Sequence[Sequence[int]]) -> list[np.ndarray]:
    """What some trees of groups (key, x, y, rows) add to the means of the rows, by row, fit and target; trees are dropped as soon as they are applied."""
    sums = [np.zeros((len(to), len(specs), y.shape[1])) for _, _, y, to in groups]
    salted = [(x, y, crc32(key.encode())) for key, x, y, _ in groups]
    for fit, spec in enumerate(specs):
        last, some = 0, []
        for g, tree in growing(salted, spec, [numbers[fit]] * len(groups)):
            if some and (g != last or len(some) * len(groups[g][3]) >= TOGETHER):
                sums[last][:, fit] += predict_sum(some, groups[last][3])
                some = []
            last = g
            some.append(tree)
        if some:
            sums[last][:, fit] += predict_sum(some, groups[last][3])
    return [s / _counts(specs) for s in sums]


def _added(parts: DataFrame, width: int, out: str) -> DataFrame:
    """(__row, out) of the sums of a row's parts."""
    values = parts.groupBy("__row").agg(*[F.sum(F.get("__sums", F.lit(i))).alias(f"__s{i}") for i in range(width)])
    return values.select("__row", F.array(*[f"__s{i}" for i in range(width)]).alias(out))


_SUMS_SCHEMA = "__row long, __sums array<double>"


def _counts(specs: Sequence[ForestSpec]) -> np.ndarray:
    return np.array([s.n_estimators for s in specs])[None, :, None]


def _sums_table(row: pa.Array, sums: np.ndarray) -> pa.Table:
    n = len(row)
    ends = np.arange(n + 1, dtype=np.int32) * (sums.size // n if n else 0)
    return pa.table({"__row": row, "__sums": pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.ravel()))})


def single_group(rows: DataFrame, features: Sequence[Column], targets: Sequence[Column]) -> DataFrame:
    """(key, x, y) of rows that make up one group."""
    return rows.select(F.lit("").alias("key"), F.array(*[c.cast("double") for c in features]).alias("x"), F.array(*[c.cast("double") for c in targets]).alias("y"))
