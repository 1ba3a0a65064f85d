"""Near duplicates by MinHash bands, odd sketches and exact sets.

A text becomes its set of word shingles; texts with equal sets are one class, and all further work
is on classes. Bands of MinHash values bring candidates together. An odd sketch, the parity bitmap
of a one-permutation MinHash sample, rules most of them out: the ones in the XOR of two sketches
say how far the samples differ. What is left is decided on the full sets.

No group of copies is ever expanded into all its pairs: members of a band are first held against
one of them, which joins true copies into components. What is outside of a band's largest component
is then held against one of its own, until that finds nothing more or little is left; and only the rest, for as long
as it lies in different components, meets the members of the band one by one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import any_names, as_bytes, attach, hot_join, lists, lookup, mixed, modest_batches, release, settle, small, texts_of
from .components import connected_components

BANDS, ROWS = 25, 4  # a pair at similarity 0.85 shares no band in 1 of 10^8 cases, at 0.8 in 2 of 10^6
BINS, BITS = 8192, 4096  # samples and bits of an odd sketch
DEVIATIONS = 4.0  # by which the difference of two sketches may exceed what the threshold makes one expect
SHARE = 250  # pairs of one text that meet in one task
LOOKS = 4  # pairs of sketches for each member of a torn band, above which its parts are first held against hubs

_SEEDS = mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
_FACTORS, _SHIFTS = _SEEDS[: BANDS * ROWS] | np.uint64(1), _SEEDS[BANDS * ROWS :]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `size` words; one of the whole sequence if it has fewer words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    value = np.full(len(words) - size + 1, np.uint64(size))
    for i in range(size):
        value = mixed(value * _STEP + hashes[i : i + len(value)])
    return np.unique(value)


def _sketch(found: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, int]:
    """(class, band keys, odd sketch, samples) of a set that isn't empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for part in range(0, len(found), 4096):
        np.minimum(least, (found[part : part + 4096, None] * _FACTORS + _SHIFTS).min(0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys * _STEP + row)
    bins = found >> np.uint64(64 - BINS.bit_length() + 1)
    samples = found[np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))]  # the least of each bin
    odd = np.bincount((mixed(samples) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return hashlib.md5(found.tobytes()).digest(), keys.view(np.int64), np.packbits(odd.astype(np.uint8)).view(np.int64), len(samples)


_SKETCH = T.StructType(
    [
        T.StructField("cls", T.BinaryType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("odd", T.ArrayType(T.LongType())),
        T.StructField("samples", T.IntegerType()),
    ]
)


def sketches(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, digest, cls, n_shingles, bands, odd, samples) of every row; cls is null and all lists are empty for a text without words."""

    @F.arrow_udf(_SKETCH)
    def sketched(texts: pa.Array) -> pa.Array:
        classes, sizes, bands, odds, samples = [], [], [], [], []
        for value in texts.to_pylist():
            found = shingles(value, size)
            cls, keys, odd, n = _sketch(found) if len(found) else (None, np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
            classes.append(cls)
            sizes.append(len(found))
            bands.append(keys)
            odds.append(odd)
            samples.append(n)
        some = np.array([bool(n) for n in sizes], np.int64)
        none = np.zeros(0, np.int64)
        columns = [
            pa.array(classes, pa.binary()),
            pa.array(sizes, pa.int64()),
            lists(np.concatenate([none, *bands]), some * BANDS, pa.int64()),
            lists(np.concatenate([none, *odds]), some * (BITS // 64), pa.int64()),
            pa.array(samples, pa.int32()),
        ]
        return pa.StructArray.from_arrays(columns, names=_SKETCH.names)

    rows = docs.select(F.col(key).alias("key"), F.md5(as_bytes(text)).alias("digest"), sketched(as_bytes(text)).alias("s"))
    return rows.select("key", "digest", "s.*")


def _alike(threshold: int) -> F.Column:
    """Whether the sketches x and y of a pair allow the similarity of `threshold` percent.

    At similarity t, a bin of a union of u shingles has one at all with chance 1 - exp(-u / BINS), and
    then equal samples with chance t; that gives the number of samples which differ. It strays by the
    collisions in bins, and the count of ones in the XOR by those in bits.
    """
    t = threshold / 100
    ones = F.aggregate(F.zip_with("x.odd", "y.odd", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, b: n + b)
    differ = F.log1p(F.least(ones, F.lit(BITS * 12 // 25)) * (-2.0 / BITS)) * (-BITS / 2.0)
    fill = (F.col("x.n_shingles") + F.col("y.n_shingles")) / ((1 + t) * BINS)
    expected = (F.expm1(fill * (-(1 + t) / 2)) * -2 + F.expm1(-fill) * 2 * t) * BINS
    full = expected * (4.0 / BITS)
    strays = F.sqrt(expected * 2 * F.least(fill, F.lit(1.0)) + (F.expm1(full) - full) * (BITS / 4.0))
    ratio = F.least("x.n_shingles", "y.n_shingles") * 100 >= F.greatest("x.n_shingles", "y.n_shingles") * threshold
    return ratio & (differ <= expected + strays * DEVIATIONS + 1)


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str, size: int, threshold: int) -> DataFrame:
    """The pairs (x, y) of classes whose full sets are similar enough."""
    pairs = settle(pairs)
    members = pairs.select(F.col("x").alias("cls")).union(pairs.select("y")).distinct()
    needed = classes.select("cls", "digest").join(members, "cls", "left_semi")
    whole = texts_of(docs, text, needed.select("digest").distinct(), F.md5)
    texts = whole.join(needed, "digest").select("cls", "text")
    met = attach(attach(pairs, texts, "x", "y", "x_text", SHARE), texts, "y", "x", "y_text", SHARE)

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        known: dict[bytes, np.ndarray] = {}

        def of(value: bytes) -> np.ndarray:
            if value not in known:
                if len(known) >= 64:
                    known.clear()
                known[value] = shingles(value, size)
            return known[value]

        answers = []
        for a, b in zip(left.to_pylist(), right.to_pylist()):
            a, b = of(a), of(b)
            shared = len(np.intersect1d(a, b, assume_unique=True))
            answers.append(100 * shared >= threshold * (len(a) + len(b) - shared))
        return pa.array(answers, pa.bool_())

    confirmed = settle(met.where(similar("x_text", "y_text")).select("x", "y"))
    release(pairs)
    release(whole)
    return confirmed


def _parts(within: DataFrame, links: DataFrame) -> DataFrame:
    """The rows (band, cls) with the component of each class as `part`."""
    found = connected_components(links).toDF("cls", "component")
    return within.join(found, "cls", "left").select("band", "cls", F.coalesce("component", "cls").alias("part"))


def _torn(labelled: DataFrame) -> DataFrame:
    """(band, n, main, rest): bands of several components, with their members, the largest component and the members outside of it."""
    sizes = labelled.groupBy("band", "part").agg(F.count("*").alias("n"))
    bands = sizes.groupBy("band").agg(F.sum("n").alias("n"), F.max(F.struct("n", "part")).alias("top"))
    return bands.where("top.n < n").select("band", "n", F.col("top.part").alias("main"), (F.col("n") - F.col("top.n")).alias("rest"))


def _looks(torn: DataFrame) -> tuple[float, int]:
    """How many pairs of members _crossing() looks at, and the members of all torn bands."""
    row = torn.agg(F.sum(F.col("n") * F.col("rest").cast("double")), F.sum("n")).first()
    return row[0] or 0.0, row[1] or 0


def _crossing(torn: DataFrame, labelled: DataFrame, sketched: DataFrame, threshold: int) -> DataFrame:
    """(x, y): pairs of classes in different components of a band whose sketches allow the threshold.

    Every member is dealt to one share of its band, and the few outside of the largest component to all of
    them. Two members meet in many bands; the first one they share has the pair.
    """
    shares = F.ceil(F.col("n") / SHARE).cast("int").alias("shares")
    rows = hot_join(labelled, torn.select("band", "n", "main", shares), "band", "n", "cls").withColumn("other", F.col("part") != F.col("main"))
    rows = settle(rows.drop("main").join(sketched, "cls"))
    left = rows.select("band", F.pmod(F.xxhash64("cls"), F.col("shares")).cast("int").alias("share"), F.col("cls").alias("x_cls"), F.col("part").alias("x_part"), F.col("other").alias("x_other"), F.col("sketch").alias("x"))
    right = rows.where("other").select("band", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("cls").alias("y_cls"), F.col("part").alias("y_part"), F.col("sketch").alias("y"))
    common = F.zip_with("x.bands", "y.bands", lambda a, b: F.when(a == b, a))
    here = F.get(F.filter(common, lambda b: b.isNotNull()), F.lit(0)) == F.col("band")
    apart = (F.col("x_part") < F.col("y_part")) | (~F.col("x_other") & (F.col("x_part") > F.col("y_part")))
    met = left.join(right, ["band", "share"]).where(apart & _alike(threshold) & here)
    return met.select(F.col("x_cls").alias("x"), F.col("y_cls").alias("y"))


@any_names
def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: int = 80) -> DataFrame:
    """All columns, with n_shingles (long), component_id (type of key) and kept (boolean) added or replaced.

    Two documents are linked if their sets of `size`-word shingles (A-Z lower-cased, words parted by
    ASCII white space) have a Jaccard similarity of at least `threshold` percent; component_id is the
    least key that links lead to, and the document with that key is kept. A text of fewer words is one
    shingle; a null text, or one without words, has none and is linked with nothing. Rows of one text
    are one class. Repeated keys are judged by their texts; rows with a null key are linked like
    others, but no component is named after them unless it has no key at all, and they are never kept
    when it has one. An empty table stays empty.
    """
    modest_batches(docs.sparkSession)
    known = settle(sketches(docs, key, text, size))
    some = known.where("cls is not null")
    grouped = some.groupBy("cls").agg(F.min(F.struct("digest", "bands", "odd", "samples", "n_shingles")).alias("s"), F.min("key").alias("key"))
    classes = settle(grouped.select("cls", "key", "s.*"))
    members = classes.select("cls", F.explode("bands").alias("band"))
    # Each band has a hub of its own, so that a large group is held against many of its members.
    hub = F.min(F.struct(F.xxhash64("cls", "band").alias("order"), "cls")).getField("cls").alias("hub")
    bands = settle(members.groupBy("band").agg(hub, F.count("*").alias("n")).where("n > 1"))
    within = settle(hot_join(members, bands, "band", "n", "cls"))

    def sketch(name: str, of: DataFrame) -> DataFrame:
        return classes.join(of, "cls", "left_semi").select(F.col("cls").alias(f"{name}_cls"), F.struct("odd", "samples", "n_shingles").alias(name))

    def starred(rows: DataFrame) -> DataFrame:
        """The confirmed links among (hub, cls): each class against the hub of its row."""
        pairs = rows.where("cls <> hub").select(F.least("hub", "cls").alias("a"), F.greatest("hub", "cls").alias("b"), F.col("hub").alias("x_cls"), F.col("cls").alias("y_cls"))
        stars = settle(pairs.dropDuplicates(["a", "b"]).select("x_cls", "y_cls"))
        hubs = sketch("x", stars.select(F.col("x_cls").alias("cls")).distinct())
        spokes = sketch("y", stars.select(F.col("y_cls").alias("cls")).distinct())
        met = lookup(stars, hubs, "x_cls", "inner").join(spokes, "y_cls")
        found = _confirmed(met.where(_alike(threshold)).select(F.col("x_cls").alias("x"), F.col("y_cls").alias("y")), classes, docs, text, size, threshold)
        release(stars)
        return found

    # One member against all others of its band.
    linked = starred(within)
    release(bands)
    within = within.select("band", "cls")
    labelled = settle(_parts(within, linked))
    torn = settle(_torn(labelled))
    # What the hub left over, as long as that halves the work: again one of them against the others.
    looks, rows = _looks(torn)
    turn, before = 0, 2 * looks
    while looks > LOOKS * rows and 2 * looks <= before:
        turn, before = turn + 1, looks
        wide = torn.where(F.col("rest") > LOOKS).select("band", "n", "main")
        rest = settle(hot_join(labelled, wide, "band", "n", "cls").where("part <> main").select("band", "cls", "part"))
        first = F.min(F.struct(F.xxhash64("cls", "band", F.lit(turn)).alias("order"), "cls", "part")).alias("hub")
        hubs = settle(rest.groupBy("band").agg(first, F.count("*").alias("n")))
        held = hot_join(rest, hubs, "band", "n", "cls").where("part <> hub.part").select("cls", F.col("hub.cls").alias("hub"))
        linked = linked.union(starred(held))
        for done in (rest, hubs, torn, labelled):
            release(done)
        labelled = settle(_parts(within, linked))
        torn = settle(_torn(labelled))
        looks, rows = _looks(torn)

    # Members of different components that share a band.
    sketched = classes.select("cls", F.struct("odd", "samples", "n_shingles", "bands").alias("sketch"))
    across = _confirmed(_crossing(torn, labelled, sketched, threshold), classes, docs, text, size, threshold)
    for done in (within, labelled, torn):
        release(done)

    whole = connected_components(linked.union(across))
    named = classes.select("cls", "key").join(whole.withColumnRenamed("node", "cls"), "cls")
    least = named.groupBy("component").agg(F.min("key").alias("least"))
    ids = settle(lookup(named, least, "component", "inner").select(F.col("cls").alias("_cls"), "least").union(
        classes.join(whole.withColumnRenamed("node", "cls"), "cls", "left_anti").select("cls", "key")))
    release(classes)

    # Back to the rows: every text by its digest.
    result = known.select("digest", "cls", "n_shingles").distinct().join(ids.withColumnRenamed("_cls", "cls"), "cls", "left")
    result = result.select(F.col("digest").alias("_digest"), "n_shingles", F.col("least").alias("_least"))
    kept = [f"`{c}`" for c in docs.columns if c not in ("n_shingles", "component_id", "kept", "_digest", "_least")]
    rows = docs.select(*kept, F.md5(as_bytes(text)).alias("_digest"))
    component = F.when(F.col("n_shingles") > 0, F.col("_least")).otherwise(F.col(key)).alias("component_id")
    return rows.join(result, "_digest", "left").select(*kept, "n_shingles", component).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


@any_names
def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: int = 80) -> DataFrame:
    """The documents without near duplicates, with their columns as they are: of each group the one
    with the least key stays, of rows that repeat a key and its text one."""
    labels = near_duplicates(docs.select(key, text), key, text, size, threshold).select(F.col(key).alias("_key"), F.md5(as_bytes(text)).alias("_digest"), "kept")
    labels = settle(labels.groupBy("_key", "_digest", "kept").agg(F.count("*").alias("n")))
    gone, _ = small(labels.where("not kept").select("_key", "_digest"))
    again, _ = small(labels.where("kept and n > 1").select("_key", "_digest"))
    names = [f"`{c}`" for c in docs.columns]
    rows = docs.select(*names, F.md5(as_bytes(text)).alias("_at"))

    def same(side: DataFrame) -> F.Column:
        return rows[key].eqNullSafe(side["_key"]) & (rows["_at"] == side["_digest"])

    left = rows.join(gone, same(gone), "left_anti")
    once = left.join(again, same(again), "left_anti")
    repeated = left.join(again, same(again), "left_semi").dropDuplicates([key, "_at"])
    return once.union(repeated).select(*names)
