"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's fingerprints are the least hashes of its word grams in every sliding window of grams. Two
texts that share `window` words in a row share all grams of that stretch, and so one fingerprint at
the same place. Equal fingerprints of documents and benchmark items are then extended to whole
windows, which are compared word for word, so nothing is reported that isn't there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .common import any_names, LOWER, UPPER, let, lookup, settle, texts_of

# What separates words, before and after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Bits of a fingerprint that hold its place. No text has as many words; the rest is hash.
PLACE_BITS = 30
PLACE = (1 << PLACE_BITS) - 1

WINDOW = 10  # words that must be shared in a row
GRAM = 5  # words of a gram; a window has WINDOW - GRAM + 1 grams


def words(text: str) -> F.Column:
    """Lower-cased words; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), GAP), "")


def winnow(texts: DataFrame, key: str, text: str, gram: int, span: int) -> DataFrame:
    """(key, print, place): the least gram of every `span` grams in a row, as its hash and the place of its first word."""

    def packed(hashes):
        def one(i):
            return F.xxhash64(F.slice(hashes, i + 1, F.lit(gram))).bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long"))

        return F.transform(F.sequence(F.lit(0), F.size(hashes) - gram), one)

    def least(prints):
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(prints) - span + 1), lambda i: F.array_min(F.slice(prints, i, F.lit(span)))))

    def prints(found):
        hashes = F.transform(found, lambda w: F.xxhash64(w))
        picked = let(hashes, packed) if span == 1 else let(let(hashes, packed), least)
        return F.when(F.size(found) >= gram + span - 1, picked)

    return texts.select(key, F.explode(let(words(text), prints)).alias("both")).select(
        key, F.shiftright("both", PLACE_BITS).alias("print"), F.col("both").bitwiseAND(F.lit(PLACE)).cast("int").alias("place")
    )


def _windows(items: DataFrame, text: str, window: int) -> DataFrame:
    """Every window of each item, as text with its size; an item of fewer words, but not none, is one window."""
    listed = items.select("*", words(text).alias("_words")).withColumn("_n", F.size("_words")).where("_n > 0")
    size = F.least("_n", F.lit(window))
    start = F.explode(F.sequence(F.lit(1), F.col("_n") - size + 1)).alias("_start")
    return listed.select("*", size.alias("size"), start).withColumn("window", F.array_join(F.slice("_words", F.col("_start"), F.col("size")), " ")).drop("_words", "_n", "_start")


@any_names
def contaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """All columns of docs, with n_words, n_hit, n_items (long) and item_ids (array<string>, sorted) added or replaced.

    A document word is hit if it lies inside an occurrence of any window of `window` words of an
    item; an item of fewer words is one window. item_ids are the items with a window in the document.
    Null and empty texts have no words and no hits, items without words have no windows, items with a
    null id count for n_hit only. Repeated rows get the same result each, and a text that many rows
    share is compared once. An empty table on either side gives no hits.
    """
    spans = settle(_windows(items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text")), "text", window).drop("text").distinct())
    sizes = sorted(r["size"] for r in spans.select("size").distinct().collect())  # at most `window` numbers
    texts = docs.select(F.md5(F.col(text).cast("binary")).alias("digest"), F.col(text).alias("text")).where(F.col("text").isNotNull())

    found = []
    for size in sizes:
        k, span = (gram, window - gram + 1) if size == window else (size, 1)
        prints = winnow(spans.where(F.col("size") == size), "item_id", "window", k, span).select("print").distinct()
        met = lookup(winnow(texts, "digest", "text", k, span), prints, "print", "inner")
        found.append(met.groupBy("digest").agg(F.collect_set("place").alias("places")).select("digest", "places", F.lit(size).alias("size"), F.lit(span).alias("span")))
    if not found:
        found = [texts.select("digest", F.array().cast("array<int>").alias("places"), F.lit(window).alias("size"), F.lit(1).alias("span")).where("false")]
    candidates = settle(reduce(DataFrame.union, found))

    # Extension: the windows around each common fingerprint, once per distinct text.
    one = texts_of(docs, text, candidates.select("digest").distinct(), F.md5).select("digest", F.col("text").cast("string").alias("text"))
    around = one.select("digest", words("text").alias("words")).join(candidates, "digest")
    starts = F.flatten(F.transform("places", lambda p: F.sequence(F.greatest(p - F.col("span") + 1, F.lit(0)), F.greatest(F.least(p, F.size("words") - F.col("size")), F.lit(0)))))
    opened = around.select("digest", "words", "size", F.explode(F.array_distinct(starts)).alias("start"))
    read = opened.select("digest", "size", "start", F.array_join(F.slice("words", F.col("start") + 1, F.col("size")), " ").alias("window"))
    hits = settle(lookup(read, spans.select("window", F.col("size").alias("_size")).distinct(), "window", "inner").where("size = _size").drop("_size"))

    covered = F.flatten(F.transform("all", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))
    hit = hits.groupBy("digest").agg(F.collect_set(F.struct("start", "size")).alias("all")).select("digest", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"))
    owners = lookup(hits.select("digest", "window").distinct(), spans.select("window", "item_id").where("item_id is not null").distinct(), "window", "inner")
    listed = owners.groupBy("digest").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    result = hit.join(listed, "digest", "left").withColumnRenamed("digest", "_digest")

    added = ("n_words", "n_hit", "n_items", "item_ids", "_digest")
    kept = [f"`{c}`" for c in docs.columns if c not in added]
    counted = docs.select(*kept, F.md5(F.col(text).cast("binary")).alias("_digest"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return lookup(counted, result, "_digest").select(*kept, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"))


def clean(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """The documents without any hit word, with their columns as they are."""
    return contaminate(docs, items, **parameters).where("n_hit = 0").select(*(f"`{c}`" for c in docs.columns))
