"""Rows whose own columns have the names that operators use inside."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stationweave.llm import byte_bpe, context_tree, decontamination, html_extraction, language_id, near_dedup, quality_rules, substring_dedup, token_counts, url_filters

OWN = ("_s", "_text", "_digest", "_least", "_counts", "_coded", "_judged", "_found", "_host", "_agreed", "_html", "_url", "_address", "_salt", "_at", "_key", "own_s")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture
def rows(docs):
    text = " ".join(f"w{i}" for i in range(60))
    made = docs([(1, text, "a"), (2, text, "a"), (3, "some other words", "b"), (4, None, None)])
    pages = made.select("*", F.concat(F.lit("http://h.org/"), "doc_id").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))
    return pages.select("*", *(F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in OWN))


def items(rows):
    return rows.select(F.lit("i").alias("item_id"), F.lit("nothing of this").alias("text"), F.lit("x").alias("_digest"))


OPERATORS = {
    "token_counts": lambda d: token_counts.count_tokens(d, RANKS),
    "url_filters": lambda d: url_filters.judge(d, [("block", "h.org", "/2")]),
    "context_tree": lambda d: context_tree.score(d, F.col("doc_id") < 3),
    "decontamination": lambda d: decontamination.contaminate(d, items(d)),
    "clean": lambda d: decontamination.clean(d, items(d)),
    "byte_bpe": lambda d: byte_bpe.decode(byte_bpe.encode(d, RANKS, public_tokenizers.PATTERN), RANKS),
    "quality_rules": lambda d: quality_rules.judge(d),
    "language_id": lambda d: language_id.predict(d, language_id.fit(d)),
    "html_extraction": lambda d: html_extraction.extract(d),
    "near_duplicates": lambda d: near_dedup.near_duplicates(d),
    "deduplicate": lambda d: near_dedup.deduplicate(d),
    "cut_repeats": lambda d: substring_dedup.cut_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_own_columns_stay(rows, name):
    got = OPERATORS[name](rows).collect()
    assert len(got) == (3 if name in ("deduplicate", "cut_repeats") else 4)
    assert all(r[c] == f"{c} {r.doc_id}" for r in got for c in OWN)


def test_parameters_may_name_them(rows):
    renamed = rows.drop("_text", "_key").withColumnsRenamed({"text": "_text", "doc_id": "_key"})
    got = {r["_key"]: r.component_id for r in near_dedup.near_duplicates(renamed, "_key", "_text").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
