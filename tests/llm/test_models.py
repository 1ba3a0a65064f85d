"""Context-tree weighting against its definition, and language identification on held-out texts."""

from __future__ import annotations

import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from stationweave.llm import context_tree, language_id


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)


class Tree:
    """The mixture by recursion over dictionaries."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, Counter(), {}
        for text in texts:
            raw = b"\0" * depth + text + b"\0"
            for i in range(depth, len(raw)):
                for step in range(8):
                    node, bit = (1 << step) | raw[i] >> (8 - step), raw[i] >> (7 - step) & 1
                    for d in range(depth + 1):
                        self.counts[raw[i - d : i], node, bit] += 1
                        if d < depth:
                            self.children.setdefault((raw[i - d : i], node), set()).add(raw[i - d - 1 : i])
        self.memo = {}

    def pair(self, context, node):
        return self.counts[context, node, 0], self.counts[context, node, 1]

    def weighted(self, context, node):
        if (context, node) not in self.memo:
            own = kt(*self.pair(context, node))
            if len(context) == self.depth:
                self.memo[context, node] = own
            else:
                below = sum(self.weighted(c, node) for c in self.children.get((context, node), ()))
                top = max(own, below)
                self.memo[context, node] = math.log(0.5) + top + math.log(math.exp(own - top) + math.exp(below - top))
        return self.memo[context, node]

    def one(self, history, node, d=0):
        context = history[len(history) - d :]
        a, b = self.pair(context, node)
        if a + b == 0:
            return None
        estimate = (b + 0.5) / (a + b + 1)
        deeper = self.one(history, node, d + 1) if d < self.depth else None
        if deeper is None:
            return estimate
        w = math.exp(math.log(0.5) + kt(a, b) - self.weighted(context, node))
        return w * estimate + (1 - w) * deeper

    def log10(self, text):
        raw, total = b"\0" * self.depth + text + b"\0", 0.0
        for i in range(self.depth, len(raw)):
            for step in range(8):
                node, bit = (1 << step) | raw[i] >> (8 - step), raw[i] >> (7 - step) & 1
                p = self.one(raw[i - self.depth : i], node)
                p = 0.5 if p is None else p
                total += math.log10(p if bit else 1 - p)
        return total


TEXTS = [(1, "The cat sat. The cat."), (2, "the dog sat\non the mat"), (3, "über den Wolken"), (4, ""), (5, None), (6, "The Zebra~ in 日本"), (7, "cat cat cat"), (7, "cat cat cat"), (None, "the dog")]


@pytest.mark.parametrize("depth, block", [(5, 10**6), (3, 10**6), (5, 200)])
def test_scores_equal_definition(docs, depth, block):
    train = (F.col("doc_id") != 6) & (F.col("doc_id") != 7)
    rules = context_tree.ContextTree(depth=depth, block=block, piece=20)
    got = context_tree.score(docs(TEXTS).selectExpr("*", "note AS score"), train, rules=rules).collect()
    assert len(got) == len(TEXTS)
    learnt = [(t or "").lower().encode() for k, t in TEXTS if k not in (6, 7, None)]
    tree = Tree(learnt, depth)
    words = Counter(w for t in learnt for w in re.findall(rb"[^\x20\x09-\x0D]+", t)) + Counter({"end": len(learnt)})
    n, v = sum(words.values()), len(words)
    for r in got:
        raw = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "").encode()
        tokens = re.findall(rb"[^\x20\x09-\x0D]+", raw) + ["end"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(words[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((words[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens), rel=1e-5)
        assert r.score == pytest.approx(tree.log10(raw), rel=1e-5)


def test_copies_of_a_text_are_alike_over_several_blocks(docs):
    """A text's sums differ in their last digits with the rows before it; it still counts once for each block."""
    rng = random.Random(4)
    texts = [" ".join(f"{rng.choice(['cat', 'Dog', 'bird'])}{rng.randint(0, 200)}" for _ in range(rng.randint(20, 120))) for _ in range(15)]
    rows = [(i, texts[i % 15]) for i in range(120)]
    got = context_tree.score(docs(rows).repartition(4), F.col("doc_id") % 10 != 0, rules=context_tree.ContextTree(block=1000)).collect()
    learnt = [t.lower().split() for k, t in rows if k % 10]
    words = Counter(w for t in learnt for w in t)
    n, v = sum(words.values()) + len(learnt), len(words) + 1
    assert sorted(r.doc_id for r in got) == list(range(120))
    for r in got:
        counts = [words[w] for w in r.text.lower().split()]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(counts) + 1, sum(c > 0 for c in counts) + 1, n)
        assert r.base_score == pytest.approx(sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*counts, len(learnt)]), rel=1e-9)


@pytest.mark.parametrize("block", [2_000_000, 500])
def test_driver_holds_one_block_of_the_model_at_a_time(docs, monkeypatch, block):
    """Keys and values travel, not tables; nothing of a block stays when its scores are written."""
    share, made = SparkContext.broadcast, []

    def counted(self, value):
        assert not any(os.path.exists(b._path) for b, _ in made)
        made.append((share(self, value), sum(len(keys) for keys, _ in value.parts)))
        assert os.path.getsize(made[-1][0]._path) <= 16 * made[-1][1] + 2_000
        return made[-1][0]

    monkeypatch.setattr(SparkContext, "broadcast", counted)
    rng = random.Random(38)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(60))) for i in range(40)]
    df = docs(rows)
    got = context_tree.score(df, F.lit(True), rules=context_tree.ContextTree(block=block))
    assert (len(made) > 1) == (block < 10_000) and not any(os.path.exists(b._path) for b, _ in made)
    assert got.count() == 40


def test_probabilities_add_up_to_one(docs):
    """Over all bytes that can follow a context."""
    every = [(i, "the ca" + chr(i)) for i in range(1, 128) if not 65 <= i <= 90] + [(0, "the ca"), (500, "the cat the cab"), (501, "a cat can")]
    got = {r.doc_id: r.score for r in context_tree.score(docs(every), F.col("doc_id") >= 500).collect()}
    # Texts with one more byte end after it; the end's chance is taken out again by the definition.
    tree = Tree([b"the cat the cab", b"a cat can"], 5)
    for i in (0, 98, 116, 120):
        assert got[i] == pytest.approx(tree.log10(b"the ca" + (bytes([i]) if i else b"")), rel=1e-5)


def test_no_training_and_empty(docs):
    got = context_tree.score(docs([(1, "ab"), (2, None)]), F.lit(False)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(2, 0, 0), (1, 0, 0)]
    assert got[0].score == pytest.approx(24 * math.log10(0.5)) and got[1].score == pytest.approx(8 * math.log10(0.5))
    assert context_tree.score(docs([]), F.lit(True)).count() == 0


SYLLABLES = {
    "en": "the and ing ly ter wh ough sh ed tion".split(), "de": "der sch ung ein keit ver ge lich pf ü".split(), "nl": "het ij oe aa ver ge sch en de zijn".split(),
    "fr": "le que eau ment oi ou é è tion aux".split(), "es": "el que ción ado mente rr ñ ó ía os".split(),
}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def test_languages_on_held_out_texts(docs):
    rng = random.Random(21)
    train = [(i, sentence(rng, lang, rng.randint(5, 60)), lang) for i in range(60) for lang in SYLLABLES]
    model = language_id.fit(docs([*train, (1, "???", "en"), (2, None, "de"), (3, "text without language", None)]))
    assert model.families == ["germanic", "romance"] and model.members == {"germanic": ["de", "en", "nl"], "romance": ["es", "fr"]}
    test = [(i, sentence(rng, lang, 25).upper() if i % 7 == 0 and lang == "en" else sentence(rng, lang, 25), lang) for i in range(40) for lang in SYLLABLES]
    odd = [(900, None), (901, ""), (902, "123 ###"), (903, "日本"), (904, "é"), (900, None)]
    got = language_id.predict(docs(test + odd).selectExpr("*", "note AS lang_pred"), model).collect()
    assert len(got) == len(test) + len(odd)
    right = [r.lang_pred == r.lang for r in got if r.doc_id < 900]
    assert sum(right) >= 0.97 * len(right)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (900, 901, 902))
    assert all(r.lang_pred in SYLLABLES for r in got if r.doc_id in (903, 904))
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_with_little_to_learn(docs):
    one = language_id.fit(docs([(1, "some text here", "xx")]))
    assert [(r.lang_pred, r.score) for r in language_id.predict(docs([(1, "other"), (2, "12")]), one).collect()] == [("xx", 1.0), ("und", 0.0)]
    none = language_id.fit(docs([(1, "some text", None)]))
    assert language_id.predict(docs([(1, "other")]), none).first().lang_pred == "und"
    assert language_id.predict(docs([]), one).count() == 0


def test_languages_that_are_mostly_copies(docs):
    """Few different texts, each thousands of times: all of them are fitted on."""
    rng = random.Random(22)
    rows = docs([(i, sentence(rng, lang, 20), lang) for i in range(3) for lang in SYLLABLES])
    copies = rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(7000))))
    model = language_id.fit(copies)
    assert sorted(sum(model.members.values(), [])) == sorted(SYLLABLES)
    assert (model.weights == language_id.fit(rows).weights).all()
