"""Quality rules against counting by hand, and the distances of planted junk."""

from __future__ import annotations

import random
import re

from stationweave.llm import quality_rules

WORDS = {"en": "the of and to in that this with from water stone river light under".split(), "de": "der die und das nicht mit von ein wasser stein fluss licht unter".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + (rng.choice(["", "", "er", "el", "on"])) + ("." if i % 9 == 8 else "") for i in range(n))


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_statistics_and_verdicts(spark, docs):
    rng = random.Random(11)
    rows = [(i, prose(rng, lang, 300), lang) for i, lang in enumerate(["en", "de"] * 40)]
    junk = " ".join(f"{w}###" for w in prose(rng, "en", 200).split())
    rows += [(100, junk, "en"), (101, junk, None), (102, "a b c", "en"), (103, None, "en"), (104, "", None), (105, "é\u2003 x\r\ny\ny\n \ny", "de"),
             (106, ("one two three four five six. " * 9 + "\n") * 3, "en"), (107, prose(rng, "de", 300), "xx"), (108, prose(rng, "en", 30) + " ### ###", "en"), (0, rows[0][1], "en")]
    df = docs(rows).selectExpr("*", "1 AS kept")
    got = quality_rules.judge(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == by_hand(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(80)) and kept[107] and kept[108]  # the guard spares the short one
    assert not any(kept[i] for i in (100, 101, 102, 103, 104, 105, 106))


def test_repeated_words_by_hand():
    rng = random.Random(2)
    for _ in range(300):
        text = " ".join(rng.choices("abc", k=rng.randint(0, 40)))
        assert quality_rules.repeated_words(text.encode().split()) == by_hand(text)[4]


def test_empty_table_and_no_language(docs):
    assert quality_rules.judge(docs([])).count() == 0
    assert quality_rules.judge(docs([(1, "word " * 5 + "a b c d e f g h")])).first().kept


def test_rare_languages(docs):
    """A language with a small share of all words has its own reference; with too few for one, the plain rules decide."""
    rng = random.Random(5)
    rare = "это как что для при вода камень река свет под".split()
    clean = [(1000 + i, " ".join(rng.choice(rare) + rng.choice(["", "", "ом", "ев"]) for _ in range(300)), "ru") for i in range(12)]
    few = [(2000 + i, " ".join(rng.choice("και το να με από νερό πέτρα".split()) + rng.choice(["", "ς", "ν"]) for _ in range(200)), "el") for i in range(3)]
    rows = [(i, prose(rng, "en", 300), "en") for i in range(20)] * 420
    junk = (3000, " ".join(f"{w}###" for w in clean[0][1].split()), "ru")
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs([*rows, *clean, *few, junk])).collect()}
    assert all(got[k] for k, _, _ in [*rows[:20], *clean, *few]) and not got[3000]
