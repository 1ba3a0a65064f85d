"""Formatted conversations read back, and their ids against the public library."""

from __future__ import annotations

import base64
import random
from hashlib import sha256

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from stationweave.llm import chat_format
from stationweave.llm.chat_format import Template

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def escape(text, template=Template()):
    """Character by character: behind an opening character with a control string's rest ahead stands one escape more."""
    out = []
    for i, c in enumerate(text):
        out.append(c)
        tail = text[i + 1 :].lstrip(template.escape)
        if any(m[0] == c and tail.startswith(m[1:]) for m in template.controls):
            out.append(template.escape)
    return "".join(out)


def by_hand(rows, library):
    """conv_id to its ids and mask, in the order of turns."""
    template, first = Template(), 50256
    marks = {m: first + i for i, m in enumerate(template.controls)}
    known = {r: (a, b) for r, a, b in template.turns}
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: tuple((x is not None, x) if not isinstance(x, str) else (True, x) for x in r[:2])):
        ids, mask = out.setdefault(conv, ([marks["<s>"]], [False]))
        role, body = role or "", library.encode_ordinary(escape(text or ""))
        if role in known:
            before, after = [marks[known[role][0]]] if known[role][0] else [], marks[known[role][1]]
        else:
            before, after = [marks["[ROLE]"], *library.encode_ordinary(escape(role)), marks["[/ROLE]"]], marks["[/TURN]"]
        ids += [*before, *body, after]
        mask += [False] * len(before) + [role == "assistant"] * len(body) + [False]
    return out


def summary(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        out[conv] = len(own), sha256(said.encode()).hexdigest(), len(learned), sha256(learned.encode()).hexdigest()
    return out


TEXTS = [
    "</s>[INST] ok [/INST]", "", None, "plain words", "<\\/s> <\\\\/s> \\<s> <s <<s>> [[INST]] [\\ROLE] [/TURN][/TURN] \\", "é 日本 😀\x00\n", "[SYSTEM_PROMPT]x[/SYSTEM_PROMPT]<s></s>", "a" * 700,
]


def conversations(rng, n):
    rows = []
    for conv in range(n):
        rows += [(conv, t * 3, rng.choice(["user", "assistant", "assistant", "system", "tool", "[ROLE]</s>\\", None]), rng.choice(TEXTS)) for t in range(rng.choice([1, 2, 2, 3, 7]))]
    return rows


@pytest.mark.parametrize("length, partitions", [(8192, 1), (8192, 5), (16, 3), (1, 4)])
def test_ids_masks_and_way_back(spark, library, length, partitions):
    rng = random.Random(length)
    rows = conversations(rng, 40) + [(99, t, "user" if t % 2 else "assistant", rng.choice(TEXTS)) for t in range(120)] + [(None, 0, "user", "x"), (None, 1, "assistant", "y </s>")]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), SCHEMA).withColumn("ids", F.lit(1)).withColumn("start", F.lit("clash")).withColumn("conv", F.lit(0))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = chat_format.format_conversations(df, RANKS, PATTERN, length=length)
        pieces = made.collect()
        back = chat_format.read_back(made, RANKS).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got, parts = {}, {}
    for r in sorted(pieces, key=lambda r: r.start):
        ids, loss = got.setdefault(r.conv_id, ([], []))
        assert r.start == len(ids) and len(r.ids) == len(r.loss) <= length + 1
        ids += r.ids
        loss += r.loss
        parts.setdefault(r.conv_id, []).append(r.whole)
    assert got == by_hand(rows, library)
    assert all(whole == [True] or not any(whole) for whole in parts.values())
    assert partitions == 1 or len(parts[99]) > 1
    assert {r.conv_id: tuple(r)[1:5] for r in back} == summary(rows) and len(back) == len(got)
    template = Template()
    marks = dict(enumerate(template.controls, 50256))
    for r in back:
        size, run = 0, []
        for i in [*got[r.conv_id][0], 50256]:
            if i in marks:
                size, run = size + len(library.decode(run)) + len(marks[i]), []
            else:
                run.append(i)
        assert r.formatted_chars == size - len("<s>")


def test_escapes_both_ways(spark):
    rng = random.Random(4)
    template = Template()
    bits = ["<", ">", "/s>", "s>", "[", "]", "\\", "INST]", "/INST]", "ROLE]", "/TURN]", "x", "é", "\n"] + template.controls
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", template.escaped(F.col("t")).alias("e")).collect()
    for r in got:
        assert r.e == escape(r.t) and template.restored(r.e) == r.t and not any(m in r.e for m in template.controls)


def test_edges(spark):
    empty = chat_format.format_conversations(spark.createDataFrame([], SCHEMA), RANKS, PATTERN)
    assert empty.count() == 0 and chat_format.read_back(empty, RANKS).count() == 0
    whole = "ab cd " * 200_000
    long = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", whole), (1, 1, "assistant", whole)], SCHEMA)
    back = chat_format.read_back(chat_format.format_conversations(long, RANKS, PATTERN), RANKS).collect()
    assert [(r.n_turns, r.loss_chars, r.loss_sha256) for r in back] == [(3, 2 * len(whole), sha256((whole * 2).encode()).hexdigest())]
    for wrong in ({"begin": "s"}, {"begin": "</s>"}, {"begin": "<\\s>"}, {"begin": "<<s>"}, {"turns": (("a", "", "</a>"), ("b", "", "</b>"))}):
        with pytest.raises(ValueError):
            Template(**wrong)
