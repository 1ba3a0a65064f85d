"""URL filters with aliases, components, and main text."""

from __future__ import annotations

import random

import pytest

from stationweave.llm import components, html_extraction, url_filters

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def link(to):
    return f"<html><head><link href='{to}' rel=canonical></head>"


@pytest.fixture
def judged(spark):
    def run(rows, redirects=None):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        moved = spark.createDataFrame(redirects, "src string, dst string") if redirects else None
        return {r.page_id: r for r in url_filters.judge(pages.withColumn("rule", pages.url), RULES, moved).collect()}

    return run


def test_rules(judged):
    got = judged([
        (1, "http://a.Example.COM/en/x?y#z", None), (2, "https://www.example.com/en/", ""), (3, "https://b.com", ""), (4, "x://n.net/es/1", ""),
        (5, None, ""), (6, "nothing", ""), (7, "http://b.com/de/", ""), (8, "http://notexample.com/en/", ""), (9, "http://n.net/es", "")])
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(1, 10)] == [
        ("a.example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("b.com", "", None, "allow"),
        ("n.net", "/es/1", "net/es/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("b.com", "/de/", "com/", "allow"),
        ("notexample.com", "/en/", "com/", "allow"), ("n.net", "/es", None, "allow")]


def test_blocks_reach_aliases_and_allow_wins(judged):
    got = judged([
        (1, "http://a.org/1", link("/2")), (2, "http://a.org/2#top", ""), (3, "http://c.org/3", "<meta http-equiv=refresh content='0; url=https://c.net/es/q'>"),
        (4, "https://c.net/es/q", ""), (5, "http://d.org/5", link("http://e.org/")), (6, "http://f.org/6", link("http://d.org/5")), (7, "http://g.org/7", "")],
        [("http://e.org/", "http://x.net/es/1"), ("http://x.net/es/1", "http://y.com/"), ("http://a.org/2", "http://z.net/es/9"), (None, "http://g.org/7")])
    # 1 and 2 through a redirect to a blocked address outside the table; 5 and 6 have an allowed alias.
    assert {i: r.verdict for i, r in got.items()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow"}
    assert got[1].component == got[2].component == "a.org/1" and got[7].component is None


def test_judge_empty(judged):
    assert judged([]) == {}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGE = (
    '<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>'
    '<div id="cookie-consent">We use cookies</div><div class="wrap"><div class="content post-{n}"><h1>Head &amp; line</h1><p>One <b>bold<br>x&nbsp;y <p>Two <a href=x>link</a> '
    'more text of this article<ul><li>item<li>item2</ul><div class="ad">buy</div><form><p>f</p></form></div><aside>side</aside><section class="user-comments"><p>{c}</p></section></div>'
    '<footer>foot</footer><script>var a="<p>x</p>"</script><!-- <p>no</p> -->'
)
TEXT = "Head & line\n\nOne bold x y\n\nTwo link more text of this article\n\nitem\n\nitem2"


def test_extraction(spark):
    rows = [(n, f"http://h.org/{n}", PAGE.replace("{n}", str(n)).replace("{c}", "a long comment " * (40 if n == 3 else 1))) for n in range(6)]
    # Its own containers would favour the box, its host's path is the content.
    rows.append((6, "http://H.org/6", '<html><body><div class="wrap"><div class="content post-">Short text</div></div><div class="box">' + "<p>Other words</p>" * 30))
    rows += [(7, "http://h.org/7", ""), (8, None, None), (9, None, "<p>own &lt;b&gt; text"), (10, "http://h.org/10", "cut <p"), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url AS path")
    got = html_extraction.extract(pages).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert [texts[n] for n in range(6)] == [TEXT] * 6
    assert [texts[n] for n in range(6, 11)] == ["Short text", "", "", "own <b> text", "cut"]
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extraction.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("html", ["<" * 5000, "<div>" * 3000 + "x" + "</div>" * 3000, "<a href='" * 500, "<p" * 2000, "&#x110000;&bogus;", "</p></td>x<table><td>y"])
def test_odd_markup_ends(html):
    text, _ = html_extraction.extract_text(html, html_extraction.vote(html)[0])
    assert isinstance(text, str)


def paragraphs(n, size):
    return "".join(f"<p>{('word ' * size).strip()} {i}" for i in range(n))


@pytest.mark.parametrize("html", [
    "<body><div class=content><div class=lead><h1>Title</h1><p>" + "lead " * 40 + "</div><div class=body>" + paragraphs(8, 20) + "</div></div>",
    "<body><article><header class='entry-header'><h1>Title</h1></header><p>lead<div><div><div class=body>" + paragraphs(8, 20) + "</div></div></div></article>",
    "<body><main><h1>Title</h1><p>lead<div><div class=body>" + paragraphs(8, 20) + "</div></div></main>",
])
def test_text_beside_the_best_container(html):
    text, _ = html_extraction.extract_text(html, html_extraction.vote(html)[0])
    assert text.startswith("Title\n\nlead") and text.endswith("word 7")


def test_lists_of_links_beside_the_article_stay_out():
    links = "".join(f"<p><a href=/{i}>another headline of this site</a>" for i in range(9))
    html = f"<body><div class=page><div class=box>{links}</div><div class=body>{paragraphs(8, 20)}</div></div>"
    text, _ = html_extraction.extract_text(html, html_extraction.vote(html)[0])
    assert "headline" not in text and text.endswith("word 7")


BODY = paragraphs(8, 20)


def main_text(html):
    return html_extraction.extract_text(html, html_extraction.vote(html)[0])[0]


def plain(n, size):
    return "\n\n".join(f"{('word ' * size).strip()} {i}" for i in range(n))


@pytest.mark.parametrize("before, after", [
    ("<body><form id=aspnetForm action=/><input type=hidden name=a><input name=q><div class=content>", "</div></form>"),
    ("<body><form><input name=q><button>Go</button><select><option>x</select><article>", "</article></form>"),
    ("<body><div class=search-results>", "</div>"),
    ("<body><article>", "<form><p>Write to us<input name=a><textarea></textarea></form></article>"),
    ("<body><article>", "<p class=notice>Short notice</p><div class='search box'>Search here</div></article>"),
])
def test_forms_and_unsure_names(before, after):
    assert main_text(before + BODY + after) == plain(8, 20)


def test_prose_of_an_unsure_name_stays_in_the_article():
    said = "This long passage tells of the rules that hold for all readers of the place. " * 4
    got = main_text(f"<article>{BODY}<p class=notice>{said}</p><div class=search-results><p>{said}</div><div class=ad><p>{said}</div></article>")
    assert got == plain(8, 20) + ("\n\n" + said.strip()) * 2


def test_what_stands_inside_a_sentence_does_not_cut_it():
    line = "<p>So <math xmlns=m><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation encoding=t>x=1</annotation></semantics></math> holds<svg><title>i</title><g/></svg>, <script>a()</script>always <button><div>no</div></button>so.</p>"
    assert main_text(f"<article>{line}{BODY}</article>") == "So x=1 holds, always so.\n\n" + plain(8, 20)


def test_generated_pages_give_their_article():
    rng = random.Random(5)
    noise = ["<nav><ul><li><a href=/>Home</a></ul></nav>", "<aside><p>Side</p></aside>", "<div class=ad>Buy</div>", "<script>x('<p>')</script>", "<footer><p>Foot</p></footer>",
             "<form><label>Name</label><input name=n><p>Write</p></form>", "<section class=comments><p>First!</p></section>", "<style>p{}</style>", "<div hidden>Gone</div>"]
    for _ in range(200):
        blocks, parts = [], []
        for _ in range(rng.randint(3, 12)):
            w = " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(5, 60)))
            tag = rng.choice(["p", "h2", "blockquote", "li", "div"])
            shown = w.replace(" w1 ", " <b>w1</b> ").replace(" w2 ", "\n<a href=/2>w2</a>\t").replace(" w3 ", " <svg><title>no</title></svg>w3<br>")
            parts.append(f"<{tag}>{shown}</{tag}>")
            blocks.append(w)
            parts += rng.sample(noise[2:], rng.randint(0, 1))
        html = "<html><body>" + "".join(rng.sample(noise[:2] + noise[4:5], 2)) + "<article>" + "".join(parts) + "</article>" + "".join(rng.sample(noise, 3)) + "</body></html>"
        assert main_text(html) == "\n\n".join(blocks), html
