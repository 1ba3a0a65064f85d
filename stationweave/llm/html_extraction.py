"""Main text of web pages by consensus of their host.

Every page scores its containers and votes for the tag-class path of the best. Votes are summed per
host; each page is then read again and gives the text below the path its host agreed on. A page
that lacks that path gives the text of its own best container.

What a page's tags say is left out at once. What only a word in a class or id says, and forms, which
some sites put around a whole page, are decided once all of their text is known.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import any_names, as_bytes, lookup, modest_batches
from .url_filters import host

# Elements by their role in a page.
CONTAINERS = frozenset("html body main article section div td th center details fieldset figure form".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr blockquote pre address hr hgroup summary figcaption".split())
DROPPED = frozenset("head title nav footer aside legend menu dialog".split())
# Those that stand inside a sentence without ending it.
SILENT = frozenset("script style noscript template button select textarea label option iframe object embed svg canvas audio video map annotation annotation-xml".split())
CONTROLS = frozenset("button select textarea input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("main", "article"))
CLOSES_P = BLOCKS - {"html", "body"}
SCOPES = SILENT - {"label", "option"}  # what inside them closes an element outside is not markup of the page
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
# Words in class names and ids of what is not the article.
NOISE = frozenset(
    "nav navbar navigation navi menu menubar topbar toolbar header masthead footer foot sidebar sidebars aside rail breadcrumb breadcrumbs crumbs pagination pager cookie cookies consent gdpr "
    "notice notices notification banner banners alert popup modal overlay ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted "
    "comment comments disqus respond replies reply share sharing social related recommended newsletter subscribe subscription signup login signin form search widget widgets skip hidden copyright".split()
)
# Those of them that also name parts of an article.
UNSURE = frozenset("notice notices notification alert search form widget widgets header".split())
# Elements whose content is not markup, and the forms of markup.
RAW = frozenset("script style title textarea noscript iframe".split())
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*"|'[^']*')*+)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORDS = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

# How much of a text's length counts for the container one level up, and how much more <article> and <main> count.
DECAY = 0.7
MAIN_BONUS = 2.0
# The most links that the text beside a container may hold to be of the same article.
LINKED = 0.3
# The least characters outside links that what an unsure class word names, and a form for itself and each of its controls, hold as part of an article.
PROSE = 200


class _Node:
    """A container: where it stands, and whether the agreed path leads to it (matches) or past it (inside).

    doubt is the nearest node around it, or itself, that is only known to be noise or not once all of its
    text is read; controls counts what a form asks for.
    """

    __slots__ = ("tag", "label", "parent", "noise", "depth", "matches", "inside", "doubt", "controls")

    def __init__(self, tag: str, label: str, parent: "_Node | None", noise: bool, path: list[str], unsure: bool = False):
        self.tag, self.label, self.parent, self.noise, self.controls = tag, label, parent, noise, 0
        self.doubt = self if unsure else parent.doubt if parent else None
        if tag in MAIN and not unsure and self.doubt is not None and self.doubt.tag == "form":
            self.doubt = self.doubt.parent.doubt  # an article in a form is no part of what the form asks
        self.depth = parent.depth + 1 if parent else 0
        self.matches = parent is None or parent.matches and self.depth <= len(path) and label == path[self.depth - 1]
        self.inside = parent is not None and (parent.inside or self.matches and self.depth == len(path))


def _label(tag: str, classes: str) -> str:
    """Tag and classes without digits, so that numbered containers of a host share a path."""
    names = sorted({re.sub(r"\d+", "", c) for c in classes.lower().split()} - {""})
    return ".".join([tag, *names])


class _Page:
    """Reads a page into blocks of text, each with its container. Noise is left out at once."""

    def __init__(self, agreed: str | None, by_class: bool = True):
        self.path = agreed.split(">") if agreed else []
        self.by_class = by_class
        self.stack: list[tuple[str, _Node]] = [("", _Node("", "", None, False, self.path))]
        self.words: list[str] = []
        self.at = self.stack[0][1]
        self.linked = 0
        self.in_link = 0
        self.blocks: list[tuple[_Node, str, int]] = []

    def flush(self) -> None:
        if not self.words:
            return
        text = " ".join("".join(self.words).split())
        if text:
            self.blocks.append((self.at, text, self.linked))
        self.words, self.linked = [], 0

    def _noise(self, tag: str, attrs: dict[str, str], parent: _Node) -> bool | None:
        """Whether an element is noise; None if its text must decide."""
        if tag in DROPPED or tag in SILENT:
            return True
        if tag in ("html", "body") or tag in MAIN and not (attrs.get("class") or attrs.get("id")):
            return False
        if tag == "header":
            at = parent
            while at is not None and at.tag not in MAIN:
                at = at.parent
            if at is None:
                return True
        if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attrs.get("style", "").lower()):
            return True
        if attrs.get("role", "").lower() in ROLES:
            return True
        sure: bool | None = None if tag == "form" else False
        if not self.by_class or tag == "header":  # of the article, as others are gone
            return sure
        for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
            words = _WORDS.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
            said = {words[0], words[-1]} & NOISE
            if said - UNSURE:
                return True
            if said and tag in BLOCKS:
                sure = None
            elif said:
                return True
        return sure

    def start(self, tag: str, attrs: str) -> None:
        parent = self.stack[-1][1]
        if tag in CONTROLS and not parent.noise and parent.doubt is not None and not re.search(r"type\s*=\s*[\"']?hidden", attrs, re.I):
            parent.doubt.controls += 1
        if tag == "br":
            self.words.append(" ")
        if tag in VOID:
            if tag in BLOCKS and not parent.noise:
                self.flush()
            return
        if tag in BLOCKS or tag in DROPPED or tag == "header":
            if not parent.noise:
                self.flush()
            if tag in CLOSES_P:
                self._close("p", CONTAINERS)
            if tag in SIBLINGS:
                for open_tag in SIBLINGS[tag]:
                    self._close(open_tag, LIMITS[tag])
        parent = node = self.stack[-1][1]
        if tag == "a":
            self.in_link += 1
        if not parent.noise and (tag in CONTAINERS or tag in DROPPED or tag in SILENT or tag == "header" or attrs and not attrs.isspace() and tag != "a"):
            named = {name.lower(): unescape(a or b or c) for name, a, b, c in _ATTRIBUTE.findall(attrs)}
            noise = self._noise(tag, named, parent)
            if noise is not False or tag in CONTAINERS:
                node = _Node(tag, _label(tag, named.get("class", "")), parent, noise is True, self.path, noise is None)
        self.stack.append((tag, node))

    def _close(self, tag: str, limits) -> None:
        """Close the nearest open `tag`, unless one of `limits` stands between."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self._drop_to(i)
                return
            if self.stack[i][0] in limits or self.stack[i][0] in SCOPES or i == 1:
                return

    def _drop_to(self, i: int) -> None:
        if not self.stack[i][1].noise:
            self.flush()
        if self.in_link:
            self.in_link -= sum(t == "a" for t, _ in self.stack[i:])
        del self.stack[i:]

    def end(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                if tag in BLOCKS or tag in DROPPED or tag in SILENT or tag == "header":
                    self._drop_to(i)
                else:
                    # An inline element never closes the blocks around it.
                    if any(t in BLOCKS for t, _ in self.stack[i + 1 :]):
                        return
                    self.in_link -= sum(t == "a" for t, _ in self.stack[i:])
                    del self.stack[i:]
                return

    def text(self, data: str) -> None:
        if not self.stack[-1][1].noise:
            if not self.words:
                self.at = self.stack[-1][1]
            self.words.append(unescape(data) if "&" in data else data)
            if self.in_link:
                self.linked += len(data)

    def read(self, html: str) -> list[tuple[_Node, str, int]]:
        at = 0
        while found := _TOKEN.search(html, at):
            if found.start() > at:
                self.text(html[at : found.start()])
            at = found.end()
            tag = (found[2] or "").lower()
            if not tag:
                continue
            if found[1]:
                self.end(tag)
                continue
            self.start(tag, found[3])
            if tag in RAW:
                close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, at)
                at = close.start() if close else len(html)
        self.text(html[at:])
        self.flush()
        return self._sure()

    def _sure(self) -> list[tuple[_Node, str, int]]:
        """The blocks without those in forms that ask more than they tell, and without parts of unsure name that are short or links."""
        sums: dict[_Node, list[int]] = {}
        for node, text, linked in self.blocks:
            at = node.doubt
            while at is not None and at not in sums:
                sums[at] = [0, 0]
                at = at.parent.doubt
            if node.doubt is not None:
                sums[node.doubt][0] += len(text)
                sums[node.doubt][1] += linked
        gone = set()
        for node in sorted(sums, key=lambda n: -n.depth):
            length, linked = sums[node]
            above = node.parent.doubt
            if linked > LINKED * length or length - linked < PROSE * (1 + (node.controls if node.tag == "form" else 0)):
                gone.add(node)
            elif above is not None:
                sums[above][0] += length
                sums[above][1] += linked
        for node in sorted(sums, key=lambda n: n.depth):
            if node.parent.doubt in gone:
                gone.add(node)
        return [block for block in self.blocks if block[0].doubt not in gone] if gone else self.blocks


def _blocks(html: str, agreed: str | None = None) -> list[tuple[_Node, str, int]]:
    """Blocks without noise. A page that is all noise by its class names is read by its tags alone."""
    found = _Page(agreed).read(html)
    return found or _Page(agreed, by_class=False).read(html)


def _path(node: _Node) -> str:
    labels = []
    while node.parent is not None:
        labels.append(node.label)
        node = node.parent
    return ">".join(reversed(labels))


def _best(blocks: list[tuple[_Node, str, int]]) -> tuple[_Node | None, float]:
    """The article around the best container, and that one's share of the page's scores: text counts less the further down it
    stands, links don't count, and <article> and <main> count more."""
    scores: dict[_Node, float] = defaultdict(float)
    for node, text, linked in blocks:
        worth, at = float(max(0, len(text) - 2 * linked)), node
        while at is not None and worth > 0.5:
            scores[at] += worth * (MAIN_BONUS if at.tag in MAIN else 1.0)
            worth *= DECAY
            at = at.parent
    if not scores:
        return (blocks[0][0], 0.0) if blocks else (None, 0.0)
    top = max(scores.values())
    return _around(next(n for n, s in scores.items() if s == top), blocks), top / sum(scores.values())


def _around(best: _Node, blocks: list[tuple[_Node, str, int]]) -> _Node:
    """The container of the whole article: the <article> around the best one, or else the furthest up,
    below the body and within <main>, that only adds text with few links on each step."""
    way, node = [best], best
    while node.tag not in MAIN and node.parent is not None and node.parent.tag not in ("", "html", "body"):
        node = node.parent
        way.append(node)
    if node.tag == "article":
        return node
    step: dict[_Node, int | None] = {n: i for i, n in enumerate(way)}
    added, linked = [0] * len(way), [0] * len(way)
    for node, text, links in blocks:
        passed = []
        while node is not None and node not in step:
            passed.append(node)
            node = node.parent
        i = step[node] if node is not None else None
        step.update(dict.fromkeys(passed, i))
        if i is not None:
            added[i] += len(text)
            linked[i] += links
    for i in range(1, len(way)):
        if linked[i] > LINKED * added[i]:
            break
        if added[i]:
            best = way[i]
    return best


def vote(html: str) -> tuple[str, float]:
    node, share = _best(_blocks(html))
    return (_path(node), share) if node is not None else ("", 0.0)


def extract_text(html: str, agreed: str | None) -> tuple[str, str]:
    """The text below the agreed path, or else of the page's own best container; and the path used."""
    blocks = _blocks(html, agreed)
    below = [text for node, text, _ in blocks if node.inside]
    if below:
        return "\n\n".join(below), agreed
    best, _ = _best(blocks)
    if best is None:
        return "", ""
    inside: dict[_Node, bool] = {}

    def within(node: _Node) -> bool:
        way = []
        while node is not None and node is not best and node not in inside:
            way.append(node)
            node = node.parent
        answer = node is best or node is not None and inside[node]
        inside.update(dict.fromkeys(way, answer))
        return answer

    return "\n\n".join(text for node, text, _ in blocks if within(node)), _path(best)


@F.arrow_udf(T.StructType([T.StructField("path", T.StringType()), T.StructField("share", T.DoubleType())]))
def _votes(pages: pa.Array) -> pa.Array:
    found = [vote(value.decode("utf-8", "replace")) for value in pages.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["path", "share"])


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("path", T.StringType())]))
def _texts(pages: pa.Array, agreed: pa.Array) -> pa.Array:
    found = [extract_text(value.decode("utf-8", "replace"), path) for value, path in zip(pages.to_pylist(), agreed.to_pylist())]
    return pa.StructArray.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([p for _, p in found], pa.string())], names=["text", "path"])


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path): the path with most votes of each host; a vote weighs its page's share of scores. Ties: the first by name."""
    votes = pages.select(host(F.col(url)).alias("host"), _votes(as_bytes(html)).alias("vote")).where("vote.path <> '' and host <> ''")
    sums = votes.groupBy("host", F.col("vote.path").alias("path")).agg(F.sum(F.round("vote.share", 6).cast("decimal(20,6)")).alias("votes"))
    return sums.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("votes"), "path")).alias("best")).select("host", "best.path")


@any_names
def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """All columns, with text, n_chars (long) and path added or replaced: the main text of each page.

    Left out are menus, headers of the page, footers, sidebars, notices, adverts, forms, scripts,
    styles and reader comments. A form stays if it holds an article or much more prose than controls;
    a block that an unsure word names (a notice, a header, search) stays if it is mostly prose. White space inside a block becomes one space, blocks are joined in
    page order by an empty line. Null and empty pages give an empty text; a page without host, or
    whose host has no agreed path, speaks for itself. Repeated rows are extracted alike.
    """
    modest_batches(pages.sparkSession)
    agreed = host_paths(pages, url, html).select(F.col("host").alias("_host"), F.col("path").alias("_agreed"))
    kept = [c for c in pages.columns if c not in ("text", "n_chars", "path", "_host", "_agreed", "_found", "_html")]
    rows = pages.select(*(f"`{c}`" for c in kept), as_bytes(html).alias("_html"), host(F.col(url)).alias("_host"))
    found = lookup(rows, agreed, "_host").withColumn("_found", _texts("_html", "_agreed"))
    text = F.col("_found.text")
    return found.select(*(f"`{c}`" for c in kept), text.alias("text"), F.length(text).cast("long").alias("n_chars"), F.col("_found.path").alias("path"))
