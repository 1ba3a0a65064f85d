"""URL filters with redirect equivalence.

Rules judge addresses by host and path. Pages that redirect to one another, or name one another as
their canonical address, are aliases: connected components over those links carry a block from one
alias to all, unless an alias is explicitly allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from stationweave.session import config_table

from .common import any_names, LOWER, UPPER, settle, small
from .components import connected_components

# How a page names its canonical address, and where it sends the reader.
CANONICAL = r"""(?i)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["'][^"'>]*?\burl\s*=\s*([^"'\s>]+)"""


def host(url: str | F.Column) -> F.Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: str | F.Column) -> F.Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: str | F.Column) -> F.Column:
    """Host, path and query: what names a page whatever its scheme and fragment. Null without ://."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host(url), path(url), query))


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): addresses that a page's own markup says are the same page. Relative targets are taken from the page's host."""
    found = pages.select(F.col(url).alias("url"), F.explode(F.array(*(F.replace(F.regexp_extract(html, p, 1), F.lit("&amp;"), F.lit("&")) for p in (CANONICAL, REFRESH)))).alias("to"))
    scheme = F.regexp_extract("url", r"(?s)^(.*?)://", 1)
    folder = F.regexp_extract(path(F.col("url")), r"(?s)^(.*/)", 1)
    whole = (
        F.when(F.col("to").contains("://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(scheme, F.lit(":"), "to"))
        .when(F.col("to").startswith("/"), F.concat(scheme, F.lit("://"), host(F.col("url")), "to"))
        .otherwise(F.concat(scheme, F.lit("://"), host(F.col("url")), F.when(folder == "", "/").otherwise(folder), "to"))
    )
    return found.where("to <> ''").withColumn("whole", whole).select(address(F.col("url")).alias("a"), address(F.col("whole")).alias("b")).where("a <> b").distinct()


def _longest_rule(urls: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Per url the longest rule that fits: (url, rule, rule_verdict). Equal lengths: allow first, then by name."""
    listed, _ = small(config_table(urls.sparkSession, [(h.lower(), p, v) for v, h, p in rules], "rule_host string, rule_path string, rule_verdict string").distinct())
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = urls.select("url", "path", F.explode(suffixes).alias("rule_host")).join(listed, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = F.min(F.struct((-F.length(rule)).alias("size"), "rule_verdict", rule.alias("rule")))
    return fitting.groupBy("url").agg(best.alias("best")).select("url", "best.rule", "best.rule_verdict")


@any_names
def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], redirects: DataFrame | None = None, url: str = "url", html: str = "html", default: str = "allow") -> DataFrame:
    """All columns, with host, path, rule, verdict and component added or replaced.

    rules are (verdict, host, path). A rule fits its host, all subdomains, and paths that start with
    its path; the longest rule decides. Where none fits, a page is blocked if an alias is blocked and
    no alias is allowed by a rule, else it gets the default. redirects are further (from, to) urls,
    such as a crawler's log; those of the pages' own markup always count. component is the least
    address among the aliases, null for a page without alias.

    A null url, or one without ://, has an empty host and path, fits no rule and has no aliases.
    Repeated rows get the same verdict each; an empty table stays empty. Rules and components are
    worked out once per distinct url, so a url that holds most rows costs no more than any other.
    """
    added = ("host", "path", "rule", "verdict", "component", "_url", "_address")
    rows = pages.select(*(f"`{c}`" for c in pages.columns if c not in added), F.col(url).alias("_url"))
    edges = links(pages, url, html)
    if redirects is not None:
        a, b = redirects.columns
        edges = edges.union(redirects.select(address(F.col(a)), address(F.col(b)))).where("a <> b")
    distinct = pages.select(F.col(url).alias("url")).where(F.col(url).isNotNull()).distinct()
    ruled = settle(distinct.withColumns({"host": host(F.col("url")), "path": path(F.col("url")), "address": address(F.col("url"))}).transform(lambda u: u.join(_longest_rule(u, rules), "url", "left")))
    groups = settle(connected_components(edges))
    # Rules also judge aliases that are no page of the table.
    aliases = groups.select("node", "component", F.concat(F.lit("x://"), "node").alias("url"))
    verdicts = _longest_rule(aliases.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).distinct(), rules)
    decided = aliases.join(verdicts, "url", "left").groupBy("component").agg(
        F.max(F.col("rule_verdict") == "allow").alias("allowed"), F.max(F.col("rule_verdict") == "block").alias("blocked")
    )
    carried = groups.join(decided, "component").select(F.col("node").alias("address"), "component", F.when(F.col("blocked") & ~F.coalesce("allowed", F.lit(False)), "block").alias("carried"))
    verdict = F.coalesce("rule_verdict", "carried", F.lit(default)).alias("verdict")
    known = ruled.join(carried, "address", "left").select(F.col("url").alias("_url"), "rule", verdict, "component")
    # A page's own columns may clash with the names above, so only new names meet in the join.
    joined = rows.join(known, "_url", "left")
    return joined.withColumns({"host": host(F.col("_url")), "path": path(F.col("_url")), "verdict": F.coalesce("verdict", F.lit(default))}).drop("_url")
