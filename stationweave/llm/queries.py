"""The operators of this folder as queries over the given tables, with check SQL where SQL can say it."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    byte_bpe, chat_format, context_tree, decontamination, filter_audit, html_extraction, language_id, merkle_manifest, near_dedup, quality_rules, substring_dedup, token_counts,
    url_filters,
)
from .common import remainder, ship, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, folder) under its own name; Python workers get this package first."""

    def add(fn):
        @wraps(fn)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = shipped
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return shipped

    return add


BPE_RANKS = "byte_bpe_50k.tiktoken"

# The rules of the URL query, as (verdict, host, path).
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path(BPE_RANKS)).select("doc_id", "n_words", "n_tokens")


# The given pages name no aliases, so the check covers the rules; tests cover the links.
@query(
    """
    WITH parts AS (
      SELECT page_id, url,
        CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
        CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
      FROM pages),
    rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
      ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
    best AS (
      SELECT url, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
        arg_max(verdict, length(rule_host || rule_path)) AS verdict
      FROM (SELECT DISTINCT url, host, path FROM parts) p
      JOIN rules ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path)
      GROUP BY url)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
    FROM parts LEFT JOIN best USING (url)
    """
)
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_filters.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query()
def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 10) == 0, F.lit(False))
    return context_tree.score(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query(
    r"""
    WITH doc AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    item AS (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    span AS (
      SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM item WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT size FROM span),
    placed AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM doc, sizes WHERE len(w) >= size),
    hit AS (
      SELECT doc_id, size, s, item_id
      FROM (SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS win FROM placed) JOIN span USING (size, win)),
    words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hit) GROUP BY doc_id),
    items AS (
      SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """
)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contaminate(docs, table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query()
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BPE_RANKS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, decoded="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = language_id.fit(docs.where(~held_out).select("text", "lang"))
    return language_id.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


@query()
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.judge(docs).drop("text", "lang")


@query()
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extraction.extract(pages).select("page_id", "url", "text", "n_chars")


@query(
    r"""
    WITH RECURSIVE doc AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    shingle AS (
      SELECT DISTINCT doc_id, hash(array_to_string(w[s:s + 2], ' ')) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS s FROM doc WHERE len(w) > 0)),
    size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
    pair AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
      FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    link AS (
      SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach(doc_id, other) AS (
      SELECT a, b FROM both_ways
      UNION
      SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
    least_of AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
      doc_id <= coalesce(m, doc_id) AS kept
    FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN least_of USING (doc_id)
    """
)
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, size=3, threshold=85).drop("text")


@query(
    r"""
    WITH RECURSIVE doc AS (
      SELECT doc_id, lang, n_chars, list_reduce(
          list_prepend(4294967295, list_transform(split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
          lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) AS crc,
        concat_ws('', coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
          coalesce(strlen(lang) || ':' || lang, '-')) AS head, coalesce(strlen(text) || ':' || text, '-') AS tail
      FROM documents),
    hashed AS (
      SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
        sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) AS other, xor(crc, 4294967295) % 7 = 0 AS tampered
      FROM doc),
    leaf AS (
      SELECT doc_id, lang, leaf, CASE WHEN tampered THEN other ELSE leaf END AS told,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n
      FROM hashed),
    level AS (
      SELECT lang, 0 AS lvl, place, n, leaf AS node FROM leaf
      UNION ALL
      SELECT lang, lvl + 1, place // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY place)) FROM level WHERE n > 1 GROUP BY lang, lvl, place // 2, n),
    sub AS (
      SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM level WHERE n = 1),
    upper AS (
      SELECT 0 AS lvl, place, n, subroot AS node FROM sub
      UNION ALL
      SELECT lvl + 1, place // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY place)) FROM upper WHERE n > 1 GROUP BY lvl, place // 2, n),
    walk AS (
      SELECT doc_id, lang, leaf, 0 AS lvl, place, n, '' AS siblings, told AS folded FROM leaf
      UNION ALL
      SELECT w.doc_id, w.lang, w.leaf, w.lvl + 1, w.place // 2, (w.n + 1) // 2, w.siblings || coalesce(s.node, ''),
        sha256(CASE WHEN w.place % 2 = 1 THEN s.node || w.folded ELSE w.folded || coalesce(s.node, '') END)
      FROM walk w LEFT JOIN level s ON s.lang IS NOT DISTINCT FROM w.lang AND s.lvl = w.lvl AND s.place = xor(w.place, 1)
      WHERE w.n > 1),
    climb AS (
      SELECT w.doc_id, w.leaf, s.subroot, 0 AS lvl, s.place, s.n, w.siblings, w.folded
      FROM walk w JOIN sub s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
      UNION ALL
      SELECT c.doc_id, c.leaf, c.subroot, c.lvl + 1, c.place // 2, (c.n + 1) // 2, c.siblings || coalesce(u.node, ''),
        sha256(CASE WHEN c.place % 2 = 1 THEN u.node || c.folded ELSE c.folded || coalesce(u.node, '') END)
      FROM climb c LEFT JOIN upper u ON u.lvl = c.lvl AND u.place = xor(c.place, 1)
      WHERE c.n > 1)
    SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = root AS verified
    FROM climb, (SELECT node AS root FROM upper WHERE n = 1) WHERE n = 1
    """
)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(remainder("doc_id", 7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle_manifest.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", {"n_chars": tampered})
    siblings = F.array_join(F.transform("proof", lambda s: F.substring(s, 2, 64)), "")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


@query(
    r"""
    WITH doc AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
    first AS (SELECT t, min(doc_id) AS least FROM doc GROUP BY t),
    label AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    judged AS (
      SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
        CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
        + 4 * CAST(100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(t) AS INT)
        + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > least, FALSE) AS INT) AS mask
      FROM doc LEFT JOIN first USING (t) LEFT JOIN label USING (doc_id)),
    mask AS (
      SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged GROUP BY part, mask),
    bit(name, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    chain AS (
      SELECT v.name || w.name || x.name || y.name || z.name AS filter_order,
        [v.b, w.b, x.b, y.b, z.b] AS bits
      FROM bit v, bit w, bit x, bit y, bit z
      WHERE v.b | w.b | x.b | y.b | z.b = 31),
    place AS (
      SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before
      FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM chain)),
    counted AS (
      SELECT part, filter_order, step, own,
        coalesce(sum(n) FILTER (mask & (before | own) = 0), 0) AS kept,
        coalesce(sum(n) FILTER (mask & before = 0 AND mask & own > 0), 0) AS removed,
        coalesce(sum(n) FILTER (mask & before > 0 AND mask & own > 0), 0) AS redundant,
        coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
        coalesce(sum(good) FILTER (mask & before = 0 AND mask & own > 0), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own > 0), 0) AS toxic_lost
      FROM mask, place GROUP BY part, filter_order, step, own, before)
    SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
      CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
      CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
    FROM counted
    """
)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    failures = filter_audit.text_failures(docs)
    labelled = filter_audit.with_labels(failures, table(spark, sf_dir, "labels"), good=F.col("quality") == 1, toxic=F.col("toxic") == 1)
    return filter_audit.audit(labelled, filter_audit.TEXT_FILTERS, "part", ["good", "toxic"], "n")


# Marks of the default template: 31, 13, 4 and 20 characters a turn by role, 3 at the start.
@query(
    r"""
    WITH said AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
      FROM (SELECT conv_id, turn, role, text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
    sized AS (
      SELECT *, CASE role WHEN 'system' THEN 31 WHEN 'user' THEN 13 WHEN 'assistant' THEN 4 ELSE 20 + length(role) END
        + length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*(/?(INST|SYSTEM_PROMPT|ROLE)|/TURN)\]')) AS chars
      FROM said)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
    FROM sized GROUP BY conv_id
    """
)
def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BPE_RANKS)
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = [(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]
    rows = said.union(spark.createDataFrame(planted, "conv_id long, turn long, role string, text string"))
    return chat_format.read_back(chat_format.format_conversations(rows, path, public_tokenizers.PATTERN), path)
