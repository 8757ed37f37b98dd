"""Registered queries of the corpus operators, with production parameters, and their DuckDB statements."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resolvescope.llm import decontamination, fill_in_middle, filter_audit, grid_order, html_extraction, license_scans, mixing, nearest, simhash, token_counts, toxicity, url_filters, warc
from resolvescope.llm.common import read_table, text_of

URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read_table(spark, sf_dir, "pages"))


OP2_SQL = """
WITH payloads AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS digest FROM pages
), digits AS (
    SELECT *, unnest(range(32)) AS i FROM (SELECT DISTINCT digest FROM payloads)
), bits AS (
    SELECT digest, i, ((('0x' || substr(digest || '0', (5 * i) // 4 + 1, 3))::BIGINT >> (7 - (5 * i) % 4)) & 31)::INT AS five FROM digits
), named AS (
    SELECT digest, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', five + 1, 1), '' ORDER BY i) AS payload_digest FROM bits GROUP BY digest
), firsts AS (
    SELECT digest, max(page_id) AS first FROM payloads GROUP BY digest
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM payloads JOIN named USING (digest) JOIN firsts USING (digest)
"""


MIX_WEIGHTS = {
    ("core",): 2.0, ("extended",): 1.0,
    ("core", "en"): 5.0, ("core", "de"): 2.0, ("core", "es"): 1.5, ("core", "fr"): 1.5,
    ("core", "en", "src0"): 3.0,
}
"""Target weights by domain, language and source; what is not named weighs 1."""


def domain_of_source() -> Column:
    """Sources of one digit are core, all others (and none) extended."""
    return F.when(F.col("source").rlike("^src[0-9]$"), "core").otherwise("extended")


def documents_mixture(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs, domain_of_source, MIX_WEIGHTS, most_epochs=4, seed=42)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_mixture(read_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, vocabulary()).drop("text")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, k=10)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.withColumn("identity", F.round(F.col("n_equal") / F.col("n_tokens"), 4))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scans.scan_licenses(read_table(spark, sf_dir, "documents"))


def noncommercial_urls(pages: DataFrame) -> DataFrame:
    """The listed URLs of the query: pages that carry a non-commercial licence notice."""
    listed = pages.where(text_of("html").contains("CC BY-NC"))
    return listed.select(url_filters.canonical_url(url_filters.url_host(F.col("url")), url_filters.url_path(F.col("url"))).alias("canonical"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return url_filters.filter_urls(pages, URL_RULES, noncommercial_urls(pages), ["page_id"])


OP9_SQL = """
WITH parts AS (
    SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
    SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), named AS (
    SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') AS canonical FROM split
), listed AS (
    SELECT DISTINCT canonical FROM named WHERE html LIKE '%CC BY-NC%' AND canonical <> ''
), rules(verdict, host, path) AS (
    VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fitting AS (
    SELECT p.page_id, p.host, p.path, p.canonical, r.verdict, r.host || r.path AS rule,
           row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS place
    FROM named p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM fitting WHERE place = 1
"""


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interactions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def orders_sql() -> str:
    """Rows (filter_order, step, before, after): the sets of filters before and after a step, as bits."""
    rows = []
    for order in itertools.permutations("ABCDE"):
        before = 0
        for step, letter in enumerate(order, 1):
            after = before | 1 << "ABCDE".index(letter)
            rows.append(f"('{''.join(order)}', {step}, {before}, {after})")
            before = after
    return ", ".join(rows)


OP11_SQL = f"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), firsts AS (
    SELECT text, min(doc_id) AS least FROM texts GROUP BY text
), marks AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), failing AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
           + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text))::INT
           + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask
    FROM texts JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)
), cells AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, mask
), orders(filter_order, step, before, after) AS (VALUES {orders_sql()})
, steps AS (
    SELECT part, filter_order, step, after - before AS own,
           sum(CASE WHEN mask & after = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN mask & before = 0 AND mask & after <> 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN mask & before <> 0 AND mask & (after - before) <> 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN mask = after - before THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN mask & before = 0 AND mask & after <> 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN mask & before = 0 AND mask & after <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM cells CROSS JOIN orders GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM steps
"""


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_order.near_duplicates(read_table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH RECURSIVE usable AS (
    SELECT row_number() OVER () AS place, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT p.vec_id AS a, q.vec_id AS b FROM usable p JOIN usable q ON p.label = q.label AND p.place <> q.place AND len(p.v) = len(q.v)
    WHERE list_cosine_similarity(p.v, q.v) >= 0.93
), reached(a, b) AS (
    SELECT a, b FROM links
    UNION
    SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), counts AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
), lowest AS (
    SELECT a, min(b) AS low FROM reached GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN lowest w ON w.a = e.vec_id
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.fill_in_middle(read_table(spark, sf_dir, "documents")))


OP13_SQL = """
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
           sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
    SELECT *, len(tokens) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM units
), cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS c1, greatest(h1 % (n + 1), h2 % (n + 1)) AS c2,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), pieces AS (
    SELECT *, array_to_string(tokens[1:c1], '') AS prefix, array_to_string(tokens[c1 + 1:c2], '') AS middle, array_to_string(tokens[c2 + 1:], '') AS suffix FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM pieces
"""


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_token_counts": op4_token_counts,
    "op5_nearest": op5_nearest,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_license_scans": op8_license_scans,
    "op9_url_filters": op9_url_filters,
    "op10_simhash": op10_simhash,
    "op11_filter_audit": op11_filter_audit,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES = {
    "op2_warc": OP2_SQL,
    "op8_license_scans": license_scans.scan_sql(),
    "op9_url_filters": OP9_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_embedding_dedup": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
