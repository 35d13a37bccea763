"""The registered queries of the subpackage, thin over its operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, merkle, mixing, ngram_join, ppm, quality_classifier, quality_rules, quotation, sentencepiece_codec, simhash, topk_join, url_filter, warc_store
from .common import scratch_path, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")

URL_RULES = (
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
)
BLOCKED_LABELS = ("ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.token_digests(table(spark, sf_dir, "documents"), MODEL)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk_join.topk(rows.where("vec_id % 50 = 0"), rows)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_classifier.featured(table(spark, sf_dir, "documents"), carry=["doc_id"])
    scored = quality_classifier.score(rows, quality_classifier.fit(rows, table(spark, sf_dir, "labels")))
    return scored.select("row.doc_id", "text_score", "meta_score", "score", "kept")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, URL_RULES, url_filter.spam_hosts(pages, BLOCKED_LABELS))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.conversations(table(spark, sf_dir, "conversations"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select("row.doc_id", *quality_rules.STATS, "base_failed", "kept")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    scored = ppm.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archive")
    warc_store.write_archive(table(spark, sf_dir, "pages"), path)
    return warc_store.read_digests(spark, path).withColumnRenamed("record_id", "page_id")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_classes(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, hit = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.manifest(docs, "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], "lang", {"n_chars": F.col("n_chars") + 1}, hit)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_topk": op2_topk,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_url_filters": op4_url_filters,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_quality_rules": op6_quality_rules,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_warc": op8_warc,
    "op9_ngram_join": op9_ngram_join,
    "op10_mixing": op10_mixing,
    "op11_simhash": op11_simhash,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_LABELS = ", ".join(f"'{x}'" for x in BLOCKED_LABELS)


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(({c})::VARCHAR))::VARCHAR || ':' || ({c})::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


ORACLE_SQL: dict[str, str] = {
    "op2_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
""",
    "op4_url_filters": f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(verdict, rhost, rpath) AS (VALUES {", ".join(f"('{x.verdict}', '{x.host}', '{x.path}')" for x in URL_RULES)}),
fit AS (SELECT page_id, host, path, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS k
        FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT u.page_id, u.host, u.path, fit.rule,
       coalesce(fit.verdict, CASE WHEN list_has_any(string_split(u.host, '.'), [{_LABELS}]) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fit ON u.page_id = fit.page_id AND fit.k = 1
""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(d, 1 + 5 * (i // 4), 5))::BIGINT >> (5 * (3 - i % 4))) % 32 + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER (PARTITION BY html) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < max(page_id) OVER (PARTITION BY html) THEN max(page_id) OVER (PARTITION BY html) END AS refers_to
FROM p
""",
    "op9_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 5 * c >= 4 * (a.n + b.n - c)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x),
k AS (SELECT x, count(*) AS k FROM l GROUP BY x)
SELECT w.doc_id, least(w.doc_id, c.y) AS class_id, coalesce(k.k, 0) AS n_links, coalesce(n.n, 0) AS n_ngrams
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.x LEFT JOIN k ON w.doc_id = k.x
""",
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("n_chars + 1")} AS changed,
    list_transform(range(8 * length(doc_id::VARCHAR)), lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1)) ELSE 0 END::BIGINT) AS bits FROM documents),
c AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], bits), lambda x, y: xor(xor(x, y) >> 1, 3988292384::BIGINT * (xor(x, y) & 1))), 4294967295::BIGINT) AS crc FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM c),
nodes AS (SELECT lang, 0 AS level, idx, n, leaf AS h FROM l
          UNION ALL SELECT lang, level + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY lang, level, idx // 2),
t AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
top AS (SELECT 0 AS level, idx, n, subroot AS h FROM t
        UNION ALL SELECT level + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 2),
f AS (SELECT doc_id, lang, idx, 0 AS level, n, CASE WHEN crc % 7 = 0 THEN changed ELSE leaf END AS h, '' AS proof FROM l
      UNION ALL SELECT f.doc_id, f.lang, f.idx // 2, f.level + 1, (f.n + 1) // 2, sha256(CASE WHEN f.idx % 2 = 0 THEN f.h || coalesce(s.h, '') ELSE s.h || f.h END), f.proof || coalesce(s.h, '')
      FROM f LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM f.lang AND s.level = f.level AND s.idx = xor(f.idx, 1) WHERE f.n > 1),
g AS (SELECT f.doc_id, f.lang, t.idx, 0 AS level, t.n, f.h, f.proof FROM f JOIN t ON f.lang IS NOT DISTINCT FROM t.lang WHERE f.n = 1
      UNION ALL SELECT g.doc_id, g.lang, g.idx // 2, g.level + 1, (g.n + 1) // 2, sha256(CASE WHEN g.idx % 2 = 0 THEN g.h || coalesce(s.h, '') ELSE s.h || g.h END), g.proof || coalesce(s.h, '')
      FROM g LEFT JOIN top s ON s.level = g.level AND s.idx = xor(g.idx, 1) WHERE g.n > 1)
SELECT l.doc_id, l.leaf, t.subroot, top.h AS root, sha256(g.proof) AS proof_sha256, g.h AS folded_root, g.h = top.h AS verified
FROM l JOIN t ON l.lang IS NOT DISTINCT FROM t.lang JOIN g ON g.doc_id = l.doc_id AND g.n = 1 JOIN top ON top.n = 1
""",
}
