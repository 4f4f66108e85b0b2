"""The thin queries ``opN_<name>`` over the whole driver tables, and SQL for those that it can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, fill_middle, fingerprint, jaccard_join, language_id, mixing, pieces, quality, secret_scan, url_filter, warc, whitening
from .common import fresh_path, table

URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

#: Wanted shares of tokens.
SOURCE_SHARES = {"src0": 0.2} | {f"src{i}": 0.8 / 19 for i in range(1, 20)}
LANGUAGE_SHARES = {"en": 0.58, "fr": 0.15, "de": 0.15, "es": 0.12}
TOPIC_SHARES = {"prose": 0.9, "short": 0.05, "table": 0.03, "marked": 0.02}
MIX_BUDGET = 0.6


def model_path() -> str:
    """The piece model: ``SCRIPTORIUM_PIECES`` or the installed public one."""
    if found := os.environ.get("SCRIPTORIUM_PIECES"):
        return found
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), rules)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_digests(table(spark, sf_dir, "documents"), model_path())


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def mixed(docs: DataFrame, budget: float = MIX_BUDGET, within_rows: bool = False) -> DataFrame:
    targets = {"source": SOURCE_SHARES, "lang": LANGUAGE_SHARES, "topic": TOPIC_SHARES}
    columns = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic(F.col("text"))}
    return mixing.mix(docs, targets, columns, mixing.token_count(F.col("text")), budget, within_rows=within_rows)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = [F.col(f"mix_{m}_{x}").alias(f"{m}_{x}") for m in ("source", "lang", "topic") for x in ("goal", "share")]
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "mix_source", "mix_lang", "mix_topic", *[F.col(f"mix_{x}").alias(x) for x in ("tokens", "weight", "expected", "probability", "copies", "kept")], *shares)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.remainder(F.col("doc_id"), 3) == 1
    model = language_id.train(docs.where(~held_out))
    return language_id.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.share").alias("share"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), "doc_id", "text", num=80, den=100)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(language_id.remainder(F.col("doc_id"), 4) != 2)
    model = quality.train(docs, labels)
    scored = quality.score(docs.select("doc_id", "text", (language_id.remainder(F.col("doc_id"), 4) == 2).alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), all_digests=True)
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    each = rows.select(F.col("id").alias("vec_id"), "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "value"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"), F.get("explained", "at").alias("explained"), "identity_error")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_nearest_neighbours, op3_fingerprints, op4_warc, op5_pieces, op6_secret_scans, op7_mixing, op8_language_id, op9_jaccard_join, op10_quality, op11_exact_dedup, op12_whitening, op13_fill_in_middle)}


_OP1 = r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), r(action, rule_host, rule_path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), best AS (
  SELECT page_id, host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(action, length(rule_host || rule_path)) AS action
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id, host, path
)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.action, 'allow') AS verdict
FROM p LEFT JOIN best ON p.page_id = best.page_id AND p.host = best.host AND p.path = best.path
"""


_OP9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), e AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), r AS (
  SELECT doc_id AS id, doc_id AS label FROM documents UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.id WHERE r.label < e.b
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(label) FROM r WHERE r.id = d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""


_OP11 = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM t WINDOW same AS (PARTITION BY body)
"""


_OP13 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || doc_id) AS h FROM documents
), u AS (
  SELECT doc_id, body, regexp_extract_all(body, '(?s)[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t
), c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT doc_id, body, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": _OP1, "op9_jaccard_join": _OP9, "op11_exact_dedup": _OP11, "op13_fill_in_middle": _OP13}
