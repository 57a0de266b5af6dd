"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import (
    adaptive_scan, bwt_dedup, chat_repair, license_scan, line_dedup, mixing, packing, period_runs, pii, pivot_search, prefix_trie,
    quality, simhash)
from pagequarry.llm.common import table


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    machine = quality.train(docs, table(spark, folder, "labels"))
    return quality.classify(docs.select("doc_id", "text", "n_chars"), machine).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_run_length_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return bwt_dedup.drop_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_pivot_search(spark: SparkSession, folder: str) -> DataFrame:
    return pivot_search.top_k(table(spark, folder, "embeddings"))


def op4_adaptive_scan(spark: SparkSession, folder: str) -> DataFrame:
    return adaptive_scan.nearest(table(spark, folder, "embeddings"))


def op5_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op6_role_repair(spark: SparkSession, folder: str) -> DataFrame:
    return chat_repair.repair(table(spark, folder, "conversations"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.drop_shared_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_concatenate_and_cut(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.span_list(base), 256).alias("base_sha256"),
                        pii.span_list(F.col("spans")).alias("spans"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


def op12_period_runs(spark: SparkSession, folder: str) -> DataFrame:
    return period_runs.digest(period_runs.periodic_runs(table(spark, folder, "documents").select("doc_id", "text"), cycles=True))


def op13_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.digest(license_scan.scan_licenses(table(spark, folder, "documents").select("doc_id", "text")))


QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_run_length_dedup, op3_pivot_search, op4_adaptive_scan, op5_simhash_near_dedup, op6_role_repair,
    op7_line_dedup, op8_source_mixing, op9_concatenate_and_cut, op10_personal_data, op11_prefix_trie, op12_period_runs,
    op13_license_scan)}

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES = {
    "op7_line_dedup": f"""
WITH base AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
parts AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM base),
keyed AS (SELECT *, translate(trim(line, {_BLANKS}), {_UPPER}) AS key FROM parts),
shared AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
           GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS dropped
           FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op11_prefix_trie": r"""
WITH RECURSIVE bits AS (SELECT b, 0 AS step, b AS v FROM range(256) r(b)
  UNION ALL SELECT b, step + 1, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END) FROM bits WHERE step < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE step = 8),
own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
          PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), left(coalesce(text, ''), 24)) AS pos
        FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, xor(4294967295, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
          lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT)) % 4 AS h
        FROM (SELECT DISTINCT conv_id FROM own), crc),
built AS (SELECT i.conv_id, 0 AS src, pos, role, text FROM ids i JOIN own o ON o.conv_id = i.conv_id - i.conv_id % 20 WHERE pos <= h
          UNION ALL SELECT i.conv_id, 1, pos, role, text FROM ids i JOIN own o ON o.conv_id = i.conv_id WHERE pos > h),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY src, pos) AS depth,
            md5(strlen(role) || ':' || role || text) AS digest, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM built),
paths AS (SELECT conv_id, depth, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key, words FROM turns
          UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
nodes AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM paths GROUP BY key, depth),
whole AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
ends AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM paths JOIN whole USING (conv_id, depth) GROUP BY key),
kids AS (SELECT left(key, (depth - 1) * 32) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (SELECT p.key, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (k.key IS NULL) AS leaves
          FROM nodes n LEFT JOIN kids k ON k.key = n.key JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.key)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.leaves AS n_leaves,
  b.saved::BIGINT AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM nodes n JOIN below b ON b.key = n.key LEFT JOIN kids k ON k.key = n.key LEFT JOIN ends e ON e.key = n.key
LEFT JOIN nodes up ON n.depth > 0 AND up.key = left(n.key, (n.depth - 1) * 32)""",
}
