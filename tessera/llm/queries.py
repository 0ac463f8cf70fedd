"""Queries opN_* over whole tables, and the SQL that DuckDB can run for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import alignment, chat, exact_dedup, fingerprints, html_blocks, licenses, ngram_join, packing, prefix_trie, quality, sentencepiece_lattice, sharding, suffix_dedup
from tessera.llm.common import documents


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.round_trip(documents(spark, sf_dir))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(documents(spark, sf_dir))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir)).drop("key", "kept_text")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(documents(spark, sf_dir))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(documents(spark, sf_dir))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_document_fingerprints,
        op3_ngram_jaccard_join,
        op4_quality_classifier,
        op5_license_scan,
        op6_packing,
        op7_suffix_array_dedup,
        op8_exact_dedup,
        op9_chat_formatting,
        op10_html_extraction,
        op11_sharding,
        op12_tokenizer_alignment,
        op13_prefix_trie,
    )
}

SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
nodes AS (SELECT w, min(doc_id) AS node, count(*) AS copies FROM words GROUP BY w),
grams AS (
  SELECT DISTINCT node, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT node, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM nodes WHERE len(w) > 0)),
sizes AS (SELECT node, count(*) AS n FROM grams GROUP BY node),
both_ AS (SELECT a.node AS a, b.node AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.node <> b.node GROUP BY ALL),
links AS (
  SELECT a, b FROM both_ JOIN sizes x ON x.node = a JOIN sizes y ON y.node = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
reach(node, root) AS (
  SELECT node, node FROM nodes UNION SELECT l.a, r.root FROM reach r JOIN links l ON l.b = r.node),
classes AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node),
counts AS (SELECT a AS node, count(*) AS n_links, sum(copies) AS n_linked_docs FROM links JOIN nodes ON nodes.node = b GROUP BY a)
SELECT doc_id, class_id, node AS copy_of, copies AS n_copies, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links,
       CAST(coalesce(n_linked_docs, 0) AS BIGINT) AS n_linked_docs
FROM words JOIN nodes USING (w) JOIN classes USING (node) LEFT JOIN counts USING (node)
""",
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
WINDOW g AS (PARTITION BY h)
""",
    "op5_license_scan": licenses.sql(),
    "op11_sharding": sharding.sql(),
    "op13_prefix_trie": prefix_trie.SQL,
    "op9_chat_formatting": f"""
WITH said AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS said, coalesce(turn, -1) AS k, row_number() OVER () AS row_no FROM conversations),
cut AS (
  SELECT *, CAST(floor((sum(length(said) + {chat.TURN}) OVER (PARTITION BY conv_id ORDER BY k, role, said, row_no) - length(said) - {chat.TURN}) / {chat.PART}) AS BIGINT) AS part
  FROM said),
people AS (SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role <> 'system'),
heads AS (
  SELECT s.*, perspective, s.role = perspective AS own,
    CASE WHEN s.role = perspective THEN '<|im_start|>assistant' || chr(10) WHEN s.role = 'system' THEN '<|im_start|>system' || chr(10)
         ELSE '<|im_start|>user name=' || s.role || chr(10) END AS head
  FROM cut s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
lines AS (SELECT *, head || said || '<|im_end|>' || chr(10) AS line FROM heads),
placed AS (SELECT *, sum(length(line)) OVER (PARTITION BY conv_id, perspective ORDER BY k, role, said, row_no) - length(line) AS place FROM lines)
SELECT conv_id, perspective, part, CAST(min(place) AS BIGINT) AS start, count(*) AS n_turns, string_agg(line, '' ORDER BY k, role, said, row_no) AS text,
  coalesce(string_agg(CAST(place + length(head) AS BIGINT) || '-' || CAST(place + length(line) - 1 AS BIGINT), ',' ORDER BY k, role, said, row_no) FILTER (WHERE own), '') AS masks,
  CAST(coalesce(sum(length(line) - 1 - length(head)) FILTER (WHERE own), 0) AS BIGINT) AS n_masked
FROM placed GROUP BY conv_id, perspective, part
""",
}
