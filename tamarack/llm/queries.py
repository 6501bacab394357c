"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embeddings, language_id, line_quality, main_text, packing, periodic_runs, prefix_trie, private_data, quality_classifier, simhash, substrings, warc
from .common import table


def vocabulary() -> str:
    """Path of the byte-level vocabulary file in the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = line_quality.fit(documents, table(spark, sf_dir, "labels"))
    return line_quality.judge(documents, model)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language_id.predict(documents, language_id.fit(documents))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(documents, table(spark, sf_dir, "labels"))
    return quality_classifier.scored(documents, model)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.report(table(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_bpe": op3_bpe,
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_warc": op7_warc,
    "op8_embeddings": op8_embeddings,
    "op9_private_data": op9_private_data,
    "op10_substrings": op10_substrings,
    "op11_main_text": op11_main_text,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_prefix_trie": op13_prefix_trie,
}
#: Base32 of a SHA-1: each five hex digits are four signs of the alphabet.
_BASE32 = """
  list_aggregate(list_transform(generate_series(0, 7), lambda g:
    list_aggregate(list_transform(generate_series(0, 3), lambda k:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, 1 + 5 * g, 5))::BIGINT >> (15 - 5 * k)) & 31)::INT, 1)
    ), 'string_agg', '')), 'string_agg', '')
"""
#: CRC-32 of a conv_id's decimal digits, bit by bit.
_CRC32 = """
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, b:
    list_reduce(list_prepend(xor(crc, b), range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295::BIGINT)
"""

ORACLE_SQL: dict[str, str] = {
    "op7_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS sha, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d""",
    "op8_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.other),
component AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN component c USING (vec_id) LEFT JOIN degree d USING (vec_id)""",
    "op13_prefix_trie": f"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns, ({_CRC32} % 9)::INT AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS turns
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
),
member AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt),
node AS (
  SELECT turns[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         string_agg(CASE WHEN len(turns) = depth THEN conv_id END::VARCHAR, ',' ORDER BY conv_id) AS ends
  FROM member GROUP BY prefix, depth
),
child AS (SELECT prefix[1:depth - 1] AS prefix, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
known AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM node n LEFT JOIN child c USING (prefix, depth)),
above AS (SELECT prefix AS whole, n_convs, n_children, depth AS own, unnest(range(depth + 1)) AS depth FROM known),
subtree AS (
  SELECT whole[1:depth] AS prefix, depth, count(*) FILTER (n_children = 0) AS n_leaves,
         sum(CASE WHEN own > 0 THEN (n_convs - 1) * strlen(whole[own].text) ELSE 0 END) AS saved_tokens
  FROM above GROUP BY ALL
)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(k.ends, '')) AS ends_sha256
FROM known k JOIN subtree s USING (prefix, depth) LEFT JOIN node p ON p.depth = k.depth - 1 AND p.prefix = k.prefix[1:k.depth - 1]""",
}
