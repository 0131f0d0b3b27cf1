"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, kdtree, metric_join, minhash, mixing, packing, passages, pieces, ppm, prefix_trie, quality, suffix, warc
from .tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op7_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "text_key")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.link(table(spark, sf_dir, "embeddings"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_passages(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file; the same path must exist on the executors."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def llm_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_near_duplicates, op3_quality, op4_top_k, op5_near_vectors, op6_warc, op7_ppm_score, op8_mix_sources, op9_passages, op10_pack,
                                      op11_align, op12_prefix_trie, op13_pieces)} | {"pipeline": pipeline}


WARC_SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    f AS (SELECT page_id, sha256(html) AS payload_digest, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes FROM p),
    g AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM f)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to FROM g"""


#: Rebuilt conversations as lists of turns; the CRC-32 of a decimal is worked out from its polynomial. A node is a prefix list.
TRIE_SQL = """
    WITH RECURSIVE bits AS (
        SELECT byte, byte AS value, 0 AS step FROM (SELECT unnest(range(256)) AS byte)
        UNION ALL
        SELECT byte, CASE WHEN value & 1 = 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END, step + 1 FROM bits WHERE step < 8),
    crc_table AS (SELECT byte, value FROM bits WHERE step = 8),
    ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS digits FROM conversations WHERE conv_id IS NOT NULL),
    crc AS (
        SELECT conv_id, digits, 0 AS place, CAST(4294967295 AS BIGINT) AS value FROM ids
        UNION ALL
        SELECT c.conv_id, c.digits, c.place + 1, xor(t.value, c.value >> 8)
        FROM crc c JOIN crc_table t ON t.byte = xor(c.value & 255, CAST(ascii(substr(c.digits, c.place + 1, 1)) AS BIGINT)) WHERE c.place < length(c.digits)),
    heads AS (SELECT conv_id, CAST(xor(value, 4294967295) % 6 AS INT) AS h FROM crc WHERE place = length(digits)),
    turns AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
              FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    rebuilt AS (SELECT t.conv_id, list_concat(coalesce(b.own, [])[:h], t.own[h + 1:]) AS whole
                FROM turns t JOIN heads USING (conv_id) LEFT JOIN turns b ON b.conv_id = t.conv_id - t.conv_id % 100),
    paths AS (SELECT conv_id, whole, unnest(range(0, len(whole) + 1)) AS depth FROM rebuilt),
    nodes AS (SELECT whole[:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(CASE WHEN depth > 0 THEN length(whole[depth].text) ELSE 0 END) AS size,
                     string_agg(CASE WHEN depth = len(whole) THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends
              FROM paths GROUP BY whole[:depth], depth),
    ancestors AS (SELECT n.path AS below, n.size * (n.n_convs - 1) AS saved, unnest(range(0, n.depth + 1)) AS up FROM nodes n),
    childless AS (SELECT path FROM nodes EXCEPT SELECT path[:depth - 1] FROM nodes WHERE depth > 0),
    subtree AS (SELECT below[:up] AS path, sum(saved) AS saved, count(c.path) AS n_leaves FROM ancestors a LEFT JOIN childless c ON c.path = a.below GROUP BY below[:up]),
    kids AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY path[:depth - 1])
    SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
           CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
    FROM nodes n JOIN subtree s USING (path) LEFT JOIN kids k USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[:n.depth - 1]"""


def llm_oracles() -> dict[str, str]:
    import corpus_pipeline
    own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return own | {"op4_top_k": kdtree.top_k_sql(), "op5_near_vectors": metric_join.link_sql(), "op6_warc": WARC_SQL, "op12_prefix_trie": TRIE_SQL}
