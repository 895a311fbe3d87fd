"""The queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import jaccard, licenses, media, negatives, neighbours, packing, piecemodel, quality, ranked, sharding, suffixes, warc

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), 1024, 2)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecemodel.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), 4096)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecemodel.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"), 0)


def op9_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 8)


def op11_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).drop("share")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), i % 100 == 0, F.when(i % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


#: Base32 of a SHA-1 in hex: 32 groups of five bits, each inside two hex digits.
BASE32 = "array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST(concat('0x', substr(hex, 5 * i // 4 + 1, 2)) AS INTEGER) >> (3 - 5 * i % 4)) & 31) + 1, 1)), '')"
#: Two vectors' inner product, added up from the first component on.
DOT = "list_reduce(list_prepend(0.0::DOUBLE, list_transform(generate_series(1, len({0})), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE)), lambda x, y: x + y)"
TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLES = {
    "op11_vantage_points": f"""WITH v AS (SELECT vec_id, embedding AS e, {DOT.format('embedding', 'embedding')} AS s FROM embeddings WHERE embedding IS NOT NULL), p AS (SELECT a.vec_id AS query_id, b.vec_id, {DOT.format('a.e', 'b.e')} / (sqrt(a.s) * sqrt(b.s)) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND a.s > 0 AND b.s > 0)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM p) WHERE k <= 5""",
    "op12_hard_negatives": f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST({DOT.format('a.e', 'b.e')} AS BIGINT) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), p AS (SELECT a, b, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.a, p.b, p.s, s.b AS n, s.s AS t, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS k FROM p JOIN s ON s.a = p.a AND NOT same AND 80 * p.s <= 100 * s.s AND s.s <= p.s)
SELECT a AS anchor_id, b AS positive_id, CAST(k AS INTEGER) AS rank, n AS negative_id, s AS positive_score, t AS negative_score FROM n WHERE k <= 5""",
    "op13_ranked_search": f"""WITH l AS (SELECT * FROM (SELECT doc_id, row_number() OVER () AS r, ts, CAST(len(ts) AS BIGINT) AS n FROM (SELECT doc_id, {TERMS} AS ts FROM documents)) WHERE n > 0), z AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM l),
q AS (SELECT DISTINCT item_id, unnest({TERMS}) AS t FROM benchmark), p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM l) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY 1), z),
x AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms))))) AS BIGINT) AS score FROM q JOIN p USING (t) JOIN w USING (t) JOIN l USING (r), z GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM x WHERE score > 0) WHERE k <= 50""",
    "op8_warc": f"""WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS hex, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages), b AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS best FROM p)
SELECT page_id, payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to FROM b""",
}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express whole; the others are tested against brute force or the libraries."""
    return dict(ORACLES)
