"""Registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizdiag.llm import bpe, chunk_bpe, fim, language, mixing, near_text, near_vectors, passages, shards, tokens, topk, urls, whitening

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
TOKEN_LIMIT = 1024
SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    out = language.identify(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op2_near_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of similarity 0.75 or more."""
    return near_text.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of every query vector."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector under cosine 0.95."""
    return near_vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page."""
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law of nearly equal bytes."""
    out = shards.shard_documents(_table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in the mix of its sources."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.token_counts(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, TOKEN_LIMIT)


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated passages, as digests."""
    return passages.digests(_table(spark, sf_dir, "documents"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests, by chunks that documents share."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return chunk_bpe.digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every embedding."""
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at line ends and put in another order, as digests."""
    return fim.digests(_table(spark, sf_dir, "documents"))


_ALL = (
    op1_language, op2_near_text, op3_top_k, op4_near_vectors, op5_url_filter, op6_shards, op7_mix_sources, op8_token_counts,
    op9_passages, op10_bpe_round_trip, op11_chunk_bpe, op12_whitening, op13_fill_in_middle,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLES = {
    "op3_top_k": """
        WITH v AS (
            SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op5_url_filter": r"""
        WITH parsed AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
            FROM pages),
        rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        fitting AS (
            SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
                   row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.host || r.path) DESC) AS n
            FROM parsed p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM parsed p LEFT JOIN fitting f ON f.n = 1 AND p.page_id = f.page_id AND p.host = f.host AND p.path = f.path
    """,
}
