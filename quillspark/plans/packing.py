"""Queries of tokenizing and packing, with the byte tokenizer, which needs no vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import byte_tokens
from ..operators import packing
from ..operators.tokenizer import encoded, round_trip_rate, token_diagnostics
from ..sources.tables import table

_BLOCK = 512
#: A tokenizer file for the queries of the encoder; the operators take any.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "lang", "text").where("text is not null").select(F.col("doc_id").alias("id"), "lang", "text")


def byte_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).withColumn("tokens", byte_tokens(F.col("text")))


def byte_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of byte_documents; texts become tokens where blocks are made."""
    return packing.pack_blocks(_texts(spark, folder).select("id", F.col("text").cast("binary").alias("bytes")), _BLOCK, tokens_col="bytes", tokens=packing.BYTES)


def byte_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = byte_documents(spark, folder)
    return rows.select(F.col("id").alias("doc_id"), F.size("tokens").alias("tokens"), F.aggregate("tokens", F.lit(0).cast("long"), lambda s, t: s + t).alias("token_sum"))


def token_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return packing.token_offsets(byte_documents(spark, folder)).select(F.col("id").alias("doc_id"), "start")


def pack_blocks(spark: SparkSession, folder: str) -> DataFrame:
    blocks = byte_blocks(spark, folder)
    return blocks.select("block_id", F.md5(F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",")).alias("tokens_md5"))


def packing_stats(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packing_stats(byte_documents(spark, folder), _BLOCK)


def split_at_eos(spark: SparkSession, folder: str) -> DataFrame:
    found = packing.split_at_eos(byte_blocks(spark, folder), _BLOCK)
    return found.select("document", F.size("tokens").alias("tokens"))


def eos_positions(spark: SparkSession, folder: str) -> DataFrame:
    return packing.eos_positions(byte_blocks(spark, folder), _BLOCK)


def byte_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    rows = byte_documents(spark, folder).withColumn("lang", F.lower(F.coalesce("lang", F.lit("none"))))
    return token_diagnostics(rows, by=("lang",))


def bpe_documents(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(_texts(spark, folder), "id", "text", TOKENIZER)


def bpe_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    return token_diagnostics(bpe_documents(spark, folder))


def bpe_packing_stats(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packing_stats(bpe_documents(spark, folder), _BLOCK)


def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip_rate(_texts(spark, folder), "id", "text", TOKENIZER)


_LEN = "l AS (SELECT doc_id, text, strlen(text) AS n FROM documents WHERE text IS NOT NULL), o AS (SELECT *, coalesce(sum(n + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l)"
_STREAM = f"{_LEN}, hx AS (SELECT doc_id, start, n, hex(encode(text)) AS h FROM o), tok AS (SELECT start + unnest(range(n + 1)) AS p, unnest(list_append(list_transform(range(n), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::INT + 2), 0)) AS t FROM hx)"
_PACKED = f"{_STREAM}, total AS (SELECT (count(*) // {_BLOCK}) * {_BLOCK} AS m FROM tok), packed AS (SELECT p, t FROM tok, total WHERE p < m)"

QUERIES = {
    "bpe_diagnostics": (bpe_diagnostics, ""),
    "bpe_packing_stats": (bpe_packing_stats, ""),
    # a byte-level vocabulary loses nothing
    "bpe_round_trip": (bpe_round_trip, "SELECT count(*) AS documents, 1.0::DOUBLE AS round_trip_rate FROM documents WHERE text IS NOT NULL"),
    "byte_token_counts": (byte_token_counts, f"WITH {_STREAM} SELECT doc_id, n::INT AS tokens, coalesce(list_sum(list_transform(range(n), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::INT + 2)), 0)::BIGINT AS token_sum FROM hx"),
    "token_offsets": (token_offsets, f"WITH {_LEN} SELECT doc_id, start FROM o"),
    "pack_blocks": (pack_blocks, f"WITH {_PACKED} SELECT (p // {_BLOCK})::BIGINT AS block_id, md5(string_agg(t::VARCHAR, ',' ORDER BY p)) AS tokens_md5 FROM packed GROUP BY 1"),
    "packing_stats": (packing_stats, f"SELECT count(*) AS examples, sum(length(text))::BIGINT AS characters, sum(strlen(text))::BIGINT AS text_tokens, count(*) AS eos_tokens, (sum(strlen(text)) + count(*))::BIGINT AS stream_tokens, ((sum(strlen(text)) + count(*)) // {_BLOCK})::BIGINT AS sequences, ((sum(strlen(text)) + count(*)) // {_BLOCK} * {_BLOCK})::BIGINT AS packed_tokens, ((sum(strlen(text)) + count(*)) % {_BLOCK})::BIGINT AS discarded_tokens, {_BLOCK} AS block_size, round(((sum(strlen(text)) + count(*)) // {_BLOCK} * {_BLOCK})::DOUBLE / (sum(strlen(text)) + count(*))::DOUBLE, 9) AS retained_fraction FROM documents WHERE text IS NOT NULL"),
    "split_at_eos": (split_at_eos, f"WITH {_PACKED}, d AS (SELECT p, t, coalesce(sum((t = 0)::INT) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS document FROM packed), c AS (SELECT document, count(*) FILTER (WHERE t <> 0)::INT AS tokens, bool_or(t = 0) AS ended FROM d GROUP BY document) SELECT document, tokens FROM c WHERE ended AND tokens > 0"),
    "eos_positions": (eos_positions, f"WITH {_PACKED} SELECT p::BIGINT AS position FROM packed WHERE t = 0"),
    "byte_diagnostics": (byte_diagnostics, "WITH l AS (SELECT lower(coalesce(lang, 'none')) AS lang, text, strlen(text) AS n FROM documents WHERE text IS NOT NULL) SELECT lang, count(*) AS documents, sum(n)::BIGINT AS tokens, round(sum(length(text)) / nullif(sum(n), 0), 6) AS chars_per_token, round(sum(strlen(text)) / nullif(sum(n), 0), 6) AS bytes_per_token, round(avg(n), 6) AS mean_tokens, round(median(n), 6) AS median_tokens, list_sort(list(n))[floor(0.95 * (count(*) - 1))::INT + 1]::INT AS p95_tokens FROM l GROUP BY lang"),
}
