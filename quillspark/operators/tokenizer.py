"""Encoding with tokenizer files, round trips and token diagnostics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_LOADED: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
        _LOADED[path].encode_special_tokens = True
    return _LOADED[path]


def fingerprint(path: str | Path) -> str:
    """SHA-256 of a tokenizer file; packed data names it and is refused with another."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def encoded(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(id_col, text_col, tokens): ids of each text without special tokens; null texts are left out."""
    rows = docs.where(F.col(text_col).isNotNull()).select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for batch in batches:
            ids = [e.ids for e in tok.encode_batch_fast(batch.column(1).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, text_col, "tokens"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"{id_col} {kinds[id_col]}, {text_col} string, tokens array<int>")


def decoded(rows: DataFrame, id_col: str, path: str) -> DataFrame:
    """(id_col, decoded) of token arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tok.decode_batch(batch.column(1).to_pylist(), skip_special_tokens=False), pa.string())], names=[id_col, "decoded"])

    rows = rows.select(id_col, "tokens")
    return rows.mapInArrow(run, f"{id_col} {rows.dtypes[0][1]}, decoded string")


def token_diagnostics(rows: DataFrame, text_col: str = "text", tokens_col: str = "tokens", by: tuple[str, ...] = ()) -> DataFrame:
    """documents, tokens, characters and bytes per token, mean, median and lower p95 of tokens per document."""
    counted = rows.select(*by, F.size(tokens_col).alias("_n"), F.char_length(text_col).alias("_c"), F.octet_length(text_col).alias("_b"))
    # a row for each length: what a percentile needs of a group of any size
    lengths = counted.groupBy(*by, "_n").agg(F.count("*").alias("_k"), F.sum("_c").alias("_c"), F.sum("_b").alias("_b"))
    group = Window.partitionBy(*by)
    upto = F.sum("_k").over(group.orderBy("_n"))
    placed = lengths.withColumn("_upto", upto).withColumn("_all", F.sum("_k").over(group))
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_n")))
    last = F.col("_all") - 1
    total = F.nullif(F.sum(F.col("_n") * F.col("_k")), F.lit(0))
    middle = (at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2
    return placed.groupBy(*by).agg(
        F.sum("_k").alias("documents"),
        F.sum(F.col("_n") * F.col("_k")).alias("tokens"),
        F.round(F.sum("_c") / total, 6).alias("chars_per_token"),
        F.round(F.sum("_b") / total, 6).alias("bytes_per_token"),
        F.round(F.sum(F.col("_n") * F.col("_k")) / F.sum("_k"), 6).alias("mean_tokens"),
        F.round(middle, 6).alias("median_tokens"),
        at(F.floor(F.lit(0.95) * last)).alias("p95_tokens"),
    )


def round_trip_rate(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """documents and the rate of those that come back from their ids, but for blanks at the start. Each text is encoded and
    decoded in the same batch, so repeated ids are documents of their own and nothing but counts is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            back = tok.decode_batch([e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)], skip_special_tokens=False)
            same = sum(x.lstrip(" ") == y.lstrip(" ") for x, y in zip(texts, back))
            yield pa.RecordBatch.from_arrays([pa.array([len(texts)]), pa.array([same])], names=["documents", "same"])

    found = docs.where(F.col(text_col).isNotNull()).select(text_col).mapInArrow(run, "documents long, same long")
    total = found.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.sum("same").alias("same"))
    return total.select("documents", F.round(F.col("same") / F.nullif(F.col("documents"), F.lit(0)), 9).alias("round_trip_rate"))
