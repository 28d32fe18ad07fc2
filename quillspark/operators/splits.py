"""Leakage-free splits: normalization, minimum length, decontamination and a hash hold-out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import Normalization, bucket, content_hash, exact_content_hash, exact_in_fraction, in_fraction, normalize_text, once


@dataclass(frozen=True)
class SplitOptions:
    """validation_fraction: share of the training source held out by hash, so copies stay together. min_chars: least
    length after normalization. exact: hash with BLAKE2b of the NFKC, case-folded text, not MD5 of the lower-case one; the
    validation split follows the hash. max_train: a seeded subset of the training split, None for all of it."""

    validation_fraction: float = 0.005
    min_chars: int = 100
    max_train: int | None = None
    seed: int = 0
    decontaminate: bool = True
    exact: bool = False
    normalization: Normalization = field(default_factory=Normalization)


def prepared(docs: DataFrame, options: SplitOptions, text_col: str = "text") -> DataFrame:
    """docs with normalized text, its hash and at least min_chars characters; the filter comes after normalization."""
    rest = [c for c in docs.columns if c != text_col]
    clean = docs.where(F.col(text_col).isNotNull()).select(*rest, once(normalize_text(F.col(text_col), options.normalization)).alias(text_col))
    hashed = exact_content_hash if options.exact else content_hash
    return clean.where(F.char_length(text_col) >= options.min_chars).select(*rest, text_col, once(hashed(F.col(text_col))).alias("hash"))


def build_splits(train: DataFrame, test: DataFrame, options: SplitOptions = SplitOptions(), id_col: str = "story_id", text_col: str = "text") -> DataFrame:
    """(id_col, text, hash, split). Test rows with an exact copy anywhere in the training source are left out, before
    the hold-out and before a subset is drawn. Duplicates inside the training split stay: they are measured, not
    dropped."""
    source, held = prepared(train.select(id_col, text_col), options), prepared(test.select(id_col, text_col), options)
    if options.decontaminate:
        held = held.join(source.select("hash").distinct(), "hash", "left_anti").select(id_col, text_col, "hash")
    hold_out = (exact_in_fraction if options.exact else in_fraction)(F.col("hash"), options.validation_fraction)
    split = lambda df, name: df.select(id_col, text_col, "hash", name.alias("split"))
    held = split(held, F.lit("test"))
    if options.max_train is None:
        return split(source, F.when(hold_out, "validation").otherwise("train")).unionByName(held)
    kept = seeded_sample(source.where(~hold_out), id_col, options.max_train, options.seed)
    return split(kept, F.lit("train")).unionByName(split(source.where(hold_out), F.lit("validation"))).unionByName(held)


def seeded_sample(rows: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a hash of id and seed: the same at every partitioning."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))), id_col).limit(n)


def split_fingerprint(splits: DataFrame) -> DataFrame:
    """(split, rows, fingerprint): identifies the contents of each split, whatever the order."""
    return splits.groupBy("split").agg(F.count("*").alias("rows"), F.bit_xor(bucket(F.col("hash"), 1 << 60)).alias("fingerprint"))


def duplicate_stats(hashes: DataFrame, key: str = "hash", by: tuple[str, ...] = ()) -> DataFrame:
    """documents, unique, redundant copies, their rate and the largest cluster (for each group of by). Two levels, the
    first with partial aggregation, so a key of a third of all rows is no hot task."""
    each = hashes.groupBy(*by, key).agg(F.count("*").alias("n"))
    out = each.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("documents"),
        F.count("*").alias("unique_documents"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant_copies"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest_cluster"),
    )
    rate = F.when(F.col("documents") > 0, F.col("redundant_copies") / F.col("documents")).otherwise(F.lit(0.0))
    return out.withColumn("redundant_rate", F.round(rate, 9))


def cross_split_exact(reference: DataFrame, queries: DataFrame, key: str = "hash") -> DataFrame:
    """documents, copies and rate: documents of queries, with multiplicity, that have a copy in reference."""
    known = reference.select(key).distinct().withColumn("hit", F.lit(1))
    found = queries.groupBy(key).agg(F.count("*").alias("n")).join(known, key, "left")
    out = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("copies"))
    return out.withColumn("rate", F.round(F.when(F.col("documents") > 0, F.col("copies") / F.col("documents")).otherwise(F.lit(0.0)), 9))
