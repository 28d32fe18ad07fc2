"""MinHash signatures, banded candidate pairs and near-duplicate reports."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wordhash import ASCII_WORDS, WordHashes, chunks
from .skew import expand, join_groups


@dataclass(frozen=True)
class MinHashOptions:
    """permutations in bands of equal rows; threshold on the share of equal permutations. cap: members of a bucket that
    are paired, the first by id, as the reference does; None, for whole results, pairs all of them. hot: a group with
    more members is paired by many tasks."""

    permutations: int = 128
    bands: int = 16
    shingle: int = 5
    threshold: float = 0.8
    seed: int = 0
    cap: int | None = None
    hot: int = 1000

    def __post_init__(self):
        if self.permutations % self.bands:
            raise ValueError("permutations must be divisible by bands")

    @property
    def rows(self) -> int:
        return self.permutations // self.bands


def md5_signatures(docs: DataFrame, id_col: str, text_col: str, options: MinHashOptions) -> DataFrame:
    """(id_col, signature ARRAY<BIGINT>) that any engine can compute: permutation p is the least of the 32-bit words
    number p % 4 of MD5("q:shingle") with q = p // 4. Documents shorter than a shingle have no row."""
    seeds = [f"{q}:".encode() for q in range(-(-options.permutations // 4))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, md5, n = re.compile("[a-z0-9']+").findall, hashlib.md5, options.shingle
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = find(text.lower())
                if len(words) < n:
                    continue
                grams = {" ".join(words[k : k + n]).encode() for k in range(len(words) - n + 1)}
                least = [np.frombuffer(b"".join([md5(q + g).digest() for g in grams]), ">u4").reshape(-1, 4).min(0) for q in seeds]
                at.append(i)
                out.append(np.concatenate(least)[: options.permutations])
            if at:
                flat = np.concatenate(out).astype(np.int64)
                ends = np.arange(0, len(flat) + 1, options.permutations, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[id_col, "signature"])

    used = docs.where(F.col(text_col).isNotNull()).select(id_col, text_col)
    return used.mapInArrow(rows, f"{id_col} {used.dtypes[0][1]}, signature array<bigint>")


def numeric_signatures(docs: DataFrame, id_col: str, text_col: str, options: MinHashOptions) -> DataFrame:
    """(id_col, signature ARRAY<BIGINT>) with multiply-add hashes modulo 2**64 over 64-bit shingle hashes, in numpy;
    words as functions.text.words has them. Documents shorter than a shingle have no row: with the same signature for
    all of them they would count as copies of each other."""
    rng = np.random.Generator(np.random.PCG64(options.seed))
    a = rng.integers(0, 2**64, options.permutations, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 2**64, options.permutations, dtype=np.uint64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lower = [t.lower() for t in batch.column(1).to_pylist()]
            for begin, end in chunks(lower):
                words = WordHashes(lower[begin:end], ASCII_WORDS)
                gram, where = words.grams(options.shingle)
                if not len(gram):
                    continue
                doc = words.doc[where]
                first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                out = np.empty((len(first), options.permutations), np.uint64)
                for p in range(options.permutations):
                    out[:, p] = np.minimum.reduceat(gram * a[p] + b[p], first)
                ends = np.arange(0, out.size + 1, options.permutations, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(begin + doc[first])), pa.ListArray.from_arrays(pa.array(ends), pa.array(out.view(np.int64).ravel()))], names=[id_col, "signature"])

    used = docs.where(F.col(text_col).isNotNull()).select(id_col, text_col)
    return used.mapInArrow(rows, f"{id_col} {used.dtypes[0][1]}, signature array<bigint>")


def band_rows(signatures: DataFrame, id_col: str, options: MinHashOptions) -> DataFrame:
    """(id_col, band, bucket): the bucket of each band of rows permutations."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(options.bands - 1)), lambda i: F.md5(F.concat_ws(",", F.transform(F.slice("signature", i * options.rows + 1, options.rows), lambda x: x.cast("string")))))
    return signatures.select(id_col, F.posexplode(bands).alias("band", "bucket"))


def _pairs_within(rows: DataFrame, keys: list[str], id_col: str, hot: int) -> DataFrame:
    """(keys, lo, hi) of all rows with equal keys, however many there are of one: expand cuts large groups."""
    rows = rows.select(*keys, F.col(id_col).alias("id")).persist()
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").withColumn("rep", F.struct(*keys)).persist()
    members = join_groups(rows, sizes, keys, "n", rows.count()).select("rep", "n", "id")
    met = expand(sizes.select(F.col("rep").alias("lo"), F.col("rep").alias("hi"), *keys), members, members, hot)
    return met.where("x < y").select(*keys, F.col("x").alias("lo"), F.col("y").alias("hi"))


def signature_classes(signatures: DataFrame, id_col: str) -> DataFrame:
    """(rep, signature, size): documents of equal signature as one row, with the smallest id and how many they are."""
    return signatures.groupBy("signature").agg(F.min(id_col).alias("rep"), F.count("*").alias("size"))


def _class_candidates(classes: DataFrame, options: MinHashOptions) -> DataFrame:
    """Distinct (lo, hi) of representatives of unequal signatures that share a bucket of some band."""
    return _pairs_within(band_rows(classes, "rep", options), ["band", "bucket"], "rep", options.hot).select("lo", "hi").distinct()


def _class_pairs(classes: DataFrame, options: MinHashOptions) -> DataFrame:
    """(lo, hi, similarity) of representatives whose estimated similarity reaches the threshold."""
    left = classes.select(F.col("rep").alias("lo"), F.col("signature").alias("a"))
    right = classes.select(F.col("rep").alias("hi"), F.col("signature").alias("b"))
    pairs = _class_candidates(classes, options).join(left, "lo").join(right, "hi")
    return pairs.select("lo", "hi", estimated_similarity(F.col("a"), F.col("b"), options).alias("similarity")).where(F.col("similarity") >= options.threshold)


def _member_pairs(pairs: DataFrame, classes: DataFrame, signatures: DataFrame, id_col: str, options: MinHashOptions) -> DataFrame:
    """Pairs of representatives (lo, hi, similarity) as pairs of all members, and the pairs within each class."""
    several = classes.where("size > 1").select("rep", "signature", F.col("size").alias("n"))
    copies = join_groups(signatures.select("signature", F.col(id_col).alias("id")), several, ["signature"], "n", signatures.count()).select("rep", "n", "id")
    every = copies.union(classes.where("size = 1").select("rep", F.lit(1).cast("long").alias("n"), F.col("rep").alias("id"))).persist()
    across = expand(pairs, every, every, options.hot).select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "similarity")
    inside = expand(several.select(F.col("rep").alias("lo"), F.col("rep").alias("hi")), every, every, options.hot).where("x < y")
    return across.union(inside.select("x", "y", F.lit(1.0)))


def candidate_pairs(signatures: DataFrame, id_col: str, options: MinHashOptions) -> DataFrame:
    """Distinct (lo, hi) that share a bucket of some band. Equal signatures are one row until the end."""
    if options.cap is None:
        classes = signature_classes(signatures, id_col).persist()
        found = _class_candidates(classes, options).withColumn("similarity", F.lit(None).cast("double"))
        return _member_pairs(found, classes, signatures, id_col, options).select("lo", "hi").distinct()
    order = Window.partitionBy("band", "bucket").orderBy(id_col)
    rows = band_rows(signatures, id_col, options).withColumn("place", F.row_number().over(order)).where(F.col("place") <= options.cap).drop("place")
    a, b = rows.select("band", "bucket", F.col(id_col).alias("lo")), rows.select("band", "bucket", F.col(id_col).alias("hi"))
    return a.join(b, ["band", "bucket"]).where("lo < hi").select("lo", "hi").distinct()


def estimated_similarity(a: Column, b: Column, options: MinHashOptions) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(options.permutations))


def near_duplicate_pairs(signatures: DataFrame, id_col: str, options: MinHashOptions) -> DataFrame:
    """(lo, hi, similarity) of candidate pairs whose estimated similarity reaches the threshold."""
    if options.cap is None:
        classes = signature_classes(signatures, id_col).persist()
        return _member_pairs(_class_pairs(classes, options), classes, signatures, id_col, options)
    left = signatures.select(F.col(id_col).alias("lo"), F.col("signature").alias("a"))
    right = signatures.select(F.col(id_col).alias("hi"), F.col("signature").alias("b"))
    pairs = candidate_pairs(signatures, id_col, options).join(left, "lo").join(right, "hi")
    return pairs.select("lo", "hi", estimated_similarity(F.col("a"), F.col("b"), options).alias("similarity")).where(F.col("similarity") >= options.threshold)


def near_duplicate_report(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """documents, verified_pairs, documents_with_near_duplicate, rate."""
    involved = pairs.select(F.col("lo").alias("id")).union(pairs.select("hi")).distinct()
    counts = docs.agg(F.count("*").alias("documents")).crossJoin(pairs.agg(F.count("*").alias("verified_pairs"))).crossJoin(involved.agg(F.count("*").alias("documents_with_near_duplicate")))
    rate = F.when(F.col("documents") > 0, F.col("documents_with_near_duplicate") / F.col("documents")).otherwise(F.lit(0.0))
    return counts.withColumn("rate", F.round(rate, 9))


def near_duplicate_counts(signatures: DataFrame, id_col: str, options: MinHashOptions) -> DataFrame:
    """The row of near_duplicate_report over the pairs of all members, counted from classes of equal signatures without
    making the pairs: a text with many copies costs one row. Ids are keys; options.cap is not used."""
    classes = signature_classes(signatures, id_col).persist()
    pairs = _class_pairs(classes, options).select("lo", "hi").persist()
    sizes = classes.select("rep", "size")
    across = pairs.join(sizes.select(F.col("rep").alias("lo"), F.col("size").alias("m")), "lo").join(sizes.select(F.col("rep").alias("hi"), F.col("size").alias("n")), "hi").agg(F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0)).alias("across"))
    linked = pairs.select(F.col("lo").alias("rep")).union(pairs.select("hi")).distinct().withColumn("linked", F.lit(True))
    inside = sizes.join(linked, "rep", "left").agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("documents"),
        F.coalesce(F.sum(F.expr("size * (size - 1) div 2")), F.lit(0)).alias("within"),
        F.coalesce(F.sum(F.when((F.col("size") > 1) | F.col("linked"), F.col("size"))), F.lit(0)).alias("documents_with_near_duplicate"),
    )
    rate = F.when(F.col("documents") > 0, F.col("documents_with_near_duplicate") / F.col("documents")).otherwise(F.lit(0.0))
    return inside.crossJoin(across).select("documents", (F.col("within") + F.col("across")).alias("verified_pairs"), "documents_with_near_duplicate", F.round(rate, 9).alias("rate"))


def cross_near_duplicates(reference: DataFrame, queries: DataFrame, id_col: str, options: MinHashOptions) -> DataFrame:
    """(id_col): queries whose bucket of some band has a first reference document (by id) that reaches the threshold."""
    first = band_rows(reference, id_col, options).groupBy("band", "bucket").agg(F.min(id_col).alias("ref"))
    pairs = band_rows(queries, id_col, options).join(first, ["band", "bucket"]).select(F.col(id_col).alias("q"), "ref").distinct()
    both = pairs.join(queries.select(F.col(id_col).alias("q"), F.col("signature").alias("a")), "q").join(reference.select(F.col(id_col).alias("ref"), F.col("signature").alias("b")), "ref")
    return both.where(estimated_similarity(F.col("a"), F.col("b"), options) >= options.threshold).select(F.col("q").alias(id_col)).distinct()


def cross_near_duplicate_pairs(reference: DataFrame, queries: DataFrame, id_col: str, options: MinHashOptions) -> DataFrame:
    """(id_col, reference_id, similarity): each query with each class of reference documents of equal signature, named by its
    smallest id, that shares a bucket with it and reaches the threshold. Unlike cross_near_duplicates, whose result depends on
    the first document of a bucket, this compares all of a bucket; large buckets are cut by expand."""
    known, asked = signature_classes(reference, id_col).persist(), signature_classes(queries, id_col).persist()
    keys = ["band", "bucket"]
    bands = band_rows(known, "rep", options).withColumn("side", F.lit(0)).union(band_rows(asked, "rep", options).withColumn("side", F.lit(1))).withColumnRenamed("rep", "id").persist()
    sizes = bands.groupBy(*keys).agg(F.count_if(F.col("side") == 0).alias("ln"), F.count_if(F.col("side") == 1).alias("rn")).where("ln > 0 and rn > 0").withColumn("n", F.col("ln") + F.col("rn")).withColumn("rep", F.struct(*keys)).persist()
    met = join_groups(bands, sizes, keys, "n", bands.count()).persist()
    left, right = (met.where(F.col("side") == k).select("rep", F.col(n).alias("n"), "id") for k, n in ((0, "ln"), (1, "rn")))
    pairs = expand(sizes.select(F.col("rep").alias("lo"), F.col("rep").alias("hi")), left, right, options.hot).distinct()
    both = pairs.join(known.select(F.col("rep").alias("x"), F.col("signature").alias("a")), "x").join(asked.select(F.col("rep").alias("y"), F.col("signature").alias("b")), "y")
    near = both.select("x", "y", estimated_similarity(F.col("a"), F.col("b"), options).alias("similarity")).where(F.col("similarity") >= options.threshold)
    members = join_groups(queries.select(F.col("signature"), F.col(id_col).alias("id")), asked.select("signature", "rep", F.col("size").alias("n")), ["signature"], "n", queries.count()).select("rep", "n", "id")
    alone = near.select(F.col("x").alias("reference_id"), "similarity", F.col("y").alias("lo"), F.col("x").alias("hi"))
    own = known.select("rep", F.lit(1).cast("long").alias("n"), F.col("rep").alias("id"))
    return expand(alone, members, own, options.hot).select(F.col("x").alias(id_col), "reference_id", "similarity")
