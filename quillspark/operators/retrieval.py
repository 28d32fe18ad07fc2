"""TF-IDF retrieval by inverted index, and nearest dense vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import join_groups


def long_words(text: Column) -> Column:
    """Words of at least two characters, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]{2,})"), F.lit(1))


def terms(words: Column) -> Column:
    """Words and their bigrams."""
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.slice(words, i, 2)))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, term, tf)."""
    return docs.select(id_col, long_words(F.col(text_col)).alias("_w")).select(id_col, F.explode(terms(F.col("_w"))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def inverse_frequencies(counts: DataFrame, id_col: str, documents: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + n) / (1 + df)) + 1; n documents, those without terms too."""
    n = documents.agg(F.count("*").alias("n"))
    return counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def sampled_frequencies(counts: DataFrame, id_col: str, documents: DataFrame, sample: int, seed: int = 0) -> DataFrame:
    """inverse_frequencies of the `sample` documents whose hashes of id and seed come first (all, if there are fewer):
    terms of other documents only have no row, so tfidf leaves them out."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))
    some = documents.select(id_col).orderBy(order, id_col).limit(sample)
    return inverse_frequencies(counts.join(some, id_col, "left_semi"), id_col, some)


def _raw(counts: DataFrame, idf: DataFrame, own: bool) -> DataFrame:
    """counts with w = (1 + ln tf) * idf. own: idf was made from these counts, so df is the number of a term's rows, and the
    rows of a term of most documents can be kept from meeting in one task."""
    rows = join_groups(counts, idf, ["term"], "df", counts.count()) if own else counts.join(idf, "term")
    return rows.withColumn("w", (1 + F.log("tf")) * F.col("idf"))


def tfidf(counts: DataFrame, idf: DataFrame, id_col: str, own: bool = False) -> DataFrame:
    """(id_col, term, weight): (1 + ln tf) * idf, each document of unit length; terms without idf are left out."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return _raw(counts, idf, own).select(id_col, "term", (F.col("w") / norm).alias("weight"))


def top_matches(queries: DataFrame, counts: DataFrame, idf: DataFrame, query_id: str, corpus_id: str, k: int = 1, most: int = 1_000_000, own: bool = True) -> DataFrame:
    """(query_id, corpus_id, similarity): the k most similar documents of each query by cosine; of equal ones (to nine
    digits) the larger id first. queries: as tfidf gives them. counts and idf: of the documents;
    own: see _raw.

    The queries' terms, if they have at most `most` rows, are broadcast, one row with all queries for each; more are
    joined with a shuffle. Documents are shuffled once, by their id, with their length and only the terms that a query
    has; each task keeps k documents of each query."""
    small = queries.limit(most + 1).count() <= most
    wanted = queries.groupBy("term").agg(F.collect_list(F.struct(F.col(query_id), F.col("weight").alias("qw"))).alias("_q"))
    met = _raw(counts, idf, own).join(F.broadcast(wanted) if small else wanted, "term", "left")
    hit = F.when(F.col("_q").isNotNull(), F.struct("w", "_q"))
    docs = met.groupBy(corpus_id).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"), F.collect_list(hit).alias("_hits"))
    each = docs.select(corpus_id, "_norm", F.inline("_hits")).select(corpus_id, (F.col("w") / F.col("_norm")).alias("cw"), F.inline("_q"))
    scores = each.groupBy(corpus_id, query_id).agg(F.round(F.sum(F.col("qw") * F.col("cw")), 9).alias("similarity"))
    order = Window.partitionBy(query_id).orderBy(F.desc("similarity"), F.desc(corpus_id))
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(query_id, corpus_id, "similarity")


def nearest_vectors(queries: DataFrame, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, block: int = 4096) -> DataFrame:
    """(query_id, id, similarity): the k nearest vectors of each query by cosine, the query's own id left out, of equal
    similarity (to six digits) the larger id first. Queries are sent in blocks of bounded size against all vectors;
    each task keeps the best k of its rows, so k rows for each query and task are shuffled."""
    spark = vectors.sparkSession
    total = queries.count()
    blocks = max(1, -(-total // block))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc("id"))
    out = None
    for b in range(blocks):
        some = queries.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == b) if blocks > 1 else queries
        rows = [(r[0], r[1]) for r in some.select(id_col, vector_col).toLocalIterator() if r[1] is not None]
        if not rows:
            continue
        ids = np.array([i for i, _ in rows], np.int64)
        matrix = np.array([v for _, v in rows], np.float64)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((ids, matrix))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                here = batch.column(0).to_numpy()
                data = np.array(batch.column(1).to_pylist(), np.float64)
                data /= np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-300)
                score = np.round(matrix @ data.T, 6)
                score[ids[:, None] == here[None, :]] = -np.inf
                rank = np.lexsort((-np.broadcast_to(here, score.shape), -score), axis=1)[:, :k]
                at, value = np.repeat(ids, rank.shape[1]), np.take_along_axis(score, rank, 1).ravel()
                keep = np.isfinite(value)
                yield pa.RecordBatch.from_arrays([pa.array(at[keep]), pa.array(here[rank].ravel()[keep]), pa.array(value[keep])], names=["query_id", "id", "similarity"])

        found = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long"), vector_col).mapInArrow(best, "query_id long, id long, similarity double")
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, id long, similarity double, place int")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
