"""Queries of MinHash near duplicates, TF-IDF retrieval and dense neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import minhash, retrieval
from ..sources.tables import table
from . import sql as S
from .corpus import corpus

_NATIVE = minhash.MinHashOptions(permutations=16, bands=4, shingle=5, threshold=0.75)
_FULL = minhash.MinHashOptions()


def _signatures(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "tinystories", "story_id", "text")
    return minhash.md5_signatures(docs, "story_id", "text", _NATIVE).persist()


def minhash_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return _signatures(spark, folder).select("story_id", F.md5(F.array_join(F.transform("signature", lambda x: x.cast("string")), ",")).alias("signature_md5"))


def lsh_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.candidate_pairs(_signatures(spark, folder), "story_id", _NATIVE)


def near_dup_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicate_pairs(_signatures(spark, folder), "story_id", _NATIVE)


def near_dup_report(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicate_counts(_signatures(spark, folder), "story_id", _NATIVE)


def near_dup_examples(spark: SparkSession, folder: str) -> DataFrame:
    """The most similar pairs, for a report."""
    return near_dup_pairs(spark, folder).orderBy(F.desc("similarity"), "lo", "hi").limit(20)


def cross_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    """Test stories with a near duplicate in the training stories."""
    rows = corpus(spark, folder).where("text is not null").select("story_id", "role", "text")
    sign = lambda role: minhash.md5_signatures(rows.where(F.col("role") == role), "story_id", "text", _NATIVE).persist()
    return minhash.cross_near_duplicates(sign("train"), sign("test"), "story_id", _NATIVE)


def cross_near_dup_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Test stories with each different near duplicate in the training stories."""
    rows = corpus(spark, folder).where("text is not null").select("story_id", "role", "text").distinct()
    sign = lambda role: minhash.md5_signatures(rows.where(F.col("role") == role), "story_id", "text", _NATIVE).persist()
    return minhash.cross_near_duplicate_pairs(sign("train"), sign("test"), "story_id", _NATIVE)


def minhash_128(spark: SparkSession, folder: str) -> DataFrame:
    """Near duplicates with 128 numeric permutations in 16 bands."""
    docs = table(spark, folder, "tinystories", "story_id", "text")
    signatures = minhash.numeric_signatures(docs, "story_id", "text", _FULL).persist()
    return minhash.near_duplicate_pairs(signatures, "story_id", _FULL)


def _weights(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents", "doc_id", "text").where("text is not null")
    counts = retrieval.term_counts(docs, "doc_id", "text").persist()
    return counts, retrieval.inverse_frequencies(counts, "doc_id", docs)


def tfidf_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Terms and squared length of each document; the length is 1."""
    counts, idf = _weights(spark, folder)
    return retrieval.tfidf(counts, idf, "doc_id", own=True).groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.max("weight"), 6).alias("largest"), F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("norm"))


def tfidf_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The most similar document of each prompt."""
    counts, idf = _weights(spark, folder)
    prompts = table(spark, folder, "prompts").select(F.col("id").alias("prompt_id"), F.col("prompt").alias("text"))
    queries = retrieval.tfidf(retrieval.term_counts(prompts, "prompt_id", "text"), idf, "prompt_id")
    found = retrieval.top_matches(queries, counts, idf, "prompt_id", "doc_id")
    return found.select("prompt_id", "doc_id", F.round("similarity", 6).alias("similarity"))


def tfidf_sampled(spark: SparkSession, folder: str) -> DataFrame:
    """The most similar document of each prompt by the idf of a sample of documents, over all documents."""
    docs = table(spark, folder, "documents", "doc_id", "text").where("text is not null")
    counts = retrieval.term_counts(docs, "doc_id", "text").persist()
    idf = retrieval.sampled_frequencies(counts, "doc_id", docs, _IDF_SAMPLE).persist()
    prompts = table(spark, folder, "prompts").select(F.col("id").alias("prompt_id"), F.col("prompt").alias("text"))
    queries = retrieval.tfidf(retrieval.term_counts(prompts, "prompt_id", "text"), idf, "prompt_id")
    found = retrieval.top_matches(queries, counts, idf, "prompt_id", "doc_id", own=False)
    return found.select("prompt_id", "doc_id", F.round("similarity", 6).alias("similarity"))


#: Documents from which tfidf_sampled learns idf, the sampling operator's parameter.
_IDF_SAMPLE = 500


def embedding_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of each vector whose id is a multiple of 50, the query set."""
    vectors = table(spark, folder, "embeddings")
    return retrieval.nearest_vectors(vectors.where("vec_id % 50 = 0"), vectors).select("query_id", "id", F.round("similarity", 4).alias("similarity"))


_GRAMS = lambda rows: f"g AS (SELECT story_id, list_distinct({S.grams('w', 5)}) AS g FROM (SELECT story_id, {S.words('text')} AS w FROM {rows} WHERE text IS NOT NULL) WHERE len(w) >= 5)"
_SIG = "e AS (SELECT story_id, unnest(g) AS x FROM g), pm AS (SELECT unnest(range(16)) AS p), h AS (SELECT story_id, q, md5(q || ':' || x) AS d FROM e, (SELECT unnest(range(4)) AS q)), m AS (SELECT story_id, p, min(('0x' || substr(d, (8 * (p % 4) + 1)::BIGINT, 8))::BIGINT) AS v FROM h JOIN pm ON q = p // 4 GROUP BY story_id, p), sig AS (SELECT story_id, list(v ORDER BY p) AS s FROM m GROUP BY story_id)"
_BANDS = "bd AS (SELECT story_id, b.band, md5(array_to_string(s[b.band * 4 + 1:b.band * 4 + 4], ',')) AS bucket FROM sig, (SELECT unnest(range(4)) AS band) b)"
_CAP = f"{_BANDS}, cand AS (SELECT DISTINCT a.story_id AS lo, b.story_id AS hi FROM bd a JOIN bd b ON a.band = b.band AND a.bucket = b.bucket AND a.story_id < b.story_id)"
_SIM = "list_sum(list_transform(range(1, 17), lambda i: (a.s[i] = b.s[i])::INT)) / 16.0"
_ALL = f"{_GRAMS('tinystories')}, {_SIG}, {_CAP}"
_PAIRS = f"{_ALL}, vp AS (SELECT lo, hi, ({_SIM})::DOUBLE AS similarity FROM cand JOIN sig a ON a.story_id = lo JOIN sig b ON b.story_id = hi WHERE {_SIM} >= 0.75)"
_LONG = "regexp_extract_all(lower(text), '[a-z0-9_]{2,}')"
_TERMS = f"list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: array_to_string(w[i:i + 1], ' ')))"
_TF = f"docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), tc AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM (SELECT doc_id, {_LONG} AS w FROM docs)) GROUP BY ALL), idf AS (SELECT term, ln((1 + (SELECT count(*) FROM docs)) / (1 + count(*))) + 1 AS idf FROM tc GROUP BY term)"
_SAMPLED = _TF.split(", idf AS")[0] + f", sm AS (SELECT doc_id FROM docs ORDER BY md5('0:' || doc_id), doc_id LIMIT {_IDF_SAMPLE}), idf AS (SELECT term, ln((1 + (SELECT count(*) FROM sm)) / (1 + count(*))) + 1 AS idf FROM tc SEMI JOIN sm USING (doc_id) GROUP BY term)"
_WEIGHT = lambda name, src, k: f"{name} AS (SELECT {k}, term, r / sqrt(sum(r * r) OVER (PARTITION BY {k})) AS weight FROM (SELECT {k}, term, (1 + ln(tf)) * idf AS r FROM {src} JOIN idf USING (term)))"

QUERIES = {
    "minhash_signatures": (minhash_signatures, f"WITH {_GRAMS('tinystories')}, {_SIG} SELECT story_id, md5(array_to_string(s, ',')) AS signature_md5 FROM sig"),
    "lsh_candidates": (lsh_candidates, f"WITH {_ALL} SELECT lo, hi FROM cand"),
    "near_dup_pairs": (near_dup_pairs, f"WITH {_PAIRS} SELECT lo, hi, similarity FROM vp"),
    "near_dup_report": (near_dup_report, f"WITH {_PAIRS}, i AS (SELECT lo AS id FROM vp UNION SELECT hi FROM vp) SELECT (SELECT count(*) FROM sig) AS documents, (SELECT count(*) FROM vp) AS verified_pairs, (SELECT count(*) FROM i) AS documents_with_near_duplicate, round((SELECT count(*) FROM i) / (SELECT count(*) FROM sig), 9) AS rate"),
    "near_dup_examples": (near_dup_examples, f"WITH {_PAIRS} SELECT lo, hi, similarity FROM vp ORDER BY similarity DESC, lo, hi LIMIT 20"),
    "cross_near_dup": (cross_near_dup, f"WITH {S.ROLES}, {_GRAMS('corpus')}, {_SIG}, {_BANDS}, ro AS (SELECT DISTINCT story_id, role FROM corpus), f AS (SELECT band, bucket, min(story_id) AS ref FROM bd JOIN ro USING (story_id) WHERE role = 'train' GROUP BY band, bucket), c AS (SELECT DISTINCT q.story_id AS q, ref FROM bd q JOIN ro ON ro.story_id = q.story_id AND ro.role = 'test' JOIN f ON f.band = q.band AND f.bucket = q.bucket) SELECT DISTINCT q AS story_id FROM c JOIN sig a ON a.story_id = q JOIN sig b ON b.story_id = ref WHERE {_SIM} >= 0.75"),
    "cross_near_dup_pairs": (
        cross_near_dup_pairs,
        f"WITH {S.ROLES}, {_GRAMS('corpus')}, {_SIG}, {_BANDS}, ro AS (SELECT DISTINCT story_id, role FROM corpus), rc AS (SELECT s, min(story_id) AS ref FROM sig JOIN ro USING (story_id) WHERE role = 'train' GROUP BY s), rb AS (SELECT DISTINCT bd.band, bd.bucket, rc.ref FROM bd JOIN rc ON bd.story_id = rc.ref), p AS (SELECT DISTINCT q.story_id, rb.ref FROM bd q JOIN ro ON ro.story_id = q.story_id AND ro.role = 'test' JOIN rb ON rb.band = q.band AND rb.bucket = q.bucket) SELECT DISTINCT p.story_id, p.ref AS reference_id, ({_SIM})::DOUBLE AS similarity FROM p JOIN sig a ON a.story_id = p.story_id JOIN sig b ON b.story_id = p.ref WHERE {_SIM} >= 0.75",
    ),
    "minhash_128": (minhash_128, ""),
    "tfidf_weights": (tfidf_weights, f"WITH {_TF}, {_WEIGHT('dw', 'tc', 'doc_id')} SELECT doc_id, count(*) AS terms, round(max(weight), 6) AS largest, round(sum(weight * weight), 6) AS norm FROM dw GROUP BY doc_id"),
    "tfidf_top1": (tfidf_neighbours, f"WITH {_TF}, {_WEIGHT('dw', 'tc', 'doc_id')}, qc AS (SELECT prompt_id, term, count(*) AS tf FROM (SELECT prompt_id, unnest({_TERMS}) AS term FROM (SELECT id AS prompt_id, {_LONG.replace('text', 'prompt')} AS w FROM prompts)) GROUP BY ALL), {_WEIGHT('qw', 'qc', 'prompt_id')}, sc AS (SELECT prompt_id, doc_id, round(sum(qw.weight * dw.weight), 9) AS similarity FROM qw JOIN dw USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY similarity DESC, doc_id DESC) AS p FROM sc) SELECT prompt_id, doc_id, round(similarity, 6) AS similarity FROM r WHERE p = 1"),
    "tfidf_sampled": (tfidf_sampled, f"WITH {_SAMPLED}, {_WEIGHT('dw', 'tc', 'doc_id')}, qc AS (SELECT prompt_id, term, count(*) AS tf FROM (SELECT prompt_id, unnest({_TERMS}) AS term FROM (SELECT id AS prompt_id, {_LONG.replace('text', 'prompt')} AS w FROM prompts)) GROUP BY ALL), {_WEIGHT('qw', 'qc', 'prompt_id')}, sc AS (SELECT prompt_id, doc_id, round(sum(qw.weight * dw.weight), 9) AS similarity FROM qw JOIN dw USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY similarity DESC, doc_id DESC) AS p FROM sc) SELECT prompt_id, doc_id, round(similarity, 6) AS similarity FROM r WHERE p = 1"),
    "embedding_topk": (embedding_topk, "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id DESC) AS p FROM s) SELECT query_id, id, round(similarity, 4) AS similarity FROM r WHERE p <= 5"),
}
