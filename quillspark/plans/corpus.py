"""Queries over the story corpus: normalization, splits, duplicates and leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import BLANK, Normalization, bucket, content_hash, exact_content_hash, in_fraction, ngrams, normalize_text, repeated_fraction, sentences, words
from ..operators.ngrams import containment, containment_summary
from ..operators.protocol import with_role
from ..operators.splits import SplitOptions, build_splits, cross_split_exact, duplicate_stats, prepared, seeded_sample, split_fingerprint
from ..sources.tables import table
from . import sql as S

_OPTIONS = SplitOptions(validation_fraction=0.05)


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Stories with their role; only columns that the queries use are read."""
    stories = table(spark, folder, "tinystories", "story_id", "text", "source", "hub_split")
    return with_role(stories, table(spark, folder, "data_integrity"))


def splits(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus(spark, folder)
    return build_splits(rows.where("role = 'train'"), rows.where("role = 'test'"), _OPTIONS)


def normalize_stories(spark: SparkSession, folder: str) -> DataFrame:
    text = normalize_text(F.col("text"))
    return table(spark, folder, "tinystories", "story_id", "text").select("story_id", text.alias("t")).select("story_id", F.md5("t").alias("text_md5"), F.char_length("t").alias("chars"))


def normalize_ascii(spark: SparkSession, folder: str) -> DataFrame:
    text = normalize_text(F.col("text"), Normalization("none", ascii_punctuation=True, strip_non_ascii=True))
    return table(spark, folder, "tinystories", "story_id", "text").select("story_id", text.alias("t")).select("story_id", F.md5("t").alias("text_md5"), F.char_length("t").alias("chars"))


def text_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tinystories").select("story_id", F.char_length("text").alias("chars"), F.octet_length("text").alias("bytes"))


def dedup_keys(spark: SparkSession, folder: str) -> DataFrame:
    h = content_hash(F.col("text"))
    return table(spark, folder, "tinystories", "story_id", "text").where("text is not null").select("story_id", h.alias("hash")).select("story_id", "hash", bucket(F.col("hash")).alias("bucket"), in_fraction(F.col("hash"), 0.05).alias("held_out"))


def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "tinystories", "story_id", "text").where("text is not null").select("story_id", words(F.col("text")).alias("w"))
    return rows.select("story_id", F.size("w").alias("words"), F.size(F.array_distinct("w")).alias("distinct_words"))


def ngram_repetition(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "tinystories", "story_id", "text").where("text is not null").select("story_id", words(F.col("text")).alias("w")).select("story_id", ngrams(F.col("w"), 4).alias("g"))
    return rows.select("story_id", F.size("g").alias("grams"), F.round(repeated_fraction(F.col("g")), 9).alias("repeated"))


def sentence_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "tinystories", "story_id", "text").where("text is not null").select("story_id", sentences(F.col("text")).alias("s"))
    return rows.select("story_id", F.size("s").alias("sentences"), (F.size("s") - F.size(F.array_distinct("s"))).alias("repeated"))


def repeated_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences that occurred before in the same completion, with their place."""
    rows = table(spark, folder, "tinystories", "story_id", "text").where("text is not null").select("story_id", F.posexplode(sentences(F.col("text"))).alias("place", "sentence"))
    seen = F.row_number().over(Window.partitionBy("story_id", "sentence").orderBy("place"))
    return rows.withColumn("seen", seen).where("seen > 1").groupBy("story_id").agg(F.count("*").alias("repeats"), F.min("place").alias("first_repeat"))


def min_chars_filter(spark: SparkSession, folder: str) -> DataFrame:
    return prepared(corpus(spark, folder).select("story_id", "role", "text"), _OPTIONS).groupBy("role").agg(F.count("*").alias("stories"), F.sum(F.char_length("text")).alias("chars"))


def role_counts(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).groupBy("role", "source").agg(F.count("*").alias("stories"), F.count("text").alias("texts"))


def decontaminated_split_counts(spark: SparkSession, folder: str) -> DataFrame:
    return splits(spark, folder).groupBy("split").agg(F.count("*").alias("stories"), F.sum(F.char_length("text")).alias("chars"))


def exact_split_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The same splits with the exact hash, which SQL doesn't have."""
    rows = corpus(spark, folder)
    exact = SplitOptions(validation_fraction=0.05, exact=True)
    return build_splits(rows.where("role = 'train'"), rows.where("role = 'test'"), exact).groupBy("split").agg(F.count("*").alias("stories"), F.sum(F.char_length("text")).alias("chars"))


def exact_content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tinystories", "story_id", "text").where("text is not null").select("story_id", exact_content_hash(F.col("text")).alias("hash"))


def decontaminated_test(spark: SparkSession, folder: str) -> DataFrame:
    return splits(spark, folder).where("split = 'test'").select("story_id", "hash")


def contaminated_test(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepared(corpus(spark, folder).select("story_id", "role", "text"), _OPTIONS)
    return rows.where("role = 'test'").join(rows.where("role = 'train'").select("hash"), "hash", "left_semi").select("story_id")


def split_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return split_fingerprint(splits(spark, folder))


def split_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes in more than one split; none for a correct build."""
    return splits(spark, folder).groupBy("hash").agg(F.count_distinct("split").alias("n")).where("n > 1").select("hash")


def dup_stats(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_stats(splits(spark, folder), "hash", ("split",))


def dup_clusters(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "tinystories", "story_id", "text").where("text is not null").select("story_id", content_hash(F.col("text")).alias("hash"))
    return rows.groupBy("hash").agg(F.count("*").alias("copies"), F.min("story_id").alias("first_id")).where("copies > 1").select("first_id", "copies")


def cross_split_copies(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepared(corpus(spark, folder).select("story_id", "role", "text"), _OPTIONS)
    train = rows.where("role = 'train'")
    each = [cross_split_exact(train, rows.where(F.col("role") == r)).select(F.lit(r).alias("role"), "documents", "copies", "rate") for r in ("validation", "test")]
    return each[0].union(each[1])


def ngram_containment(spark: SparkSession, folder: str) -> DataFrame:
    """13-word containment of test and validation stories in the training stories."""
    rows = corpus(spark, folder).where("text is not null")
    found = containment(rows.where("role = 'train'"), rows.where("role <> 'train'"), "story_id", "story_id")
    return found.select("story_id", "grams", "matched", "containment")


def containment_by_role(spark: SparkSession, folder: str) -> DataFrame:
    roles = corpus(spark, folder).where("role <> 'train'").select("story_id", "role")
    return containment_summary(ngram_containment(spark, folder).join(roles, "story_id"), ("role",))


def ngram_scan(spark: SparkSession, folder: str) -> DataFrame:
    """8-, 16- and 32-word n-grams of generated texts found in the training stories."""
    train = corpus(spark, folder).where("role = 'train' and text is not null")
    queries = table(spark, folder, "memorization_records").where("text is not null").select("record_id", "text")
    return containment(train, queries, "story_id", "record_id", ns=(8, 16, 32))


def sample_stories(spark: SparkSession, folder: str) -> DataFrame:
    """A seeded sample of training stories: the sampling operator."""
    return seeded_sample(corpus(spark, folder).where("role = 'train'").select("story_id"), "story_id", 100, 7)


def first_stories(spark: SparkSession, folder: str) -> DataFrame:
    """The first stories by id of the validation split: the prefix operator."""
    return corpus(spark, folder).where("role = 'validation'").orderBy("story_id").limit(50).select("story_id")


def blank_texts(spark: SparkSession, folder: str) -> DataFrame:
    state = F.when(F.col("text").isNull(), "null").when(F.col("text").rlike(f"^{BLANK}*$"), "blank").when(F.char_length("text") < 100, "short").otherwise("story")
    return table(spark, folder, "tinystories").groupBy(state.alias("state")).agg(F.count("*").alias("stories"))


_P, _C = S.PREPARED, S.ROLES
_W = S.words("text")
_CONTAIN = f"""{_C},
q AS (SELECT story_id, role, {S.words("text")} AS w FROM corpus WHERE role <> 'train' AND text IS NOT NULL),
g AS (SELECT story_id, unnest({S.grams("w", 13)}) AS gram FROM q),
known AS (SELECT DISTINCT gram FROM (SELECT unnest({S.grams("w", 13)}) AS gram FROM (SELECT {S.words("text")} AS w FROM corpus WHERE role = 'train' AND text IS NOT NULL))),
m AS (SELECT story_id, count(*) AS grams, count(k.gram) AS matched FROM g LEFT JOIN known k USING (gram) GROUP BY story_id),
c AS (SELECT q.story_id, role, coalesce(grams, 0) AS grams, coalesce(matched, 0) AS matched, coalesce(round(matched / grams, 9), 0.0) AS containment FROM q LEFT JOIN m USING (story_id))"""

_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '^{S.BLANK}+|{S.BLANK}+$', '', 'g'), '([.!?]){S.BLANK}+', concat('\\1', chr(1)), 'g'), chr(1)), lambda s: array_to_string({S.words('s')}, ' ')), lambda s: s <> '')"

QUERIES = {
    "normalize_stories": (normalize_stories, f"SELECT story_id, md5(t) AS text_md5, length(t)::INT AS chars FROM (SELECT story_id, {S.norm('text')} AS t FROM tinystories)"),
    "normalize_ascii": (normalize_ascii, f"SELECT story_id, md5(t) AS text_md5, length(t)::INT AS chars FROM (SELECT story_id, {S.norm('text', False, True, True)} AS t FROM tinystories)"),
    "text_lengths": (text_lengths, "SELECT story_id, length(text)::INT AS chars, strlen(text)::INT AS bytes FROM tinystories"),
    "dedup_keys": (dedup_keys, f"SELECT story_id, hash, {S.bucket('hash')} AS bucket, {S.bucket('hash')} < 50000 AS held_out FROM (SELECT story_id, {S.key('text')} AS hash FROM tinystories WHERE text IS NOT NULL)"),
    "word_counts": (word_counts, f"SELECT story_id, len(w)::INT AS words, len(list_distinct(w))::INT AS distinct_words FROM (SELECT story_id, {_W} AS w FROM tinystories WHERE text IS NOT NULL)"),
    "ngram_repetition": (ngram_repetition, f"SELECT story_id, len(g)::INT AS grams, CASE WHEN len(g) > 0 THEN round((len(g) - len(list_distinct(g))) / len(g), 9) ELSE 0.0 END AS repeated FROM (SELECT story_id, {S.grams('w', 4)} AS g FROM (SELECT story_id, {_W} AS w FROM tinystories WHERE text IS NOT NULL))"),
    "sentence_counts": (sentence_counts, f"SELECT story_id, len(s)::INT AS sentences, (len(s) - len(list_distinct(s)))::INT AS repeated FROM (SELECT story_id, {_SENTENCES} AS s FROM tinystories WHERE text IS NOT NULL)"),
    "repeated_sentences": (repeated_sentences, f"WITH s AS (SELECT story_id, unnest(s) AS sentence, unnest(range(len(s))) AS place FROM (SELECT story_id, {_SENTENCES} AS s FROM tinystories WHERE text IS NOT NULL)), r AS (SELECT *, row_number() OVER (PARTITION BY story_id, sentence ORDER BY place) AS seen FROM s) SELECT story_id, count(*) AS repeats, min(place)::INT AS first_repeat FROM r WHERE seen > 1 GROUP BY story_id"),
    "min_chars_filter": (min_chars_filter, f"WITH {_P} SELECT role, count(*) AS stories, sum(length(text))::BIGINT AS chars FROM prepared GROUP BY role"),
    "role_counts": (role_counts, f"WITH {_C} SELECT role, source, count(*) AS stories, count(text) AS texts FROM corpus GROUP BY role, source"),
    "decontaminated_split_counts": (decontaminated_split_counts, f"WITH {S.SPLITS} SELECT split, count(*) AS stories, sum(length(text))::BIGINT AS chars FROM splits GROUP BY split"),
    "exact_split_counts": (exact_split_counts, ""),
    "exact_content_hashes": (exact_content_hashes, ""),
    "decontaminated_test": (decontaminated_test, f"WITH {S.SPLITS} SELECT story_id, hash FROM splits WHERE split = 'test'"),
    "contaminated_test": (contaminated_test, f"WITH {_P} SELECT story_id FROM prepared WHERE role = 'test' AND hash IN (SELECT hash FROM prepared WHERE role = 'train')"),
    "split_fingerprints": (split_fingerprints, f"WITH {S.SPLITS} SELECT split, count(*) AS rows, bit_xor({S.bucket('hash', 1 << 60)}) AS fingerprint FROM splits GROUP BY split"),
    "split_overlap": (split_overlap, f"WITH {S.SPLITS} SELECT hash FROM splits GROUP BY hash HAVING count(DISTINCT split) > 1"),
    "dup_stats": (dup_stats, f"WITH {S.SPLITS}, e AS (SELECT split, hash, count(*) AS n FROM splits GROUP BY split, hash) SELECT split, sum(n)::BIGINT AS documents, count(*) AS unique_documents, sum(n - 1)::BIGINT AS redundant_copies, max(n) AS largest_cluster, round(sum(n - 1) / sum(n), 9) AS redundant_rate FROM e GROUP BY split"),
    "dup_clusters": (dup_clusters, f"SELECT min(story_id) AS first_id, count(*) AS copies FROM (SELECT story_id, {S.key('text')} AS hash FROM tinystories WHERE text IS NOT NULL) GROUP BY hash HAVING count(*) > 1"),
    "cross_split_copies": (cross_split_copies, f"WITH {_P}, k AS (SELECT DISTINCT hash FROM prepared WHERE role = 'train'), r AS (SELECT unnest(['validation', 'test']) AS role) SELECT r.role, count(p.story_id) AS documents, count(k.hash) AS copies, coalesce(round(count(k.hash) / nullif(count(p.story_id), 0), 9), 0.0) AS rate FROM r LEFT JOIN prepared p ON p.role = r.role LEFT JOIN k ON k.hash = p.hash GROUP BY r.role"),
    "ngram_containment": (ngram_containment, f"WITH {_CONTAIN} SELECT story_id, grams, matched, containment FROM c"),
    "containment_by_role": (containment_by_role, f"WITH {_CONTAIN} SELECT role, count(*) AS documents, round(avg(containment), 9) AS mean, round(median(containment), 9) AS median, round(avg((containment >= 0.5)::INT), 9) AS share_ge_0_5, round(avg((containment >= 0.8)::INT), 9) AS share_ge_0_8, round(avg((containment >= 1.0)::INT), 9) AS share_ge_1_0 FROM c GROUP BY role"),
    "ngram_scan_8_16_32": (
        ngram_scan,
        f"""WITH {_C}, ns AS (SELECT unnest([8, 16, 32]) AS n),
q AS (SELECT record_id, {S.words("text")} AS w FROM memorization_records WHERE text IS NOT NULL),
t AS (SELECT {S.words("text")} AS w FROM corpus WHERE role = 'train' AND text IS NOT NULL),
g AS (SELECT record_id, 8 AS n, unnest({S.grams("w", 8)}) AS gram FROM q UNION ALL SELECT record_id, 16, unnest({S.grams("w", 16)}) FROM q UNION ALL SELECT record_id, 32, unnest({S.grams("w", 32)}) FROM q),
k AS (SELECT DISTINCT 8 AS n, unnest({S.grams("w", 8)}) AS gram FROM t UNION ALL SELECT DISTINCT 16, unnest({S.grams("w", 16)}) FROM t UNION ALL SELECT DISTINCT 32, unnest({S.grams("w", 32)}) FROM t),
m AS (SELECT record_id, n, count(*) AS grams, count(k.gram) AS matched FROM g LEFT JOIN k USING (n, gram) GROUP BY record_id, n)
SELECT q.record_id, ns.n, coalesce(grams, 0) AS grams, coalesce(matched, 0) AS matched, coalesce(round(matched / grams, 9), 0.0) AS containment FROM q CROSS JOIN ns LEFT JOIN m ON m.record_id = q.record_id AND m.n = ns.n""",
    ),
    "sample_stories": (sample_stories, f"WITH {_C} SELECT story_id FROM corpus WHERE role = 'train' ORDER BY md5(story_id::VARCHAR || ':7'), story_id LIMIT 100"),
    "first_stories": (first_stories, f"WITH {_C} SELECT story_id FROM corpus WHERE role = 'validation' ORDER BY story_id LIMIT 50"),
    "blank_texts": (blank_texts, f"SELECT CASE WHEN text IS NULL THEN 'null' WHEN regexp_matches(text, '^{S.BLANK}*$') THEN 'blank' WHEN length(text) < 100 THEN 'short' ELSE 'story' END AS state, count(*) AS stories FROM tinystories GROUP BY 1"),
}
