"""Queries of memorization records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memorization, reports
from ..sources.tables import table


def records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "memorization_records")


def longest_common_spans(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(spark, folder).where("text is not null and nearest_training_example is not null")
    found = rows.select("record_id", memorization.longest_common_span("text", "nearest_training_example").alias("s"))
    return found.select("record_id", "s.words", F.md5("s.span").alias("span_md5"))


def memorization_flags(spark: SparkSession, folder: str) -> DataFrame:
    return memorization.flagged(records(spark, folder)).select("record_id", "flagged", F.array_join("flag_reasons", "; ").alias("reasons"))


def memorization_summary(spark: SparkSession, folder: str) -> DataFrame:
    return memorization.memorization_summary(memorization.flagged(records(spark, folder)))


def neighbour_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Records with the story that they name as nearest; the join is on the story's unique id."""
    stories = table(spark, folder, "tinystories").select(F.col("story_id").alias("nearest_training_index"), "source", F.char_length("text").alias("chars"))
    rows = records(spark, folder).select("record_id", "nearest_training_index", F.col("source").alias("record_source"))
    return rows.join(stories, "nearest_training_index", "left").select("record_id", "record_source", "nearest_training_index", F.col("source").alias("story_source"), "chars")


def popular_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).where("nearest_training_index is not null").groupBy("nearest_training_index").agg(F.count("*").alias("records"), F.count_if("flagged").alias("flagged")).where("records > 1")


def similarity_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return reports.histogram(records(spark, folder), "similarity", "source")


def top_flagged(spark: SparkSession, folder: str) -> DataFrame:
    """The most similar flagged generations, for a report."""
    rows = memorization.flagged(records(spark, folder)).where("flagged and source = 'generation'").select("record_id", "item_id", F.round("similarity", 6).alias("similarity"))
    return reports.top(rows, [F.desc_nulls_last("similarity"), F.asc("record_id")], 5)


def repeated_items(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).where("item_id is not null").groupBy("item_id").agg(F.count("*").alias("records"), F.min("record_id").alias("first_record")).where("records > 1")


def overlap_long(spark: SparkSession, folder: str) -> DataFrame:
    """The overlap map in long form."""
    return records(spark, folder).select("record_id", F.explode("ngram_overlap").alias("n", "overlap"))


def generation_union(spark: SparkSession, folder: str) -> DataFrame:
    """Generations and held-out stories as one table of items, told apart by source."""
    made = table(spark, folder, "generation_samples").drop("token_ids").distinct().select(F.lit("generation").alias("source"), reports.item_id("prompt_id", "preset", "seed").alias("item_id"), F.md5("text").alias("text_md5"))
    held = records(spark, folder).where("source = 'heldout_test'").select("source", "item_id", F.md5("text").alias("text_md5"))
    return made.unionByName(held)


_F = """f AS (SELECT *, list_filter([
  CASE WHEN similarity >= 0.8 THEN 'similarity ' || ((floor(similarity * 100 + 0.5)::BIGINT) // 100) || '.' || lpad(((floor(similarity * 100 + 0.5)::BIGINT) % 100)::VARCHAR, 2, '0') || ' >= 0.8' END,
  CASE WHEN max_matched_ngram >= 32 THEN 'verbatim ' || max_matched_ngram || '-token n-gram in training data' END,
  CASE WHEN longest_common_span_words >= 30 THEN longest_common_span_words || '-word span shared with nearest story' END], lambda x: x IS NOT NULL) AS reasons FROM memorization_records)"""
_N = lambda n: f"round(avg(ngram_overlap['{n}']), 6) AS overlap_{n}_mean, round(avg((coalesce(max_matched_ngram, 0) >= {n})::INT), 6) AS share_verbatim_{n}"
_SPLIT = lambda c: f"list_filter(regexp_split_to_array({c}, '[\\t-\\r\\x1c-\\x20\\x{{85}}\\p{{Z}}]+'), lambda x: x <> '')"

QUERIES = {
    "longest_common_span": (
        longest_common_spans,
        f"""WITH r AS (SELECT record_id, {_SPLIT("text")} AS a, {_SPLIT("nearest_training_example")} AS b FROM memorization_records WHERE text IS NOT NULL AND nearest_training_example IS NOT NULL),
x AS (SELECT record_id, unnest(a) AS w, unnest(range(len(a))) AS i FROM r), y AS (SELECT record_id, unnest(b) AS w, unnest(range(len(b))) AS j FROM r),
m AS (SELECT record_id, i, j, i - row_number() OVER (PARTITION BY record_id, i - j ORDER BY i) AS island FROM x JOIN y USING (record_id, w)),
s AS (SELECT record_id, i - j AS d, island, count(*) AS n, min(i) AS i, min(j) AS j FROM m GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY n DESC, i, j) AS p FROM s)
SELECT r.record_id, coalesce(n, 0)::INT AS words, md5(coalesce(array_to_string(a[i + 1:i + n], ' '), '')) AS span_md5 FROM r LEFT JOIN (SELECT * FROM t WHERE p = 1) t USING (record_id)""",
    ),
    "memorization_flags": (memorization_flags, f"WITH {_F} SELECT record_id, len(reasons) > 0 AS flagged, array_to_string(reasons, '; ') AS reasons FROM f"),
    "memorization_summary": (
        memorization_summary,
        f"WITH {_F} SELECT source, count(*) AS count, round(median(similarity), 6) AS similarity_median, round(quantile_cont(similarity, 0.95), 6) AS similarity_p95, round(max(similarity), 6) AS similarity_max, {_N(8)}, {_N(16)}, {_N(32)}, round(median(longest_common_span_words), 6) AS span_words_median, max(longest_common_span_words) AS span_words_max, count(*) FILTER (WHERE len(reasons) > 0) AS flagged FROM f GROUP BY source",
    ),
    "neighbour_lookup": (neighbour_lookup, "SELECT record_id, m.source AS record_source, nearest_training_index, t.source AS story_source, length(t.text)::INT AS chars FROM memorization_records m LEFT JOIN tinystories t ON t.story_id = nearest_training_index"),
    "popular_neighbours": (popular_neighbours, "SELECT nearest_training_index, count(*) AS records, count(*) FILTER (WHERE flagged) AS flagged FROM memorization_records WHERE nearest_training_index IS NOT NULL GROUP BY 1 HAVING count(*) > 1"),
    "histogram_30": (similarity_histogram, "WITH b AS (SELECT source, least(30, floor(similarity * 30)::INT + 1)::INT AS bin FROM memorization_records WHERE similarity BETWEEN 0 AND 1) SELECT source, bin, count(*) AS count, round(count(*) * 30 / sum(count(*)) OVER (PARTITION BY source), 6)::DOUBLE AS density FROM b GROUP BY source, bin"),
    "top_flagged": (top_flagged, f"WITH {_F} SELECT record_id, item_id, round(similarity, 6) AS similarity FROM f WHERE len(reasons) > 0 AND source = 'generation' ORDER BY round(similarity, 6) DESC NULLS LAST, record_id LIMIT 5"),
    "repeated_items": (repeated_items, "SELECT item_id, count(*) AS records, min(record_id) AS first_record FROM memorization_records WHERE item_id IS NOT NULL GROUP BY item_id HAVING count(*) > 1"),
    "overlap_long": (overlap_long, "SELECT record_id, unnest(map_keys(ngram_overlap)) AS n, unnest(map_values(ngram_overlap)) AS overlap FROM memorization_records"),
    "memorization_union": (generation_union, "WITH g AS (SELECT DISTINCT * EXCLUDE (token_ids) FROM generation_samples) SELECT 'generation' AS source, concat_ws('|', prompt_id, preset, seed::VARCHAR) AS item_id, md5(text) AS text_md5 FROM g UNION ALL SELECT source, item_id, md5(text) FROM memorization_records WHERE source = 'heldout_test'"),
}
