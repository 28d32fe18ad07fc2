"""Tables of a folder, with declared schemas for the formats that don't carry one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Scans below this estimate are not worth a shuffle to more tasks.
SPREAD_BYTES = 512 << 10


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose files give fewer tasks than the session has cores, over all cores. That is a file or two of a size
    worth it; large inputs have more splits than cores and stay as they are. For plans without a shuffle only."""
    spark = scan.sparkSession
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    if size < SPREAD_BYTES or scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores)


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table name in folder; with columns only these, spread over all cores."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows.select(*columns)) if columns else rows


GENERATION_SCHEMA = """prompt_id STRING, category STRING, suite_version INT, prompt STRING, completion STRING, text STRING,
prompt_tokens INT, new_tokens INT, finished_with_eos BOOLEAN, preset STRING, seed INT,
settings STRUCT<do_sample: BOOLEAN, temperature: DOUBLE, top_p: DOUBLE, top_k: INT, repetition_penalty: DOUBLE, max_new_tokens: INT, prepend_bos: BOOLEAN, use_cache: BOOLEAN>,
token_ids ARRAY<INT>, created_at STRING, checkpoint STRING, tokenizer_sha256 STRING, device STRING"""

MEMORIZATION_SCHEMA = """source STRING, item_id STRING, text STRING, tokens INT, ngram_overlap MAP<STRING, DOUBLE>, max_matched_ngram INT,
nearest_training_index BIGINT, nearest_training_example STRING, similarity DOUBLE, longest_common_span_words INT,
longest_common_span STRING, flagged BOOLEAN, flag_reasons ARRAY<STRING>"""

HISTORY_SCHEMA = """step BIGINT, train_loss DOUBLE, lr DOUBLE, grad_norm DOUBLE, tokens_seen BIGINT, tokens_per_second DOUBLE,
train_seconds DOUBLE, val_loss DOUBLE, val_perplexity DOUBLE, val_predicted_tokens BIGINT"""

INDEX_SCHEMA = """run_id STRING, model_name STRING, seed INT, parameters BIGINT, training_tokens BIGINT, steps BIGINT, validation_loss DOUBLE,
test_loss DOUBLE, test_perplexity DOUBLE, tokens_per_second DOUBLE, peak_vram_mb DOUBLE, wall_clock_seconds DOUBLE, hardware STRING,
checkpoint_path STRING, git_commit STRING"""
