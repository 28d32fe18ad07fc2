"""Queries of the experiment index, training history, schedules and memory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import planning, reports, tracking
from ..sources.tables import table
from . import sql as S

_ORDER = ("tiny-27m", "rope", "rmsnorm", "swiglu", "gqa")
_METRICS = ["validation_loss", "test_loss", "tokens_per_second", "peak_vram_mb"]


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each run: of repeated ones the least validation loss."""
    order = [F.asc_nulls_last(c) for c in ("validation_loss", "test_loss", "tokens_per_second")]
    return tracking.latest_per_run(table(spark, folder, "experiments"), order)


def history(spark: SparkSession, folder: str) -> DataFrame:
    return tracking.last_logged(table(spark, folder, "training_history"))


def index_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs(spark, folder).select("run_id", "model_name", "seed", F.round("validation_loss", 9).alias("validation_loss"))


def upsert_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index with a new test loss for the runs of one model."""
    index = runs(spark, folder).select("run_id", "model_name", "test_loss")
    new = index.where("model_name = 'rope'").withColumn("test_loss", F.lit(1.0))
    return tracking.upsert(index, new).select("run_id", "model_name", F.round("test_loss", 9).alias("test_loss"))


def seed_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return tracking.seed_statistics(runs(spark, folder), "model_name", _METRICS)


def ablation_summary(spark: SparkSession, folder: str) -> DataFrame:
    return tracking.ablation_summary(runs(spark, folder), _ORDER)


def paired_deltas(spark: SparkSession, folder: str) -> DataFrame:
    return tracking.paired_deltas(runs(spark, folder), _ORDER)


def perplexities(spark: SparkSession, folder: str) -> DataFrame:
    return runs(spark, folder).select("run_id", F.round(F.exp("validation_loss"), 6).alias("validation_perplexity"), F.round(F.exp("test_loss"), 6).alias("test_perplexity"))


def run_results(spark: SparkSession, folder: str) -> DataFrame:
    """Runs with the best validation loss of their history, if they have one."""
    return runs(spark, folder).select("run_id", "model_name", "steps").join(tracking.best_checkpoint(history(spark, folder)), "run_id", "left")


def hardware_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "experiments").where("hardware is not null").select("hardware").distinct().select("hardware", reports.hardware_slug(F.col("hardware")).alias("slug"))


def speed_by_hardware(spark: SparkSession, folder: str) -> DataFrame:
    return reports.most_per_group(runs(spark, folder).where("hardware is not null"), ["hardware", "model_name"], "tokens_per_second")


def timing_summary(spark: SparkSession, folder: str) -> DataFrame:
    return reports.timing_summary(runs(spark, folder), ["model_name"], "wall_clock_seconds")


def token_budget(spark: SparkSession, folder: str) -> DataFrame:
    return planning.token_budget(runs(spark, folder))


def training_memory(spark: SparkSession, folder: str) -> DataFrame:
    return planning.training_memory(runs(spark, folder))


def history_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return history(spark, folder).groupBy("run_id", "kind").agg(F.count("*").alias("records"), F.max("step").alias("last_step"))


def record_union(spark: SparkSession, folder: str) -> DataFrame:
    """Both shapes of history records as one table; columns that a shape lacks are null."""
    rows = history(spark, folder)
    train = rows.where("kind = 'train'").select("run_id", "step", F.round("lr", 9).alias("lr"), "tokens_seen")
    validation = rows.where("kind = 'validation'").select("run_id", "step", "val_predicted_tokens")
    return train.unionByName(validation, allowMissingColumns=True)


def repeated_records(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("val_loss").isNotNull(), F.lit("validation")).otherwise(F.lit("train")).alias("kind")
    return table(spark, folder, "training_history").groupBy("run_id", "step", kind).agg(F.count("*").alias("times")).where("times > 1")


def history_truncate(spark: SparkSession, folder: str) -> DataFrame:
    """Records that a resume from each run's best checkpoint keeps."""
    rows = history(spark, folder).persist()
    at = tracking.best_checkpoint(rows).select("run_id", F.col("best_step").alias("checkpoint_step"))
    return tracking.truncate(rows, at).groupBy("run_id").agg(F.count("*").alias("kept"), F.max("step").alias("last_step"))


def tumbling_log_mean(spark: SparkSession, folder: str) -> DataFrame:
    return tracking.tumbling_means(history(spark, folder), 500)


def best_so_far(spark: SparkSession, folder: str) -> DataFrame:
    return tracking.best_so_far(history(spark, folder))


def best_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    return tracking.best_checkpoint(history(spark, folder))


def checkpoint_rotation(spark: SparkSession, folder: str) -> DataFrame:
    return tracking.keep_last_checkpoints(history(spark, folder).where("kind = 'validation'"), 3).select("run_id", "step")


def weighted_validation_loss(spark: SparkSession, folder: str) -> DataFrame:
    return tracking.weighted_loss(history(spark, folder).where("kind = 'validation'"), "val_loss", "val_predicted_tokens", ["run_id"])


def invocation_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return tracking.invocation_rollup(history(spark, folder))


def invocation_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of each model over all index rows of it, as the invocations of one entry."""
    parts = ["wall_clock_seconds", "training_tokens", "peak_vram_mb", "hardware"]
    nested = table(spark, folder, "experiments").groupBy("model_name").agg(F.collect_list(F.struct(*parts)).alias("invocations"))
    return tracking.invocation_totals(nested, ["model_name"])


def short_hardware(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "experiments").where("hardware is not null").select("hardware").distinct().select("hardware", reports.short_hardware(F.col("hardware")).alias("short"))


def speed_ratios(spark: SparkSession, folder: str) -> DataFrame:
    return reports.speed_ratios(runs(spark, folder).where("hardware is not null"), ["hardware"], "model_name", "tokens_per_second", "tiny-27m")


def step_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of a run's steps in place of tokens, the first of which took the mean time."""
    rows = runs(spark, folder).where("steps > 0 and wall_clock_seconds > 0").withColumn("first", F.col("wall_clock_seconds") / F.col("steps"))
    return reports.generation_rates(rows, "steps", "first", "wall_clock_seconds").select("run_id", "decode_per_second", "end_to_end_per_second")


def chart_points(spark: SparkSession, folder: str) -> DataFrame:
    return reports.chart_points(history(spark, folder).where("not isnan(train_loss)"))


def lr_schedule(spark: SparkSession, folder: str) -> DataFrame:
    return planning.lr_schedule(spark)


def kv_cache_table(spark: SparkSession, folder: str) -> DataFrame:
    return planning.kv_cache_table(spark)


def parameter_report(spark: SparkSession, folder: str) -> DataFrame:
    return planning.parameter_report(planning.parameter_tensors(spark))


def epoch_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of 64 stories over two epochs, each a permutation by seed and epoch."""
    stories = table(spark, folder, "tinystories").select("story_id")
    n = stories.count()
    order = planning.epoch_order(stories, "story_id", 0, 7).union(planning.epoch_order(stories, "story_id", 1, 7))
    return planning.batches(order, n, 64).select("batch", "slot", F.col("id").alias("story_id"))


_R, _H = S.RUNS, S.KINDS
_VAL = "v AS (SELECT * FROM history WHERE kind = 'validation' AND NOT isnan(val_loss))"
_BEST = f"{_H}, {_VAL}, best AS (SELECT run_id, step AS best_step, round(val_loss, 9) AS best_loss FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY val_loss, step) AS p FROM v) WHERE p = 1)"
_STAT = lambda m: f"SELECT model_name, '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS std, count({m}) AS n FROM runs GROUP BY model_name"
_LIST = "['tiny-27m', 'rope', 'rmsnorm', 'swiglu', 'gqa']"
_EPOCH = lambda e: f"SELECT {e} AS epoch, row_number() OVER (ORDER BY md5('7:{e}:' || story_id), story_id) - 1 AS position, story_id FROM tinystories"

QUERIES = {
    "index_runs": (index_runs, f"WITH {_R} SELECT run_id, model_name, seed, round(validation_loss, 9) AS validation_loss FROM runs"),
    "upsert_index": (upsert_index, f"WITH {_R} SELECT run_id, model_name, CASE WHEN model_name = 'rope' THEN 1.0::DOUBLE ELSE round(test_loss, 9) END AS test_loss FROM runs"),
    "seed_mean_std": (seed_statistics, f"WITH {_R} {' UNION ALL '.join(map(_STAT, _METRICS))}"),
    "ablation_summary": (
        ablation_summary,
        f"WITH {_R} SELECT model_name, array_to_string(list_sort(list(DISTINCT seed) FILTER (WHERE seed IS NOT NULL)), ',') AS seeds, coalesce(array_to_string(list_sort(list(DISTINCT hardware) FILTER (WHERE hardware IS NOT NULL)), '; '), '') AS hardware, arg_min(parameters, (coalesce(seed, -1), run_id)) AS parameters, round(avg(validation_loss), 6) AS loss_mean, round(stddev_samp(validation_loss), 6) AS loss_std, count(validation_loss) AS n, coalesce(nullif(list_position({_LIST}, model_name), 0), 999)::INT AS place FROM runs GROUP BY model_name",
    ),
    "variant_lag": (
        paired_deltas,
        f"WITH {_R}, b AS (SELECT seed, model_name, min(validation_loss) AS loss FROM runs WHERE list_position({_LIST}, model_name) > 0 GROUP BY seed, model_name) SELECT seed, model_name, round(loss, 6) AS loss, round(loss - lag(loss) OVER (PARTITION BY seed ORDER BY list_position({_LIST}, model_name)), 6) AS delta FROM b",
    ),
    "perplexities": (perplexities, f"WITH {_R} SELECT run_id, round(exp(validation_loss), 6) AS validation_perplexity, round(exp(test_loss), 6) AS test_perplexity FROM runs"),
    "run_results": (run_results, f"WITH {_R}, {_BEST} SELECT run_id, model_name, steps, best_step, best_loss FROM runs LEFT JOIN best USING (run_id)"),
    "hardware_slug": (hardware_names, "SELECT DISTINCT hardware, regexp_replace(regexp_replace(lower(hardware), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM experiments WHERE hardware IS NOT NULL"),
    "max_per_hardware": (speed_by_hardware, f"WITH {_R} SELECT hardware, model_name, round(max(tokens_per_second), 6) AS most FROM runs WHERE hardware IS NOT NULL GROUP BY 1, 2"),
    "timing_summary": (timing_summary, f"WITH {_R} SELECT model_name, count(*) AS n, round(avg(wall_clock_seconds), 6) AS mean, round(coalesce(stddev_samp(wall_clock_seconds), 0.0), 6) AS std, round(median(wall_clock_seconds), 6) AS median FROM runs WHERE wall_clock_seconds IS NOT NULL GROUP BY 1"),
    "token_budget": (token_budget, f"WITH {_R} SELECT run_id, training_tokens // nullif(steps, 0) AS tokens_per_step, round(training_tokens / nullif(parameters, 0), 6) AS tokens_per_parameter FROM runs"),
    "training_memory": (training_memory, f"WITH {_R} SELECT run_id, round(parameters * 4 / 1048576.0::DOUBLE, 6) AS weights_mb, round(parameters * 4 / 1048576.0::DOUBLE, 6) AS gradients_mb, round(parameters * 4 / 1048576.0::DOUBLE * 2, 6) AS adamw_mb, round(parameters * 4 / 1048576.0::DOUBLE * 4, 6) AS total_mb FROM runs"),
    "history_kinds": (history_kinds, f"WITH {_H} SELECT run_id, kind, count(*) AS records, max(step) AS last_step FROM history GROUP BY 1, 2"),
    "history_union": (record_union, f"WITH {_H} SELECT run_id, step, CASE WHEN kind = 'train' THEN round(lr, 9) END AS lr, CASE WHEN kind = 'train' THEN tokens_seen END AS tokens_seen, CASE WHEN kind = 'validation' THEN val_predicted_tokens END AS val_predicted_tokens FROM history"),
    "repeated_records": (repeated_records, f"WITH {_H} SELECT run_id, step, kind, count(*) AS times FROM kinds GROUP BY 1, 2, 3 HAVING count(*) > 1"),
    "history_truncate": (history_truncate, f"WITH {_BEST} SELECT run_id, count(*) AS kept, max(step) AS last_step FROM history LEFT JOIN best USING (run_id) WHERE best_step IS NULL OR step <= best_step GROUP BY run_id"),
    "tumbling_log_mean": (tumbling_log_mean, f"WITH {_H} SELECT run_id, ceil(step / 500)::BIGINT AS bucket, count(*) AS records, round(avg(train_loss), 6) AS mean_loss, max(step) AS last_step FROM history WHERE kind = 'train' AND train_loss IS NOT NULL AND NOT isnan(train_loss) GROUP BY 1, 2"),
    "best_so_far": (best_so_far, f"WITH {_H}, {_VAL}, b AS (SELECT *, min(val_loss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v) SELECT run_id, step, round(val_loss, 9) AS val_loss, before IS NULL OR val_loss < before AS is_best FROM b"),
    "best_checkpoint": (best_checkpoint, f"WITH {_BEST} SELECT run_id, best_step, best_loss FROM best"),
    "checkpoint_rotation": (checkpoint_rotation, f"WITH {_H} SELECT run_id, step FROM (SELECT run_id, step, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS p FROM (SELECT DISTINCT run_id, step FROM history WHERE kind = 'validation')) WHERE p <= 3"),
    "weighted_validation_loss": (weighted_validation_loss, f"WITH {_H}, {_VAL} SELECT run_id, round(sum(val_loss * val_predicted_tokens) / sum(val_predicted_tokens), 9) AS mean_loss, sum(val_predicted_tokens)::BIGINT AS weight FROM v WHERE val_predicted_tokens > 0 GROUP BY run_id"),
    "invocation_rollup": (invocation_rollup, f"WITH {_H} SELECT run_id, count(*) AS records, max(tokens_seen) AS tokens_seen, round(max(train_seconds), 6) AS train_seconds, round(max(tokens_seen) / nullif(max(train_seconds), 0.0), 6) AS tokens_per_second FROM history WHERE kind = 'train' GROUP BY run_id"),
    "invocation_totals": (
        invocation_totals,
        "SELECT model_name, count(*) AS invocations, round(sum(wall_clock_seconds), 6) AS wall_clock_seconds, sum(training_tokens)::BIGINT AS training_tokens, round(max(peak_vram_mb), 6) AS peak_vram_mb, coalesce(array_to_string(list_sort(list(DISTINCT hardware) FILTER (WHERE hardware IS NOT NULL)), '; '), '') AS hardware, round(sum(training_tokens) FILTER (WHERE wall_clock_seconds IS NOT NULL) / nullif(sum(wall_clock_seconds) FILTER (WHERE training_tokens IS NOT NULL), 0.0), 6) AS tokens_per_second FROM experiments GROUP BY model_name",
    ),
    "short_hardware": (
        short_hardware,
        "WITH h AS (SELECT DISTINCT hardware FROM experiments WHERE hardware IS NOT NULL), p AS (SELECT hardware, replace(replace(replace(replace(replace(replace(replace(hardware, 'NVIDIA ', ''), 'GeForce ', ''), '(R)', ''), '(TM)', ''), '11th Gen ', ''), 'Intel ', ''), 'Core ', '') AS p FROM h) SELECT hardware, trim(regexp_replace(CASE WHEN starts_with(p, 'CPU (') THEN 'CPU ' || trim(regexp_extract(p, '^CPU \\(([^,@]*)', 1)) ELSE p END, '\\s+', ' ', 'g')) AS short FROM p",
    ),
    "speed_ratios": (
        speed_ratios,
        f"WITH {_R}, m AS (SELECT hardware, model_name, median(tokens_per_second) AS median FROM runs WHERE hardware IS NOT NULL AND tokens_per_second IS NOT NULL GROUP BY 1, 2) SELECT m.hardware, m.model_name, round(m.median, 6) AS median, round(m.median / nullif(b.median, 0.0), 6) AS ratio FROM m LEFT JOIN m b ON b.hardware = m.hardware AND b.model_name = 'tiny-27m'",
    ),
    "step_rates": (
        step_rates,
        f"WITH {_R} SELECT run_id, round((steps - 1) / greatest(wall_clock_seconds - wall_clock_seconds / steps, 1e-9), 6) AS decode_per_second, round(steps / wall_clock_seconds, 6) AS end_to_end_per_second FROM runs WHERE steps > 0 AND wall_clock_seconds > 0",
    ),
    "chart_points": (chart_points, f"WITH {_H} SELECT run_id, step, round(train_loss, 4) AS train_loss, round(lr, 8) AS lr FROM history WHERE kind = 'train' AND NOT isnan(train_loss) AND (step % 100 = 0 OR step < 100)"),
    "lr_schedule": (lr_schedule, "SELECT step, round(CASE WHEN step < 500 THEN (step + 1) / 500.0::DOUBLE ELSE 0.1::DOUBLE + (1 - 0.1::DOUBLE) * 0.5::DOUBLE * (1 + cos(pi() * least(1.0::DOUBLE, (step - 500) / 11500.0::DOUBLE))) END, 9) AS multiplier FROM (SELECT unnest(range(12000)) AS step)"),
    "kv_cache_table": (kv_cache_table, "SELECT b::BIGINT AS batch_size, 512 AS seq_len, round(b * 2 * 8 * 512 * 4 * 64 * 2 / 1048576.0::DOUBLE, 6) AS gqa_mb, round(b * 2 * 8 * 512 * 8 * 64 * 2 / 1048576.0::DOUBLE, 6) AS mha_mb, 2.0::DOUBLE AS ratio FROM (SELECT unnest([1, 8, 64]) AS b)"),
    "parameter_report": (parameter_report, "SELECT * FROM (VALUES ('Token embedding (tied LM head)', 1::BIGINT, (512 * 8192)::BIGINT), ('Attention', 32::BIGINT, (8 * (2 * 512 * 512 + 2 * 512 * 256))::BIGINT), ('Feed-forward', 24::BIGINT, (8 * 3 * 512 * 1408)::BIGINT), ('Normalization', 17::BIGINT, (17 * 512)::BIGINT)) t(component, tensors, parameters)"),
    "epoch_batches": (epoch_batches, f"WITH o AS ({_EPOCH(0)} UNION ALL {_EPOCH(1)}), a AS (SELECT epoch * (SELECT count(*) FROM tinystories) + position AS pos, story_id FROM o) SELECT (pos // 64)::BIGINT AS batch, (pos % 64)::BIGINT AS slot, story_id FROM a"),
}
