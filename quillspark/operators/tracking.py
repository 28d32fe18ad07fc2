"""Experiment index, training history and configuration differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import seed_std


def upsert(index: DataFrame, new: DataFrame, key: str = "run_id") -> DataFrame:
    """index with the rows of new in place of those with the same key."""
    return index.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*index.columns))


def latest_per_run(index: DataFrame, order: list[Column], key: str = "run_id") -> DataFrame:
    """One row for each key: the last in the given order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return index.withColumn("_place", place).where("_place = 1").drop("_place")


def seed_statistics(runs: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """(by, metric, mean, std, n): over seeds; unmeasured values don't count, one value has no deviation."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)))
    long = runs.select(by, each.alias("m")).select(by, "m.metric", "m.value")
    return long.groupBy(by, "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(seed_std("value"), 6).alias("std"), F.count("value").alias("n"))


def ablation_summary(runs: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """Per variant: place in the list (known ones first, then by name), seeds, distinct hardware, parameters of the
    first seed, mean and deviation of the validation loss."""
    known = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("model_name")), F.lit(0)), F.lit(999)) if order else F.lit(999)
    out = runs.groupBy("model_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set("seed")), lambda s: s.cast("string")), ",").alias("seeds"),
        F.array_join(F.array_sort(F.collect_set("hardware")), "; ").alias("hardware"),
        F.min(F.struct("seed", "run_id", "parameters"))["parameters"].alias("parameters"),
        F.round(F.avg("validation_loss"), 6).alias("loss_mean"),
        F.round(seed_std("validation_loss"), 6).alias("loss_std"),
        F.count("validation_loss").alias("n"),
    )
    return out.withColumn("place", known.cast("int"))


def paired_deltas(runs: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(seed, model_name, loss, delta): each seed's loss minus that of the variant before it in the list."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("model_name"))
    best = runs.where(rank > 0).groupBy("seed", "model_name").agg(F.min("validation_loss").alias("loss"))
    before = F.lag("loss").over(Window.partitionBy("seed").orderBy(rank))
    return best.select("seed", "model_name", F.round("loss", 6).alias("loss"), F.round(F.col("loss") - before, 6).alias("delta"))


def last_logged(history: DataFrame) -> DataFrame:
    """History with one record of each kind for each run and step: the last logged; equal times by values."""
    kind = F.when(F.col("val_loss").isNotNull(), F.lit("validation")).otherwise(F.lit("train"))
    order = Window.partitionBy("run_id", "step", "kind").orderBy(F.desc("logged_at"), F.desc("train_loss"), F.desc("val_loss"), F.desc("tokens_seen"), F.desc("lr"), F.desc("grad_norm"), F.desc("tokens_per_second"), F.desc("train_seconds"))
    return history.withColumn("kind", kind).withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def truncate(history: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """History up to the checkpoint (run_id, checkpoint_step) of each run; runs without one are kept whole."""
    return history.join(checkpoints, "run_id", "left").where(F.col("checkpoint_step").isNull() | (F.col("step") <= F.col("checkpoint_step"))).drop("checkpoint_step")


def tumbling_means(history: DataFrame, every: int) -> DataFrame:
    """(run_id, bucket, records, mean_loss, last_step): means over windows of `every` steps, each closed at its end."""
    measured = history.where("kind = 'train' and train_loss is not null and not isnan(train_loss)")
    return measured.groupBy("run_id", F.ceil(F.col("step") / every).alias("bucket")).agg(F.count("*").alias("records"), F.round(F.avg("train_loss"), 6).alias("mean_loss"), F.max("step").alias("last_step"))


def best_so_far(history: DataFrame) -> DataFrame:
    """(run_id, step, val_loss, is_best): validation records in order; a strictly lower loss is the new best."""
    measured = history.where("kind = 'validation' and not isnan(val_loss)")
    before = F.min("val_loss").over(Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    return measured.select("run_id", "step", F.round("val_loss", 9).alias("val_loss"), (before.isNull() | (F.col("val_loss") < before)).alias("is_best"))


def best_checkpoint(history: DataFrame) -> DataFrame:
    """(run_id, best_step, best_loss): the earliest step with the least validation loss."""
    measured = history.where("kind = 'validation' and not isnan(val_loss)")
    return measured.groupBy("run_id").agg(F.min(F.struct("val_loss", "step")).alias("b")).select("run_id", F.col("b.step").alias("best_step"), F.round("b.val_loss", 9).alias("best_loss"))


def keep_last_checkpoints(checkpoints: DataFrame, keep: int) -> DataFrame:
    """The `keep` latest steps of each run."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("step")))
    return checkpoints.select("run_id", "step").distinct().withColumn("place", place).where(F.col("place") <= keep)


def weighted_loss(records: DataFrame, loss: str, weight: str, by: list[str]) -> DataFrame:
    """Mean of loss weighted with weight; groups without weight have no row."""
    used = records.where(F.col(loss).isNotNull() & ~F.isnan(loss) & (F.col(weight) > 0))
    return used.groupBy(*by).agg(F.round(F.sum(F.col(loss) * F.col(weight)) / F.sum(weight), 9).alias("mean_loss"), F.sum(weight).alias("weight"))


def invocation_rollup(history: DataFrame) -> DataFrame:
    """Per run: records, tokens, seconds, mean speed."""
    train = history.where("kind = 'train'")
    return train.groupBy("run_id").agg(
        F.count("*").alias("records"),
        F.max("tokens_seen").alias("tokens_seen"),
        F.round(F.max("train_seconds"), 6).alias("train_seconds"),
        F.round(F.max("tokens_seen") / F.nullif(F.max("train_seconds"), F.lit(0.0)), 6).alias("tokens_per_second"),
    )


def invocation_totals(runs: DataFrame, by: list[str], column: str = "invocations") -> DataFrame:
    """(by, invocations, wall_clock_seconds, training_tokens, peak_vram_mb, hardware, tokens_per_second) over rows with an
    ARRAY of STRUCT<wall_clock_seconds, training_tokens, peak_vram_mb, hardware> in a column: sums of all invocations, the
    most memory, the different hardware in order. What no invocation measured is null."""
    each = runs.select(*by, F.explode(column).alias("i")).select(*by, "i.*")
    total = each.groupBy(*by).agg(
        F.count("*").alias("invocations"),
        F.round(F.sum("wall_clock_seconds"), 6).alias("wall_clock_seconds"),
        F.sum("training_tokens").alias("training_tokens"),
        F.round(F.max("peak_vram_mb"), 6).alias("peak_vram_mb"),
        F.array_join(F.array_sort(F.collect_set("hardware")), "; ").alias("hardware"),
        # a speed needs both numbers of an invocation
        (F.sum(F.when(F.col("wall_clock_seconds").isNotNull(), F.col("training_tokens"))) / F.nullif(F.sum(F.when(F.col("training_tokens").isNotNull(), F.col("wall_clock_seconds"))), F.lit(0.0))).alias("speed"),
    )
    return total.withColumn("tokens_per_second", F.round("speed", 6)).drop("speed")


def flatten_struct(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, key, value): a row for each leaf of a struct, with dotted keys and values as strings."""

    def leaves(kind, path: str):
        for f in kind.fields:
            here = f"{path}.{f.name}"
            if hasattr(f.dataType, "fields"):
                yield from leaves(f.dataType, here)
            else:
                yield here

    paths = list(leaves(rows.schema[column].dataType, column))
    each = F.explode(F.array(*(F.struct(F.lit(p.split(".", 1)[1]).alias("key"), F.col(p).cast("string").alias("value")) for p in paths)))
    return rows.select(*keys, each.alias("e")).select(*keys, "e.key", "e.value")


def config_diff(old: DataFrame, new: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(key, old, new) of two tables (key, value) where they differ; keys of one side only count as null on the other."""
    both = old.select("key", F.col("value").alias("old")).join(new.select("key", F.col("value").alias("new")), "key", "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new")) & ~F.col("key").isin(*ignore) if ignore else ~F.col("old").eqNullSafe(F.col("new")))
