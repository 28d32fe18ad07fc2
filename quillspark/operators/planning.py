"""Schedules, budgets, job lists, sampling orders and memory tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScheduleOptions:
    """Linear warm-up, then a cosine to least_ratio, or a constant rate."""

    steps: int = 12_000
    warmup: int = 500
    least_ratio: float = 0.1
    kind: str = "cosine"


def lr_multiplier(step: Column, options: ScheduleOptions) -> Column:
    done = (step - options.warmup) / F.lit(float(max(1, options.steps - options.warmup)))
    after = F.lit(1.0) if options.kind == "constant" else options.least_ratio + (1 - options.least_ratio) * 0.5 * (1 + F.cos(F.pi() * F.least(F.lit(1.0), done)))
    return F.when(step < options.warmup, (step + 1) / F.lit(float(max(1, options.warmup)))).otherwise(after)


def lr_schedule(spark: SparkSession, options: ScheduleOptions = ScheduleOptions()) -> DataFrame:
    return spark.range(options.steps).select(F.col("id").alias("step"), F.round(lr_multiplier(F.col("id"), options), 9).alias("multiplier"))


def token_budget(runs: DataFrame) -> DataFrame:
    """(run_id, tokens_per_step, tokens_per_parameter): of the planned tokens."""
    return runs.select("run_id", F.expr("training_tokens div nullif(steps, 0)").alias("tokens_per_step"), F.round(F.col("training_tokens") / F.nullif(F.col("parameters"), F.lit(0)), 6).alias("tokens_per_parameter"))


def training_memory(runs: DataFrame) -> DataFrame:
    """(run_id, weights_mb, gradients_mb, adamw_mb, total_mb): static memory of 32-bit weights, gradients and moments."""
    mb = F.col("parameters") * 4 / F.lit(1024.0 * 1024.0)
    return runs.select("run_id", *(F.round(mb * k, 6).alias(n) for n, k in (("weights_mb", 1), ("gradients_mb", 1), ("adamw_mb", 2), ("total_mb", 4))))


@dataclass(frozen=True)
class ModelShape:
    layers: int = 8
    hidden: int = 512
    heads: int = 8
    kv_heads: int = 4
    feed_forward: int = 1408
    vocabulary: int = 8192
    positions: int = 512
    tied: bool = True

    @property
    def head(self) -> int:
        return self.hidden // self.heads


def kv_cache_table(spark: SparkSession, shape: ModelShape = ModelShape(), batch_sizes: tuple[int, ...] = (1, 8, 64), bytes_each: int = 2) -> DataFrame:
    """(batch_size, seq_len, gqa_mb, mha_mb, ratio): key and value caches at full context."""
    size = lambda heads: F.col("batch_size") * (2 * shape.layers * shape.positions * heads * shape.head * bytes_each)
    rows = spark.createDataFrame([(b,) for b in batch_sizes], "batch_size long")
    mb = F.lit(1024.0 * 1024.0)
    return rows.select("batch_size", F.lit(shape.positions).alias("seq_len"), F.round(size(shape.kv_heads) / mb, 6).alias("gqa_mb"), F.round(size(shape.heads) / mb, 6).alias("mha_mb"), F.round(size(shape.heads) / size(shape.kv_heads), 6).alias("ratio"))


def parameter_tensors(spark: SparkSession, shape: ModelShape = ModelShape()) -> DataFrame:
    """(name, tensor_id, layer, size): the tensors of a decoder; tied tensors share their id."""
    h, kv = shape.hidden, shape.kv_heads * shape.head
    inner = [("self_attn.q_proj", h * h), ("self_attn.k_proj", h * kv), ("self_attn.v_proj", h * kv), ("self_attn.o_proj", h * h), ("mlp.gate_proj", h * shape.feed_forward), ("mlp.up_proj", h * shape.feed_forward), ("mlp.down_proj", h * shape.feed_forward), ("input_layernorm", h), ("post_attention_layernorm", h)]
    rows = [("model.embed_tokens.weight", "embed", None, h * shape.vocabulary), ("model.norm.weight", "norm", None, h), ("lm_head.weight", "embed" if shape.tied else "head", None, h * shape.vocabulary)]
    rows += [(f"model.layers.{i}.{n}.weight", f"{i}.{n}", i, size) for i in range(shape.layers) for n, size in inner]
    return spark.createDataFrame(rows, "name string, tensor_id string, layer int, size long")


# Parts of tensor names and the group they belong to; the first that fits counts.
PARAMETER_GROUPS = [
    (("embed_tokens",), "Token embedding (tied LM head)"),
    (("embed_positions",), "Learned position embedding"),
    (("lm_head",), "LM head (untied)"),
    (("q_proj", "k_proj", "v_proj", "o_proj"), "Attention"),
    (("gate_proj", "up_proj", "down_proj"), "Feed-forward"),
    (("norm",), "Normalization"),
]


def parameter_group(name: Column) -> Column:
    out = None
    for parts, label in PARAMETER_GROUPS:
        fits = name.rlike("|".join(parts))
        out = F.when(fits, label) if out is None else out.when(fits, label)
    return out.otherwise("Other")


def parameter_report(tensors: DataFrame) -> DataFrame:
    """(component, tensors, parameters): each tensor once, under the first of its names."""
    once = tensors.groupBy("tensor_id").agg(F.max_by("size", F.when(F.col("name").contains("embed"), 1).otherwise(0)).alias("size"), F.max_by("name", F.when(F.col("name").contains("embed"), 1).otherwise(0)).alias("name"))
    return once.groupBy(parameter_group(F.col("name")).alias("component")).agg(F.count("*").alias("tensors"), F.sum("size").alias("parameters"))


MOST_BROADCAST_JOBS = 10_000


def generation_jobs(prompts: DataFrame, presets: DataFrame, seeds: DataFrame) -> DataFrame:
    """(prompt_id, preset, seed): every prompt with every preset (preset, do_sample) and seed; a preset that doesn't
    sample runs with the first seed only. The list is the product by its meaning; presets with seeds are broadcast only
    as far as they are few."""
    first = seeds.agg(F.min("seed").alias("first"))
    jobs = presets.crossJoin(seeds).crossJoin(first).where(F.col("do_sample") | (F.col("seed") == F.col("first"))).select("preset", "seed")
    few = jobs.limit(MOST_BROADCAST_JOBS + 1).count() <= MOST_BROADCAST_JOBS
    return prompts.select(F.col("id").alias("prompt_id")).crossJoin(F.broadcast(jobs) if few else jobs)


def pending_jobs(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs without a result."""
    return jobs.join(done.select("prompt_id", "preset", "seed").distinct(), ["prompt_id", "preset", "seed"], "left_anti")


def fits_context(rows: DataFrame, tokens: str, most: int) -> DataFrame:
    """rows with fits and, for those that don't, a reason; one token is kept for the document's start."""
    ok = F.col(tokens) + 1 < most
    return rows.withColumn("fits", ok).withColumn("reason", F.when(~ok, F.concat(F.lit("prompt has "), F.col(tokens).cast("string"), F.lit(f" tokens, context {most}"))))


def epoch_order(rows: DataFrame, id_col: str, epoch: int, seed: int) -> DataFrame:
    """(epoch, position, id): the permutation of an epoch, a function of seed, epoch and id only. Positions come from a
    prefix sum over hash ranges, so no task sorts all rows; the ranges are the 65,536 beginnings of the hash."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(id_col).cast("string")))
    keyed = rows.select(F.col(id_col).alias("id"), key.alias("_key")).withColumn("_part", F.substring("_key", 1, 4))
    base = keyed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_base")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_key", "id")) - 1
    return keyed.withColumn("_inside", inside).join(F.broadcast(base), "_part").select(F.lit(epoch).alias("epoch"), (F.col("_base") + F.col("_inside")).alias("position"), "id")


def batches(order: DataFrame, rows_per_epoch: int, batch: int) -> DataFrame:
    """(batch, slot, id): consecutive positions over epochs; a batch may span two of them."""
    at = F.col("epoch") * F.lit(rows_per_epoch).cast("long") + F.col("position")
    return order.select(F.floor(at / batch).alias("batch"), (at % batch).alias("slot"), "id")
