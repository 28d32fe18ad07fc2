"""Mixing sources to target shares of all tokens, by weighted sampling with exponential keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .encode import VOCABULARY, with_token_counts


@dataclass(frozen=True)
class MixOptions:
    """seed: of the sampling keys. total_tokens: planned size of the mixture; None takes the largest at which each
    source that has documents can give its share within its repeats. vocabulary: the tokenizer's file. bins: bins of the
    sampling keys for each unit of their logarithm; whatever the weights, a bin has at most 1 / (2.7 bins) of a source in the
    mean, and only the one in which a budget ends is sorted. near: part of what is left of a budget by which the last
    document may miss it. broadcast_rows: more targets than this
    are joined with a shuffle."""

    seed: int = 17
    total_tokens: int | None = None
    vocabulary: str = VOCABULARY
    bins: int = 1024
    near: float = 0.25
    broadcast_rows: int = 10_000


def text_quality(text: Column) -> Column:
    """Default quality weight, 0.1 to 1: the share of letters and blanks among a text's characters."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\s]", ""))
    return F.greatest(F.lit(0.1), kept / F.greatest(F.length(text), F.lit(1)))


def _gathered(rows: DataFrame) -> DataFrame:
    """A table of at most a row for each target source, as a local one: its plan is not part of the plans that use it."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def mixture(docs: DataFrame, targets: DataFrame, options: MixOptions = MixOptions(), quality=text_quality) -> DataFrame:
    """(doc_id, source, tokens, uses): the documents of the mixture and how often each is used.

    Each source gets target_share of the planned total in tokens of the vocabulary: complete epochs first, then a
    sample of the source without replacement, in the order of -ln(u) / weight with u a hash of doc_id and the seed
    (Efraimidis and Spirakis), as far as the sum stays within the budget; last comes the first document in that order whose
    size is within options.near of what is left, if there is one. No document is used more than max_repeats times. Sums over bins of keys place the end of each budget; only that bin is sorted, so a source
    with a third of all rows is never sorted or gathered in one task.

    Documents of sources that are not listed, of a null source, and without tokens (null or empty text) are not used. A
    listed source without documents gets nothing, and what the others give stays in proportion. Targets with a null or
    non-positive share or repeats give nothing; repeated rows of targets count once. Rows that repeat a doc_id are
    documents of their own. Other columns are ignored.
    """
    goal = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    small = goal.limit(options.broadcast_rows + 1).count() <= options.broadcast_rows
    hint = F.broadcast if small else (lambda df: df)
    listed = docs.select("doc_id", "source", "text").join(hint(goal.select("source")), "source")
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(options.seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = listed.where("length(text) > 0").select("doc_id", "source", (-F.log(uniform) / quality(F.col("text"))).alias("key"), F.xxhash64("text").alias("tie"), "text")
    sized = with_token_counts(keyed, "text", options.vocabulary).withColumn("bin", F.floor(options.bins * F.log(F.greatest("key", F.lit(1e-300)))).cast("int")).persist()
    bins = sized.groupBy("source", "bin").agg(F.sum("tokens").alias("tokens")).persist()
    own = bins.groupBy("source").agg(F.sum("tokens").alias("all_tokens")).where("all_tokens > 0").join(goal, "source")
    if options.total_tokens is None:
        total = own.agg(F.min(F.col("all_tokens") * F.col("max_repeats") / F.col("target_share")).alias("t"))
        planned = own.crossJoin(total)  # one row
    else:
        planned = own.withColumn("t", F.lit(float(options.total_tokens)))
    budget = F.col("target_share") * F.col("t")
    plan = planned.withColumn("epochs", F.least(F.col("max_repeats"), F.floor(budget / F.col("all_tokens") + 1e-9)).cast("int")).withColumn(
        "rest", F.when(F.col("epochs") >= F.col("max_repeats"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), budget - F.col("epochs") * F.col("all_tokens")))
    )
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        bins.withColumn("before", F.coalesce(F.sum("tokens").over(upto), F.lit(0)))
        .join(plan.select("source", "epochs", "rest"), "source")
        .groupBy("source", "epochs", "rest")
        .agg(F.max(F.when(F.col("before") < F.col("rest"), F.struct("bin", "before"))).alias("last"))
        .select("source", "epochs", "rest", F.coalesce("last.bin", F.lit(-(1 << 31))).alias("last_bin"), F.coalesce("last.before", F.lit(0)).alias("before"))
    )
    ends = _gathered(ends) if small else ends
    rows = sized.join(hint(ends), "source")
    order = Window.partitionBy("source").orderBy("key", "doc_id", "tie")
    running = F.col("before") + F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = ["doc_id", "source", "tokens", "key", "tie", "epochs"]
    inner = rows.where("bin <> last_bin").select(*kept, (F.col("bin") < F.col("last_bin")).alias("taken"), "rest", F.col("before").alias("sum"))
    edge = rows.where("bin = last_bin").select(*kept, running.alias("sum"), "rest", "before")
    edge = edge.select(*kept, (F.col("sum") <= F.col("rest")).alias("taken"), "rest", F.greatest("before", F.when(F.col("sum") <= F.col("rest"), F.col("sum"))).alias("sum"))
    chosen = inner.unionByName(edge).where("tokens > 0")
    # one row for each source: what the prefix leaves of the budget, and the document that fits it best
    chosen = chosen.persist()
    left = chosen.groupBy("source").agg((F.max("rest") - F.max("sum")).alias("left"))
    off = F.abs(F.col("tokens") - F.col("left"))
    fill = chosen.where("not taken").join(hint(left), "source").where(off <= options.near * F.col("left")).groupBy("source").agg(F.min(F.struct("key", "doc_id", "tie")).alias("fill")).select(F.col("source").alias("_source"), "fill")
    fill = _gathered(fill) if small else fill
    extra = F.coalesce((F.col("key") == F.col("fill.key")) & F.col("doc_id").eqNullSafe(F.col("fill.doc_id")) & (F.col("tie") == F.col("fill.tie")), F.lit(False))
    uses = F.col("epochs") + (F.col("taken") | extra).cast("int")
    return chosen.join(hint(fill), F.col("source") == F.col("_source"), "left").select("doc_id", "source", "tokens", uses.alias("uses")).where("uses > 0")


def mixture_shares(docs: DataFrame, targets: DataFrame, options: MixOptions = MixOptions(), quality=text_quality) -> DataFrame:
    """(source, target_share, max_repeats, documents, most_uses, tokens, actual_share) of each listed source in the
    mixture; actual_share is of the tokens that the mixture reaches."""
    used = mixture(docs, targets, options, quality).groupBy("source").agg(F.count("*").alias("documents"), F.max("uses").alias("most_uses"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"))
    all_tokens = used.agg(F.sum("tokens").alias("all_tokens"))
    goal = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return goal.join(used, "source", "left").crossJoin(all_tokens).select("source", "target_share", "max_repeats", none("documents"), none("most_uses"), none("tokens"), F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"))
