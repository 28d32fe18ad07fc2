"""JSON lines, CSV index, prompt suite, guarded caches and packed data."""

from __future__ import annotations

import json
import os
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import INDEX_SCHEMA


def write_json(path: str | Path, value: Any) -> None:
    """Writes a file of metadata in one step: readers see the old or the new one."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    part.write_text(json.dumps(value, indent=2, ensure_ascii=False, sort_keys=True), encoding="utf-8")
    os.replace(part, path)


def read_json(path: str | Path) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines with a declared schema; blank lines don't count, a missing path is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The experiment index: header, declared columns, blanks are nulls; a missing path is an empty index."""
    if not _exists(spark, path):
        return spark.createDataFrame([], INDEX_SCHEMA)
    return spark.read.option("header", True).option("nullValue", "").schema(INDEX_SCHEMA).csv(path)


def write_index(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompts of a suite file {"version": n, "prompts": [...]}; raises ValueError for ids that stand twice."""
    schema = "version INT, prompts ARRAY<STRUCT<id: STRING, category: STRING, `group`: STRING, prompt: STRING, expected: STRING>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select("version", F.explode("prompts").alias("p")).select("version", "p.*")
    twice = [r["id"] for r in rows.groupBy("id").count().where("count > 1").select("id").toLocalIterator()]
    if twice:
        raise ValueError(f"prompt ids stand twice: {sorted(twice)}")
    return rows


class StaleData(RuntimeError):
    """Stored data that was made with other settings."""


def write_splits(splits: DataFrame, folder: str, key: dict[str, Any], revision: str | None = None) -> None:
    """Splits as Parquet, one folder for each, with the settings that made them beside."""
    splits.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/splits")
    write_json(f"{folder}/meta.json", {"key": key, "revision": revision})


def read_splits(spark: SparkSession, folder: str, key: dict[str, Any]) -> DataFrame | None:
    """Stored splits if they were made with these settings; None if there are none; StaleData if with others."""
    meta = Path(folder, "meta.json")
    if not meta.exists():
        return None
    if read_json(meta).get("key") != json.loads(json.dumps(key)):
        raise StaleData(f"{folder} was made with other settings; remove it or write it again")
    return spark.read.parquet(f"{folder}/splits")


def write_packed(blocks: DataFrame, folder: str, block_size: int, tokenizer: str) -> None:
    """Packed blocks as Parquet, sorted by block within files, with block size and the tokenizer's fingerprint."""
    blocks.repartitionByRange("block_id").sortWithinPartitions("block_id").write.mode("overwrite").parquet(f"{folder}/blocks")
    write_json(f"{folder}/meta.json", {"block_size": block_size, "tokenizer": tokenizer})


def read_packed(spark: SparkSession, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Packed blocks; raises StaleData if another tokenizer made them, ValueError if a block has another length."""
    meta = read_json(f"{folder}/meta.json")
    if tokenizer is not None and meta["tokenizer"] != tokenizer:
        raise StaleData(f"{folder} was packed with another tokenizer")
    blocks = spark.read.parquet(f"{folder}/blocks")
    if blocks.where(F.size("tokens") != meta["block_size"]).limit(1).count():
        raise ValueError(f"{folder} has blocks that are not {meta['block_size']} tokens long")
    return blocks


def rows_of(rows: DataFrame, id_col: str, ids: list[Any]) -> DataFrame:
    """Rows by id; the filter reaches the scan."""
    return rows.where(F.col(id_col).isin(ids))


def resolved_revision(configured: str | None, lookup) -> str | None:
    """The revision that lookup() gives; the configured one if it gives none or fails, for whatever reason."""
    try:
        return lookup() or configured
    except Exception:  # noqa: BLE001 - a store that can't be reached must not stop a run
        return configured
