"""Roles of rows by the split protocol of their source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_QUOTES = "\"'`‘’‚‛“”„‟«»‹›「」"
ROLES = ("train", "validation", "test")


def split_roles(integrity: DataFrame) -> DataFrame:
    """(source, split_name, role): the official split that a report's protocol names in quotation marks for each role.
    Repeated reports count once; a role without a quoted name has no row."""
    name = lambda role: F.lower(F.regexp_extract(F.col("split_protocol")[role], f"[{_QUOTES}]\\s*([^{_QUOTES}]*?)\\s*[{_QUOTES}]", 1))
    roles = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), name(r).alias("split_name")) for r in ROLES))).alias("r")
    return integrity.where("source is not null").select("source", roles).select("source", "r.split_name", "r.role").where("split_name <> ''").distinct()


def with_role(rows: DataFrame, integrity: DataFrame, source_col: str = "source", split_col: str = "hub_split") -> DataFrame:
    """rows with a column role (train, validation, test); rows in no split are left out. Names of splits compare without
    case and outer blanks. The protocol has a row for each source and role; Spark broadcasts it while it is small."""
    official = F.lower(F.regexp_replace(F.col(split_col), r"(?U)^\s+|\s+$", ""))
    roles = split_roles(integrity).select(F.col("source").alias("_source"), F.col("split_name").alias("_split"), "role")
    return rows.join(roles, (F.col(source_col) == F.col("_source")) & (official == F.col("_split"))).drop("_source", "_split")
