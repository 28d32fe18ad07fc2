"""Help against hot keys: counts in tables of fixed size that tell, before a shuffle, which keys are too large for one task,
and a join with the row of each key's group that never gathers a hot group."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import slots_of

_PART = 1 << 13
#: join_groups broadcasts fewer groups than this, whatever the data's size.
MAX_HEAVY = 256


@dataclass(frozen=True)
class SlotCounts:
    """Counts of 64-bit values by slot: at least as high as the count of any value in the slot."""

    counts: np.ndarray

    def of(self, values: np.ndarray) -> np.ndarray:
        return self.counts[slots_of(values, len(self.counts))]

    def parts(self, values: np.ndarray, hot: int) -> np.ndarray:
        """Into how many parts the rows of each value are cut: 1 unless its slot stands out of the usual load by more than
        hot rows, so one that does is always cut, however full the table is."""
        over = hot + 2 * int(self.counts.sum() // len(self.counts))
        n = self.of(values)
        return np.where(n > over, -(-n // hot), 1)


def _count_rows(slots: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.int64)
        for batch in batches:
            for column in batch.columns:
                values = np.frombuffer(b"".join(column.drop_null().to_pylist()), np.int64) if pa.types.is_binary(column.type) else column.drop_null().to_numpy()
                counts += np.bincount(slots_of(values, slots).astype(np.int64), minlength=slots)
        at = [i for i in range(0, slots, _PART) if counts[i : i + _PART].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([zlib.compress(counts[i : i + _PART].tobytes(), 1) for i in at], pa.binary())], names=["at", "counts"])

    return rows


def _summed(key, table):
    out = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in table.column("counts").to_pylist())
    return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([out.tobytes()], pa.binary())})


def slot_counts(values: DataFrame, slots: int = 1 << 18) -> SlotCounts:
    """How often the values in the columns of a table (BIGINT, or BINARY with many 64-bit values) stand in each of a fixed
    number of slots, a power of two. Tasks count, executors add up; the driver gets 8 bytes a slot. Nulls don't count."""
    out = np.zeros(slots, np.int64)
    found = values.mapInArrow(_count_rows(slots), "at long, counts binary").groupBy("at").applyInArrow(_summed, "at long, counts binary")
    for row in found.collect():
        part = np.frombuffer(row["counts"], np.int64)
        out[row["at"] : row["at"] + len(part)] = part
    return SlotCounts(out)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with groups, which has one row for each key with the number of its rows in column `size`; total:
    all rows. Groups of more than a MAX_HEAVY-th of all rows are fewer than MAX_HEAVY and are broadcast, so their rows
    stay where they are; in the shuffle of the others no key has more than that many rows. Null keys match nothing."""
    large = F.col(size) > max(1, total // MAX_HEAVY)
    heavy, light = groups.where(large), groups.where(~large)
    mark = heavy.select(*keys, F.lit(True).alias("_heavy"))
    rest = rows.join(F.broadcast(mark), keys, "left").where("_heavy is null").drop("_heavy")
    return rows.join(F.broadcast(heavy), keys).unionByName(rest.join(light, keys))


def expand(pairs: DataFrame, left: DataFrame, right: DataFrame, hot: int) -> DataFrame:
    """Pairs (lo, hi, more columns) of representatives as pairs (x, y) of members of both classes; left and right: members
    (rep, n, id, ...), n the rows of their class, whose other columns come out with l_ and r_ before their names. A class of more than hot rows
    is cut into parts, and each pair of parts is joined on a key of its own."""

    def parts(n) -> Column:
        return F.ceil(n / F.lit(hot)).cast("int")

    def cut(members: DataFrame, rep: str, part: str, to: str, prefix: str) -> DataFrame:
        others = [F.col(c).alias(prefix + c) for c in members.columns if c not in ("rep", "n", "id")]
        return members.select(F.col("rep").alias(rep), F.pmod(F.xxhash64("id"), parts(F.col("n"))).cast("int").alias(part), F.col("id").alias(to), *others)

    def size(members: DataFrame, rep: str, to: str) -> DataFrame:
        return members.where(F.col("n") > hot).groupBy(F.col("rep").alias(rep)).agg(F.max("n").alias(to))

    steps = lambda n: F.explode(F.sequence(F.lit(0), parts(F.coalesce(n, F.lit(1))) - 1))
    tiles = pairs.join(size(left, "lo", "_ln"), "lo", "left").join(size(right, "hi", "_rn"), "hi", "left")
    tiles = tiles.withColumn("_a", steps(F.col("_ln"))).withColumn("_b", steps(F.col("_rn"))).drop("_ln", "_rn")
    return tiles.join(cut(left, "lo", "_a", "x", "l_"), ["lo", "_a"]).join(cut(right, "hi", "_b", "y", "r_"), ["hi", "_b"]).drop("lo", "hi", "_a", "_b")
