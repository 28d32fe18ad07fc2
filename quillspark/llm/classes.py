"""Texts with the same sequence of words as one class, with one representative, and pairs of classes as pairs of members."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.bitmap import contains, membership_bitmap, only_possible
from ..operators.skew import join_groups


class Classes:
    """The classes of a persisted table (id, words, ...): rows with equal words. The representative is the least id. Most
    classes have one member; a bitmap of bounded size tells those that may have several, so only their rows are
    shuffled, and no task gets all rows of a large class."""

    def __init__(self, table: DataFrame):
        self.table = table
        self.firsts: DataFrame | None = None
        self.total = table.count()
        self.sizes = table.groupBy("words").agg(F.min("id").alias("rep"), F.count("*").alias("n")).persist()
        several = self.sizes.where("n > 1")
        self.bits = table.sparkSession.sparkContext.broadcast(membership_bitmap(several.select(F.xxhash64("words")), several.count()))

    def _split(self, rows: DataFrame, maybe: bool) -> DataFrame:
        """Of rows with a column words, those of classes that may have several members, or the others."""
        bits = self.bits

        def chosen(batches):
            for batch in batches:
                keep = contains(bits.value, batch.column(0).to_numpy()) == maybe
                if keep.any():
                    yield batch.filter(pa.array(keep))

        slot = rows.select(F.xxhash64("words").alias("_slot"), *rows.columns)
        return slot.mapInArrow(chosen, slot.schema).drop("_slot")

    def representatives(self) -> DataFrame:
        """One row of each class, that of the least id, with its columns."""
        if self.firsts is None:
            first = self._split(self.sizes.select("words", "rep"), True).withColumnsRenamed({"words": "_words", "rep": "_rep"})
            rows = self._split(self.table, True)
            self.firsts = rows.join(first, (F.col("words") == F.col("_words")) & (F.col("id") == F.col("_rep"))).drop("_words", "_rep").dropDuplicates(["words", "id"]).persist()
        return self._split(self.table, False).unionByName(self.firsts)

    def members(self, reps: DataFrame, columns: list[str]) -> DataFrame:
        """(rep, n, id, *columns) of all members of the classes whose representatives are in the BIGINT columns of reps, and
        perhaps of some more; n: the class's rows."""
        bits = membership_bitmap(reps, reps.count() * len(reps.columns))
        alone = only_possible(self._split(self.table, False).select(F.col("id").alias("rep"), F.lit(1).cast("long").alias("n"), "id", *columns), bits)
        sizes = only_possible(self._split(self.sizes, True).select("rep", "n", "words"), bits)
        more = join_groups(self._split(self.table, True).select("words", "id", *columns), sizes, ["words"], "n", self.total)
        return alone.unionByName(more.select("rep", "n", "id", *columns))


def same_record() -> Column:
    """Whether both members have the same letters and digits or the same labelled fields."""
    return (F.col("l_flat") == F.col("r_flat")) | F.coalesce(F.col("l_fields") == F.col("r_fields"), F.lit(False))
