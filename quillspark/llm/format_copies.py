"""Copies hidden by formatting, by progressive partition refinement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.wordhash import mix
from ..operators.bitmap import contains, membership_bitmap
from ..operators.skew import join_groups
from .charforms import LABELS, count_letters_and_digits, field_key, flat_key, letters_and_digits, one_form, record_fields


def _weights() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, 256, dtype=np.uint64)


def letter_histograms(flats: list[bytes]) -> np.ndarray:
    """A hash of how often each byte stands in each of the non-empty strings, whatever the order."""
    if not flats:
        return np.zeros(0, np.int64)
    weight = _weights()[np.frombuffer(b"".join(flats), np.uint8)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in flats])[:-1]])
    return np.add.reduceat(weight, first).view(np.int64)


def _invariant(form: str, flat: bytes, labels: tuple[str, ...]) -> bytes:
    """The letters whose number and histogram are compared: escapes and quotes of an encoded record add none once it is
    read."""
    fields = record_fields(form, labels) if form.lstrip()[:1] == "{" else None
    return flat if fields is None else b"".join(letters_and_digits(x) for f in fields for x in f)


def _classes(texts: list[str], min_letters: int, labels: tuple[str, ...]) -> tuple[list[int], list[tuple[str, bytes]], np.ndarray]:
    """Of the texts long enough: their indexes, one forms with letters and digits, and classes of equal length and histogram."""
    at, forms, same = [], [], []
    for i, text in enumerate(texts):
        form = one_form(text)
        flat = letters_and_digits(form)
        if count_letters_and_digits(flat) >= min_letters:
            at.append(i)
            forms.append((form, flat))
            same.append(_invariant(form, flat, labels))
    size = np.array([len(x) for x in same], np.uint64)
    return at, forms, mix(size + letter_histograms(same).view(np.uint64)).view(np.int64)


def _class_rows(min_letters: int, labels: tuple[str, ...]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_classes(batch.column(0).to_pylist(), min_letters, labels)[2])], names=["class"])

    return rows


def _key_rows(bits, min_letters: int, labels: tuple[str, ...]):
    """(id, text) -> (id, flat, fields) of texts whose class may have several members."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, forms, of = _classes(batch.column(1).to_pylist(), min_letters, labels)
            keep = np.flatnonzero(contains(bits.value, of))
            flat, fields = [flat_key(forms[i][1]) for i in keep], [field_key(forms[i][0], labels) for i in keep]
            ids = batch.column(0).take(pa.array([at[i] for i in keep], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(flat, pa.binary()), pa.array(fields, pa.binary())], names=["id", "flat", "fields"])

    return rows


def record_classes(docs: DataFrame, id_col: str, text_col: str, min_letters: int = 40, labels: tuple[str, ...] = LABELS) -> tuple[DataFrame, int]:
    """(id, record) of the texts that may share length and letter histogram with another, and the number of rows before
    repeated ones are dropped; equal record: the same record.

    Refinement: classes of equal length and letter histogram first, which order, case, layout and blanks don't change.
    They are counted with partial aggregation, so a class of a third of all rows is one row for each task; a bitmap of
    bounded size brings the classes with several members back to the texts, so no text is shuffled and no task gets a
    class. Only their members get the costly keys (whole letter sequence, parsed fields). Then the classes of equal
    letters are refined once more: if some of its texts are records of labelled fields and others are not read as such,
    all take the key of the fields.
    """
    text = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    several = text.select("text").mapInArrow(_class_rows(min_letters, labels), "class long").groupBy("class").count().where("count > 1").select("class").persist()
    bits = docs.sparkSession.sparkContext.broadcast(membership_bitmap(several, several.count()))
    several.unpersist()
    keyed = text.mapInArrow(_key_rows(bits, min_letters, labels), "id long, flat binary, fields binary").persist()
    total = keyed.count()
    mixed = keyed.groupBy("flat").agg(F.min("fields").alias("best"), F.max("fields").alias("other"), F.count("fields").alias("read"), F.count("*").alias("n"))
    mixed = mixed.where("read > 0 and (read < n or best <> other)").select("flat", "best", "n")
    own = keyed.select("id", "flat", F.lit(0).alias("known"), F.coalesce("fields", "flat").alias("record"))
    better = join_groups(keyed.select("id", "flat"), mixed, ["flat"], "n", total).select("id", "flat", F.lit(1).alias("known"), F.col("best").alias("record"))
    return own.unionByName(better).groupBy("id", "flat").agg(F.max(F.struct("known", "record"))["record"].alias("record")).select("id", "record").distinct(), total


def format_copies(docs: DataFrame, id_col: str = "story_id", text_col: str = "text", min_letters: int = 40, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(keep_id, copy_id) for each copy of a record that differs in blanks, case, punctuation, look-alike characters or
    the order of labelled fields only; keep_id is the record's smallest id. A record of a third of all rows is spread over
    all tasks.

    Null ids, null texts and texts with fewer than min_letters letters and digits are no case. Identical texts are
    copies. A row repeated with the same id is one row. Other columns are ignored. An empty table gives no rows.
    """
    classes, total = record_classes(docs, id_col, text_col, min_letters, labels)
    classes = classes.persist()
    kept = classes.groupBy("record").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")
    return join_groups(classes, kept, ["record"], "n", total).where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))


def copy_counts(docs: DataFrame, id_col: str = "story_id", text_col: str = "text", min_letters: int = 40, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(keep_id, copies): one row for each record that has copies, with their number."""
    classes, _ = record_classes(docs, id_col, text_col, min_letters, labels)
    return classes.groupBy("record").agg(F.min("id").alias("keep_id"), (F.count("*") - 1).alias("copies")).where("copies > 0").select("keep_id", "copies")
