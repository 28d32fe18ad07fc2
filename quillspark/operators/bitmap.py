"""Membership bitmaps of bounded size: they say which values cannot be in a set, so rows without a partner stay out of
a shuffle. A bitmap that is small for its set lets more rows pass; no row of the set is ever lost."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.wordhash import mix

#: Bytes that a bitmap has at most, whatever the data's size.
MAX_BYTES = 16 << 20
_PART = 1 << 16


def slots_of(values: np.ndarray, slots: int) -> np.ndarray:
    """The slot of each 64-bit value; slots is a power of two."""
    return mix(values.view(np.uint64)) & np.uint64(slots - 1)


def contains(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the 64-bit values may be in the set."""
    slot = slots_of(values, 8 * len(bits))
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _rows(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(8 * size, bool)
        for batch in batches:
            for column in batch.columns:
                values = np.frombuffer(b"".join(column.to_pylist()), np.int64) if pa.types.is_binary(column.type) else column.to_numpy()
                bits[slots_of(values, 8 * size)] = True
        packed = np.packbits(bits, bitorder="little")
        at = [i for i in range(0, size, _PART) if packed[i : i + _PART].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([zlib.compress(packed[i : i + _PART].tobytes(), 1) for i in at], pa.binary())], names=["at", "bits"])

    return rows


def _merged(key, table):
    out = np.zeros(_PART, np.uint8)
    for x in table.column("bits").to_pylist():
        part = np.frombuffer(zlib.decompress(x), np.uint8)
        out[: len(part)] |= part
    return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})


def membership_bitmap(values: DataFrame, expected: int, max_bytes: int = MAX_BYTES) -> np.ndarray:
    """The bitmap of all values in the columns of a table (BIGINT, or BINARY with many 64-bit values); about 16 bits for
    each of the expected values, max_bytes at most. Tasks fill parts, which executors merge."""
    size = _PART
    while size < min(2 * expected, max_bytes):
        size *= 2
    size = min(size, max_bytes)
    out = np.zeros(size, np.uint8)
    for row in values.mapInArrow(_rows(size), "at long, bits binary").groupBy("at").applyInArrow(_merged, "at long, bits binary").collect():
        out[row["at"] : row["at"] + _PART] = np.frombuffer(row["bits"], np.uint8)
    return out


def only_possible(table: DataFrame, bits: np.ndarray) -> DataFrame:
    """The rows of a table whose first column, a BIGINT, may be in the bitmap's set."""
    shared = table.sparkSession.sparkContext.broadcast(bits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = contains(shared.value, batch.column(0).to_numpy())
            if keep.any():
                yield batch.filter(pa.array(keep))

    return table.mapInArrow(rows, table.schema)
