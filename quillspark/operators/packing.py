"""Packing token sequences into blocks of fixed length, with exact accounting."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import byte_ids
from ..session import checkpoint


_BEFORE = (Window.unboundedPreceding, -1)
#: Tokens that a Python worker holds before it puts blocks out, and tokens of a run of blocks in split_at_eos.
_AT_ONCE = 1 << 20
_RUN = 1 << 17
#: Runs of a group of the two-level sum over runs.
_GROUP = 1 << 10


def _slices(rows: DataFrame) -> int:
    """Ranges of a two-level prefix sum: a task each, and few enough to broadcast their sums."""
    return max(256, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def _arrays(column: pa.Array) -> Iterator[np.ndarray]:
    """The arrays of a list column without nulls."""
    values, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
    return (values[a:b] for a, b in zip([0, *ends[:-1]], ends))


@dataclass(frozen=True)
class Tokens:
    """How a column holds tokens: their number, a part of them (from a place on, so many), and their values as numpy arrays."""

    size: Callable[[Column], Column]
    part: Callable[[Column, Column, Column], Column]
    read: Callable[[pa.Array], Iterator[np.ndarray]]


ARRAYS = Tokens(F.size, F.slice, _arrays)
#: UTF-8 texts, as BINARY, of the byte tokenizer: they become tokens only where blocks are made.
BYTES = Tokens(F.octet_length, F.substring, byte_ids)


def _starts(lengths: DataFrame, id_col: str) -> DataFrame:
    """(id, _length, start) of documents (id, _length): a prefix sum in two levels over ids and lengths alone: within ranges
    of about equally many documents, whatever their ids, and over the ranges' sums."""
    order = F.col(id_col).asc_nulls_last()
    # the ranges are a matter of how the rows were shuffled, so they are written down
    rows = checkpoint(lengths.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    sums = rows.groupBy("_part").agg(F.sum("_length").alias("_sum"))
    base = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(*_BEFORE)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("_length").over(Window.partitionBy("_part").orderBy(order).rowsBetween(*_BEFORE)), F.lit(0))
    # a row for each task of the shuffle above
    return rows.withColumn("_inside", inside).join(F.broadcast(base), "_part").select(id_col, "_length", (F.col("_base") + F.col("_inside")).alias("start"))


def token_offsets(docs: DataFrame, id_col: str = "id", tokens_col: str = "tokens", tokens: Tokens = ARRAYS) -> DataFrame:
    """docs with start, the place of each document in the stream of all documents by id, each followed by one token
    that ends it; ids are unique. Token arrays only meet their offsets, by id."""
    starts = _starts(docs.select(F.col(id_col), (tokens.size(F.col(tokens_col)) + 1).cast("long").alias("_length")), id_col)
    return docs.join(starts.drop("_length"), id_col)


def _blocks_of(block_size: int, eos: int, width: int, last: int, read: Callable[[pa.Array], Iterator[np.ndarray]]):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([eos], np.int32)
        now, number, held, parts = -1, 0, 0, []

        def full() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, parts
            if whole := held // block_size:
                stream = np.concatenate(parts)
                cut = whole * block_size
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + whole)), _lists(stream[:cut], np.full(whole, block_size))], names=["block_id", "tokens"])
                # a copy, so the rest of a block doesn't keep the stream
                number, held, parts = number + whole, held - cut, [stream[cut:].copy()]

        def over() -> Iterator[pa.RecordBatch]:
            yield from full()
            if held and now != last:
                raise ValueError("tokens of a range don't end where its last block does: ids repeat")

        for batch in batches:
            for at, ended, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), read(batch.column(2))):
                if at != now:
                    yield from over()
                    now, number, held, parts = at, at * width, 0, []
                parts += [tokens, end] if ended else [tokens]
                held += len(tokens) + ended
                if held >= max(_AT_ONCE, block_size):
                    yield from full()
        yield from over()

    return blocks


def pack_blocks(docs: DataFrame, block_size: int = 512, eos: int = 0, id_col: str = "id", tokens_col: str = "tokens", tokens: Tokens = ARRAYS) -> DataFrame:
    """(block_id, tokens): the stream of all documents by id, each ended by eos, cut into blocks of block_size; a last block
    that is not full is dropped; ids are unique, documents without tokens (null) are left out. The stream is cut into
    ranges of whole blocks. Ids and lengths tell which documents stand where ranges begin, a few hundred; by these each
    document finds its range, so tokens are shuffled once, and one that reaches into several ranges in parts."""
    docs = docs.where(F.col(tokens_col).isNotNull()).select(id_col, tokens_col)
    starts = _starts(docs.select(id_col, (tokens.size(F.col(tokens_col)) + 1).cast("long").alias("_length")), id_col)
    total = starts.agg(F.max(F.col("start") + F.col("_length"))).first()[0] or 0
    width = max(1, -(-total // (block_size * _slices(docs))))
    size = width * block_size
    step = F.lit(size).cast("long")
    bounds = sorted(starts.where(F.expr(f"(start + {size - 1}) div {size} * {size} < start + _length")).collect(), key=lambda r: r["start"])
    schema = "block_id long, tokens array<int>"
    if total < block_size:
        return docs.sparkSession.createDataFrame([], schema)
    kind = docs.schema[id_col].dataType
    ident = F.col(id_col)
    # how many ranges' first documents stand before a document, or are it; null is the last id
    upto = F.size(F.filter(F.array(*(F.lit(r[id_col]).cast(kind) for r in bounds)), lambda b: F.coalesce(b <= ident, ident.isNull())))

    def of(values: list) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("_upto"))

    near = docs.withColumn("_upto", upto)
    near = near.select(id_col, tokens_col, of([r[id_col] for r in bounds]).cast(kind).eqNullSafe(ident).alias("_first"), of([r["start"] for r in bounds]).cast("long").alias("_start"), of([r["start"] + r["_length"] for r in bounds]).cast("long").alias("_end"))
    last = F.expr(f"(_end - 1) div {size}")
    ranged = near.withColumn("_range", F.explode(F.sequence(F.when(F.col("_first"), F.expr(f"_start div {size}")).otherwise(last), last)))
    begin = F.greatest(F.col("_range") * step - F.col("_start"), F.lit(0))
    stop = F.least((F.col("_range") + 1) * step, F.col("_end"))
    part = tokens.part(F.col(tokens_col), (begin + 1).cast("int"), (stop - F.col("_start") - begin).cast("int"))
    pieces = ranged.select("_range", id_col, F.when(F.col("_first"), stop == F.col("_end")).otherwise(F.lit(True)).alias("_ended"), F.when(F.col("_first"), part).otherwise(F.col(tokens_col)).alias("_part"))
    placed = pieces.repartition("_range").sortWithinPartitions(F.col("_range"), ident.asc_nulls_last()).select("_range", "_ended", "_part")
    return placed.mapInArrow(_blocks_of(block_size, eos, width, (total - 1) // size, tokens.read), schema)


def packing_stats(docs: DataFrame, block_size: int = 512, text_col: str = "text", tokens_col: str = "tokens") -> DataFrame:
    """Counts of one packed split: examples, characters, text, eos, stream and packed tokens, sequences, discarded."""
    counts = docs.agg(
        F.count("*").alias("examples"),
        F.coalesce(F.sum(F.char_length(text_col)), F.lit(0)).alias("characters"),
        F.coalesce(F.sum(F.size(tokens_col).cast("long")), F.lit(0)).alias("text_tokens"),
        F.count("*").alias("eos_tokens"),
    )
    stream = counts.withColumn("stream_tokens", F.col("text_tokens") + F.col("eos_tokens")).withColumn("sequences", F.expr(f"stream_tokens div {block_size}"))
    packed = stream.withColumn("packed_tokens", F.col("sequences") * block_size).withColumn("discarded_tokens", F.col("stream_tokens") - F.col("packed_tokens")).withColumn("block_size", F.lit(block_size))
    share = F.when(F.col("stream_tokens") > 0, F.col("packed_tokens") / F.col("stream_tokens")).otherwise(F.lit(0.0))
    return packed.withColumn("retained_fraction", F.round(share, 9))


def balanced(stats: DataFrame) -> DataFrame:
    """The rows of packing_stats; computing one whose counts contradict each other fails. Every token of the stream is a
    document's or ends one, and is in a full block or in the rest, which is smaller than a block."""
    c = F.col
    stream = c("examples") + c("text_tokens")
    off = F.abs(c("eos_tokens") - c("examples")) + F.abs(c("stream_tokens") - stream) + F.abs(c("packed_tokens") - c("sequences") * c("block_size")) + F.abs(stream - c("sequences") * c("block_size") - c("discarded_tokens"))
    right = (off == 0) & c("discarded_tokens").between(0, c("block_size") - 1)
    return stats.withColumn("sequences", F.when(right, c("sequences")).otherwise(F.raise_error(F.concat(F.lit("packing counts contradict each other: "), F.to_json(F.struct("*")))).cast("long")))


def stream_tokens(blocks: DataFrame, block_size: int) -> DataFrame:
    """(position, token) of packed blocks."""
    return blocks.select("block_id", F.posexplode("tokens").alias("at", "token")).select((F.col("block_id") * block_size + F.col("at")).alias("position"), "token")


def eos_positions(blocks: DataFrame, block_size: int, eos: int = 0) -> DataFrame:
    """(position) of all tokens that end a document."""
    return stream_tokens(blocks, block_size).where(F.col("token") == eos).select("position")


def _width(values: np.ndarray) -> str:
    """The least type that holds all tokens."""
    low, high = values.min(initial=0), values.max(initial=0)
    return "<i4" if low < 0 or high >= 1 << 16 else "<u2" if high >= 1 << 8 else "<u1"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(1).flatten().to_numpy()
        kind = _width(values)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([kind] * len(batch), pa.string()), pa.array([x.astype(kind).tobytes() for x in _arrays(batch.column(1))], pa.binary())], names=["block_id", "kind", "data"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(run, base, tokens) of rows (run, base, kind, data) in order of runs and blocks."""
    now, parts = None, []
    for batch in batches:
        for run, base, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (run, base):
                if parts:
                    yield *now, np.concatenate(parts)
                now, parts = (run, base), []
            parts.append(np.frombuffer(data, kind).astype(np.int32))
    if parts:
        yield *now, np.concatenate(parts)


def _ends(eos: int):
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, kinds, data = (batch.column(c).to_pylist() for c in ("_run", "kind", "data"))
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array([int((np.frombuffer(x, k) == eos).sum()) for k, x in zip(kinds, data)], pa.int64())], names=["_run", "_n"])

    return ends


def _whole(eos: int):
    """(document, tokens) of documents that begin and end in a run."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, base, stream in _runs(batches):
            ends = np.flatnonzero(stream == eos)
            if len(ends) > 1:
                lengths = np.diff(ends) - 1
                inner = stream[ends[0] + 1 : ends[-1]]
                yield pa.RecordBatch.from_arrays([pa.array(base + 1 + np.flatnonzero(lengths)), _lists(inner[inner != eos], lengths[lengths > 0])], names=["document", "tokens"])

    return whole


def _edges(eos: int):
    """(document, run, tokens, ended) of what stands before the first end of a run and behind the last."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, base, stream in _runs(batches):
            ends = np.flatnonzero(stream == eos)
            found = [(base, stream[: ends[0]], True), (base + len(ends), stream[ends[-1] + 1 :], False)] if len(ends) else [(base, stream, False)]
            numbers, pieces, ended = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([run] * len(found), pa.int64()), _lists(np.concatenate(pieces), np.array([*map(len, pieces)])), pa.array(ended)], names=["document", "run", "tokens", "ended"])

    return edges


def split_at_eos(blocks: DataFrame, block_size: int, eos: int = 0) -> DataFrame:
    """(document, tokens): the documents of packed blocks, numbered from 0 in order of the stream; empty ones and a
    last one without an end are left out. Runs of neighbouring blocks are gathered, their tokens in as few bytes as hold
    them, and cut by themselves; only what reaches over a run's edge is shuffled again, by the number of ends before it."""
    packed = blocks.select("block_id", "tokens").mapInArrow(_packed, "block_id long, kind string, data binary")
    placed = packed.withColumn("_run", F.expr(f"block_id div {max(1, _RUN // block_size)}")).repartition("_run")
    # read by Python whole, so the shuffle is the one that the documents are cut from
    counts = placed.mapInArrow(_ends(eos), "_run long, _n long").groupBy("_run").agg(F.sum("_n").alias("_n")).withColumn("_group", F.expr(f"_run div {_GROUP}"))
    # ends before each run: a prefix sum in two levels; a row for each group of runs
    sums = counts.groupBy("_group").agg(F.sum("_n").alias("_sum"))
    base = sums.select("_group", F.coalesce(F.sum("_sum").over(Window.orderBy("_group").rowsBetween(*_BEFORE)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_group").orderBy("_run").rowsBetween(*_BEFORE)), F.lit(0))
    before = counts.withColumn("_inside", inside).join(F.broadcast(base), "_group").select("_run", (F.col("_base") + F.col("_inside")).alias("_before"))
    # every run is in before; an inner join would put a filter below the shuffle and so make it another one
    ordered = placed.join(before, "_run", "left").sortWithinPartitions("_run", "block_id").select("_run", "_before", "kind", "data")
    whole = ordered.mapInArrow(_whole(eos), "document long, tokens array<int>")
    edges = ordered.mapInArrow(_edges(eos), "document long, run long, tokens array<int>, ended boolean")
    joined = edges.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("run", "tokens"))).alias("ps"), F.bool_or("ended").alias("ended"))
    return whole.unionByName(joined.where("ended").select("document", F.flatten(F.transform("ps", lambda p: p["tokens"])).alias("tokens")).where(F.size("tokens") > 0))
