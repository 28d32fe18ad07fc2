"""Packing and deduplication of streams of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import content_hash

_BLOCKS = "split string, block_id long, tokens array<int>"
_STATE = "next_block long, rest array<int>"
#: Blocks put out at once.
_AT_ONCE = 4096


def packed_stream(docs: DataFrame, block_size: int = 512, eos: int = 0) -> DataFrame:
    """(split, block_id, tokens) from a stream (split, id, tokens): documents of each split in order of id within a
    micro-batch, each ended by eos, cut into full blocks. What is left of a block, and the next number, are the state of
    the split; with a checkpoint location a restart goes on exactly there. The order across splits and the batches
    decide the order of documents, so all of a split's state is one small row."""

    def pack(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, rest = (state.get[0], np.asarray(state.get[1], np.int32)) if state.exists else (0, np.zeros(0, np.int32))
        # Spark sorts nothing within a group: parts are small columns of ids and arrays, ordered once
        ids, arrays = [], []
        for part in parts:
            kept = part[part["tokens"].notna()]
            ids.append(kept["id"].to_numpy())
            arrays += list(kept["tokens"])
        order = np.argsort(np.concatenate(ids), kind="stable") if ids else []
        end = np.array([eos], np.int32)
        stream = np.concatenate([rest, *(x for i in order for x in (np.asarray(arrays[i], np.int32), end))])
        whole = len(stream) // block_size
        state.update((number + whole, stream[whole * block_size :].tolist()))
        for at in range(0, whole, _AT_ONCE):
            blocks = stream[at * block_size : min(whole, at + _AT_ONCE) * block_size].reshape(-1, block_size)
            yield pd.DataFrame({"split": key[0], "block_id": range(number + at, number + at + len(blocks)), "tokens": list(blocks)})

    grouped = docs.select("split", "id", "tokens").groupBy("split")
    return grouped.applyInPandasWithState(pack, _BLOCKS, _STATE, "append", GroupStateTimeout.NoTimeout)


def first_copies(docs: DataFrame, time_col: str, delay: str = "1 day", text_col: str = "text") -> DataFrame:
    """The first copy of each text of a stream by its hash; hashes older than the watermark are forgotten."""
    hashed = docs.where(F.col(text_col).isNotNull()).withColumn("hash", content_hash(F.col(text_col)))
    return hashed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["hash"])


def step_means(records: DataFrame, time_col: str = "logged_at", window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """(run_id, start, records, mean_loss): means of logged training losses in tumbling windows, late lines included up
    to the watermark."""
    used = records.where("train_loss is not null and not isnan(train_loss)").withWatermark(time_col, delay)
    return used.groupBy("run_id", F.window(time_col, window)).agg(F.count("*").alias("records"), F.avg("train_loss").alias("mean_loss")).select("run_id", F.col("window.start").alias("start"), "records", "mean_loss")
