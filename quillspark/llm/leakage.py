"""Evaluation passages inside a corpus, by a prefix-filtered set join over item-sized windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.wordhash import WordHashes, chunks
from ..operators.bitmap import MAX_BYTES, contains, membership_bitmap
from ..operators.skew import slot_counts
from .charforms import one_form, word_text


@dataclass(frozen=True)
class LeakOptions:
    """run: consecutive words of an item that make a leak. shingle: words of a shingle; a window of `run` words is the
    set of its shingles. max_filter_bytes: bound of the membership filter of the items' shingles. slots: of the table of
    their counts. hot: text rows of a prefix token from which they are joined by several tasks."""

    run: int = 13
    shingle: int = 3
    max_filter_bytes: int = MAX_BYTES
    slots: int = 1 << 20
    hot: int = 100_000


def _shingles(texts: list[str], options: LeakOptions) -> Iterator[tuple[int, WordHashes, np.ndarray, np.ndarray]]:
    """For ranges of raw texts: where the range begins, its words, and the hash of the shingle at each word with whether
    there is one inside the text."""
    plain = [word_text(one_form(t)) for t in texts]
    for begin, end in chunks(plain):
        words = WordHashes(plain[begin:end])
        gram, where = words.grams(options.shingle)
        at, there = np.zeros(len(words.hashes), np.uint64), np.zeros(len(words.hashes), bool)
        at[where], there[where] = gram, True
        yield begin, words, at, there


def _shingle_rows(options: LeakOptions, bits=None):
    """(text) -> packed hashes of the different shingles of each text; with bits, only those that an item may have."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words, at, there in _shingles(batch.column(0).to_pylist(), options):
                gram, doc = at[there], words.doc[there]
                if bits is not None:
                    known = contains(bits.value, gram)
                    gram, doc = gram[known], doc[known]
                order = np.lexsort((gram, doc))
                gram, doc = gram[order], doc[order]
                if len(gram):
                    new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])])
                    yield pa.RecordBatch.from_arrays([pa.array([gram[new].tobytes()], pa.binary())], names=["shingles"])

    return rows


def _window_rows(options: LeakOptions, order, names: list[str]):
    """(text, *names) -> (token, place, window, parts, *names): a row for each window of options.run words all of whose
    shingles an item may have. token: its prefix, the rarest shingle (ties by hash, then the first); place: where in the
    window it stands; window: the words; parts: into how many parts the rows of the token are cut."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, counts = order.value
        wide = options.run - options.shingle + 1
        for batch in batches:
            for begin, words, gram, there in _shingles(batch.column(0).to_pylist(), options):
                n = len(gram) - options.run + 1
                if n <= 0:
                    continue
                known = np.concatenate([[0], np.cumsum(there & contains(bits, gram))])
                starts = np.flatnonzero((known[wide : wide + n] - known[:n] == wide) & (words.doc[:n] == words.doc[options.run - 1 :]))
                for part in range(0, len(starts), 50_000):
                    start = starts[part : part + 50_000]
                    inside = start[:, None] + np.arange(wide)
                    often = np.minimum(counts.of(gram[inside.ravel()]), (1 << 20) - 1).astype(np.uint64)
                    rank = ((often << np.uint64(44)) | (gram[inside.ravel()] >> np.uint64(20))).reshape(inside.shape)
                    place = rank.argmin(1)
                    token = gram[start + place]
                    raw, a, b = words.buffer.tobytes(), words.start, words.end
                    text = [b" ".join(raw[a[k] : b[k]] for k in range(s, s + options.run)).decode("utf-8", "surrogatepass") for s in start.tolist()]
                    at = pa.array(begin + words.doc[start])
                    columns = [pa.array(token.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(text, pa.string()), pa.array(counts.parts(token, options.hot).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*columns, *(batch.column(1 + k).take(at) for k in range(len(names)))], names=["token", "place", "window", "parts", *names])

    return rows


_WINDOW = "token long, place int, window string, parts int"


def leaked_items(texts: DataFrame, items: DataFrame, options: LeakOptions = LeakOptions()) -> DataFrame:
    """(record_table, record_id, item_id): each text of texts (record_table, record_id, text) with each item of items
    (item_id, text) of which it holds at least options.run consecutive words.

    Two passes over the texts, however many items there are. The first counts how many texts hold each shingle of the
    items. In the second, texts and items send the prefix of their windows, the rarest shingle: all shingles of a window
    must be in a text that contains it, so of a text only windows remain all of whose shingles some item may have, as a
    filter of bounded size tells; texts of fewer words have none. Prefix tokens join with the position of the token in the
    window, and all words of the window decide. The text rows of a hot token are cut into parts, to each of which its
    item rows go, so no task gets all of them.

    Null ids and texts and items with fewer than options.run words are no case; a text and item count once. Rows with
    the same record_table and record_id count as one record. Other columns are ignored. Empty tables give no rows.
    """
    share = texts.sparkSession.sparkContext.broadcast
    rows = texts.where("text is not null and record_id is not null").select("text", "record_table", F.col("record_id").cast("long").alias("record_id"))
    usable = items.where("text is not null and item_id is not null").select("text", F.col("item_id").cast("long").alias("item_id"))
    expected = usable.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long")).first()[0] // 4
    bits = membership_bitmap(usable.select("text").mapInArrow(_shingle_rows(options), "shingles binary"), expected, options.max_filter_bytes)
    counts = slot_counts(rows.select("text").mapInArrow(_shingle_rows(options, share(bits)), "shingles binary"), options.slots)
    order = share((bits, counts))
    passages = usable.mapInArrow(_window_rows(options, order, ["item_id"]), f"{_WINDOW}, item_id long").distinct()
    passages = passages.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    found = rows.mapInArrow(_window_rows(options, order, ["record_table", "record_id"]), f"{_WINDOW}, record_table string, record_id long")
    found = found.withColumn("part", F.pmod(F.xxhash64("record_table", "record_id"), F.col("parts")).cast("int")).drop("parts")
    return found.join(passages, ["token", "place", "window", "part"]).select("record_table", "record_id", "item_id").distinct()


def leak_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, task, stories, records): for each leaked item the number of texts of each table that hold it."""
    found = leaks.groupBy("item_id").agg(F.count_if(F.col("record_table") == "tinystories").alias("stories"), F.count_if(F.col("record_table") == "memorization_records").alias("records"))
    return found.join(items.select("item_id", "task"), "item_id").select("item_id", "task", "stories", "records")
