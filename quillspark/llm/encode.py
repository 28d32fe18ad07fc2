"""Encoding of a whole corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; every function takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's texts were cut into pre-tokens.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class RankQueue:
    """Positions by merge rank. A bitmap over ranks in levels of 64 bits tells the least rank with positions by
    find-first-set; each rank's positions come leftmost first. Entries are never removed early: the caller skips those
    that are stale."""

    def __init__(self, ranks: int):
        self.levels = []
        while True:
            ranks = (ranks + 63) // 64
            self.levels.append([0] * ranks)
            if ranks == 1:
                break
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        for level in self.levels:
            word = level[rank >> 6]
            level[rank >> 6] = word | (1 << (rank & 63))
            if word:
                break
            rank >>= 6

    def pop(self) -> tuple[int, int] | None:
        """The least rank and its leftmost position; None when empty."""
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            if not word:
                return None
            rank = (rank << 6) + (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            at = rank
            for level in self.levels:
                level[at >> 6] &= ~(1 << (at & 63))
                if level[at >> 6]:
                    break
                at >>= 6
        return rank, position


class BytePairEncoder:
    """Byte-level BPE with a vocabulary of ranks (lines of base64 bytes and rank)."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN, memo: int = 1 << 20):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.size = max(self.tokens) + 1
        self.find = regex.compile(pattern).findall
        self.joined: dict[int, int] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.most = memo

    def _rank(self, a: int, b: int) -> int:
        """Rank of the token that two tokens make, -1 if none; also its id."""
        key = (a << 32) | b
        rank = self.joined.get(key)
        if rank is None:
            rank = self.joined[key] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return rank

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token. Always merges the pair of least rank, the leftmost of several; n log n in its length."""
        if piece in self.ranks:
            return (self.ranks[piece],)
        ids = [self.ranks[piece[i : i + 1]] for i in range(len(piece))]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue, rank_of = RankQueue(self.size), self._rank
        for i in range(n - 1):
            rank = rank_of(ids[i], ids[i + 1])
            if rank >= 0:
                queue.push(rank, i)
        while (top := queue.pop()) is not None:
            rank, i = top
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of(ids[i], ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                right = rank_of(rank, ids[k])
                if right >= 0:
                    queue.push(right, i)
            h = before[i]
            if h >= 0:
                left = rank_of(ids[h], rank)
                if left >= 0:
                    queue.push(left, h)
        return tuple(x for x in ids if x >= 0)

    def encode(self, text: str, out: list[int]) -> int:
        """Appends the ids of a text to out and returns how many; strings of special tokens are ordinary text."""
        memo, start = self.memo, len(out)
        for piece in self.find(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= 64:
                    if len(memo) >= self.most:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return len(out) - start


_ENCODERS: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """The worker's encoder for a vocabulary, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BytePairEncoder(path)
    return _ENCODERS[path]


def _id_rows(path: str, names: list[str], count_only: bool) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            done, texts, last = 0, batch.column(batch.num_columns - 1), batch.num_rows
            while done < last:
                # a batch of very long texts goes out in parts
                ids: list[int] = []
                ends, begin = [0], done
                while done < last and len(ids) < 2_000_000:
                    text = texts[done].as_py()
                    if count_only:
                        ends.append(ends[-1] + (bpe.encode(text, ids) if text else 0))
                        ids.clear()
                    else:
                        if text:
                            bpe.encode(text, ids)
                        ends.append(len(ids))
                    done += 1
                kept = [batch.column(c).slice(begin, done - begin) for c in range(batch.num_columns - 1)]
                value = pa.array(np.diff(ends), pa.int64()) if count_only else pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(ids, np.int32)))
                yield pa.RecordBatch.from_arrays([*kept, value], names=names)

    return rows


def corpus_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id_col, ids ARRAY<INT>): the ids of each text, without special tokens; one row for each row of docs. An empty
    or null text has the empty list; strings of special tokens are ordinary text; a null id stays null, repeated rows
    stay. Other columns are ignored. No shuffle; the vocabulary file is read on each executor from path."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_id_rows(path, [id_col, "ids"], False), f"{id_col} {rows.dtypes[0][1]}, ids array<int>")


def with_token_counts(docs: DataFrame, text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """docs without its text but with tokens BIGINT, the number of ids of the text (0 for an empty or null one)."""
    kept = [c for c in docs.columns if c not in (text_col, "tokens")]
    rows = docs.select(*kept, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes[:-1])
    return rows.mapInArrow(_id_rows(path, [*kept, "tokens"], True), f"{schema}, tokens long")
