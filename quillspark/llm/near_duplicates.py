"""Near-duplicate texts with small edits, by pigeonhole blocks over bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.wordhash import WordHashes, chunks, mix
from ..operators.bitmap import membership_bitmap, only_possible
from ..operators.skew import expand, slot_counts
from ..session import checkpoint
from .charforms import count_letters_and_digits, field_key, flat_key, letters_and_digits, one_form, word_key, word_text
from .classes import Classes, same_record


@dataclass(frozen=True)
class NearDuplicateOptions:
    """shingle: words in a sequence. threshold: least similarity of a pair. The fingerprint has `components` bytes, each of
    the minimum of a hash function over the text's sequences. It is split into blocks of `rows` neighbouring components
    and a second time into blocks of components that stand components / rows apart; two blocks have at most one component in
    common. shared: blocks that a pair must have in common to be compared. A pair with a similarity of 0.6 has 13.5 of
    the 104 blocks in common in the mean and misses 2 with probability 1e-4 (0.62: 2e-5, 0.65: 2e-6). Raise rows and components
    together for corpora far beyond 1e9 documents. min_equal: least equal components of a pair that is verified exactly,
    4.7 standard deviations under what a similarity of 0.6 gives (probability of a loss 2e-6). min_letters: texts
    with fewer letters and digits are in no pair. hot: more members of a block are compared by many tasks."""

    shingle: int = 3
    threshold: float = 0.6
    components: int = 208
    rows: int = 4
    shared: int = 2
    min_equal: int = 92
    min_letters: int = 40
    hot: int = 4096

    @property
    def blocks(self) -> int:
        return 2 * self.components // self.rows


def _functions(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    return rng.integers(0, 2**32, size, dtype=np.uint32), rng.integers(0, 2**32, size, dtype=np.uint32) | np.uint32(1)


def fingerprints(texts: list[str], options: NearDuplicateOptions) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (a row of bytes each) of texts as of charforms.word_text, and which of them have one (shorter texts
    than a shingle have none)."""
    out, has = np.zeros((len(texts), options.components), np.uint8), np.zeros(len(texts), bool)
    flip, odd = _functions(options.components)
    for begin, end in chunks(texts):
        words = WordHashes(texts[begin:end])
        gram, where = words.grams(options.shingle)
        if not len(gram):
            continue
        doc = words.doc[where]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        small, row = (gram >> np.uint64(32)).astype(np.uint32), begin + doc[first]
        has[row] = True
        work = np.empty_like(small)
        for k in range(options.components):
            np.bitwise_xor(small, flip[k], out=work)
            np.multiply(work, odd[k], out=work)
            low = np.minimum.reduceat(work, first)
            out[row, k] = (low ^ (low >> np.uint32(8))) & np.uint32(255)
    return out, has


def block_keys(prints: np.ndarray, options: NearDuplicateOptions) -> np.ndarray:
    """The blocks of fingerprints, a row of 64-bit keys for each."""
    n, wide = len(prints), options.components // options.rows
    apart = prints.reshape(n, options.rows, wide).transpose(0, 2, 1).reshape(n, options.components)
    values = np.concatenate([prints, apart], 1).view(f"<u{options.rows}").astype(np.int64)
    return values | (np.arange(options.blocks, dtype=np.int64) << (8 * options.rows))


def _fingerprint_rows(options: NearDuplicateOptions):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, plain, fields, texts = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                form = one_form(text)
                flat = letters_and_digits(form)
                if count_letters_and_digits(flat) >= options.min_letters:
                    ids.append(i)
                    plain.append(flat_key(flat))
                    fields.append(field_key(form))
                    texts.append(word_text(form))
            prints, has = fingerprints(texts, options)
            columns = [pa.array(ids, pa.int64()), pa.array([word_key(t) for t in texts], pa.binary()), pa.array(plain, pa.binary()), pa.array(fields, pa.binary()), pa.array([p.tobytes() for p in prints], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "words", "flat", "fields", "print"]).filter(pa.array(has))

    return rows


def fingerprint_table(docs: DataFrame, id_col: str, text_col: str, options: NearDuplicateOptions) -> DataFrame:
    """(id, words, flat, fields, print) of each text long enough; words is equal for the same sequence of words, flat for
    the same letters and digits, fields for the same labelled fields."""
    return docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).mapInArrow(_fingerprint_rows(options), "id long, words binary, flat binary, fields binary, print binary")


def _prints(column: pa.Array, options: NearDuplicateOptions) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, options.components)


def _key_rows(options: NearDuplicateOptions):
    """(print) -> a row of packed block keys."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([block_keys(_prints(batch.column(0), options), options).tobytes()], pa.binary())], names=["keys"])

    return rows


#: Bits of a row's key below the block: 22 for the tile, 2 for the side.
_TILE, _SIDE = 22, 2
#: Parts of a block at most, so tiles fit their bits; beyond it parts get larger.
_MAX_PARTS = 2000


def _block_rows(options: NearDuplicateOptions, load):
    """(id, print) -> (key, id): a row for each block; the key has the block, the tile and the side. The members of a block
    with more than options.hot rows are cut into parts by their id, and each pair of parts is a tile: a member goes to the
    tiles of its part, on one of their two sides. Other blocks have tile 0."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for part in range(0, len(ids), 2000):
                some = ids[part : part + 2000]
                keys = block_keys(_prints(batch.column(1).slice(part, 2000), options), options).ravel()
                of = np.repeat(some, options.blocks)
                cut = np.minimum(load.value.parts(keys, options.hot), _MAX_PARTS)
                whole = cut == 1
                if whole.any():
                    yield pa.RecordBatch.from_arrays([pa.array(keys[whole] << (_TILE + _SIDE)), pa.array(of[whole])], names=["key", "id"])
                if whole.all():
                    continue
                keys, of, cut = keys[~whole], of[~whole], cut[~whole]
                own = (mix(of.view(np.uint64)) % cut.astype(np.uint64)).astype(np.int64)
                other = np.arange(int(cut.sum())) - np.repeat(np.cumsum(cut) - cut, cut)
                keys, of, own, cut = (np.repeat(x, cut) for x in (keys, of, own, cut))
                tile = np.minimum(own, other) * cut + np.maximum(own, other) + 1
                # side 2: both sides of a tile are the same part
                side = np.where(own == other, 2, (own > other).astype(np.int64))
                keys = ((keys << _TILE | tile) << _SIDE) | side
                for at in range(0, len(keys), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 18)]), pa.array(of[at : at + (1 << 18)])], names=["key", "id"])

    return rows


def _whole_runs(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[list[np.ndarray]]:
    """From rows sorted by their first column: columns of rows such that no run of equal keys, without their last `shift`
    bits, is torn. Parts of a long run are put together once."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy() for c in batch.columns]
        cut = int(np.searchsorted(now[0] >> shift, now[0][-1] >> shift))
        if held and held[-1][0][-1] >> shift != now[0][0] >> shift:
            yield [np.concatenate(c) for c in zip(*held)]
            held = []
        if cut:
            yield [np.concatenate(c) for c in zip(*held, [c[:cut] for c in now])]
            held = []
        held.append([c[cut:] for c in now])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


#: Pairs made at once.
_AT_ONCE = 1 << 20


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, id) sorted by key: (lo, hi) of the pairs of each block or tile."""
    for key, ids in _whole_runs(batches, _SIDE):
        n = len(key)
        run_key, side = key >> _SIDE, key & ((1 << _SIDE) - 1)
        new = np.flatnonzero(run_key[1:] != run_key[:-1]) + 1
        first, end = np.concatenate([[0], new]), np.concatenate([new, [n]])
        size = end - first
        # partners of a row: the rows after it, in a tile of two parts those of the other side
        begin, last = np.arange(1, n + 1), np.repeat(end, size)
        two = (run_key & ((1 << _TILE) - 1) > 0) & (side < 2)
        if two.any():
            middle = first + np.add.reduceat((two & (side == 0)).astype(np.int64), first)
            begin = np.where(two, np.where(side == 0, np.repeat(middle, size), last), begin)
        wide = last - begin
        at = np.flatnonzero(wide > 0)
        if not len(at):
            continue
        total = np.cumsum(wide[at])
        cuts = np.searchsorted(total, np.arange(_AT_ONCE, int(total[-1]), _AT_ONCE)) + 1
        for rows in np.split(at, np.unique(cuts)):
            if not len(rows):
                continue
            w = wide[rows]
            left = np.repeat(ids[rows], w)
            right = ids[np.arange(len(left)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(begin[rows], w)]
            keep = left != right
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)[keep]), pa.array(np.maximum(left, right)[keep])], names=["lo", "hi"])


def candidate_pairs(prints: DataFrame, options: NearDuplicateOptions) -> DataFrame:
    """(lo, hi) of rows (id, print) that share options.shared blocks. Blocks are counted in a table of fixed size first, so
    one with many members is cut into tiles before anything is shuffled, and no task gets it."""
    load = prints.sparkSession.sparkContext.broadcast(slot_counts(prints.select("print").mapInArrow(_key_rows(options), "keys binary")))
    blocks = prints.select("id", "print").mapInArrow(_block_rows(options, load), "key long, id long")
    pairs = blocks.repartition(F.shiftright("key", _SIDE)).sortWithinPartitions("key").mapInArrow(_pair_rows, "lo long, hi long")
    return pairs.groupBy("lo", "hi").count().where(F.col("count") >= options.shared).select("lo", "hi")


def _equal_components(options: NearDuplicateOptions):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_prints(batch.column(c), options) for c in (2, 3))
            keep = pa.array((a == b).sum(1) >= options.min_equal)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["lo", "hi"]).filter(keep)

    return rows


def similar(left: list[str], right: list[str], shingle: int, threshold: float) -> np.ndarray:
    """Whether the sets of word sequences of each pair of raw texts have at least this similarity."""
    out = np.zeros(len(left), bool)
    texts = [word_text(one_form(t)) for pair in zip(left, right) for t in pair]
    for begin, end in chunks([texts[i] + texts[i + 1] for i in range(0, len(texts), 2)]):
        words = WordHashes(texts[2 * begin : 2 * end])
        gram, where = words.grams(shingle)
        doc = words.doc[where]
        # one row for each distinct gram of each text: sort by (pair, gram, side)
        order = np.lexsort((doc, gram, doc // 2))
        gram, doc = gram[order], doc[order]
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])]) if len(gram) else np.zeros(0, bool)
        gram, doc = gram[new], doc[new]
        shared = (gram[1:] == gram[:-1]) & (doc[1:] == doc[:-1] + 1) & (doc[:-1] % 2 == 0)
        both = np.bincount(doc[1:][shared] // 2, minlength=end - begin)
        each = np.bincount(doc // 2, minlength=end - begin)
        out[begin:end] = (each > 0) & (both >= threshold * (each - both) - 1e-9)
    return out


def _similar_rows(options: NearDuplicateOptions):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = similar(batch.column(2).to_pylist(), batch.column(3).to_pylist(), options.shingle, options.threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["lo", "hi"]).filter(pa.array(keep))

    return rows


def verified_pairs(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, options: NearDuplicateOptions) -> DataFrame:
    """The pairs (lo, hi) whose texts are similar, by their whole sets of word sequences. Only texts that may be in a
    pair are shuffled."""
    bits = membership_bitmap(pairs, 2 * pairs.count())
    text = only_possible(docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), bits)
    return (
        pairs.join(text.select(F.col("id").alias("lo"), F.col("text").alias("lo_text")), "lo")
        .join(text.select(F.col("id").alias("hi"), F.col("text").alias("hi_text")), "hi")
        .select("lo", "hi", "lo_text", "hi_text")
        .mapInArrow(_similar_rows(options), "lo long, hi long")
    )


def near_duplicates(docs: DataFrame, id_col: str = "story_id", text_col: str = "text", options: NearDuplicateOptions = NearDuplicateOptions()) -> DataFrame:
    """All pairs (id_lo, id_hi) of texts with similarity of at least options.threshold that are not the same record.

    One pass makes a fingerprint of each text: bytes of minima over the text's word sequences. Texts with the same sequence
    of words are one class with one representative in all that follows, so a text with many copies is one row.
    Fingerprints are split into blocks and joined on equal blocks; the Hamming distance of whole fingerprints (in
    components) sorts out chance meetings, and the exact sets decide. Pairs of classes are expanded to pairs of members at
    the end, large classes in tiles.

    Null ids and null texts are left out; so are texts with fewer than options.min_letters letters and digits and texts
    shorter than a shingle. Repeated ids count once with each of their texts. Other columns are ignored. An empty table
    gives an empty result.
    """
    table = fingerprint_table(docs, id_col, text_col, options).persist()
    classes = Classes(table)
    prints = classes.representatives().select("id", "print").persist()
    near = checkpoint(candidate_pairs(prints, options))  # small, and the result of the costly stages
    some = only_possible(prints, membership_bitmap(near, 2 * near.count()))
    near = (
        near.join(some.select(F.col("id").alias("lo"), F.col("print").alias("a")), "lo")
        .join(some.select(F.col("id").alias("hi"), F.col("print").alias("b")), "hi")
        .select("lo", "hi", "a", "b")
        .mapInArrow(_equal_components(options), "lo long, hi long")
        .persist()
    )
    found = checkpoint(verified_pairs(near, docs, id_col, text_col, options))
    members = classes.members(found, ["flat", "fields"]).persist()
    both = expand(found, members, members, options.hot).where(~same_record() & (F.col("x") != F.col("y")))
    return both.select(F.least("x", "y").alias("id_lo"), F.greatest("x", "y").alias("id_hi")).distinct()
