"""Overlaps between evaluation and training splits, by winnowing fingerprints."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.wordhash import WordHashes, chunks, mix
from ..operators.bitmap import MAX_BYTES, contains, membership_bitmap, only_possible
from ..operators.protocol import with_role
from ..operators.skew import SlotCounts, expand, join_groups, slot_counts
from ..session import checkpoint
from .charforms import count_letters_and_digits, field_key, flat_key, letters_and_digits, one_form, word_key, word_text
from .classes import Classes
from .near_duplicates import NearDuplicateOptions, fingerprints, similar


@dataclass(frozen=True)
class CrossSplitOptions:
    """gram: words in a rolling hash. window: hashes of which the least is selected; runs of gram + window - 1 equal
    words always share one. share: part of the larger one's selected hashes that two similar texts have in common at least
    (of 1,200 texts of each length with evenly spread edits down to a similarity of 0.6 the worst left 0.24). shared: seeds that a pair must have. short: texts
    with fewer different sequences of `shingle` words are found by these sequences, exactly. max_sketch: most
    differing bits of 128 in the sketches of two texts, 4.5 standard deviations over what a similarity of 0.6 gives
    (probability of a loss 1e-5). max_filter_bytes: bound of the membership filter of the evaluation texts' hashes; slots: of
    the table of their counts. hot: more members of a hash are joined by many tasks."""

    gram: int = 5
    window: int = 4
    share: float = 0.2
    shared: int = 2
    short: int = 40
    shingle: int = 3
    threshold: float = 0.6
    min_letters: int = 40
    max_sketch: int = 46
    max_filter_bytes: int = MAX_BYTES
    slots: int = 1 << 20
    hot: int = 4096


def winnow(hashes: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Indexes of the selected hashes: the least of each window of one text; all-in-one minimum of shorter texts.
    The smallest hash has the first place among equal ones."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    size = np.diff(np.concatenate([first, [n]]))
    selected = np.zeros(n, bool)
    if n >= window:
        low = hashes[: n - window + 1].copy()
        for k in range(1, window):
            np.minimum(low, hashes[k : n - window + 1 + k], out=low)
        inside = doc[: n - window + 1] == doc[window - 1 :]
        for k in range(window):
            selected[k : n - window + 1 + k] |= inside & (hashes[k : n - window + 1 + k] == low)
    for f, s in zip(first[size < window], size[size < window]):
        selected[f + int(hashes[f : f + s].argmin())] = True
    return np.flatnonzero(selected)


_SKETCH = NearDuplicateOptions(components=128)


@dataclass(frozen=True)
class SeedOrder:
    """One order of all hashes, rarest first: those that no evaluation text has, then by how many evaluation texts have them,
    as a filter and a table of bounded size tell. Any order would do, as long as all texts share it."""

    bits: np.ndarray
    counts: SlotCounts

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of hashes in the order, and which of them an evaluation text may have."""
        known = contains(self.bits, hashes)
        often = np.where(known, np.minimum(self.counts.of(hashes) + 1, (1 << 20) - 1), 0).astype(np.uint64)
        return (often << np.uint64(44)) | (hashes >> np.uint64(20)), known


def _own_grams(words: WordHashes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of k words, and the text of each."""
    hashes, where = words.grams(k)
    return hashes, words.doc[where]


def _different(doc: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """Indexes of the different rows of each text, sorted by text and values."""
    order = np.lexsort((*values[::-1], doc))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (doc, *values)])
    return order[new]


def _rarest(doc: np.ndarray, place: np.ndarray, hashes: np.ndarray, share: float, shared: int) -> np.ndarray:
    """Of the different hashes of each text, indexes of the rarest that must hold `shared` of those that it has in common
    with another text, if these are at least `share` of them all."""
    at = _different(doc, place, hashes)
    first = np.flatnonzero(np.concatenate([[True], doc[at][1:] != doc[at][:-1]])) if len(at) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(at)]]))
    rank, n = np.arange(len(at)) - np.repeat(first, size), np.repeat(size, size)
    return at[rank < n - np.ceil(share * n - 1e-9) + shared]


def _eval_grams(options: CrossSplitOptions):
    """(text) -> packed hashes of all runs of words that may be seeds."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [word_text(one_form(t)) for t in batch.column(0).to_pylist()]
            for begin, end in chunks(texts):
                words = WordHashes(texts[begin:end])
                few, doc = _own_grams(words, options.shingle)
                few = few[np.bincount(doc[_different(doc, few)], minlength=end - begin)[doc] < _reach(options)]
                yield pa.RecordBatch.from_arrays([pa.array([_own_grams(words, options.gram)[0].tobytes(), few.tobytes()], pa.binary())], names=["grams"])

    return rows


def _reach(options: CrossSplitOptions) -> float:
    """A text with as many different sequences or more is similar to no short text."""
    return options.short / options.threshold


def _print_rows(options: CrossSplitOptions, order):
    """(id, role, text) -> (id, role, words, flat, fields, s1, s2, seeds, few): s1 and s2 are the sketch, the seeds are the rarest selected hashes,
    few the rarest sequences of short texts and those that can be similar to one; both only if an evaluation text may
    have them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, roles, plain, fields, texts = [], [], [], [], []
            for i, role, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                form = one_form(text)
                flat = letters_and_digits(form)
                if count_letters_and_digits(flat) >= options.min_letters:
                    ids.append(i)
                    roles.append(role)
                    plain.append(flat_key(flat))
                    fields.append(field_key(form))
                    texts.append(word_text(form))
            seeds, few = [], []

            def packed(doc: np.ndarray, hashes: np.ndarray, n: int) -> list[bytes]:
                cut = np.searchsorted(doc, np.arange(n + 1))
                return [hashes[a:b].tobytes() for a, b in zip(cut, cut[1:])]

            for begin, end in chunks(texts):
                n, words = end - begin, WordHashes(texts[begin:end])
                hashes, doc = _own_grams(words, options.shingle)
                size = np.bincount(doc[_different(doc, hashes)], minlength=n)
                near = size[doc] < _reach(options)
                hashes, doc = hashes[near], doc[near]
                place, known = order.value.of(hashes)
                at = _rarest(doc, place, hashes, options.threshold, 1)
                at = at[known[at]]
                few += packed(doc[at], hashes[at], n)
                hashes, doc = _own_grams(words, options.gram)
                far = size[doc] >= options.short
                hashes, doc = hashes[far], doc[far]
                place, known = order.value.of(hashes)
                chosen = winnow(place, doc, options.window)
                hashes, doc, place, known = hashes[chosen], doc[chosen], place[chosen], known[chosen]
                at = _rarest(doc, place, hashes, options.share, options.shared)
                at = at[known[at]]
                seeds += packed(doc[at], hashes[at], n)
            sketch = np.packbits(fingerprints(texts, _SKETCH)[0] & 1, axis=1).view(np.int64)
            # copies within a side are one class
            keys = [word_key(t) + (b"t" if r == "train" else b"e") for t, r in zip(texts, roles)]
            columns = [pa.array(ids, pa.int64()), pa.array(roles, pa.string()), pa.array(keys, pa.binary()), pa.array(plain, pa.binary()), pa.array(fields, pa.binary()), pa.array(sketch[:, 0]), pa.array(sketch[:, 1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(seeds, pa.binary()), pa.array(few, pa.binary())], names=["id", "role", "words", "flat", "fields", "s1", "s2", "seeds", "few"])

    return rows


_PRINT = "id long, role string, words binary, flat binary, fields binary, s1 long, s2 long, seeds binary, few binary"


def _seed_rows(options: CrossSplitOptions, loads, side: int):
    """(id, s1, s2, seeds, few) -> (gram, id, s1, s2): a row for each seed. The last bit of gram tells sequences of short
    texts. The rows of a hot hash are cut into parts on both sides, and each pair of parts is a tile with a gram of its
    own, made from both; should it equal another one by chance, the pairs that meet there are sorted out later."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for column, last in ((3, 0), (4, 1)):
                packed = batch.column(column).to_pylist()
                n = np.array([len(g) // 8 for g in packed], np.int64)
                if not n.sum():
                    continue
                gram = np.frombuffer(b"".join(packed), np.int64)
                of = np.repeat(np.arange(len(n)), n)
                mine, theirs = (load.parts(gram, options.hot) for load in (loads.value[side], loads.value[1 - side]))
                other = np.arange(int(theirs.sum())) - np.repeat(np.cumsum(theirs) - theirs, theirs)
                gram, of, mine, theirs = (np.repeat(x, theirs) for x in (gram, of, mine, theirs))
                ids = batch.column(0).to_numpy()[of]
                own = (mix(ids.view(np.uint64)) % mine.astype(np.uint64)).astype(np.int64)
                tile = own * theirs + other if side == 0 else other * mine + own
                key = np.where(mine * theirs > 1, mix(gram.view(np.uint64) + mix(tile.astype(np.uint64) + np.uint64(1))).view(np.int64), gram)
                sketch = (batch.column(k).to_numpy()[of] for k in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(key & -2 | last), pa.array(ids), *map(pa.array, sketch)], names=["gram", "id", "s1", "s2"])

    return rows


def seeds(evals: DataFrame, trains: DataFrame, options: CrossSplitOptions) -> DataFrame:
    """(lo, hi) of evaluation and training texts (id, s1, s2, seeds, few) that share enough seeds and have near sketches; a
    shared sequence of short texts is enough."""
    sides = [side.select("id", "s1", "s2", "seeds", "few") for side in (evals, trains)]
    loads = evals.sparkSession.sparkContext.broadcast([slot_counts(side.select("seeds", "few")) for side in sides])
    left, right = (side.mapInArrow(_seed_rows(options, loads, k), "gram long, id long, s1 long, s2 long") for k, side in enumerate(sides))
    right = right.select("gram", F.col("id").alias("hi"), F.col("s1").alias("o1"), F.col("s2").alias("o2"))
    far = F.bit_count(F.col("s1").bitwiseXOR(F.col("o1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("o2")))
    met = left.join(right, "gram").where(far <= options.max_sketch)
    weight = F.when(F.col("gram").bitwiseAND(F.lit(1)) == 1, options.shared).otherwise(1)
    return met.groupBy(F.col("id").alias("lo"), "hi").agg(F.sum(weight).alias("weight")).where(F.col("weight") >= options.shared).select("lo", "hi")


def chain(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of seeds (eval_place, train_place) that rises in both; of several the one that ends
    first in the evaluation text."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    places = sorted(places, key=lambda p: (p[0], -p[1]))
    for i, (_, t) in enumerate(places):
        k = bisect_left(tails, t)
        back.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(t)
            ends.append(i)
        else:
            tails[k], ends[k] = t, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(places[i])
        i = back[i]
    return out[::-1]


def covered(left: np.ndarray, right: np.ndarray, seeds: list[tuple[int, int]], gram: int) -> int:
    """Words of left in the runs around the chained seeds that equal right, extended as far as they go."""
    hit = np.zeros(len(left), bool)
    for a, b in seeds:
        if hit[a] and hit[min(a + gram, len(left)) - 1]:
            continue
        back = min(a, b)
        same = left[a - back : a][::-1] == right[b - back : b][::-1]
        before = int(same.argmin()) if not same.all() else back
        ahead = min(len(left) - a, len(right) - b)
        same = left[a : a + ahead] == right[b : b + ahead]
        after = int(same.argmin()) if not same.all() else ahead
        hit[a - before : a + after] = True
    return int(hit.sum())


def _same_places(left: np.ndarray, right: np.ndarray, gram: int, window: int) -> list[tuple[int, int]]:
    """Seeds (place, place) of two texts' word hashes: equal selected hashes, the k-th with the k-th where one repeats."""
    found = []
    for words in (left, right):
        n = len(words) - gram + 1
        if n <= 0:
            return []
        rolled = np.zeros(n, np.uint64)
        for k in range(gram):
            rolled = mix(rolled * np.uint64(31) + words[k : n + k])
        at = winnow(rolled, np.zeros(n, np.int64), window)
        order = np.lexsort((at, rolled[at]))
        at = at[order]
        new = np.flatnonzero(np.concatenate([[True], rolled[at][1:] != rolled[at][:-1]]))
        nth = np.arange(len(at)) - np.repeat(new, np.diff(np.concatenate([new, [len(at)]])))
        found.append((at, mix(rolled[at] + nth.astype(np.uint64))))
    (a, x), (b, y) = found
    _, i, j = np.intersect1d(x, y, return_indices=True)
    return list(zip(a[i].tolist(), b[j].tolist()))


def _verify_rows(options: CrossSplitOptions):
    """(lo, hi, eval_text, train_text) -> similar pairs with the share of the evaluation text's words in aligned runs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = similar(left, right, options.shingle, options.threshold)
            share = []
            for i in np.flatnonzero(keep):
                words = WordHashes([word_text(one_form(t)) for t in (left[i], right[i])])
                a, b = words.hashes[: words.first[1]], words.hashes[words.first[1] :]
                gram, window = (options.gram, options.window) if min(len(a), len(b)) >= options.short else (options.shingle, 1)
                share.append(covered(a, b, chain(_same_places(a, b, gram, window)), gram) / len(a))
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), pa.array(share, pa.float64())], names=["lo", "hi", "coverage"])

    return rows


def _same_records(prints: DataFrame, options: CrossSplitOptions) -> DataFrame:
    """(x, y, l_role) of evaluation and training rows (id, role, flat, fields) with the same letters and digits or the same
    labelled fields."""
    keyed = prints.select(F.explode(F.array_compact(F.array("flat", "fields"))).alias("key"), "id", "role")
    trained = F.col("role") == "train"
    sizes = keyed.groupBy("key").agg(F.count_if(~trained).alias("ln"), F.count_if(trained).alias("rn")).where("ln > 0 and rn > 0").withColumn("n", F.col("ln") + F.col("rn")).persist()
    met = join_groups(keyed, sizes, ["key"], "n", 2 * prints.count()).persist()
    left = met.where(~trained).select(F.col("key").alias("rep"), F.col("ln").alias("n"), "id", "role")
    right = met.where(trained).select(F.col("key").alias("rep"), F.col("rn").alias("n"), "id")
    return expand(sizes.select(F.col("key").alias("lo"), F.col("key").alias("hi")), left, right, options.hot)


def cross_split_overlaps(stories: DataFrame, integrity: DataFrame, options: CrossSplitOptions = CrossSplitOptions()) -> DataFrame:
    """(eval_id, train_id, eval_split, coverage): stories of the test and validation splits that are the same record as
    a story of a training split, of any source, or similar to it by at least options.threshold. coverage: the share of
    the evaluation text's words in aligned runs, 1 for the same record.

    Rolling hashes are winnowed by one order of all hashes, rarest first, so equal runs select equal hashes and what
    every story says is selected last. Of its selected hashes a text sends the rarest, as many as must hold those that
    it shares with a similar text (of sequences that no evaluation text has, none); short texts do the same with all
    their three-word sequences, which loses nothing. Equal hashes join; sketches sort out chance meetings; the seeds
    of a pair are chained, extended by alignment and checked against the exact similarity. Texts with the same words
    are one row until the end.

    Stories in no split, null ids and null texts and texts with fewer than options.min_letters letters and digits are
    no case. Other columns are ignored. Empty tables give no rows.
    """
    rows = with_role(stories.where("text is not null and story_id is not null").select("story_id", "source", "hub_split", "text"), integrity)
    rows = rows.select(F.col("story_id").alias("id"), "role", "text")
    tests = rows.where("role <> 'train'").select("text")
    grams = tests.mapInArrow(_eval_grams(options), "grams binary")
    expected = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long")).first()[0] // 4
    order = SeedOrder(membership_bitmap(grams, expected, options.max_filter_bytes), slot_counts(grams, options.slots))
    prints = rows.mapInArrow(_print_rows(options, stories.sparkSession.sparkContext.broadcast(order)), _PRINT).persist()
    classes = Classes(prints)
    reps = classes.representatives().select("id", "role", "s1", "s2", "seeds", "few").persist()
    # small, and the result of the costly stages before
    found = checkpoint(seeds(reps.where("role <> 'train'"), reps.where("role = 'train'"), options))
    pairs = membership_bitmap(found, 2 * found.count(), options.max_filter_bytes)
    text = only_possible(stories.where("text is not null and story_id is not null").select(F.col("story_id").alias("id"), "text"), pairs)
    near = checkpoint(
        found.join(text.select(F.col("id").alias("lo"), F.col("text").alias("eval_text")), "lo")
        .join(text.select(F.col("id").alias("hi"), F.col("text").alias("train_text")), "hi")
        .select("lo", "hi", "eval_text", "train_text")
        .mapInArrow(_verify_rows(options), "lo long, hi long, coverage double")
    )
    members = classes.members(near.select("lo", "hi"), ["role"]).persist()
    similar_ones = expand(near, members.where("role <> 'train'"), members.where("role = 'train'"), options.hot).drop("r_role")
    same = _same_records(prints.select("id", "role", "flat", "fields"), options).withColumn("coverage", F.lit(1.0))
    return (
        similar_ones.unionByName(same)
        .where("x <> y")
        .groupBy(F.col("x").alias("eval_id"), F.col("y").alias("train_id"), F.col("l_role").alias("eval_split"))
        .agg(F.max("coverage").alias("coverage"))
    )


def overlap_pairs(stories: DataFrame, integrity: DataFrame, options: CrossSplitOptions = CrossSplitOptions()) -> DataFrame:
    """(id_lo, id_hi, eval_split) of cross_split_overlaps."""
    found = cross_split_overlaps(stories, integrity, options)
    return found.select(F.least("eval_id", "train_id").alias("id_lo"), F.greatest("eval_id", "train_id").alias("id_hi"), "eval_split")


def overlap_report(stories: DataFrame, integrity: DataFrame, options: CrossSplitOptions = CrossSplitOptions()) -> DataFrame:
    """(eval_split, source, stories, overlapping, pairs, mean_coverage): for each evaluation split of each source its
    stories, how many of them overlap with a training split, in how many pairs and with which mean of the best
    coverage."""
    each = cross_split_overlaps(stories, integrity, options).groupBy("eval_id", "eval_split").agg(F.count("*").alias("pairs"), F.max("coverage").alias("coverage"))
    rows = with_role(stories.where("story_id is not null").select("story_id", "source", "hub_split"), integrity).where("role <> 'train'").select(F.col("story_id").alias("eval_id"), "source", F.col("role").alias("eval_split")).distinct()
    return rows.join(each, ["eval_id", "eval_split"], "left").groupBy("eval_split", "source").agg(F.count("*").alias("stories"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))
