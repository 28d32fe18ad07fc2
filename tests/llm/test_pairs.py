"""Pairs of stories against brute force, with all kinds of odd rows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import charforms as C
from quillspark.llm.cross_split import CrossSplitOptions, chain, covered, cross_split_overlaps, overlap_pairs, overlap_report
from quillspark.llm.format_copies import copy_counts, format_copies
from quillspark.llm.lookalikes import LookalikeTrie, canonical, lookalike_pairs, vocabulary
from quillspark.llm.near_duplicates import NearDuplicateOptions, _whole_runs, block_keys, near_duplicates

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "pa", "re", "si", "to", "vu") for b in ("n", "r", "st", "d", "lk", "m", "p", "x", "g", "f")]
ALIKE = str.maketrans({"a": "а", "e": "е", "o": "о", "i": "і", "p": "р"})
SCHEMA = "story_id long, text string, record string, id string, lo int, print int, rep string"


def corpus(seed: int = 3) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    make = lambda: " ".join(rng.choice(WORDS) for _ in range(120))
    texts: list[str | None] = []
    for _ in range(40):
        base = make()
        texts.append(base)
        words = base.split()
        edited = words[:]
        for _ in range(4):
            edited[rng.randrange(len(edited))] = rng.choice(WORDS)
        texts += [" ".join(edited), base.upper(), base.replace(" ", "  "), base.translate(ALIKE), base.replace(" ", " "), " ".join(words[60:] + words[:60])]
    texts += [texts[0], texts[0], None, None, "", " ", "tiny", "tiny", "!" * 500, make() * 30, " ".join(["ha"] * 400), " ".join(["ha"] * 399)]
    rng.shuffle(texts)
    return [(k, t) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def stories(spark, rows):
    # extra columns with names that the operators use themselves
    return spark.createDataFrame([(k, t, "x", "y", 1, 2, "z") for k, t in rows] + [(None, "nobody" * 20, "x", "y", 1, 2, "z")], SCHEMA).repartition(5).persist()


def usable(rows):
    return {k: t for k, t in rows if t is not None and C.count_letters_and_digits(C.letters_and_digits(C.one_form(t))) >= 40}


def similarity(a: str, b: str) -> float:
    x, y = ({tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (C.words(a), C.words(b)))
    return len(x & y) / len(x | y) if x | y else 0.0


@pytest.fixture(scope="module")
def truth(rows):
    good = usable(rows)
    keys = {k: C.record_key(C.one_form(t)) for k, t in good.items()}
    ids = sorted(good)
    same = {(a, b) for a in ids for b in ids if a < b and keys[a] == keys[b]}
    near = {(a, b) for a in ids for b in ids if a < b and (a, b) not in same and similarity(good[a], good[b]) >= 0.6}
    return good, keys, same, near


def pairs(df):
    return sorted((r[0], r[1]) for r in df.collect())


def test_near_duplicates(stories, truth):
    assert pairs(near_duplicates(stories)) == sorted(truth[3])


def test_hot_blocks_give_the_same(stories, truth):
    assert pairs(near_duplicates(stories, options=NearDuplicateOptions(hot=2))) == sorted(truth[3])


def test_lookalikes(stories, truth, rows):
    good = truth[0]
    forms = {k: C.one_form(t) for k, t in good.items()}
    expected = sorted((a, b) for a in good for b in good if a < b and forms[a] == forms[b] and good[a] != good[b])
    assert expected and pairs(lookalike_pairs(stories)) == expected


def test_format_copies(stories, truth):
    groups: dict[bytes, list[int]] = {}
    for k, key in truth[1].items():
        groups.setdefault(key, []).append(k)
    expected = sorted((min(g), k) for g in groups.values() for k in g if k != min(g))
    assert pairs(format_copies(stories)) == expected
    counts = {r["keep_id"]: r["copies"] for r in copy_counts(stories).collect()}
    assert counts == {min(g): len(g) - 1 for g in groups.values() if len(g) > 1}


@pytest.fixture(scope="module")
def integrity(spark):
    protocol = "struct<train: string, validation: string, test: string>"
    return spark.createDataFrame([("s", ("rows of 'Main'", None, "official “ dev ” split")), ("s", ("rows of 'Main'", None, "official “ dev ” split")), ("t", ("`train`", "the 'eval' one", "no name")), (None, ("'x'", None, None))], f"source string, split_protocol {protocol}")


def placed(stories):
    k = F.col("story_id") % 7
    source = F.when(k < 4, "s").when(k < 6, "t")
    split = F.when(k == 0, " DEV ").when(k < 4, "main").when(k == 4, "Eval").when(k == 5, "train")
    return stories.select("story_id", "text", source.alias("source"), split.alias("hub_split"), F.lit(1).alias("role"), F.lit(2).alias("grams"))


@pytest.mark.parametrize("hot", [4096, 1])
def test_cross_split(stories, integrity, truth, hot):
    role = {k: {0: "test", 1: "train", 2: "train", 3: "train", 4: "validation", 5: "train"}.get(k % 7) for k in truth[0]}
    expected = set()
    for a, b in truth[2] | truth[3]:
        for e, t in ((a, b), (b, a)):
            if role[t] == "train" and role[e] in ("test", "validation"):
                expected.add((a, b, role[e]))
    found = overlap_pairs(placed(stories).drop("role"), integrity, CrossSplitOptions(hot=hot))
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_cross_split_report(stories, integrity):
    report = {(r["eval_split"], r["source"]): r for r in overlap_report(placed(stories).drop("role"), integrity).collect()}
    assert set(report) == {("test", "s"), ("validation", "t")}
    for r in report.values():
        assert 0 < r["overlapping"] <= r["stories"] and r["pairs"] >= r["overlapping"] and 0.3 < r["mean_coverage"] <= 1


def test_nothing(spark, integrity):
    none = spark.createDataFrame([], "story_id long, text string, source string, hub_split string")
    for found in (near_duplicates(none), lookalike_pairs(none), format_copies(none), copy_counts(none), overlap_pairs(none, integrity), overlap_report(none, integrity), cross_split_overlaps(none, integrity.limit(0))):
        assert found.count() == 0
    lone = spark.createDataFrame([(1, "a" * 50), (2, None)], "story_id long, text string")
    assert near_duplicates(lone).count() == lookalike_pairs(lone).count() == format_copies(lone).count() == 0


def test_repeated_rows_and_very_long_texts(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(WORDS) for _ in range(150_000))
    rows = spark.createDataFrame([(1, long), (1, long), (2, long + " end"), (3, long.upper()), (3, long.upper())], "story_id long, text string")
    assert pairs(near_duplicates(rows)) == [(1, 2), (2, 3)]
    assert pairs(format_copies(rows)) == [(1, 3)]
    assert pairs(lookalike_pairs(rows)) == []


def test_a_popular_text_is_one_row(spark):
    """A third of all rows are copies of one text; only pairs with its edited form come out."""
    rng, base = random.Random(2), " ".join(WORDS[:60])
    rows = [(k, base) for k in range(300)] + [(900, base.replace("ban", "zzz"))] + [(1000 + k, " ".join(rng.choice(WORDS) for _ in range(60))) for k in range(300)]
    table = spark.createDataFrame(rows, "story_id long, text string")
    assert pairs(near_duplicates(table)) == [(k, 900) for k in range(300)]
    assert format_copies(table).count() == 299


def test_trie():
    trie = LookalikeTrie({"pebble": 5, "Then": 3, "café": 2, "It": 1, "lt": 9})
    assert trie.spelling("реbbⅼе") == "pebble"
    assert trie.spelling("Т​һеn") == "Then"
    assert trie.spelling("cаfé") == "café"
    assert trie.spelling("cafe") is None and trie.spelling("pebblе́") is None
    assert trie.spelling("ӏt") == "lt"
    assert LookalikeTrie({"pebble": 1}, max_cost=1).spelling("pabbⅼе") == "pebble"
    assert canonical("Тһе реbbⅼе ѕank．", trie, {}) == "The pebble sank."


def test_vocabulary_has_what_odd_tokens_may_mean(spark):
    """Frequent words take no place from a rare one that a token with other characters stands for."""
    rows = [(k, " ".join(WORDS)) for k in range(5)] + [(9, "Zorblin"), (10, "Ƶoo Zоrblın"), (11, None)]
    found = vocabulary(spark.createDataFrame(rows, "story_id long, text string"), "text", 3).collect()
    assert [r["token"] for r in found] == ["Zorblin"]


def test_lookalikes_of_a_hot_form(spark):
    base = " ".join(WORDS[:30])
    variants = [base, base.replace("a", "а"), base.replace("e", "е"), base.replace(" ", "\u00a0")]
    rows = [(k, variants[k % 4]) for k in range(40)]
    expected = sorted((i, j) for i in range(40) for j in range(i + 1, 40) if i % 4 != j % 4)
    table = spark.createDataFrame(rows, "story_id long, text string")
    assert pairs(lookalike_pairs(table, hot=3)) == expected


def test_chain_and_coverage():
    import numpy as np

    assert chain([]) == []
    assert chain([(0, 5), (3, 1), (6, 4), (9, 9)]) == [(3, 1), (6, 4), (9, 9)]
    a, b = np.array([1, 2, 3, 4, 5, 9]), np.array([7, 2, 3, 4, 5, 8])
    assert covered(a, b, [(2, 2)], 2) == 4


def test_pairs_at_the_threshold(spark):
    rows = []
    for k in range(600):
        shared = " ".join(f"s{k}x{i}" for i in range(77))
        rows += [(2 * k, shared + "".join(f" a{k}x{i}" for i in range(25))), (2 * k + 1, shared + "".join(f" b{k}x{i}" for i in range(25)))]
    # 75 of 125 three-word sequences
    found = near_duplicates(spark.createDataFrame(rows, "story_id long, text string"))
    assert pairs(found) == [(2 * k, 2 * k + 1) for k in range(600)]


def test_joint_miss_at_the_threshold():
    """Both groupings of components into blocks by chance, and the distance of whole fingerprints by the binomial."""
    import numpy as np

    options, rng = NearDuplicateOptions(), np.random.default_rng(1)
    n, missed = 20_000, 0
    for _ in range(10):
        other = np.where(rng.random((n, options.components)) < options.threshold, 0, rng.integers(1, 256, (n, options.components))).astype(np.uint8)
        same = block_keys(other, options) == block_keys(np.zeros((1, options.components), np.uint8), options)
        missed += int((same.sum(1) < options.shared).sum())
    assert missed / (10 * n) < 2.5e-4
    below = sum(math.comb(options.components, i) * options.threshold**i * (1 - options.threshold) ** (options.components - i) for i in range(options.min_equal))
    assert below < 5e-6


def sequences(text: str) -> set:
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def test_one_other_letter_is_another_text(spark):
    """The keys of copies, written here a second time: letters and digits in lower case, in their order."""
    base = " ".join(WORDS[:50])
    texts = [base + " a vest", base + " a nest", base + " A-VEST!", base + " a νest", base + " an est"]
    plain = ["".join(c for c in t.replace("ν", "v").lower() if c.isalnum()) for t in texts]
    expected = sorted((min(j for j, q in enumerate(plain) if q == p), i) for i, p in enumerate(plain) if plain.index(p) != i)
    table = spark.createDataFrame(list(enumerate(texts)), "story_id long, text string")
    assert pairs(format_copies(table)) == expected == [(0, 2), (0, 3), (1, 4)]
    near = [(i, j) for i in range(5) for j in range(i + 1, 5) if plain[i] != plain[j]]
    assert pairs(near_duplicates(table)) == near


def test_same_letters_in_other_words_are_the_same_record(spark):
    """The class of one word sequence has members with other words in the same record."""
    base = " ".join(WORDS[:40])
    rows = [(1, base.replace("ban ", "ban")), (2, base), (3, base + " end"), (4, "Story: x\nWords: " + base), (5, "Words: " + base + "\nStory: x"), (6, "Story x Words " + base)]
    found = pairs(near_duplicates(spark.createDataFrame(rows, "story_id long, text string")))
    assert (1, 2) not in found and (4, 5) not in found and (4, 6) not in found and (2, 3) in found
    copies = pairs(format_copies(spark.createDataFrame(rows, "story_id long, text string")))
    assert copies == [(1, 2), (4, 5), (4, 6)]


def test_whole_runs():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    for _ in range(50):
        keys = np.sort(np.array([rng.randrange(6) for _ in range(40)], np.int64))
        cuts = [0, *sorted(rng.randrange(41) for _ in range(9)), 40]
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.array(np.arange(a, b))], names=["k", "v"]) for a, b in zip(cuts, cuts[1:])]
        out = list(_whole_runs(iter(batches), 0))
        assert np.concatenate([o[0] for o in out]).tolist() == keys.tolist() and np.concatenate([o[1] for o in out]).tolist() == list(range(40))
        ends = [o[0][-1] for o in out]
        assert len(set(ends)) == len(ends) and all(o[0][0] != e for o, e in zip(out[1:], ends))


@pytest.mark.parametrize("low,high", [(8, 16), (17, 32), (33, 64), (65, 128), (129, 400)])
def test_cross_split_recall_by_length(spark, integrity, low, high):
    """One-edit and spread-edit pairs of each length down to a similarity of 0.6: all come out."""
    rng, rows, expected = random.Random(low), [], set()
    word = lambda: "w" + str(rng.randrange(10**6))
    for k in range(120):
        base = [word() for _ in range(rng.randint(low, high))]
        other = base[:]
        step = rng.choice([5, 8, 11, 12, 13, 15, 40])
        for i in range(rng.randrange(step), len(base), step):
            kind = rng.randrange(3)
            if kind == 0:
                other[i] = word()
            elif kind == 1 and i < len(other):
                other[i] = other[i] + " " + word()
            else:
                other[i] = ""
            if step == 40:
                break
        a, b = " ".join(base), " ".join(" ".join(other).split())
        x, y = sequences(a), sequences(b)
        if min(sum(map(str.isalnum, t)) for t in (a, b)) >= 40 and x and y and len(x & y) / len(x | y) >= 0.6 and a != b:
            expected.add((2 * k, 2 * k + 1, "test"))
        rows += [(2 * k, a, "s", "main"), (2 * k + 1, b, "s", "dev")]
    found = overlap_pairs(spark.createDataFrame(rows, "story_id long, text string, source string, hub_split string"), integrity)
    got = set(map(tuple, found.collect()))
    assert len(expected) > 20 and expected <= got and len(got) <= 120


def test_cross_split_short_texts_and_spread_edits(spark):
    rows = []
    for k in range(40):
        few = [f"word{k}x{i}" for i in range(8)]
        many = [f"long{k}x{i}" for i in range(65)]
        edited = [f"new{k}x{i}" if i % 12 == 11 else w for i, w in enumerate(many)]
        for n, (a, b) in enumerate(((few, few[:7]), (many, edited))):
            rows += [(1000 * n + 2 * k, " ".join(a), "s", "train"), (1000 * n + 2 * k + 1, " ".join(b), "s", "test")]
    stories = spark.createDataFrame(rows, "story_id long, text string, source string, hub_split string")
    integrity = spark.createDataFrame([("s", ("'train'", None, "'test'"))], "source string, split_protocol struct<train: string, validation: string, test: string>")
    found = {(r["id_lo"], r["id_hi"]) for r in overlap_pairs(stories, integrity).collect()}
    assert found == {(r[0], r[0] + 1) for r in rows[::2]}
