from __future__ import annotations

import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm.charforms import words
from quillspark.llm.encode import VOCABULARY, BytePairEncoder, RankQueue, corpus_ids, with_token_counts
from quillspark.llm.leakage import LeakOptions, leak_report, leaked_items
from quillspark.llm.mixing import MixOptions, mixture, mixture_shares
from quillspark.llm.spam import page_curves, spam_pages

needs_vocabulary = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary files")


def brute_leaks(texts, items, run=13):
    out = set()
    for table, k, text in texts:
        if text is None or k is None:
            continue
        w = words(text)
        have = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for item, passage in items:
            p = words(passage) if passage is not None else []
            if item is not None and any(tuple(p[i : i + run]) in have for i in range(len(p) - run + 1)):
                out.add((table, k, item))
    return sorted(out)


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(make(40))) for k in range(12)] + [(20, None), (21, "one short line"), (22, "x y z " * 20), (None, " ".join(make(30)))]
    texts = []
    for k in range(60):
        body = make(80)
        if k % 3 == 0:
            passage = items[k % 12][1].split()
            n = rng.choice([10, 13, 20, 40])
            at = rng.randrange(len(passage) - n + 1)
            body[30:30] = passage[at : at + n]
        text = " ".join(body)
        texts.append(("tinystories" if k % 2 else "memorization_records", k, text.upper().replace(" ", " -- ") if k % 5 == 0 else text))
    texts += [("tinystories", 500, None), ("tinystories", 501, ""), ("tinystories", None, items[0][1]), ("tinystories", 502, items[1][1] + " q " + items[2][1]), ("tinystories", 502, items[3][1]), ("tinystories", 503, " ".join(make(20_000)) + " " + items[4][1]), ("tinystories", 504, "x y z " * 9)]
    return texts, items


@pytest.mark.parametrize("options", [LeakOptions(), LeakOptions(hot=1, slots=1 << 13)])
def test_leaks(spark, leaks, options):
    texts, items = leaks
    table = spark.createDataFrame([(*t, 1) for t in texts], "record_table string, record_id long, text string, item_id int").repartition(4)
    queries = spark.createDataFrame([(*i, "t", "r") for i in items], "item_id long, text string, task string, record_id string")
    found = leaked_items(table, queries, options)
    assert sorted(map(tuple, found.collect())) == brute_leaks(texts, items)
    assert leak_report(found, queries).agg(F.sum(F.col("stories") + F.col("records"))).first()[0] == found.count()


def test_leaks_of_nothing(spark, leaks):
    texts = spark.createDataFrame(leaks[0], "record_table string, record_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string, task string")
    assert leaked_items(texts, none).count() == 0
    items = spark.createDataFrame(leaks[1], "item_id long, text string")
    assert leaked_items(texts.limit(0), items).count() == 0


def test_rank_queue_pops_in_order():
    rng = random.Random(2)
    queue, entries = RankQueue(50_000), [(rng.randrange(50_000), rng.randrange(1000)) for _ in range(2000)]
    for e in entries:
        queue.push(*e)
    assert [queue.pop() for _ in entries] == sorted(entries) and queue.pop() is None


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    reference.encode_special_tokens = True
    return BytePairEncoder(), reference


def ids(encoder, text):
    out: list[int] = []
    encoder.encode(text, out)
    return out


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(blacklist_categories=("Cs",)), max_size=200))
def test_encoding_equals_the_reference(both, text):
    assert ids(both[0], text) == both[1].encode(text, add_special_tokens=False).ids


@needs_vocabulary
def test_long_pre_tokens(both):
    rng = random.Random(4)
    for text in ("a" * 30_000, "".join(rng.choice("abcde") for _ in range(50_000)), "ab" * 10_000, "é" * 5_000, "<|endoftext|>", " " * 5_000, "\n\n\t x"):
        assert ids(both[0], text) == both[1].encode(text, add_special_tokens=False).ids


@needs_vocabulary
def test_corpus_ids(spark):
    docs = spark.createDataFrame([(1, "Once upon a time", 7), (2, "", 7), (3, None, 7), (None, "x", 7), (4, "x", 7), (4, "x", 7)], "doc_id long, text string, ids int")
    rows = corpus_ids(docs).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in rows) == [(0, 1), (1, 4), (2, 0), (3, 0), (4, 1), (4, 1)]
    assert corpus_ids(docs.limit(0)).count() == 0
    assert corpus_ids(docs).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    assert {r["doc_id"]: r["tokens"] for r in with_token_counts(docs.withColumn("tokens", F.lit("z"))).collect()} == {1: 4, 2: 0, 3: 0, None: 1, 4: 1}


@pytest.fixture(scope="module")
def mix(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["fox", "pond", "bear", "song"]) for _ in range(rng.randrange(5, 40))), "ab"[k % 3 == 0], 1) for k in range(600)]
    rows += [(9000, None, "a", 1), (9001, "", "b", 1), (9002, "not listed", "z", 1), (9003, "no source", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int")


@needs_vocabulary
def test_mixture_reaches_its_shares(spark, mix):
    targets = spark.createDataFrame([("a", 0.2, 2), ("b", 0.8, 3), ("b", 0.8, 3)], "source string, target_share double, max_repeats int")
    used = mixture(mix, targets).collect()
    shares = {r["source"]: r for r in mixture_shares(mix, targets).collect()}
    assert all(abs(r["actual_share"] - r["target_share"]) < 0.005 for r in shares.values())
    assert max(r["uses"] for r in used if r["source"] == "b") <= 3 and max(r["uses"] for r in used if r["source"] == "a") <= 2
    by_uses = {s: {r["uses"] for r in used if r["source"] == s} for s in "ab"}
    # complete epochs come before a fraction of another
    assert all(max(u) - min(u) <= 1 for u in by_uses.values())
    assert {r["doc_id"] for r in used}.isdisjoint({9000, 9001, 9002, 9003})
    again = mixture(mix.repartition(7), targets).collect()
    assert sorted(again) == sorted(used)
    other = mixture(mix, targets, MixOptions(seed=18, total_tokens=3000)).collect()
    assert abs(sum(r["tokens"] * r["uses"] for r in other) - 3000) < 60


@needs_vocabulary
def test_mixture_with_a_missing_source(spark, mix):
    targets = spark.createDataFrame([("a", 0.5, 1), ("none", 0.5, 4)], "source string, target_share double, max_repeats int")
    shares = {r["source"]: r["actual_share"] for r in mixture_shares(mix, targets).collect()}
    assert shares == {"a": 1.0, "none": 0.0}
    assert mixture(mix.limit(0), targets).count() == 0
    assert mixture(mix, targets.limit(0)).count() == 0


@needs_vocabulary
def test_sampling_follows_the_weights(spark, mix):
    """Texts with twice the weight come into a half sample more often."""
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    heavy = F.length(F.col("text")) % 2 == 0
    weight = lambda text: F.when(F.length(text) % 2 == 0, 4.0).otherwise(1.0)
    chosen = mixture(mix, targets, MixOptions(total_tokens=2500), weight).select("doc_id")
    parts = {r["h"]: r["n"] for r in mix.join(chosen, "doc_id").groupBy(heavy.alias("h")).agg(F.count("*").alias("n")).collect()}
    assert parts[True] > 1.5 * parts[False]


PROSE = ["the", "a", "and", "to", "of", "was", "it", "in", "that", "she"]


def prose(rng, n):
    return " ".join(rng.choice(PROSE) if rng.random() < 0.45 else f"word{rng.randrange(400)}" for _ in range(n)) + "."


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(6)
    rows = [(k, prose(rng, rng.randrange(60, 400)), rng.choice(["en", "EN", "en", None, "und"])) for k in range(200)]
    spam = [
        "#" + " #".join(f"toy{rng.randrange(40)}" for _ in range(80)),
        " ".join(f"http://shop{rng.randrange(9)}.example/item/{rng.randrange(999)}" for _ in range(50)),
        "buy doll house, " * 60,
        prose(rng, 20) + " " + " | ".join(f"red toy{rng.randrange(40)} sale" for _ in range(60)),
    ]
    honest = [prose(rng, 200) + " buy doll house" * 20, "ha " * 10, None, "", (prose(rng, 30) + " ") * 8]
    return rows + [(1000 + k, t, "en") for k, t in enumerate(spam)] + [(2000 + k, t, "en") for k, t in enumerate(honest)] + [(3000, "hola " * 50, "xx")]


def test_spam(spark, pages):
    table = spark.createDataFrame([(*p, 1, 2) for p in pages], "doc_id long, text string, lang string, words int, page int").repartition(6)
    # 3000, of a language without a model, by its curve
    assert sorted(r["doc_id"] for r in spam_pages(table).collect()) == [1000, 1001, 1002, 1003, 3000]
    twice = table.union(table)
    assert sorted(r["doc_id"] for r in spam_pages(twice).collect()) == [1000, 1001, 1002, 1003, 3000]
    assert spam_pages(table.limit(0)).count() == 0


def test_spam_with_many_copies(spark):
    rng = random.Random(7)
    honest = [(k, prose(rng, 200), "en") for k in range(100)]
    copies = [(1000 + k, "cheap shoes discount offer sale boots sneakers brand " * 20, "en") for k in range(120)]
    table = spark.createDataFrame(honest + copies, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in spam_pages(table).collect()) == [k for k, _, _ in copies]


def test_spam_of_many_languages(spark):
    """Each of fifty languages has a model, in which a page of few others doesn't speak for itself."""
    rows = []
    for k in range(50):
        rng = random.Random(k)
        rows += [(100 * k + n, prose(rng, 100).replace("word", f"l{k}w").replace("the", f"l{k}the"), f"l{k}") for n in range(24)]
        rows.append((100 * k + 50, f"tag{k} shoe{k} sale{k} " * 30, f"l{k}"))
    rng = random.Random(99)
    rows += [(9000 + n, prose(rng, 200), "en") for n in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in spam_pages(table).collect()) == [100 * k + 50 for k in range(50)]


def test_curves(spark):
    text = " ".join(["a"] * 16 + ["b"] * 8 + ["c"] * 4 + ["d"] * 2)
    table = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    row = page_curves(table).first()
    assert row["words"] == 30 and row["slope"] < -1 and row["residual"] >= 0
