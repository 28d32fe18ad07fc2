from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import byte_tokens, content_hash
from quillspark.operators import lexical, memorization, minhash, ngrams, packing, planning, reports, retrieval, splits, tokenizer, tracking
from quillspark.plans.queries import queries


def story(k: int) -> str:
    return f"Story number {k} tells how a fox called Fen{k} met a bear near pond {k * 7} and how they shared {k + 3} cakes with every bird of the wood."


def test_splits_are_disjoint_and_decontaminated(spark):
    train = spark.createDataFrame([(k, story(k)) for k in range(40)], "story_id long, text string")
    leaked = [(100 + k, "  " + story(k).upper().replace(" ", "  ")) for k in range(5)]
    test = spark.createDataFrame([(50 + k, story(1000 + k)) for k in range(10)] + leaked + [(200, "short"), (201, None)], "story_id long, text string")
    built = splits.build_splits(train, test, splits.SplitOptions(validation_fraction=0.2))
    rows = {(r["split"], r["story_id"]) for r in built.collect()}
    assert {i for s, i in rows if s == "test"} == set(range(50, 60))
    assert {i for s, i in rows if s != "test"} == set(range(40))
    assert built.groupBy("hash").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    exact = splits.build_splits(train, test, splits.SplitOptions(validation_fraction=0.2, exact=True))
    assert {r["story_id"] for r in exact.where("split = 'test'").collect()} == set(range(50, 60))
    some = splits.build_splits(train, test, splits.SplitOptions(validation_fraction=0.0, max_train=7, decontaminate=False))
    assert some.where("split = 'train'").count() == 7
    assert some.where("split = 'test'").count() == 15


def test_exact_copies(spark):
    a = spark.createDataFrame([("Hello  world",), ("hello world",), ("Other",)], "t string").select(content_hash(F.col("t")).alias("hash"))
    b = spark.createDataFrame([("HELLO WORLD",), ("new",)], "t string").select(content_hash(F.col("t")).alias("hash"))
    assert splits.duplicate_stats(a).first().asDict() == {"documents": 3, "unique_documents": 2, "redundant_copies": 1, "largest_cluster": 2, "redundant_rate": round(1 / 3, 9)}
    assert splits.cross_split_exact(a, b).first().asDict() == {"documents": 2, "copies": 1, "rate": 0.5}
    none = a.limit(0)
    assert splits.duplicate_stats(none).first()["redundant_rate"] == 0.0
    assert splits.cross_split_exact(none, none).first()["rate"] == 0.0


def test_containment(spark):
    corpus = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "id long, text string")
    queries = spark.createDataFrame([(1, "b c d"), (2, "x y z"), (3, "b"), (4, "a b x a b"), (5, None)], "q long, text string")
    found = {(r["q"], r["n"]): (r["grams"], r["matched"], r["containment"]) for r in ngrams.containment(corpus, queries, "id", "q", ns=(2, 3)).collect()}
    assert found[1, 2] == (2, 2, 1.0) and found[1, 3] == (1, 1, 1.0)
    assert found[2, 2] == (2, 0, 0.0) and found[3, 2] == (0, 0, 0.0) and found[5, 2] == (0, 0, 0.0)
    assert found[4, 2] == (4, 2, 0.5)


def test_minhash_finds_an_edited_copy(spark):
    base = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(1, base), (2, base.replace("w100 ", "zz ")), (3, " ".join(f"v{k}" for k in range(200))), (4, "too short"), (5, None)], "id long, text string")
    options = minhash.MinHashOptions()
    for signatures in (minhash.numeric_signatures(docs, "id", "text", options), minhash.md5_signatures(docs, "id", "text", options)):
        pairs = minhash.near_duplicate_pairs(signatures, "id", options)
        assert [(r["lo"], r["hi"]) for r in pairs.collect()] == [(1, 2)]
        report = minhash.near_duplicate_report(signatures, pairs).first()
        assert (report["documents"], report["verified_pairs"], report["documents_with_near_duplicate"]) == (3, 1, 2)
        both = signatures.where("id = 1"), signatures.where("id in (2, 3)")
        assert [r["id"] for r in minhash.cross_near_duplicates(*both, "id", options).collect()] == [2]
    with pytest.raises(ValueError):
        minhash.MinHashOptions(permutations=10, bands=3)


def test_bucket_cap(spark):
    docs = spark.createDataFrame([(k, "one two three four five six seven") for k in range(6)], "id long, text string")
    capped = minhash.MinHashOptions(cap=3)
    signatures = minhash.numeric_signatures(docs, "id", "text", capped)
    assert minhash.near_duplicate_pairs(signatures, "id", capped).count() == 3
    assert minhash.near_duplicate_pairs(signatures, "id", minhash.MinHashOptions(cap=None)).count() == 15


@pytest.mark.parametrize("hot", [1000, 7])
def test_many_copies_keep_all_links(spark, hot):
    base = " ".join(f"w{k}" for k in range(200))
    rows = [(k, base) for k in range(60)] + [(100 + k, base + f" end{k}") for k in range(5)] + [(200, " ".join(f"v{k}" for k in range(200)))]
    docs = spark.createDataFrame(rows, "id long, text string")
    options = minhash.MinHashOptions(hot=hot)
    signatures = minhash.md5_signatures(docs, "id", "text", options)
    every = sorted((a, b) for a, _ in rows[:65] for b, _ in rows[:65] if a < b)
    found = minhash.near_duplicate_pairs(signatures, "id", options)
    assert sorted((r["lo"], r["hi"]) for r in found.collect()) == every
    assert sorted((r["lo"], r["hi"]) for r in minhash.candidate_pairs(signatures, "id", options).collect()) == every
    report = minhash.near_duplicate_counts(signatures, "id", options).first()
    assert report == minhash.near_duplicate_report(signatures, found).first()
    assert (report["documents"], report["verified_pairs"], report["documents_with_near_duplicate"]) == (66, len(every), 65)
    empty = minhash.near_duplicate_counts(signatures.limit(0), "id", options).first()
    assert tuple(empty) == (0, 0, 0, 0.0)


def test_longest_span(spark):
    assert memorization.longest_span("the cat sat on the red mat", "a dog sat on the red rug") == (4, "sat on the red")
    assert memorization.longest_span("", "a") == (0, "")
    assert memorization.longest_span("x y x y", "y x y") == (3, "y x y")
    rows = spark.createDataFrame([("a b c", "b c d"), (None, "x"), ("q", "r")], "a string, b string")
    assert [tuple(r[0]) for r in rows.select(memorization.longest_common_span("a", "b")).collect()] == [(2, "b c"), (0, ""), (0, "")]


def test_flags(spark):
    rows = spark.createDataFrame([(1, 0.805, 32, 31), (2, 0.1, None, 0), (3, None, None, None)], "id int, similarity double, max_matched_ngram int, longest_common_span_words int")
    found = {r["id"]: (r["flagged"], list(r["flag_reasons"])) for r in memorization.flagged(rows).collect()}
    assert found[1] == (True, ["similarity 0.81 >= 0.8", "verbatim 32-token n-gram in training data", "31-word span shared with nearest story"])
    assert found[2] == (False, []) and found[3] == (False, [])


def test_lexical_values(spark):
    rows = spark.createDataFrame([("a", "a b"), ("a", "a b"), ("b", "a a a a"), (None, "a b c d")], "preset string, completion string").withColumn("new_tokens", F.lit(2)).withColumn("finished_with_eos", F.lit(True))
    found = {r["preset"]: r for r in lexical.lexical_summary(rows, {"preset": F.col("preset")}).collect()}
    assert found["a"]["distinct_1"] == 0.5 and found["a"]["distinct_2"] == 0.5
    assert found["b"]["distinct_1"] == 0.25
    assert found["None"]["distinct_1"] == 1.0
    assert lexical.lexical_summary(rows.limit(0), {"preset": F.col("preset")}).count() == 0


def brute_pack(docs: list[list[int]], size: int) -> list[list[int]]:
    stream = [t for d in docs for t in [*d, 0]]
    return [stream[i : i + size] for i in range(0, len(stream) - size + 1, size)]


@pytest.mark.parametrize("size", [1, 3, 16, 50])
def test_packing_equals_brute_force(spark, size):
    docs = [[(k * 7 + j) % 90 + 2 for j in range((k * 13) % 40)] for k in range(60)]
    table = spark.createDataFrame([(k * k, d) for k, d in enumerate(docs)], "id long, tokens array<int>")
    blocks = packing.pack_blocks(table, size)
    rows = sorted(blocks.collect())
    assert [r["block_id"] for r in rows] == list(range(len(rows)))
    assert [list(r["tokens"]) for r in rows] == brute_pack(docs, size)
    ended = packing.split_at_eos(blocks, size)
    stream = [t for b in brute_pack(docs, size) for t in b]
    parts, now = [], []
    for t in stream:
        if t == 0:
            parts.append(now)
            now = []
        else:
            now.append(t)
    assert [list(r["tokens"]) for r in ended.orderBy("document").collect()] == [p for p in parts if p]
    assert packing.eos_positions(blocks, size).count() == stream.count(0)


def written(spark, query) -> int:
    """Bytes that computing a query writes to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = total()
    query.write.format("noop").mode("overwrite").save()
    return total() - before


def byte_documents(spark, folder, count: int = 2_000) -> int:
    """Writes documents of random digits, which a shuffle can't make much smaller; returns their bytes."""
    text = F.concat(*(F.sha2(F.concat("id", F.lit(f" {k}")), 512) for k in range(16)))
    spark.range(count).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), text.alias("text")).write.parquet(f"{folder}/documents.parquet")
    return count * 16 * 128


def test_packing_shuffles_texts_once(spark, tmp_path):
    size = byte_documents(spark, tmp_path)
    assert written(spark, queries()["pack_blocks"](spark, str(tmp_path))) < size


def test_splitting_shuffles_blocks_once(spark, tmp_path):
    size = byte_documents(spark, tmp_path)
    assert written(spark, queries()["split_at_eos"](spark, str(tmp_path))) < 2 * size


def test_splitting_over_runs(spark, monkeypatch):
    """Documents over several runs of blocks, empty ones, large and negative tokens, one without an end."""
    monkeypatch.setattr(packing, "_RUN", 8)
    monkeypatch.setattr(packing, "_GROUP", 2)
    stream = [7, 0, 0, *range(1, 40), 0, -3, 70_000, 0, 300, 0, *[5] * 30, 0, 9, 0, 0, 4, 4, 4, 4]
    stream += [4] * (-len(stream) % 4)
    blocks = spark.createDataFrame([(k // 4, stream[k : k + 4]) for k in range(0, len(stream), 4)][::-1], "block_id long, tokens array<int>")
    found = {r["document"]: list(r["tokens"]) for r in packing.split_at_eos(blocks, 4).collect()}
    assert found == {0: [7], 2: [*range(1, 40)], 3: [-3, 70_000], 4: [300], 5: [5] * 30, 6: [9]}


@pytest.mark.parametrize("tokens", [packing.ARRAYS, packing.BYTES], ids=["arrays", "bytes"])
def test_packing_in_ranges(spark, tokens):
    """A document over many ranges, empty ones, null tokens, a null id as the last."""
    texts = [("a", b"x" * 7), ("b", bytes(range(65, 91)) * 300), ("c", b""), ("d", None), ("e", b"yz"), (None, b"last")]
    docs = [[b + 2 for b in x] for _, x in texts if x is not None]
    table = spark.createDataFrame(texts[::-1], "id string, bytes binary")
    if tokens is packing.ARRAYS:
        table = spark.createDataFrame([(k, None if x is None else [b + 2 for b in x]) for k, x in texts[::-1]], "id string, bytes array<int>")
    for size in (1, 7, 64):
        rows = sorted(packing.pack_blocks(table, size, tokens_col="bytes", tokens=tokens).collect())
        assert [list(r["tokens"]) for r in rows] == brute_pack(docs, size)
        assert [r["block_id"] for r in rows] == list(range(len(rows)))


def test_packing_of_nothing(spark):
    none = spark.createDataFrame([], "id long, tokens array<int>")
    assert packing.pack_blocks(none, 4).count() == 0
    assert packing.split_at_eos(packing.pack_blocks(none, 4), 4).count() == 0


def test_accounting(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "é")], "id long, text string").withColumn("tokens", byte_tokens(F.col("text")))
    stats = packing.balanced(packing.packing_stats(docs, 4)).first().asDict()
    assert (stats["stream_tokens"], stats["sequences"], stats["discarded_tokens"]) == (6, 1, 2)
    for wrong in ({"discarded_tokens": 3}, {"eos_tokens": 1}, {"sequences": 2}, {"text_tokens": 5}, {"sequences": 0, "packed_tokens": 0, "discarded_tokens": 6}):
        with pytest.raises(Exception, match="contradict"):
            packing.balanced(spark.createDataFrame([stats | wrong])).collect()


def test_offsets_of_skewed_ids(spark):
    ids = [0, 1, 2, 3, 10**15, 10**15 + 1, 2 * 10**17]
    docs = spark.createDataFrame([(k, list(range(1, n + 2))) for n, k in enumerate(ids)], "id long, tokens array<int>").repartition(3)
    found = [r["start"] for r in packing.token_offsets(docs).orderBy("id").collect()]
    assert found == [sum(n + 2 for n in range(k)) for k in range(len(ids))]


def test_seed_statistics(spark):
    runs = spark.createDataFrame([("m", 1.0), ("m", 3.0), ("m", None), ("n", 2.0)], "model_name string, x double")
    found = {r["model_name"]: (r["mean"], r["std"], r["n"]) for r in tracking.seed_statistics(runs, "model_name", ["x"]).collect()}
    assert found == {"m": (2.0, round(math.sqrt(2), 6), 2), "n": (2.0, None, 1)}


def test_upsert(spark):
    index = spark.createDataFrame([("r1", 2.0), ("r2", 3.0)], "run_id string, loss double")
    new = spark.createDataFrame([("r1", 1.5), ("r3", None)], "run_id string, loss double")
    assert sorted(map(tuple, tracking.upsert(index, new).collect()), key=str) == [("r1", 1.5), ("r2", 3.0), ("r3", None)]


def test_history(spark):
    rows = spark.createDataFrame([("r", 1, 5.0, None), ("r", 2, float("nan"), None), ("r", 2, None, 4.0), ("r", 4, None, 4.0), ("r", 6, None, 3.0)], "run_id string, step long, train_loss double, val_loss double")
    for c, kind in (("logged_at", "timestamp"), ("tokens_seen", "long"), ("lr", "double"), ("grad_norm", "double"), ("tokens_per_second", "double"), ("train_seconds", "double")):
        rows = rows.withColumn(c, F.lit(None).cast(kind))
    kept = tracking.last_logged(rows)
    assert [(r["step"], r["is_best"]) for r in tracking.best_so_far(kept).orderBy("step").collect()] == [(2, True), (4, False), (6, True)]
    assert tuple(tracking.best_checkpoint(kept.where("step < 6")).first())[:2] == ("r", 2)
    assert [r["records"] for r in tracking.tumbling_means(kept, 2).collect()] == [1]


def test_histogram_right_edge(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("a", None), ("a", 1.5)], "source string, v double")
    assert {(r["bin"], r["count"]) for r in reports.histogram(rows, "v", "source").collect()} == {(30, 1), (1, 1)}


def test_judgements(spark):
    rows = spark.createDataFrame([('{"plot": {"score": 7, "justification": "ok"}}',), ("no json",)], "a string").select(F.transform_values(reports.parse_judgement(F.col("a")), lambda k, v: v["score"]).alias("scores"))
    assert [tuple(r) for r in reports.rubric_summary(rows).collect()] == [("plot", 7.0, 0.0, 1)]


def test_epoch_order_is_a_permutation_of_seed_and_position(spark):
    rows = spark.range(40).withColumnRenamed("id", "i")
    first = planning.epoch_order(rows, "i", 0, 7)
    order = [r["id"] for r in first.orderBy("position").collect()]
    assert sorted(order) == list(range(40)) and order == [r["id"] for r in planning.epoch_order(rows.repartition(3), "i", 0, 7).orderBy("position").collect()]
    assert order != [r["id"] for r in planning.epoch_order(rows, "i", 1, 7).orderBy("position").collect()]
    small, large = (planning.batches(first, 40, b) for b in (2, 4))
    as_list = lambda df: [r["story"] for r in df.orderBy("batch", "slot").withColumnRenamed("id", "story").collect()]
    assert as_list(small) == as_list(large) == order


def test_job_list(spark):
    prompts = spark.createDataFrame([("a",), ("b",)], "id string")
    presets = spark.createDataFrame([("greedy", False), ("balanced", True)], "preset string, do_sample boolean")
    seeds = spark.createDataFrame([(0,), (1,)], "seed int")
    jobs = planning.generation_jobs(prompts, presets, seeds)
    assert jobs.count() == 2 * (1 + 2)
    assert planning.pending_jobs(jobs, jobs.limit(1)).count() == 5


def test_schedule(spark):
    rows = {r["step"]: r["multiplier"] for r in planning.lr_schedule(spark, planning.ScheduleOptions(100, 10, 0.1)).collect()}
    assert rows[0] == 0.1 and rows[9] == 1.0 and rows[10] == 1.0 and rows[99] == pytest.approx(0.1, abs=1e-3)


def test_retrieval_finds_the_copy(spark):
    docs = spark.createDataFrame([(1, "a fox ran over the hill"), (2, "many bees sing in trees"), (3, None)], "id long, text string")
    counts = retrieval.term_counts(docs, "id", "text")
    idf = retrieval.inverse_frequencies(counts, "id", docs)
    weights = retrieval.tfidf(counts, idf, "id")
    found = retrieval.top_matches(weights.withColumnRenamed("id", "q"), counts, idf, "q", "id").collect()
    assert sorted(found) == sorted(retrieval.top_matches(weights.withColumnRenamed("id", "q"), counts, idf, "q", "id", most=0).collect())
    assert {(r["q"], r["id"], r["similarity"]) for r in found} == {(1, 1, 1.0), (2, 2, 1.0)}


def test_nearest_vectors_in_blocks(spark):
    rows = spark.createDataFrame([(k, [math.cos(k / 10), math.sin(k / 10)]) for k in range(30)] + [(99, None)], "vec_id long, embedding array<double>")
    whole = retrieval.nearest_vectors(rows, rows, k=2)
    blocks = retrieval.nearest_vectors(rows, rows, k=2, block=4)
    assert sorted(whole.collect()) == sorted(blocks.collect())
    assert {(r["query_id"], r["id"]) for r in whole.where("query_id = 5").collect()} == {(5, 4), (5, 6)}


def test_longest_span_is_the_earliest():
    import random

    rng = random.Random(0)
    for _ in range(400):
        v = rng.choice([2, 3, 30])
        a, b = ([str(rng.randrange(v)) for _ in range(rng.randrange(30))] for _ in range(2))
        runs = [(n, -i) for i in range(len(a)) for n in range(1, len(a) - i + 1) if any(b[j : j + n] == a[i : i + n] for j in range(len(b) - n + 1))]
        n, i = max(runs, default=(0, 0))
        assert memorization.longest_span(" ".join(a), " ".join(b)) == (n, " ".join(a[-i : -i + n]))


def test_idf_of_a_sample(spark):
    docs = spark.createDataFrame([(k, f"fox word{k}") for k in range(20)], "id long, text string")
    counts = retrieval.term_counts(docs, "id", "text")
    found = {r["term"]: (r["df"], r["idf"]) for r in retrieval.sampled_frequencies(counts, "id", docs, 5).collect()}
    assert found["fox"] == (5, 1.0) and sum(t.startswith("word") for t in found) == 5
    assert retrieval.sampled_frequencies(counts, "id", docs, 99).where("term = 'fox'").first()["df"] == 20


def test_tokenizer_file(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    path = str(tmp_path / "t.json")
    tok.save(path)
    assert len(tokenizer.fingerprint(path)) == 64
    docs = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "id long, text string")
    rows = tokenizer.encoded(docs, "id", "text", path)
    assert {r["id"]: list(r["tokens"]) for r in rows.collect()} == {1: [0, 1], 2: []}
    assert tokenizer.token_diagnostics(rows).first()["tokens"] == 2
    again = tokenizer.round_trip_rate(docs.union(docs), "id", "text", path).first()
    assert (again["documents"], again["round_trip_rate"]) == (4, 1.0)
    assert tokenizer.round_trip_rate(docs.limit(0), "id", "text", path).first()["round_trip_rate"] is None


def test_reports(spark, tmp_path):
    names = spark.createDataFrame([("NVIDIA GeForce RTX 3050 Ti Laptop GPU",), ("CPU (11th Gen Intel(R) Core(TM) i5-11300H @ 3.10GHz, 8 threads)",), ("Plain",), (None,)], "h string")
    assert [r[0] for r in names.select(reports.short_hardware(F.col("h"))).collect()] == ["RTX 3050 Ti Laptop GPU", "CPU i5-11300H", "Plain", None]
    sheet = spark.createDataFrame([("p", "x", 1, "c", "say \"hi\",\nor not", "done")], "prompt_id string, preset string, seed int, category string, prompt string, completion string")
    reports.write_rating_sheet(sheet, str(tmp_path / "sheet"))
    row = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "sheet")).first()
    assert row["item_id"] == "p|x|1" and row["prompt"] == "say \"hi\",\nor not"
    runs = spark.createDataFrame([("m", [(10.0, 100, 5.0, "a"), (30.0, 300, None, "b"), (None, 50, 9.0, "a")]), ("n", [])], "name string, invocations array<struct<wall_clock_seconds: double, training_tokens: long, peak_vram_mb: double, hardware: string>>")
    total = tracking.invocation_totals(runs, ["name"]).collect()
    assert len(total) == 1 and tuple(total[0]) == ("m", 3, 40.0, 450, 9.0, "a; b", 10.0)
    speed = spark.createDataFrame([("h", "base", 2.0), ("h", "base", 4.0), ("h", "x", 6.0), ("i", "x", 1.0)], "h string, m string, v double")
    assert {(r["h"], r["m"]): r["ratio"] for r in reports.speed_ratios(speed, ["h"], "m", "v", "base").collect()} == {("h", "base"): 1.0, ("h", "x"): 2.0, ("i", "x"): None}
