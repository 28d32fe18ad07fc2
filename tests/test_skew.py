"""Counts by slot, joins with hot groups and pairs of groups, against plain Python."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators.bitmap import contains, membership_bitmap
from quillspark.operators.skew import expand, join_groups, slot_counts


def test_slot_counts(spark):
    values = [7] * 500 + list(range(1000, 3000)) + [None, -5, -5]
    counts = slot_counts(spark.createDataFrame([(v,) for v in values], "v long").repartition(4), 1 << 16)
    assert int(counts.counts.sum()) == len(values) - 1
    assert (counts.of(np.array([7, 1000, -5], np.int64)) >= np.array([500, 1, 2])).all()
    assert counts.parts(np.array([7, 1000], np.int64), 100).tolist() == [-(-int(counts.of(np.array([7], np.int64))[0]) // 100), 1]
    packed = spark.createDataFrame([(np.array([7, 7, 9], np.int64).tobytes(),), (None,)], "v binary")
    assert slot_counts(packed, 1 << 13).of(np.array([7], np.int64))[0] >= 2
    assert slot_counts(packed.limit(0), 1 << 13).counts.sum() == 0


def test_bitmap_loses_nothing(spark):
    values = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    bits = membership_bitmap(spark.createDataFrame([(int(v),) for v in values], "v long").repartition(3), 10)
    assert contains(bits, values).all() and contains(bits, values + 1).mean() < 0.2


def test_join_groups(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(900)}", i) for i in range(3000)] + [(None, -1)]
    table = spark.createDataFrame(rows, "k string, i int").repartition(5)
    groups = table.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("least")).where("n > 2")
    found = sorted(map(tuple, join_groups(table, groups, ["k"], "n", len(rows)).select("k", "i", "n", "least").collect()))
    members: dict[str, list[int]] = {}
    for k, i in rows:
        members.setdefault(k, []).append(i)
    assert found == sorted((k, i, len(m), min(m)) for k, m in members.items() if k is not None and len(m) > 2 for i in m)
    assert join_groups(table.limit(0), groups, ["k"], "n", 0).count() == 0


def test_expand(spark):
    left = {1: list(range(10)), 2: [50]}
    right = {7: list(range(100, 117)), 8: []}
    frame = lambda side, tag: spark.createDataFrame([(k, len(m), i, f"{tag}{i}") for k, m in side.items() for i in m], "rep long, n long, id long, name string")
    pairs = spark.createDataFrame([(1, 7, "p"), (2, 7, "q"), (1, 8, "r"), (3, 7, "s")], "lo long, hi long, tag string")
    for hot in (3, 1000):
        found = expand(pairs, frame(left, "a"), frame(right, "b"), hot)
        assert set(found.columns) == {"tag", "x", "y", "l_name", "r_name"}
        assert sorted((r["tag"], r["x"], r["y"], r["l_name"], r["r_name"]) for r in found.collect()) == sorted((t, i, j, f"a{i}", f"b{j}") for a, t in ((1, "p"), (2, "q")) for i in left[a] for j in right[7])
