from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.streaming.packer import first_copies, packed_stream, step_means


def drain(stream, name, path, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_packer_goes_on_after_a_restart(spark, tmp_path):
    schema, source = "split string, id long, tokens array<int>", str(tmp_path / "in")
    docs = [("train", k, [k + 2] * (k % 5)) for k in range(20)]
    out = str(tmp_path / "out")
    for part in (docs[:9], docs[9:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = packed_stream(spark.readStream.schema(schema).parquet(source), 4)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).orderBy("block_id").collect()
    whole = [t for _, _, d in docs for t in [*d, 0]]
    assert [list(r["tokens"]) for r in rows] == [whole[i : i + 4] for i in range(0, len(whole) - 3, 4)]
    assert [r["block_id"] for r in rows] == list(range(len(rows)))


def test_first_copies_and_late_lines(spark, tmp_path):
    source = str(tmp_path / "docs")
    rows = spark.createDataFrame([("Hello  world", "2026-01-01 10:00:00"), ("hello world", "2026-01-01 10:05:00"), ("other", "2026-01-01 10:06:00"), (None, "2026-01-01 10:07:00")], "text string, t string").withColumn("t", F.to_timestamp("t"))
    rows.coalesce(1).write.parquet(source)
    drain(first_copies(spark.readStream.schema("text string, t timestamp").parquet(source), "t"), "copies", tmp_path / "c1")
    assert spark.table("copies").count() == 2
    logs = str(tmp_path / "logs")
    rows = spark.createDataFrame([("r", 1.0, "2026-01-01 10:00:00"), ("r", 3.0, "2026-01-01 10:09:00"), ("r", float("nan"), "2026-01-01 10:09:30"), ("r", 5.0, "2026-01-01 13:00:00")], "run_id string, train_loss double, t string").withColumn("logged_at", F.to_timestamp("t"))
    rows.coalesce(1).write.parquet(logs)
    drain(step_means(spark.readStream.schema(rows.schema).parquet(logs)), "means", tmp_path / "c2", "complete")
    assert sorted((r["records"], r["mean_loss"]) for r in spark.table("means").collect()) == [(1, 5.0), (2, 2.0)]
