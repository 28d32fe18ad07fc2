from __future__ import annotations

import json

import pytest

from quillspark import config
from quillspark.sources import files
from quillspark.sources.tables import HISTORY_SCHEMA


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "history")
    assert files.read_json_lines(spark, path, HISTORY_SCHEMA).count() == 0
    rows = spark.createDataFrame([(1, 2.5)], "step long, train_loss double")
    files.append_json_lines(rows, path)
    files.append_json_lines(rows, path)
    (tmp_path / "history" / "blank.json").write_text('\n\n{"step": 3, "val_loss": 1.0}\n')
    assert sorted((r["step"], r["train_loss"], r["val_loss"]) for r in files.read_json_lines(spark, path, HISTORY_SCHEMA).where("step < 3").collect()) == [(1, 2.5, None)] * 2
    assert files.read_json_lines(spark, path, HISTORY_SCHEMA).count() == 3


def test_index_keeps_nulls(spark, tmp_path):
    path = str(tmp_path / "index")
    assert files.read_index(spark, path).count() == 0
    rows = spark.createDataFrame([("r1", 1.5), ("r2", None)], "run_id string, validation_loss double")
    index = files.read_index(spark, path).unionByName(rows, allowMissingColumns=True)
    files.write_index(index, path)
    assert {(r["run_id"], r["validation_loss"], r["hardware"]) for r in files.read_index(spark, path).collect()} == {("r1", 1.5, None), ("r2", None, None)}


def test_prompt_suite(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"version": 1, "prompts": [{"id": "a", "category": "c", "prompt": "x"}, {"id": "b", "category": "c", "prompt": "y", "group": "g"}]}))
    assert files.read_prompts(spark, str(path)).count() == 2
    path.write_text(json.dumps({"version": 1, "prompts": [{"id": "a"}, {"id": "a"}]}))
    with pytest.raises(ValueError, match="twice"):
        files.read_prompts(spark, str(path))


def test_stored_splits_are_guarded(spark, tmp_path):
    folder = str(tmp_path / "s")
    assert files.read_splits(spark, folder, {"a": 1}) is None
    files.write_splits(spark.createDataFrame([(1, "train"), (2, "test")], "id long, split string"), folder, {"a": 1})
    assert files.read_splits(spark, folder, {"a": 1}).where("split = 'test'").count() == 1
    with pytest.raises(files.StaleData):
        files.read_splits(spark, folder, {"a": 2})


def test_packed_blocks_are_guarded(spark, tmp_path):
    folder = str(tmp_path / "p")
    files.write_packed(spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "block_id long, tokens array<int>"), folder, 2, "sha")
    assert files.read_packed(spark, folder, "sha").count() == 2
    with pytest.raises(files.StaleData):
        files.read_packed(spark, folder, "other")
    files.write_packed(spark.createDataFrame([(0, [1])], "block_id long, tokens array<int>"), folder, 2, "sha")
    with pytest.raises(ValueError):
        files.read_packed(spark, folder)


def test_settings(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"packing": {"block_size": 64}, "description": "x"}))
    (tmp_path / "child.json").write_text(json.dumps({"extends": "base.json", "splits": {"min_chars": 5, "normalization": {"form": "NFKC"}}}))
    made = config.load(tmp_path / "child.json", ["packing.block_size=128"])
    assert made.packing.block_size == 128 and made.splits.min_chars == 5 and made.splits.normalization.form == "NFKC" and made.description == "x"
    with pytest.raises(config.ConfigError, match="splits.mini"):
        config.load(tmp_path / "child.json", ["splits.mini=3"])
    with pytest.raises(config.ConfigError):
        config.load(tmp_path / "child.json", ["packing.block_size=0"])
    assert config.load(tmp_path / "child.json").packing.block_size == 64
    assert config.typed(config.PipelineConfig, {}) == config.PipelineConfig()
    (tmp_path / "base.json").write_text(json.dumps({"extends": "child.json"}))
    with pytest.raises(config.ConfigError, match="extend"):
        config.load(tmp_path / "child.json")
    assert config.difference({"a": {"b": 1}, "description": "x"}, {"a": {"b": 2, "c": 3}, "description": "y"}, ["description"]) == {"a.b": (1, 2), "a.c": (None, 3)}


def test_revision_falls_back():
    def fails():
        raise OSError("no network")

    assert files.resolved_revision("main", lambda: "abc") == "abc"
    assert files.resolved_revision("main", fails) == "main" and files.resolved_revision("main", lambda: None) == "main" and files.resolved_revision(None, fails) is None
