"""Conversations as JSON files: odd names, commits, and what a failed write leaves."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import files
from millrace.sources.conversation_files import ConversationWriter

COLS = "conv_id string, turn long, role string, content string"


def test_round_trip(spark, tmp_path):
    names = ["a", "b/c d", "50%", "é+ü", "x.json", ".", "a=b?#", "_c", ""]
    rows = [(n, t, "user" if t % 2 == 0 else "assistant", f'{n} "{t}"\n') for n in names for t in range(12)]
    path = str(tmp_path / "saved")
    files.write_conversations(spark.createDataFrame(rows, COLS).orderBy(F.rand(3)), path)
    got = files.read_conversations(spark, path).select("conv_id", "turn", "role", "content")
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    files.write_conversations(spark.createDataFrame([("new", 5, "user", "added")], COLS), path)
    assert files.read_conversations(spark, path).count() == len(rows) + 1
    folders = [p for p in (tmp_path / "saved").iterdir() if p.is_dir()]
    assert not [p for p in folders if p.name.startswith(".")] and sum(len(list(p.glob("*.json"))) for p in folders) == len(names) + 1
    assert len(folders) < len(names) + 1


def test_failed_write_is_not_read(spark, tmp_path):
    path = str(tmp_path / "saved")
    files.write_conversations(spark.createDataFrame([("a", 0, "user", "x")], COLS), path)
    bad = spark.createDataFrame([(f"c{i}", 0, "user", str(i)) for i in range(40)], COLS).withColumn("content", F.when(F.col("conv_id") == "c7", F.raise_error("lost")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        files.write_conversations(bad, path)
    assert [r.conv_id for r in files.read_conversations(spark, path).collect()] == ["a"]


def test_writer_streams_and_aborts(tmp_path):
    writer = ConversationWriter(f"file://{tmp_path}/w")
    done = [writer.write(iter([("a", "1"), ("a", "2"), ("b", "3")])), writer.write(iter([])), None]
    assert not list(tmp_path.glob("w/[!.]*"))
    writer.abort(done[1:])
    writer.commit(done[:1])
    assert {p.name: json.loads(p.read_text()) for p in tmp_path.glob("w/*/*.json")} == {"a.json": [1, 2], "b.json": [3]}
    assert len(list(tmp_path.glob("w/*"))) == 1
