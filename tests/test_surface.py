"""Tools, hooks, readers and writers."""

import json

import pytest
from pyspark.sql import functions as F

from kelpwood import catalogue, tools
from kelpwood.operators import hooks
from kelpwood.sources import readers, writers

FOLDER = "/root/testdata/sf0.001"


def test_every_tool_has_a_query():
    assert len(tools.TOOLS) == 50 and set(tools.TOOLS.values()) <= set(catalogue.queries())


def test_calls(spark):
    assert tools.call("memory_views_list", spark, FOLDER).count() == tools.call("list_views", spark, FOLDER).count() > 0
    with pytest.raises(KeyError):
        tools.call("no_such_tool", spark, FOLDER)


def test_extractor_and_backend(spark):
    df = spark.createDataFrame([(1, "Ada met Bo"), (2, None), (2, "")], "id long, text string")
    got = hooks.extract(df, "id", "text", lambda xs: [[(i, 2, "two", 1.0) for i, c in enumerate(x) if x[i : i + 2] == "Bo"] for x in xs])
    assert [tuple(r) for r in got.collect()] == [(1, 8, 2, "two", 1.0)]
    g = spark.createDataFrame([(1, "q", 2, "b"), (1, "q", 1, "a"), (2, "r", 1, "c")], "query_id long, question string, n int, chunk string")
    assert sorted(map(tuple, hooks.answer(g, lambda q, c: q + "".join(c)).collect())) == [(1, "qab"), (2, "rc")]


def test_hash_embedding(spark):
    v = [r["v"] for r in spark.createDataFrame([("a",), ("b",), ("a",)], "t string").select(hooks.hash_embedding(F.col("t"), 16).alias("v")).collect()]
    assert v[0] == v[2] != v[1] and sum(x * x for x in v[0]) == pytest.approx(1)


def test_question_sets(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "x", "category": "temporal", "context_turns": ["a", "b"], "question": "q", "gold_answer": "g", "gold_spans": ["g"]}]))
    r = readers.read_cases(spark, str(tmp_path / "a.json"), "dialogue").first()
    assert r["context_turns"] == ["a", "b"] and r["category"] == "temporal"
    (tmp_path / "b.json").write_text(json.dumps([{"id": "y", "initial_claim": "a", "query": "q", "expected_answer": "e", "contradiction_should_surface": True}]))
    assert readers.read_cases(spark, str(tmp_path / "b.json"), "claims").first()["contradiction_should_surface"] is True
    assert readers.mini_fixtures(spark).count() == 3


def test_notes_are_imported(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("---\ntitle: x\n---\nbody")
    (tmp_path / "docs" / "b.txt").write_text("+++\nno end")
    (tmp_path / "docs" / "c.bin").write_text("skip")
    (tmp_path / "docs" / "node_modules").mkdir()
    (tmp_path / "docs" / "node_modules" / "d.md").write_text("skip")
    (tmp_path / "docs" / "big.md").write_text("x" * 3000)
    notes = readers.read_notes(spark, str(tmp_path / "docs"), most_kb=2)
    assert sorted(r["text"] for r in notes.collect()) == ["[File: a.md]\nbody", "[File: b.txt]\n+++\nno end"]
    assert sorted((r["extension"], r["files"]) for r in readers.import_plan(notes).collect()) == [("md", 1), ("txt", 1)]
    assert readers.read_clipboard(spark, str(tmp_path / "docs" / "b.txt")).first()["text"] == "+++\nno end"


def test_compaction(spark, tmp_path):
    spark.range(100).repartition(9).write.parquet(str(tmp_path / "a"))
    writers.compact(spark, str(tmp_path / "a"), str(tmp_path / "b"), 2)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 100 and len(list((tmp_path / "b").glob("part-*.parquet"))) == 2
    writers.purge_folder(spark.read.parquet(str(tmp_path / "b")), F.col("id") % 2 == 0, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 50
