"""Queries and operators on small tables of a test's own, where results are worked out by hand."""

import pytest
from pyspark.sql import functions as F

from kelpwood import catalogue
from kelpwood.operators import dictionary, graph, retrieval


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_every_rejected_link_counts(spark, tmp_path):
    """A name that was turned down as a link isn't proposed again, whatever the id of that row."""
    lines = [(1, 1, 1, "N", 1.0), (1, 2, 2, "N", 2.0), (4, 2, 1, "R", 1.0), (4, 3, 3, "N", 1.0), (5, 1, 3, "R", 2.0)]
    at = write(
        spark, tmp_path, part=([(1, "B1", "x"), (2, "B2", "y"), (3, "B3", "z")], "p_partkey long, p_brand string, p_type string"),
        lineitem=(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_quantity double"),
    )
    got = catalogue.queries()["persist_proposals"](spark, at).collect()
    assert sorted(map(tuple, got)) == [("link", "B3 z", 2), ("object", "B2 y", 2)]


def test_captures_of_later_times_keep_their_order(spark):
    """Scores of captures after ``now`` pass 1; the later one is first, whatever its id."""
    day = 86400
    rows = [(1, [1.0, 0.0], "a word", 0, 300 * day), (2, [1.0, 0.0], "a word", 0, 390 * day), (3, [1.0, 0.0], "a word", 0, 0)]
    signals = spark.createDataFrame(rows, "id long, embedding array<double>, raw_text string, tier int, created_at long").withColumn("cluster_id", F.lit(None).cast("long"))
    asked = spark.createDataFrame([(0, [1.0, 0.0], "word")], "query_id long, q array<double>, query string")
    got = {r["id"]: (r["rank"], r["score"]) for r in retrieval.signal_hits(signals, asked, F.lit(0), 3, 2).collect()}
    want = {i: (0.534 + 0.311 + 0.078 * 2.0 ** (at / day / 30) + 0.078 * 0.7) / (0.534 + 0.311 + 0.078 + 0.078) for i, _, _, _, at in rows}
    assert [got[i][0] for i in (2, 1, 3)] == [1, 2, 3]
    assert [got[i][1] for i in (1, 2, 3)] == pytest.approx([want[i] for i in (1, 2, 3)])


def test_weights_of_logged_verbs(spark, tmp_path):
    at = write(spark, tmp_path, events=([(0, "view"), (4, "error"), (1, "view")], "user_id long, event_type string"))
    got = catalogue.queries()["default_verb_weights"](spark, at).collect()
    assert sorted((r["verb"], r["text"], r["n"]) for r in got) == [("plan", 0.3, 1), ("recall", 0.534, 2)]


def test_baseline_variables_are_kept(spark, tmp_path):
    """A variable that events speak of keeps its values."""
    at = write(spark, tmp_path, events=([(0, "view"), (4, "error"), (1, "error")], "user_id long, event_type string"))
    got = catalogue.queries()["ensure_baseline_variables"](spark, at).collect()
    assert sorted(map(tuple, got)) == [("context", 2), ("event_kind", 5), ("time_window", 4), ("view", 1)]


def test_questions_about_customers(spark, tmp_path):
    at = write(spark, tmp_path, customer=([(3, "Ada", 1), (4, "Bo", 1), (5, "Cy", 1)], "c_custkey long, c_name string, c_nationkey int"), nation=([(1, "Here")], "n_nationkey int, n_name string"))
    kinds = {r["id"]: r["kinds"] for r in catalogue.queries()["expand_queries"](spark, at).collect()}
    assert kinds == {3: "original,who:Ada,what:Ada,who:May", 4: "original", 5: "original,who:Cy's,what:Cy's,temporal-recent"}
    said = {r["id"]: (r["question"], r["suggestion"]) for r in catalogue.queries()["generate_suggestions"](spark, at).collect()}
    assert said == {3: ("what happened yesterday", "What changed since then?"), 4: ("how is Bo linked to Here", "What is related to Bo?"), 5: ("what happened yesterday", "What changed since then?")}


def test_fingerprints_exchange_edges_twice(spark, monkeypatch):
    """Two edges away, with the way back left out; no exchange tells edges apart first."""
    monkeypatch.setattr(graph, "checkpointed", lambda df: df)
    triples = spark.createDataFrame([("a", "knows", "b"), ("b", "knows", "c"), ("b", "has", "d"), ("a", "knows", "b")], "subject_id string, predicate string, object_id string")
    entities = spark.createDataFrame([(x, "t" if x == "d" else "p") for x in "abcd"], "id string, entity_type string")
    fp = graph.fingerprints(triples, entities)
    assert {r["id"]: (r["hop1"], r["hop2"]) for r in fp.collect()} == {
        "a": (["knows->p"], ["has->t", "knows->p"]), "b": (["has->t", "knows->p", "knows<-p"], []),
        "c": (["knows<-p"], ["has->t", "knows<-p"]), "d": (["has<-p"], ["knows->p", "knows<-p"]),
    }
    plan = fp._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan and "Expand" not in plan and not [x for x in plan.splitlines() if "Aggregate [id#" in x and "other#" in x.split("], [")[0]]


def test_places_that_start_no_name_go_first(spark):
    """All places that a name may start at stay, and of a thousand others next to none do."""
    node = spark.range(50).selectExpr("xxhash64(id) as g")
    place = spark.range(1050).selectExpr("id as doc", "xxhash64(id) as g")
    got = {r["doc"] for r in dictionary._may_start(place, node).collect()}
    assert got >= set(range(50)) and len(got) < 60
