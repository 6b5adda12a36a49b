import random
from datetime import datetime

from pyspark.sql import functions as F

from kelpwood.functions import scalars as S
from kelpwood.operators import beliefs, graph, relational, temporal
from kelpwood.plans.planner import plan, replan, retrieve, time_range
from kelpwood.sources import readers, writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_names(spark):
    assert one(spark, S.fingerprint(F.lit("The Widgets"))) == "the widget"
    assert one(spark, S.fingerprint(F.lit("Boss"))) == "boss"
    assert one(spark, S.fingerprint(F.lit("ab"))) == ""
    assert one(spark, S.slug(F.lit(" Hello, World! "))) == "hello-world"
    assert one(spark, S.humanize(F.lit("worksAt_place"))) == "works at place"
    assert one(spark, S.strip_frontmatter(F.lit("---\na: 1\n---\ntext"))) == "text"
    assert one(spark, S.strip_frontmatter(F.lit("---\na: 1\ntext"))) == "---\na: 1\ntext"
    assert one(spark, S.redact(F.lit("me@x.org 123-45-6789"))) == "[email] [ssn]"


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert abs(one(spark, S.cosine(a, a)) - 1) < 1e-12
    assert one(spark, S.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0
    assert one(spark, S.cosine(a, F.array(F.lit(1.0)))) == 0


def test_propagation(spark):
    b = spark.createDataFrame([("a", "in"), ("b", "out"), ("c", "in"), ("d", "out"), ("e", "out")], "id string, status string")
    j = spark.createDataFrame([(1, "b", "support", "a"), (2, "c", "defeat", "b"), (3, "d", "support", "b"), (3, "d", "support", "e")], "jid int, target string, kind string, premise string")
    assert {r["id"]: r["status"] for r in beliefs.propagate(b, j).collect()} == {"a": "in", "b": "in", "c": "out", "d": "out", "e": "out"}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["label"] for r in graph.components(e).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 43


def test_components_write_edges_once(spark, monkeypatch):
    """Groups of any shape, loops and ends that are null; of a dense graph the edges are written once, in one direction, and the rest follows the nodes."""
    rnd = random.Random(5)
    rows = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(400, 400), (None, 401), (402, None)] + [(500 + i, 599) for i in range(30)]
    up = {v: v for r in rows if None not in r for v in r}
    for _ in range(300):
        for a, b in rows:
            if None not in (a, b):
                up[a] = up[b] = min(up[a], up[b])
    e = spark.createDataFrame(rows, "a long, b long")
    assert {r["id"]: r["label"] for r in graph.components(e).collect()} == up
    assert graph.components(e.limit(0)).isEmpty()
    written, kept = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: (out := kept(df), written.append(out.count()))[0])
    dense = spark.createDataFrame([(f"x{i}", f"x{j}") for i in range(60) for j in range(i)], "a string, b string")
    assert {(r["label"]) for r in graph.components(dense).collect()} == {"x0"}
    assert sum(n >= 1770 for n in written) == 1 and sum(written) < 2 * 1770


def test_change_log(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, version long, v string")
    new = writers.upsert(log, spark.createDataFrame([("a", "z"), ("c", "w")], "id string, v string"), ["id"], "version")
    assert {r["id"]: (r["version"], r["v"]) for r in writers.current(new, ["id"], "version").collect()} == {"a": (2, "z"), "b": (1, "y"), "c": (1, "w")}


def test_facts(spark):
    d = lambda m: datetime(2024, m, 1)
    schema = "entity_id long, fact_id long, valid_from timestamp, valid_to timestamp, recorded_at timestamp, superseded_at timestamp"
    facts = spark.createDataFrame([(1, 1, d(1), None, d(1), None)], schema)
    after = temporal.update_facts(facts, spark.createDataFrame([(1, 2, d(3), None, d(4), None)], schema))
    at = lambda v, r: [x["fact_id"] for x in temporal.query_at(after, F.lit(d(v)), F.lit(d(r))).collect()]
    assert at(3, 2) == [1] and at(3, 5) == [2] and at(2, 5) == []


def test_planner(spark):
    now = datetime(2024, 5, 15, 12)
    assert time_range("yesterday", now) == (datetime(2024, 5, 14), datetime(2024, 5, 15))
    assert time_range("last 2 weeks", now)[0] == datetime(2024, 5, 1, 12)
    assert plan("who is Bo").action == "direct_lookup"
    assert replan(plan("who is Bo"), 0.1).action == "bandit_retrieval"
    s = spark.createDataFrame([(1, "blue bolt order", datetime(2024, 5, 14, 8)), (2, "blue bolt", datetime(2023, 1, 1)), (3, "red ring", datetime(2024, 5, 14, 9))], "id long, text string, at timestamp")
    assert [r["id"] for r in retrieve("blue bolt yesterday", s, now).collect()] == [1]
    assert [r["id"] for r in retrieve("bolt", s, now).collect()] == [2, 1]


def test_readers(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.md").write_text("---\nt: 1\n---\nhello")
    (tmp_path / "n" / "b.bin").write_text("no")
    assert [r["text"] for r in readers.read_notes(spark, str(tmp_path / "n")).collect()] == ["[File: a.md]\nhello"]
    (tmp_path / "h").write_text(": 1700000000:3;make all\n: 1700000001:0;ls -l\nnoise\n")
    assert [(r["seconds"], r["command"]) for r in readers.read_shell_history(spark, str(tmp_path / "h")).collect()] == [(3, "make all")]
    (tmp_path / "l").write_text('{"a": 1}\n{bad\n')
    assert readers.read_lines(spark, str(tmp_path / "l"), "a long").collect()[0]["a"] == 1


def test_view_without_includes(spark):
    e = spark.createDataFrame([("a", 1), ("b", None)], "id string, context_id long")
    none = spark.createDataFrame([("exclude", "entity", "a")], "kind string, member_type string, member_id string")
    assert [r["id"] for r in relational.apply_view(e, none).collect()] == ["b"]


def test_fuzzy_match(spark):
    """Every name within the distance is found, short ones and those with edits near both ends too."""
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(4)
    known = ["supplier#000000005", "china", "iq"] + ["".join(rng.choices("abcdxyz", k=rng.randint(3, 12))) + "q" for _ in range(60)]
    asked = {"xupplier#000000009", "chima", "nobody at all"}
    for name in known[3:]:
        edited = list(name)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(edited))
            edited[at : at + rng.randint(0, 1)] = rng.choice(["", "k", "kk"])
        asked.add("".join(edited) + "k")
    entities = spark.createDataFrame(list(enumerate(known)), "id int, name string")
    for most in (1, 2):
        got = {r["query"]: (r["distance"], r["id"]) for r in relational.fuzzy_match(spark.createDataFrame([(a,) for a in asked], "query string"), entities, most).collect()}
        best = {a: min((distance(a, n), i) for i, n in enumerate(known)) for a in asked}
        assert got == {a: b for a, b in best.items() if b[0] <= most}
