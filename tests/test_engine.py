"""The end-to-end search against plain Python, and its odd cases."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kelpwood.plans import engine

NOW = datetime(2024, 1, 17, 16)
AT = 1705507200
V = "id string, embedding array<double>"
U = "id string, retrieved long, succeeded long, last long"
T = "subject_id string, predicate string, object_id string, confidence double"
S = "id long, raw_text string, embedding array<double>, tier int, cluster_id long, created_at long"
Q = "query_id long, q array<double>"


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / n


def plain_entities(q, k, wider, vectors, known, usage):
    """Ids in the fused order."""
    order = sorted(vectors, key=lambda r: (-cosine(r[1], q), r[0]))
    own = [i for i, _ in order[:k] if i in known]
    if not order:
        return []
    use = {r[0]: r[1:] for r in usage}
    value = lambda i: use[i][1] / (use[i][0] + 1) if i in use else 0.5
    rare = lambda i: 1 / (use[i][0] + 1) if i in use else 1.0
    fresh = lambda i: math.exp(-0.05 * (math.floor((AT - use[i][2]) / 60) / 60)) if i in use else 0.0
    score = dict.fromkeys(own, 0.0)
    for f in (lambda i: 0, value, rare, fresh):
        for n, i in enumerate(sorted(own, key=lambda i: -f(i)), 1):
            score[i] += 1 / (60 + n)
    out = sorted(own, key=lambda i: -round(score[i], 12))
    if max(cosine(v, q) for _, v in order[:k]) < 0.3 and len(own) < 3:
        out += [i for i, v in order[k:wider] if i in known and cosine(v, q) * 0.6 >= 0.15]
    return out


def plain_neighbours(seeds, triples, hops):
    seen, front, out = set(seeds), set(seeds), {}
    for h in range(1, hops + 1):
        front = ({o for s, _, o, _ in triples if s in front} | {s for s, _, o, _ in triples if o in front}) - seen
        seen |= front
        out |= dict.fromkeys(front, h)
    return out


@pytest.fixture(scope="module")
def world():
    rnd = random.Random(4)
    vectors = [(f"e{i}", [rnd.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    usage = [(f"e{i}", rnd.randint(1, 4), rnd.randint(0, 1), AT - rnd.randint(0, 3) * 3600) for i in range(0, 60, 2)]
    triples = [(f"e{rnd.randrange(80)}", "knows", f"e{rnd.randrange(80)}", 0.5) for _ in range(90)]
    signals = [(i, rnd.choice(["blue bolt", "red nut", "old car"]), [rnd.gauss(0, 1) for _ in range(4)], 1 + i % 4, None, AT - i * 6 * 3600) for i in range(80)]
    return vectors, usage, triples, signals


def test_lists_are_those_of_plain_python(spark, world):
    vectors, usage, triples, signals = world
    known = {f"e{i}" for i in range(80) if i % 7}
    questions = {0: "the blue bolt", 1: "how is a bolt related to nuts", 2: "what came in last week", 3: "ls", 4: "which of the cars did they sell there"}
    asked = [(i, [math.sin(i + 1), math.cos(i), 0.3, -0.2 * i]) for i in questions]
    frames = spark.createDataFrame(vectors, V), spark.createDataFrame([(i,) for i in sorted(known)], "id string"), spark.createDataFrame(usage, U), spark.createDataFrame(triples, T), spark.createDataFrame(signals, S)
    got = engine.search(questions, spark.createDataFrame(asked, Q), *frames, NOW, 4, diversity=0.0).collect()
    plans = {0: (5, 0, 10), 1: (15, 2, 20), 2: (10, 1, 15), 4: (10, 1, 15)}
    assert {r["query_id"] for r in got} == set(plans)
    for i, (k, hops, wider) in plans.items():
        q = dict(asked)[i]
        ents = sorted((r["rank"], r["id"]) for r in got if r["query_id"] == i and r["kind"] == "entity")
        assert [e for _, e in ents] == plain_entities(q, k, wider, vectors, known, usage) and [n for n, _ in ents] == list(range(1, len(ents) + 1))
        assert {r["id"]: r["rank"] for r in got if r["query_id"] == i and r["kind"] == "neighbour"} == plain_neighbours([e for _, e in ents], triples, hops)
        assert len([r for r in got if r["query_id"] == i and r["kind"] == "signal"]) <= max(3, k // 2)
    week = [(0.6 * cosine(s[2], dict(asked)[2]) + 0.4 * 2 ** (-(AT - s[5]) / 86400 / 7), s[0]) for s in signals if 1704672000 <= s[5] < 1705276800]
    want = [str(i) for _, i in sorted(week, key=lambda r: (-r[0], r[1]))[:10]]
    assert [r["id"] for r in sorted((r for r in got if r["kind"] == "temporal"), key=lambda r: r["rank"])] == want and {r["query_id"] for r in got if r["kind"] == "temporal"} == {2}


def test_fallback_takes_the_next_arm(spark):
    """Nothing is like the question and the view hides most hits: the next arm's list follows, faded, and only what is still worth something."""
    angle = lambda c: [c, math.sqrt(1 - c * c)]
    vectors = [(f"e{i}", angle(0.295 - i / 100)) for i in range(9)]
    asked = spark.createDataFrame([(0, [1.0, 0.0], 3, 6)], "query_id long, q array<double>, k int, wider int")
    got = engine.found(spark.createDataFrame(vectors, V), spark.createDataFrame([(f"e{i}",) for i in range(1, 9)], "id string"), asked, 6).collect()
    assert sorted((r["id"], r["own"]) for r in got) == [("e1", True), ("e2", True), ("e3", False), ("e4", False)]
    full = engine.found(spark.createDataFrame(vectors, V), spark.createDataFrame([(f"e{i}",) for i in range(9)], "id string"), asked, 6).collect()
    assert sorted(r["id"] for r in full) == ["e0", "e1", "e2"]
    f = engine.fused(spark.createDataFrame(got), spark.createDataFrame([], U), AT).collect()
    assert [(r["id"], r["fused"] is None) for r in sorted(f, key=lambda r: r["rank"])] == [("e1", False), ("e2", False), ("e3", True), ("e4", True)]


def test_odd_tables(spark, world):
    """Empty tables, null vectors, questions that the gate turns away, questions without a vector: no rows of theirs, no error."""
    vectors, usage, triples, signals = world
    none = [spark.createDataFrame([], s) for s in (V, "id string", U, T, S)]
    asked = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], Q)
    assert engine.search({0: "what happened last week"}, asked, *none, NOW, 4).collect() == []
    assert engine.search({0: "ls"}, asked, *none, NOW, 4).collect() == []
    frames = [spark.createDataFrame([*vectors, ("n", None)], V), spark.createDataFrame([("e1",), ("e2",), ("n",)], "id string"), *none[2:]]
    got = engine.search({0: "the blue bolt", 9: "one red nut"}, asked.withColumn("extra", F.lit(1)), *frames, NOW, 4).collect()
    assert {r["query_id"] for r in got} <= {0} and all(r["id"] != "n" for r in got)


def test_diversity_only_reorders(spark, world):
    vectors, usage, triples, signals = world
    frames = spark.createDataFrame(vectors, V), spark.createDataFrame([(i,) for i, _ in vectors], "id string"), spark.createDataFrame(usage, U), spark.createDataFrame(triples, T), spark.createDataFrame(signals, S)
    asked = spark.createDataFrame([(0, [1.0, 0.2, 0.0, 0.1])], Q)
    ids = lambda d: [r["id"] for r in engine.search({0: "how is a related to b"}, asked, *frames, NOW, 4, diversity=d).filter("kind = 'entity'").orderBy("rank").collect()]
    plain, spread = ids(0.0), ids(0.9)
    assert sorted(plain) == sorted(spread) and plain != spread and plain[0] == spread[0]
