"""The policy search against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from kelpwood.operators import policy_search as PS
from kelpwood.operators.policy import Policy

SPACES = ("text", "lexical", "recency", "confidence")
SCHEMA = "g long, good boolean, " + ", ".join(f"{s} double" for s in SPACES)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    return [(i % 7, x < 0.4, rnd.random(), rnd.random(), x, 0.7) for i in range(400) for x in [rnd.random()]]


def plain(rows, p):
    """Share of right rows by instance."""
    w, out = p.weights, {}
    for g, good, *v in rows:
        s = sum(w.get(k, 0.0) * x for k, x in zip(SPACES, v, strict=True)) / sum(w.get(k, 0.0) for k in SPACES)
        out.setdefault(g, []).append((s >= p.floor and s >= 0.5) == good)
    return {g: sum(x) / len(x) for g, x in out.items()}


def test_matrix(spark, rows):
    policies = {0: Policy(), 3: Policy({"text": 0.1, "lexical": 0.2, "recency": 0.6, "confidence": 0.1}), 5: Policy(floor=0.6)}
    got = PS.score_matrix(spark.createDataFrame(rows, SCHEMA), "g", {k: F.col(k) for k in SPACES}, F.col("good"), policies).collect()
    assert len(got) == 21
    for r in got:
        assert r["score"] == pytest.approx(plain(rows, policies[r["candidate"]])[r["instance"]])


def test_search(spark, rows):
    tried, scores = PS.policy_search(spark.createDataFrame(rows, SCHEMA), "g", {k: F.col(k) for k in SPACES}, F.col("good"), rounds=3)
    mean = {}
    for t in tried:
        own = plain(rows, t.policy)
        mean[t.candidate] = sum(own.values()) / len(own)
        assert t.mean == pytest.approx(mean[t.candidate])
        assert t.accepted == (t.reason in ("seed", "accepted")) and (not t.reason.startswith("lost") or 100 * (mean[0] - t.mean) > PS.MOST_LOSS)
    prints = [t.policy.fingerprint() for t in tried]
    taken = {t.candidate for t in tried if t.accepted}
    assert len(prints) == len(set(prints)) and len(taken) > 1 and {t.parent for t in tried[1:]} <= taken
    assert {r["candidate"] for r in scores.select("candidate").distinct().collect()} == taken
    for r in scores.collect():
        assert r["score"] == pytest.approx(plain(rows, tried[r["candidate"]].policy)[r["instance"]])


def test_nothing_to_score(spark):
    assert PS.policy_search(spark.createDataFrame([], SCHEMA), "g", {k: F.col(k) for k in SPACES}, F.col("good")) == ([], None)
