"""Bandit replay against a plain fold: cut keys, odd rows, worth of the chosen arms."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from kelpwood.operators import bandit

SCHEMA = "id long, k string, arm int, reward double, x array<double>, hint int"


def near(a, b):
    (p, q), (r, s) = bandit.ARM_FEATURES[a], bandit.ARM_FEATURES[b]
    return math.exp(-3 * math.hypot(p - r, q - s))


def plain(rows):
    """Choices by id, and the last state of each key, one event after the other."""
    made, state = {}, {}
    for i, k, arm, reward, x, hint in sorted(rows, key=lambda r: r[0]):
        w, v, bias, n, alpha = state.setdefault(k, [[[0.0] * 2 for _ in range(6)], [[0.0] * 2 for _ in range(6)], [0.0] * 6, [0] * 6, [0.5]])
        good = x is not None and len(x) == 2 and all(c is not None and math.isfinite(c) for c in x)
        if not good:
            made[i] = sum(n) % 6
            continue
        score = [math.inf if n[a] == 0 else sum(w[a][d] * x[d] for d in range(2)) + bias[a] + alpha[0] * math.sqrt(sum(x[d] ** 2 / (v[a][d] + 1) for d in range(2))) + (0.1 if hint == a else 0) for a in range(6)]
        made[i] = score.index(max(score))
        if arm is None or not 0 <= arm < 6 or reward is None:
            continue
        error = min(1, max(0, reward)) - sum(w[arm][d] * x[d] for d in range(2)) - bias[arm]
        for d in range(2):
            w[arm][d] += 0.01 * error * x[d]
            v[arm][d] += x[d] ** 2
        for a in range(6):
            bias[a] += 0.01 * error * near(arm, a)
        n[arm] += 1
        alpha[0] = max(0.05, alpha[0] * 0.995)
    return made, state


def events():
    rnd = random.Random(5)
    rows = []
    for i in range(900):
        k = rnd.choice(["hot"] * 6 + ["a", "b", None])
        x = [rnd.random(), rnd.random() * 2 - 1]
        x = rnd.choice([x] * 20 + [None, [1.0], [math.nan, 1.0], [None, 1.0]])
        rows.append((i, k, rnd.choice([0, 1, 2, 3, 4, 5, None, 9]), rnd.choice([rnd.random(), rnd.random() * 3 - 1, None]), x, rnd.choice([None, 2, 5, 77])))
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_replay_is_a_plain_fold(spark, parts):
    rows = events()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = bandit.replay(df, "k", ["id"], 2, parts=parts)
    made, state = plain(rows)
    out = got.collect()
    assert len(out) == len(rows) and {r["id"]: r["chosen"] for r in out} == made
    assert {r["id"]: (r["k"], r["arm"], r["reward"]) for r in out} == {r[0]: r[1:4] for r in rows}
    for r in bandit.states(df, "k", ["id"], 2, parts=parts).collect():
        w, _, bias, n, alpha = state[r["k"]]
        assert r["pulls"] == n[r["arm"]] and r["alpha"] == pytest.approx(alpha[0], rel=1e-9)
        assert r["bias"] == pytest.approx(bias[r["arm"]], abs=1e-9) and r["weight"] == pytest.approx(np.mean(np.abs(w[r["arm"]])), abs=1e-9)


def test_the_hot_key_is_cut(spark):
    """The rows of one key lie in several pieces, none of which holds half of them."""
    df = spark.createDataFrame([(i, "hot", i % 6, 0.5, [1.0, 0.0], None) for i in range(2000)], SCHEMA)
    e = bandit._segments(df, "k", ["id"], 8)
    sizes = [r["count"] for r in e.groupBy("__segment").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 1000


def test_empty_and_single(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bandit.replay(none, "k", ["id"], 2).collect() == [] and bandit.states(none, "k", ["id"], 2).collect() == []
    one = bandit.replay(spark.createDataFrame([(1, None, None, None, None, None)], SCHEMA), "k", ["id"], 2).collect()
    assert [(r["k"], r["chosen"]) for r in one] == [(None, 0)]


def test_order_of_time_and_no_hint(spark):
    """Times as the order, and no column of hints."""
    rows = [(i, "a", i % 6, 0.9, [1.0, 0.5], None) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("timestamp_seconds(id) as at", "id", "k", "arm", "reward", "x")
    got = {r["id"]: r["chosen"] for r in bandit.replay(df, "k", ["at", "id"], 2, parts=3).collect()}
    assert got == plain(rows)[0]


def test_value(spark):
    rnd = random.Random(2)
    rows = [("q", rnd.randrange(3), rnd.random(), rnd.randrange(3)) for _ in range(200)] + [(None, 1, 1.0, 2), ("q", None, 0.3, 1), ("q", 1, None, 1)]
    got = {r["c"]: r for r in bandit.value_of(spark.createDataFrame(rows, "c string, arm int, reward double, chosen int"), ["c"]).collect()}
    use = [r for r in rows[:200]]
    of = defaultdict(int)
    for r in use:
        of[r[1]] += 1
    hits = [(r[2], 1 / of[r[1]]) for r in use if r[1] == r[3]]
    assert got["q"]["n"] == 200 and got["q"]["agreed"] == len(hits)
    assert got["q"]["logged"] == pytest.approx(sum(r[2] for r in use) / 200) and got["q"]["estimate"] == pytest.approx(sum(r * w for r, w in hits) / sum(w for _, w in hits))
    assert got[None]["agreed"] == 0 and got[None]["estimate"] is None
