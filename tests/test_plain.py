"""Operators that SQL can't say, against plain Python on small fixtures."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpwood.operators import answers, beliefs, graph, ingest, intent, learning, policy, store
from kelpwood.operators import text as X
from kelpwood.operators import vectors
from kelpwood.plans import planner
from kelpwood.streaming import operators as streaming


# ----------------------------------------------------------------- graph
def quality(edges, label):
    m = sum(w for _, _, w in edges)
    k = defaultdict(float)
    for a, b, w in edges:
        k[a] += w
        k[b] += w
    total = defaultdict(float)
    for n, v in k.items():
        total[label[n]] += v
    return sum(w for a, b, w in edges if label[a] == label[b]) / m - sum((v / (2 * m)) ** 2 for v in total.values())


def test_communities(spark):
    """Two dense groups with one edge between them: no move of a single node raises modularity any more, which is that of plain Python."""
    rnd = random.Random(2)
    edges = [(f"{g}{i}", f"{g}{j}", rnd.choice([0.01, 0.5, 1.0, 3.0])) for g in "xy" for i in range(8) for j in range(i) if rnd.random() < 0.8] + [("x1", "y1", 0.3)]
    df = spark.createDataFrame(edges, "a string, b string, weight double")
    label = {r["id"]: r["label"] for r in graph.communities(df, least=1e-12).collect()}
    clamped = [(a, b, min(max(w, 0.05), 1.0)) for a, b, w in edges]
    assert quality(clamped, label) > quality(clamped, {n: n for n in label})
    for n in label:
        for other in set(label.values()):
            assert quality(clamped, label | {n: other}) <= quality(clamped, label) + 1e-9
    assert all(n[0] == v[0] for n, v in label.items())
    rows = spark.createDataFrame([(n, v) for n, v in label.items()], "id string, label string")
    q = graph.modularity(spark.createDataFrame(clamped, "a string, b string, weight double"), rows).first()["q"]
    assert q == pytest.approx(quality(clamped, label))


def test_hops_chains_and_rank(spark):
    rnd = random.Random(5)
    t = [(f"n{rnd.randint(0, 14)}", "p", f"n{rnd.randint(0, 14)}", rnd.randint(1, 99) / 100) for _ in range(40)]
    df = spark.createDataFrame(t, "subject_id string, predicate string, object_id string, confidence double")
    near = defaultdict(set)
    for a, _, b, _ in t:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    dist, front = {"n1": 0}, {"n1"}
    for h in range(1, 4):
        front = {b for a in front for b in near[a]} - set(dist)
        dist |= dict.fromkeys(front, h)
    assert {r["id"]: r["hop"] for r in graph.k_hop(df, "n1", 3).collect()} == {n: d for n, d in dist.items() if d}

    found = []

    def walk(path, score):
        for a, _, b, c in t:
            if a == path[-1] and b not in path and c >= 0.1 and len(path) <= 3:
                s = score * c * (0.85 if len(path) > 1 else 1)
                if len(path) > 1:
                    found.append((s, ">".join([*path, b])))
                walk([*path, b], s)

    walk(["n1"], 1.0)
    want = sorted(((-s, p) for s, p in found))[:10]
    got = [(-r["score"], r["path"]) for r in graph.explore(df, ["n1"]).collect()]
    assert [p for _, p in got] == [p for _, p in want] or np.allclose([s for s, _ in got], [s for s, _ in want])

    out, ids = defaultdict(set), {x for a, _, b, _ in t for x in (a, b)}
    for a, _, b, _ in t:
        out[a].add(b)
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(3):
        rank = {n: 0.15 / len(ids) + 0.85 * sum(rank[a] / len(out[a]) for a in out if n in out[a]) for n in ids}
    assert {r["id"]: pytest.approx(r["r"]) for r in graph.pagerank(df, 3).collect()} == rank


# ----------------------------------------------------------------- diversity
def test_mmr(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(12, 4))
    got = [r["id"] for r in vectors.mmr(spark.createDataFrame([(1, i, i + 1, x.tolist()) for i, x in enumerate(v)], "query_id long, id long, rank int, v array<double>")).orderBy("rank").collect()]
    u, chosen, left = v / np.linalg.norm(v, axis=1, keepdims=True), [0], list(range(1, 12))
    while left:
        best = max(left, key=lambda i: (1 / (i + 1) - 0.3 * max(float(u[c] @ u[i]) for c in chosen), -i))
        chosen.append(best)
        left.remove(best)
    assert got == chosen


# ----------------------------------------------------------------- cards, spans, phrases
def test_cards_are_admitted(spark):
    rnd = random.Random(8)
    cards = sorted((rnd.randint(0, 3), i, rnd.randint(0, 5), round(rnd.random(), 2), rnd.randint(0, 9000)) for i in range(300))
    df = spark.createDataFrame(cards, "host int, id long, target_id long, score double, seen_at long")
    want = set()
    for host in range(4):
        last, shown = {}, []
        for at, i, target, score in sorted((c[4], c[1], c[2], c[3]) for c in cards if c[0] == host):
            if score >= 0.18 and at - last.get(target, -10**9) >= 1800 and sum(s > at - 3600 for s in shown) < 8:
                last[target] = at
                shown.append(at)
                want.add(i)
    assert {r["id"] for r in intent.admit(df, "host").collect()} == want


def test_mined_phrases(spark):
    docs = [(1, "I need to call Bo today. So I should rest"), (2, "Nothing here."), (3, "remind me to"), (4, None), (5, "I'll try to go, I think Bo settled on it!\nfoo i'll"), (6, "wei must not. They plan to; he plans to")]
    got = sorted((r.id, r.at, r.phrase, r.kind, r.start, r.statement, round(r.confidence, 6)) for r in intent.mine(spark.createDataFrame(docs, "id long, text string"), "id", "text").collect())
    assert got == [
        (1, 0, "i need to", "intent", 0, "I need to call Bo today", 0.75), (1, 1, "i should", "intent", 4, "I should rest", 0.55), (3, 0, "remind me to", "intent", 0, "remind me to", 0.8),
        (5, 0, "i'll try to", "intent", 0, "I'll try to go, I think Bo settled on it", 0.65), (5, 2, "i'll", "intent", 4, "i'll", 0.6), (6, 1, "they plan to", "intent", 1, "They plan to; he plans to", 0.55),
    ]


def test_model_spans(spark):
    hits = [(1, 0, 5, "a", 0.9), (1, 3, 4, "b", 0.95), (1, 10, 2, "c", 0.3), (1, 11, 2, "d", 0.2), (2, 0, 3, "e", 0.5), (2, 0, 4, "f", 0.5)]
    got = ingest.greedy_spans(spark.createDataFrame(hits, "doc long, start int, length int, label string, score double")).collect()
    assert sorted((r["doc"], r["label"]) for r in got) == [(1, "b"), (1, "c"), (2, "f")]


def test_label_terms(spark):
    df = spark.createDataFrame([(1, "The red Widget of 2024 memory engine")], "id long, text string")
    assert df.select(X.label_terms(F.col("text")).alias("t")).first()["t"] == ["red", "widget", "memory", "engine", "red widget", "memory engine"]


def test_keyphrases_without_stop_words(spark):
    df = spark.createDataFrame([(1, "Machine learning explored machine learning, the end"), (2, "a b"), (3, None), (4, "")], "id long, text string")
    got = [(r["phrase"], round(r["score"], 4)) for r in X.keyphrases(df, "id", "text").collect()]
    assert ("machine learning", 3.0) in got and not any("the" in p.split() for p, _ in got)
    assert ("machine learning explored", 2.0) not in got


# ----------------------------------------------------------------- models and policies
@pytest.mark.parametrize("hidden", [0, 5])
def test_outcome_model(spark, hidden):
    """Chances in the plan are those of numpy, the model beats a uniform one, and contributions add up to a linear score."""
    rnd = random.Random(1)
    rows = []
    for i in range(300):
        a, b = rnd.randint(0, 1), rnd.randint(0, 1)
        rows.append((i, [float(a), float(b)], (1 if a else -1) if rnd.random() < 0.9 else 0, i % 5 == 0))
    df = spark.createDataFrame(rows, "id long, x array<double>, polarity int, held boolean")
    m = learning.OutcomeModel(hidden=hidden).fit(df)
    x = np.array([r[1] for r in rows])
    got = np.array([r["c"] for r in df.orderBy("id").select(m.chances(F.col("x")).alias("c")).collect()])
    assert np.allclose(got, m._layers(x)[-1]) and np.allclose(got.sum(1), 1)
    s = learning.scored(df, m.chances(F.col("x"))).first()
    assert s["loss"] < math.log(3) and s["accuracy"] > 0.8 and m.report["held"] == 60
    if not hidden:
        assert sum(p for _, p in m.contributions([1.0, 1.0], 1)) + m.layers[0][-1, 2] == pytest.approx(float((np.array([1.0, 1.0, 1.0]) @ m.layers[0])[2]))
    few = learning.OutcomeModel().fit(df.limit(3))
    assert few.layers == [] and few.contributions([1.0], 1) == []


def test_split(spark):
    df = spark.createDataFrame([(i,) for i in range(1000)], "id long")
    held = learning.split(df).filter("held").count()
    assert 130 < held < 270 and learning.split(df.limit(8)).filter("held").count() == 0


def test_policy_search():
    """The search climbs to a policy with more weight on recency, which the scorer rewards, and stops where nothing rises."""
    calls = []

    def scorer(p):
        calls.append(p.fingerprint())
        return policy.normalised(p.weights)["recency"], "ranked_low"

    rounds = policy.optimize(policy.Policy(), scorer, rounds=4)
    accepted = [r.mean for r in rounds if r.accepted]
    assert accepted == sorted(accepted) and accepted[-1] > accepted[0] and len(calls) == len(set(calls))
    assert policy.dominant_diagnosis(rounds) == "ranked_low" and policy.dominant_diagnosis([]) is None
    flat = policy.optimize(policy.Policy(), lambda p: (1.0, "mixed"))
    assert sum(r.accepted for r in flat) == 1
    a, b = policy.Policy(), policy.Policy(weights={"text": 1.0}, floor=0.35, multiplier=8)
    assert a.merge(b).floor == pytest.approx(0.25) and a.merge(b).multiplier == 6 and sum(a.merge(b).weights.values()) == pytest.approx(1)


# ----------------------------------------------------------------- stores and beliefs
def test_change_and_decide(spark):
    t = spark.createDataFrame([(1, "pending", 1), (2, "done", 2), (2, "done", 2), (None, "pending", 3)], "id long, status string, n int")
    d = spark.createDataFrame([(1, "accepted"), (1, "accepted"), (2, "accepted")], "id long, decided string")
    assert sorted((r["id"] or 0, r["status"]) for r in store.decide(t, d, "id").collect()) == [(0, "pending"), (1, "accepted"), (2, "done"), (2, "done")]
    changed = store.change(t, spark.createDataFrame([(2, 9), (2, 7)], "id long, n int"), ["id"])
    assert sorted((r["id"] or 0, r["n"]) for r in changed.collect()) == [(0, 3), (1, 1), (2, 9), (2, 9)]


def test_tombstones_and_versions(spark):
    log = spark.createDataFrame([("a", 1, 1, False), ("a", 2, 2, True), ("b", 1, 3, False)], "k string, v int, seq int, deleted boolean")
    assert [(r["k"], r["v"]) for r in store.current(log, ["k"]).collect()] == [("b", 1)]
    got = store.versioned(log.select("k", F.col("v").alias("version")), spark.createDataFrame([("a",), ("z",)], "k string"), ["k"])
    assert sorted(map(tuple, got.collect())) == [("a", 3), ("z", 1)]


def test_belief_network(spark):
    """Support falls with its premise; a defeat that holds wins."""
    b = spark.createDataFrame([(1, "in"), (2, "out"), (3, "in"), (4, "in")], "id long, status string")
    j = spark.createDataFrame([(1, 2, "support", 1), (2, 3, "support", 2), (3, 4, "defeat", 3), (4, 9, "support", 1), (5, 4, "support", 77)], "jid long, target long, kind string, premise long")
    ok = beliefs.justified(j, b)
    assert sorted({r["jid"] for r in ok.collect()}) == [1, 2, 3]
    state = {r["id"]: r["status"] for r in beliefs.propagate(b, ok).collect()}
    assert state == {1: "in", 2: "in", 3: "in", 4: "out"}


def test_greedy_answers(spark):
    chunks = spark.createDataFrame([(1, "Red cats sleep. Red cats sleep. Dogs run far away!", 0.5), (2, "Red cats sleep now. Birds sing red songs loudly", 0.1)], "id long, text string, score double")
    assert answers.greedy(chunks, "red cats", 0.05, "novelty").first()["answer"].startswith("Red cats sleep.")
    assert answers.greedy(chunks, "red cats", 0.1, "coverage").first()["answer"].count("Red cats sleep") <= 1


# ----------------------------------------------------------------- plans
def test_planner_variants():
    kinds = [v.kind for v in planner.expand("Did Ada's car change since June?")]
    assert kinds[0] == "original" and len(kinds) <= 4
    assert planner.expand("what did it cost")[0].text == "what did it cost"
    assert [v.text for v in planner.expand("is it open, Bob", most=9) if v.kind.startswith("deref")] == ["is Bob open, Bob"]
    assert not planner.should_retrieve("ls") and planner.should_retrieve("who?") and not planner.should_retrieve("where is it now", miss_rate=0.9)
    assert planner.replan_with_context(planner.Plan("analogy"), "no entities").confidence == 0.1


# ----------------------------------------------------------------- streams
def _files(tmp_path, spark, rows, schema, parts):
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("t")).repartition(parts, "id").write.parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in")).schema, str(tmp_path / "in")


def test_token_bucket_and_rest(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 3), t) for i, t in enumerate(sorted(rnd.randint(0, 2000) for _ in range(120)))]
    schema, folder = _files(tmp_path, spark, rows, "id long, k int, t long", 1)
    out = streaming.run_available(streaming.token_bucket(spark.readStream.schema(schema).parquet(folder).select("id", "k", "ts"), "k", "ts", 1.0, 2), "bucket_test")
    want, level, last = {}, defaultdict(lambda: 2.0), {}
    for i, k, t in rows:
        level[k] = min(2.0, level[k] + (t - last.get(k, t)) / 60)
        last[k], want[i] = t, level[k] >= 1
        level[k] -= want[i]
    assert {r["id"]: r["admitted"] for r in out.collect()} == want
    kept = streaming.run_available(streaming.admitted(spark.readStream.schema(schema).parquet(folder).select("id", "k", "ts"), "k", "ts", 100), "rest_test")
    shown, want = {}, set()
    for i, k, t in rows:
        if k not in shown or t - shown[k] >= 100:
            shown[k] = t
            want.add(i)
    assert {r["id"] for r in kept.collect()} == want


def test_two_speeds_and_bounded_batches(spark, tmp_path):
    schema, folder = _files(tmp_path, spark, [(i, i % 4, i) for i in range(60)], "id long, tier int, t long", 6)
    sizes, seen = [], defaultdict(list)
    source = streaming.bounded(spark, schema, folder, 1)

    def take(level):
        def run(batch, _):
            rows = [r["id"] for r in batch.collect()]
            sizes.append(len(rows))
            seen[level] += rows

        return run

    for q in streaming.two_speed(source, "tier", take(2), take(3), str(tmp_path / "state"), once=True):
        q.awaitTermination()
    assert sorted(seen[2]) == [i for i in range(60) if i % 4 == 2] and sorted(seen[3]) == [i for i in range(60) if i % 4 == 3]
    assert len(sizes) > 2 and max(sizes) < 15  # nothing is dropped, nothing comes all at once


def test_expiring_state(spark, tmp_path):
    schema, folder = _files(tmp_path, spark, [(1, 7, 0), (2, 7, 100), (3, 7, 1000), (4, 8, 50)], "id long, k int, t long", 1)
    out = streaming.run_available(streaming.expiring(spark.readStream.schema(schema).parquet(folder).select("id", "k", "ts"), "k", "ts", "300 seconds"), "ttl_test", "complete")
    assert sorted((r["k"], r["n"]) for r in out.collect()) == [(7, 1), (7, 2), (8, 1)]


# ----------------------------------------------------------------- bounds that are no errors
def test_models_beyond_their_sample(spark):
    """More combinations of features than a model is fitted on: an even sample, not an error, and the same however rows are dealt."""
    rows = [([float(i % 97), float(i)], 1 if i % 97 > 48 else -1, i % 5 == 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "x array<double>, polarity int, held boolean")
    one, two = learning.OutcomeModel(most=400, epochs=20).fit(df), learning.OutcomeModel(most=400, epochs=20).fit(df.repartition(7))
    assert one.layers and all(np.allclose(a, b) for a, b in zip(one.layers, two.layers, strict=True))
    words = spark.createDataFrame([(f"w{i}", "ab"[i % 2], "yn"[i % 2]) for i in range(900)], "w string, k string, label string")
    model = learning.SoftmaxModel(most=300, levels=50).fit(words, ["w", "k"], "label")
    assert len(model.values["w"]) == 50
    assert model.transform(words).filter("predicted = label").count() == 900


def test_many_centroids(spark):
    """Centroids in blocks give what one block gives."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))], "id long, v array<double>")
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(25, 4)))], "grp int, centroid array<double>")
    got = [sorted((r.id, r.grp, round(r.score, 9)) for r in vectors.assign(df, c, "id", "v", 0.9, most).collect()) for most in (4096, 4)]
    assert got[0] == got[1] and {g for _, g, _ in got[0]} > {-1}
