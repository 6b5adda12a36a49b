"""Interval overlaps, levels of communities and spreading beliefs against plain versions."""

import random
from collections import Counter

import pytest

from kelpwood.operators import beliefs, graph, intervals


@pytest.mark.parametrize("span", [40, 10**6])
def test_overlaps(spark, span):
    rnd = random.Random(span)
    rows = []
    for i in range(160):
        a = rnd.choice([None, *[rnd.randrange(span) for _ in range(7)]])
        b = rnd.choice([None, *[rnd.randrange(span) if a is None else a + rnd.choice([0, 1, 2, 5, span // 4]) - rnd.choice([0, 0, 0, 3]) for _ in range(7)]])
        rows.append((rnd.choice(["x", "x", "y", None]), i // 2 if rnd.random() < 0.3 else i, a, b))
    df = spark.createDataFrame(rows, "k string, value long, start long, stop long")
    before = lambda a, b: a is None or b is None or a < b
    want = Counter((a[0], a[1], b[1]) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and a[1] < b[1] and before(a[2], b[3]) and before(b[2], a[3]))
    assert Counter((r.k, r.value_a, r.value_b) for r in intervals.overlapping(df, ["k"], "value", "start", "stop").collect()) == want
    full = [r for r in rows if r[0] is not None and before(r[2], r[3])]
    counts = sorted(((a[0], a[1], a[2], a[3], sum(a[0] == b[0] and a[1] != b[1] and before(a[2], b[3]) and before(b[2], a[3]) for b in full)) for a in full), key=repr)
    assert sorted(map(tuple, intervals.overlap_counts(df, ["k"], "value", "start", "stop").collect()), key=repr) == counts
    assert intervals.overlapping(df.limit(0), ["k"], "value", "start", "stop").isEmpty()


def quality(edges, label):
    m = sum(w for *_, w in edges)
    k = Counter()
    for a, b, w in edges:
        k[label[a]] += w
        k[label[b]] += w
    return sum(w for a, b, w in edges if label[a] == label[b]) / m - sum((x / (2 * m)) ** 2 for x in k.values())


def test_levels_of_communities(spark):
    """Rings of small cliques: quality rises from level to level, is that of plain Python, and no move of a node or of a whole community of the last level raises it."""
    rnd = random.Random(3)
    edges = [(f"{c:02}{i}", f"{c:02}{j}", 1.0) for c in range(12) for i in range(4) for j in range(i)] + [(f"{c:02}0", f"{(c + 1) % 12:02}1", 0.4) for c in range(12)]
    edges += [(f"{c:02}2", f"{rnd.randrange(12):02}3", 0.3) for c in range(12)]
    edges = [e for e in edges if e[0] != e[1]]
    found = graph.community_levels(spark.createDataFrame(edges, "a string, b string, weight double"), least=1e-12).collect()
    levels = {n: {r.id: r.label for r in found if r.level == n} for n in {r.level for r in found}}
    stated = {r.level: r.quality for r in found}
    assert all(stated[n] == pytest.approx(quality(edges, levels[n])) for n in levels)
    assert [stated[n] for n in sorted(stated)] == sorted(stated.values()) and stated[1] > 0.5
    last = levels[max(levels)]
    assert all(v == min(n for n in last if last[n] == v) for v in last.values())
    for one in set(last.values()):
        for other in set(last.values()):
            assert quality(edges, {n: other if v == one else v for n, v in last.items()}) <= stated[max(levels)] + 1e-9


@pytest.mark.parametrize(("solved", "nodes", "pairs"), [(20, 120, 700), (1 << 19, 120, 700)])
def test_levels_go_on_until_none_adds(spark, monkeypatch, solved, nodes, pairs):
    """A random graph, whose communities are weak: whether blocks of nodes or one task move them, quality is that of plain Python, and no community of the last level has one to join."""
    monkeypatch.setattr(graph, "SOLVED", solved, raising=False)
    rnd = random.Random(5)
    edges = {tuple(sorted(rnd.sample(range(nodes), 2))): rnd.uniform(0.05, 1) for _ in range(pairs)}
    edges = [(f"{a:03}", f"{b:03}", w) for (a, b), w in edges.items()]
    context, group = spark.sparkContext, f"levels {solved}"
    context.setJobGroup(group, group)
    found = graph.community_levels(spark.createDataFrame(edges, "a string, b string, weight double"), least=0.01).collect()
    jobs = len(context.statusTracker().getJobIdsForGroup(group))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert solved < len(edges) or jobs < 60, f"{jobs} jobs for what one task finds"
    levels = {n: {r.id: r.label for r in found if r.level == n} for n in {r.level for r in found}}
    stated = [{r.level: r.quality for r in found}[n] for n in sorted(levels)]
    assert sorted(levels) == list(range(1, len(levels) + 1)) and stated == sorted(stated)
    assert stated == pytest.approx([quality(edges, levels[n]) for n in sorted(levels)])
    last = levels[max(levels)]
    assert len(last) == len({x for e in edges for x in e[:2]}) and all(v == min(n for n in last if last[n] == v) for v in last.values())
    for one in set(last.values()):
        for other in set(last.values()):
            assert quality(edges, {n: other if v == one else v for n, v in last.items()}) <= stated[-1] + 1e-9
    for v in levels[1]:  # what belongs together below does so above
        assert len({last[n] for n in last if levels[1][n] == levels[1][v]}) == 1


def spread(status, justs, roots):
    """Rounds of plain Python: what leans on what changed is judged by the statuses before; each belief passes changes on once."""
    status, passed, moved = dict(status), Counter(roots), set(roots)
    while moved:
        new = {}
        for t in {j["target"] for j in justs.values() if moved & set(j["premises"])} & set(status):
            holds = [j["kind"] for j in justs.values() if j["target"] == t and all(p is None or status.get(p) == "in" for p in j["premises"])]
            verdict = "out" if "defeat" in holds or "support" not in holds else "in"
            if verdict != status[t]:
                new[t] = verdict
        status |= new
        moved = {t for t in new if passed[t] < 1}
        passed.update(moved)
    return status


@pytest.mark.parametrize("seed", [1, 2])
def test_beliefs_spread(spark, seed):
    rnd = random.Random(seed)
    status = {i: rnd.choice(["in", "in", "out", "contradicted"]) for i in range(40)}
    justs = {i: {"target": rnd.randrange(43), "kind": rnd.choice(["support", "support", "defeat"]), "premises": [rnd.choice([rnd.randrange(43)] * 9 + [None]) for _ in range(rnd.randint(1, 3))]} for i in range(60)}
    roots = rnd.sample(range(40), 5)
    for r in roots:
        status[r] = "out"
    b = spark.createDataFrame(list(status.items()), "id long, status string")
    j = spark.createDataFrame([(i, x["target"], x["kind"], p) for i, x in justs.items() for p in x["premises"]], "jid long, target long, kind string, premise long")
    got = beliefs.propagate(b, j, spark.createDataFrame([(r,) for r in roots], "id long"))
    assert {r.id: r.status for r in got.collect()} == spread(status, justs, roots)
