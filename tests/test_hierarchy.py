"""Hierarchical density clusters against a plain top-down version over all pairs."""

import random

import numpy as np
import pytest

from kelpwood.operators import graph, hierarchy, neighbours
from kelpwood.operators.hierarchy import LEAST_WEIGHT, condensed_tree, hierarchical_clusters

SCHEMA = "k long, v array<double>"


def plain(points, least, samples, alone=False):
    """id -> label, membership, persistence; by taking edges off from the longest on."""
    ids, x = [i for i, _ in points], np.array([v for _, v in points])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, min(samples, len(x)) - 1] if samples > 1 else np.zeros(len(x))
    m = np.maximum(np.maximum(d, core[:, None]), core)
    grown, tree = [0], []
    while len(grown) < len(x):
        w, a, b = min((m[a, b], a, b) for a in grown for b in range(len(x)) if b not in grown)
        tree.append((w, a, b))
        grown.append(b)
    clusters = []

    def walk(members, edges, parent, w):
        c = len(clusters)
        clusters.append({"parent": parent, "w": w, "n": len(members), "falls": [], "kids": []})
        while True:
            w = max(e[0] for e in edges)
            up = {v: v for v in members}

            def root(v):
                while up[v] != v:
                    v = up[v]
                return v

            edges = [e for e in edges if e[0] < w]
            for _, a, b in edges:
                up[root(a)] = root(b)
            groups = {}
            for v in members:
                groups.setdefault(root(v), []).append(v)
            big = [g for g in groups.values() if len(g) >= least]
            clusters[c]["falls"] += [(v, w) for g in groups.values() if len(g) < least for v in g]
            if len(big) > 1:
                for g in big:
                    clusters[c]["kids"].append(walk(g, [e for e in edges if e[1] in g], c, w))
            if len(big) != 1:
                return c
            members, edges = big[0], [e for e in edges if e[1] in big[0]]
            if not edges:  # copies, or clusters of one
                clusters[c]["falls"] += [(v, w) for v in members]
                return c

    out = {i: (-1, 0.0, 0.0) for i in ids}
    if len(x) < max(2, least):
        return out
    walk(list(range(len(x))), tree, None, None)
    density = lambda w: 1 / max(w, LEAST_WEIGHT)
    most = {}
    for c, t in enumerate(clusters):
        rows = [(density(w), 1) for _, w in t["falls"]] + [(density(clusters[k]["w"]), clusters[k]["n"]) for k in t["kids"]]
        born = density(t["w"]) if t["w"] is not None else 0.0
        t["s"], most[c] = sum(n * (r - born) for r, n in rows), max(r for r, _ in rows)

    def best(c):
        t = clusters[c]
        below = [best(k) for k in t["kids"]]
        value = sum(v for v, _ in below)
        if (t["parent"] is not None or alone) and t["s"] >= value:
            return t["s"], [c]
        return value, [z for _, s in below for z in s]

    def within(c):
        return clusters[c]["falls"] + [f for k in clusters[c]["kids"] for f in within(k)]

    for c in best(0)[1]:
        falls = within(c)
        label = min(ids[v] for v, _ in falls)
        for v, w in falls:
            out[ids[v]] = (label, min(density(w), most[c]) / most[c], clusters[c]["s"] / (len(falls) * max(most.values())))
    return out


def sets(seed):
    rnd = np.random.default_rng(seed)
    blobs = np.concatenate([rnd.normal(c, s, (n, 3)) for c, s, n in [((0, 0, 0), 0.3, 30), ((4, 0, 0), 0.2, 25), ((4, 1.5, 0), 0.2, 12), ((0, 6, 2), 1.0, 20)]] + [rnd.uniform(-3, 8, (12, 3))])
    copies = np.concatenate([blobs[:40], blobs[:8], blobs[:8], np.repeat(blobs[40:41], 9, axis=0)])
    grid = np.array([(i, j, 0.0) for i in range(7) for j in range(6)] + [(20 + i, j / 2, 0.0) for i in range(3) for j in range(5)])
    return {"blobs": blobs, "copies": copies, "grid": grid}


@pytest.mark.parametrize(("name", "rows", "solved", "nearest", "least", "samples", "alone"), [
    ("blobs", 40, 30, 3, 5, 4, False), ("copies", 1024, 200_000, 16, 5, 4, False), ("grid", 1024, 200_000, 3, 5, 4, True),
])
def test_clusters(spark, monkeypatch, name, rows, solved, nearest, least, samples, alone):
    monkeypatch.setattr(neighbours, "ROWS", rows)
    monkeypatch.setattr(hierarchy, "SOLVED", solved)
    monkeypatch.setattr(hierarchy, "NEIGHBOURS", nearest)
    points = [(i * 7 % 1000 + 1, v.tolist()) for i, v in enumerate(sets(3)[name])]
    got = hierarchical_clusters(spark.createDataFrame(points, SCHEMA), "k", "v", least, samples, alone)
    want = plain(points, least, samples, alone)
    rows = {r.id: (r.label, r.membership, r.persistence) for r in got.collect()}
    assert {i: r[0] for i, r in rows.items()} == {i: r[0] for i, r in want.items()}
    assert len({r[0] for r in want.values()}) > 1
    assert all(np.allclose(rows[i], want[i], rtol=1e-6, atol=1e-9) for i in want)


def test_a_dense_region_is_one_cluster(spark, monkeypatch):
    """Two balls of 1,500 points each, far above a block's size, are two clusters."""
    monkeypatch.setattr(neighbours, "ROWS", 256)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 2))
    x = x / np.linalg.norm(x, axis=1)[:, None] * rng.uniform(0, 1, (3000, 1)) ** 0.5 + np.arange(3000)[:, None] % 2 * 5
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = hierarchical_clusters(frame, "k", "v", least_members=600, samples=5).collect()
    assert {r.label for r in got} <= {-1, min(r.id for r in got if r.label >= 0 and r.id % 2 == 0), min(r.id for r in got if r.label >= 0 and r.id % 2)}
    assert all(sum(r.label >= 0 for r in got if r.id % 2 == side) > 1450 for side in (0, 1))


def test_nearest_and_groups(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 16)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(90, 5)), rng.normal(size=(30, 5)) * 0.05 + [3, 0, 0, 0, 0]])
    x = np.concatenate([x, x[:5]])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 5), (None, [1.0] * 5)], SCHEMA)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    d = np.sqrt(((u[:, None] - u[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {r.id: r for r in neighbours.k_nearest(frame, "k", "v", 4).collect()}
    assert sorted(got) == list(range(len(x)))
    assert all(np.allclose(got[i].d, np.sort(d[i])[:4], atol=1e-9) and np.allclose(d[i, got[i].nbr], got[i].d, atol=1e-9) for i in got)
    for least in (0.6, 0.9):
        up = list(range(len(x)))
        for i in range(len(x)):
            for j in range(i):
                if u[i] @ u[j] >= least and up[i] != up[j]:
                    up = [min(up[i], up[j]) if k in (up[i], up[j]) else k for k in up]
        label = {r.id: r.label for r in neighbours.like_groups(frame, "k", "v", least).collect()}
        assert label == dict(enumerate(up)) | {500: 500, 501: 501, None: None}


def test_odd_rows(spark):
    points = [(i, [float(i % 2) * 9 + i / 100, 0.0]) for i in range(20)]
    odd = [(50, None), (51, []), (52, [float("nan"), 1.0]), (53, [1.0]), (None, [0.0, 0.0]), (54, [None, 1.0]), (3, [0.5, 0.5])]
    frame = spark.createDataFrame(points + odd, SCHEMA)
    rows = hierarchical_clusters(frame, "k", "v", 4, 3).collect()
    assert len(rows) == 27 and {r.label for r in rows if r.id is None or r.id >= 50} == {-1}
    want = plain([(i, min(v, [0.5, 0.5]) if i == 3 else v) for i, v in points], 4, 3)
    assert all((r.label, round(r.membership, 9)) == (want[r.id][0], round(want[r.id][1], 9)) for r in rows if r.id is not None and r.id < 20)
    assert hierarchical_clusters(frame.limit(0), "k", "v").isEmpty()
    assert {r.label for r in hierarchical_clusters(frame.filter("k < 3"), "k", "v", 4, 3).collect()} == {-1}


def test_parts_of_a_tree_give_the_whole(spark, monkeypatch):
    """A long chain: the condensed tree is the same however its edges are dealt into parts."""
    rnd = random.Random(4)
    edges = [(i, i + 1, float(rnd.choice([1, 2, 3, 5, 8, 13]))) for i in range(400)]
    frame, seen = spark.createDataFrame(edges, "a long, b long, w double"), []
    for most in (10**6, 80):
        monkeypatch.setattr(hierarchy, "SOLVED", most)
        clusters, points = condensed_tree(frame, 4)
        names = {c: min(i for i, k, _ in points.collect() if k == c) for c in {r.c for r in points.collect()}}
        of = {r.c: r for r in clusters.collect()}

        def ends(c):
            return (of[c].w, of[c].n) if of[c].parent is not None else None

        seen.append((sorted((r.id, names[r.c], r.w) for r in points.collect()), sorted((names.get(c, -1), ends(c) or (0, 0)) for c in of)))
    assert seen[0] == seen[1] and len(seen[0][0]) == 401


def test_components_of_a_long_path(spark):
    """A path whose ids are in no order, as a spanning tree's lower half has: more steps from a node to the least one than rounds may be."""
    ids = random.Random(8).sample(range(10**6), 600)
    pairs = [*zip(ids, ids[1:]), (-5, -6)]
    got = {r["id"]: r["label"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == dict.fromkeys(ids, min(ids)) | {-5: -6, -6: -6}


def test_tree_in_parts_along_a_line(spark, monkeypatch):
    """Points of a line, whose tree is a path, in parts of few edges and without the driver's joins: the clusters of the whole."""
    rnd = random.Random(9)
    at = np.cumsum([rnd.choice([1.0, 1.1, 1.2, 5.0]) for _ in range(300)])
    keys = rnd.sample(range(1000), 300)
    df = spark.createDataFrame([(k, [float(x), 0.0]) for k, x in zip(keys, at, strict=True)], SCHEMA)
    run = lambda: sorted(tuple(r) for r in hierarchical_clusters(df, "k", "v", 5, 3).collect())
    want = run()
    monkeypatch.setattr(hierarchy, "SOLVED", 100)
    monkeypatch.setattr(hierarchy, "FEW", 0)
    got = run()
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2:] for r in got], [r[2:] for r in want])
