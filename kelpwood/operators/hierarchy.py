"""Hierarchical density clustering of all vectors (HDBSCAN), exact, without a bound on the size of a region.

1. An exact k-nearest join (``neighbours``) gives core distances.
2. The minimum spanning tree of mutual reachability grows by Boruvka's rounds. The edges of the join answer for most components; where an edge beyond
   the k nearest could be shorter than a component's best, the pairs of blocks that can hold it are searched.
3. The tree's edges are halved by weight until each part fits a task: what the lower half connects is a part of its own, and one vertex of the upper
   part. Each part yields its share of the condensed tree, bottom up; edges of equal weight merge at once, so the result doesn't depend on the tree.
4. The clusters of greatest stability are chosen along heavy paths: with l the values of the light children, v[i] = max(s[i], l[i] + v[i - 1]) is a running
   sum and a running maximum, so a chain of clusters is a window and the rounds are as many as a path has light edges.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed, components
from .neighbours import by_block, dealt, distances, met, nearest, packed, unpacked

NEIGHBOURS = 16
SOLVED = 200_000  # edges that a task takes at once
LEAST_WEIGHT = 1e-12  # the distance that copies count as
FEW = 10_000  # links that the driver joins by itself
EDGE = "a long, b long, w double, ca long, cb long"


# ----------------------------------------------------------------- the spanning tree
def _shortest_rows(batches):
    """For each component of a block its shortest edge of mutual reachability to another component, in the blocks that it meets."""
    for rows in by_block(batches):
        low = None
        for row in rows:
            (ids, x), (ids2, y) = unpacked(row), unpacked(row, "2")
            core, core2 = (np.frombuffer(row[c], np.float64) for c in ("core", "core2"))
            comp, comp2 = (np.frombuffer(row[c], np.int64) for c in ("comp", "comp2"))
            if low is None:
                low, at, other = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            m = np.maximum(np.maximum(distances(x, y), core[:, None]), core2)
            m[comp[:, None] == comp2] = np.inf
            j = m.argmin(axis=1)
            i = np.flatnonzero(np.isfinite(m[np.arange(len(ids)), j]))
            j = j[i]
            w = np.maximum(np.maximum(np.sqrt(((x[i] - y[j]) ** 2).sum(1)), core[i]), core2[j])
            less = (w < low[i]) | (w == low[i]) & (ids2[j] < at[i])
            i, j = i[less], j[less]
            low[i], at[i], other[i] = w[less], ids2[j], comp2[j]
        order = np.lexsort((ids, low, comp))
        first = order[np.concatenate([[True], np.diff(comp[order]) != 0])]
        first = first[np.isfinite(low[first])]
        yield pa.RecordBatch.from_arrays([pa.array(c[first]) for c in (ids, at, low, comp, other)], ["a", "b", "w", "ca", "cb"])


def _marked(points: DataFrame) -> DataFrame:
    """block, core, comp of a block's points in the order of their ids."""

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        raw = [pa.array([t.column(c).to_numpy().astype(kind).tobytes()], pa.binary()) for c, kind in (("core", np.float64), ("comp", np.int64))]
        return pa.table([t.column("block")[:1], *raw], ["block", "core", "comp"])

    return points.select("block", "id", "core", "comp").groupBy("block").applyInArrow(one, "block long, core binary, comp binary")


def _searched(points: DataFrame, blocks: DataFrame, best: DataFrame, apart: np.ndarray, radius: np.ndarray) -> DataFrame | None:
    """Edges among which each component's shortest is, where one beyond the nearest neighbours could be shorter than its ``best``; none if none could."""
    open_ = points.join(best.select(F.col("c").alias("comp"), F.col("e.w").alias("bw")), "comp", "left").withColumn("bw", F.coalesce("bw", F.lit(float("inf"))))
    seen = open_.groupBy("cell").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("core").alias("core"), F.max(F.when(F.col("least") < F.col("bw"), F.col("bw"))).alias("need")).collect()
    if all(r.need is None for r in seen):
        return None
    size = len(apart)
    low, high, core, need = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.full(size, -1.0)
    there = np.zeros(size, bool)
    for r in seen:
        low[r.cell], high[r.cell], core[r.cell], there[r.cell] = r.low, r.high, r.core, True
        need[r.cell] = -1.0 if r.need is None else r.need
    mixed = low != high
    other = there[:, None] & there & (mixed[:, None] | mixed | (low[:, None] != low))
    bound = np.maximum(np.maximum(apart + radius[:, None] + radius, core[:, None]), core)
    foreign = np.where(other & (mixed | (low[:, None] != low)), bound, np.inf)
    np.fill_diagonal(foreign, np.where(mixed, np.maximum(2 * radius, core), np.inf))
    # a mixed cell offers a point of another component to all of its own; a cell of one component is offered those of others
    enough = np.where(mixed, np.diag(foreign), foreign.min(axis=1))
    need = np.minimum(need, enough) * (1 + 1e-9)
    wanted = other & (np.maximum(apart - radius[:, None] - radius, 0) <= np.maximum(need[:, None], need))
    some = [int(c) for c in np.flatnonzero((wanted | wanted.T).any(axis=1))]
    marked = checkpointed(blocks.filter(F.col("cell").isin(some)).join(_marked(points), "block").select(*blocks.columns, "core", "comp"))
    found = met(marked, wanted).mapInArrow(_shortest_rows, EDGE)
    return checkpointed(_shortest(found).select("e.*").distinct())


def _labels(links: DataFrame) -> DataFrame:
    """id, label (least reachable id) of the ends of links a, b; the last rounds, which have few links, don't need jobs for that."""
    rows = links.select("a", "b").limit(FEW + 1).collect()
    if len(rows) > FEW:
        return components(links)
    up: dict = {}

    def root(v):
        while up.setdefault(v, v) != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for a, b in rows:
        low, high = sorted((root(a), root(b)))
        up[high] = low
    kind = links.schema["a"].dataType.simpleString()
    return links.sparkSession.createDataFrame([(v, root(v)) for v in list(up)], f"id {kind}, label {kind}")


def _shortest(edges: DataFrame) -> DataFrame:
    """c, e: each component's shortest edge, ties by its ends."""
    one = F.struct("w", "a", "b", "ca", "cb").alias("e")
    ends = edges.select(F.col("ca").alias("c"), one).unionByName(edges.select(F.col("cb").alias("c"), one))
    return ends.groupBy("c").agg(F.min("e").alias("e"))


def spanning_tree(points: DataFrame, blocks: DataFrame, apart: np.ndarray, radius: np.ndarray, edges: DataFrame) -> DataFrame:
    """a, b, w of a minimum spanning tree. ``points``: id, cell, block, core, least (an unlisted edge is at least so long), and their ``packed`` blocks; ``edges``: a < b, w."""
    points = points.withColumn("comp", F.col("id"))
    edges = edges.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb"))
    tree = None
    while True:
        best = checkpointed(_shortest(edges))
        more = _searched(points, blocks, best, apart, radius)
        if more is not None:
            edges = edges.unionByName(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w", F.when(F.col("a") < F.col("b"), F.col("ca")).otherwise(F.col("cb")).alias("ca"), F.when(F.col("a") < F.col("b"), F.col("cb")).otherwise(F.col("ca")).alias("cb"))).distinct()
            best = checkpointed(_shortest(edges))
        chosen = checkpointed(best.select("e.*").distinct())
        tree = chosen.select("a", "b", "w") if tree is None else checkpointed(tree.unionByName(chosen.select("a", "b", "w")))
        label = _labels(chosen.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        if label.select("label").distinct().limit(2).count() < 2:
            return tree
        to = lambda c: label.select(F.col("id").alias(c), F.col("label").alias("new"))
        for c in ("ca", "cb"):
            edges = edges.join(to(c), c).drop(c).withColumnRenamed("new", c)
        edges = checkpointed(edges.filter("ca <> cb").select("a", "b", "w", "ca", "cb"))
        points = checkpointed(points.join(to("comp"), "comp").drop("comp").withColumnRenamed("new", "comp"))


# ----------------------------------------------------------------- the condensed tree
def _condense(edges: pd.DataFrame, least: int) -> pd.DataFrame:
    """One part's share of the condensed tree: rows of kind c (cluster, its parent, weight where it ends, members), v (vertex, cluster it is in, weight) and t (part, its last cluster)."""
    part, out, made = edges["part"].iloc[0], [], 0
    up, size, cluster, held = {}, {}, {}, {}
    for end, n in (("a", "na"), ("b", "nb")):
        for v, k in zip(edges[end], edges[n], strict=True):
            up[v], size[v], cluster[v], held[v] = v, k, ("@" + v if k >= least else None), ([v] if k < least else [])

    def root(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for w, batch in edges.sort_values("w", kind="stable").groupby("w", sort=False):
        groups, first = defaultdict(set), {}
        for a, b in zip(batch["a"], batch["b"], strict=True):
            ra, rb = root(a), root(b)
            for r in (ra, rb):
                first.setdefault(r, {r})
            if ra == rb:
                continue
            if len(first[ra]) < len(first[rb]):
                ra, rb = rb, ra
            up[rb] = ra
            first[ra] |= first.pop(rb)
        groups = {r: m for r, m in first.items() if len(m) > 1}
        for r, were in groups.items():
            big = sorted(x for x in were if cluster[x] is not None)
            total = sum(size[x] for x in were)
            small = [v for x in were if cluster[x] is None for v in held[x]]
            name = cluster[big[0]] if len(big) == 1 else None
            if len(big) > 1 or (not big and total >= least):
                name, made = f"{part}#{made}", made + 1
                out += [("c", cluster[x], name, w, size[x]) for x in big]
            if name is not None:
                out += [("v", v, name, w, 0) for v in small]
                small = []
            size[r], cluster[r], held[r] = total, name, small
    last = cluster[root(edges["a"].iloc[0])]
    return pd.DataFrame([*out, ("t", part, last, 0.0, 0)], columns=["kind", "of", "cluster", "w", "n"])


def condensed_tree(tree: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Clusters (c, parent or null, w, n) and points (id, c, w): the weight at which each leaves its cluster; points of a tree of fewer than ``least`` are in none."""
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string")).alias(c)
    rest = tree.select(F.lit("0").alias("part"), name("a"), name("b"), "w", F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb"))
    done, inside, level = [], [], 0
    while True:
        rest = checkpointed(rest)
        parts = rest.groupBy("part").agg(F.count("*").alias("n"), F.percentile_approx("w", 0.5).alias("mid"), F.min("w").alias("lo"), F.max("w").alias("hi"))
        parts = checkpointed(parts.withColumn("whole", (F.col("n") <= SOLVED) | (F.col("lo") == F.col("hi"))))
        met = rest.join(parts.select("part", "whole", "mid", "hi"), "part")
        done.append(met.filter("whole").select(*rest.columns))
        if parts.filter("not whole").isEmpty():
            break
        # equal weights stay together; where the middle is the greatest weight, what is below it goes
        split = checkpointed(met.filter("not whole").withColumn("lower", F.when(F.col("mid") < F.col("hi"), F.col("w") <= F.col("mid")).otherwise(F.col("w") < F.col("hi"))).select(*rest.columns, "lower"))
        below, above = split.filter("lower"), split.filter("not lower")
        label = _labels(below.select("a", "b")).select("id", F.concat(F.lit(f"{level}:"), "label").alias("label"))
        sizes = below.select(F.col("a").alias("id"), F.col("na").alias("n")).unionByName(below.select(F.col("b").alias("id"), F.col("nb").alias("n"))).distinct()
        label = checkpointed(label.join(sizes, "id"))
        total = checkpointed(label.groupBy("label").agg(F.sum("n").alias("total")))
        inside.append(label.select("id", "label"))
        low = below.join(label.select(F.col("id").alias("a"), "label"), "a").select(F.col("label").alias("part"), "a", "b", "w", "na", "nb")
        for end, n in (("a", "na"), ("b", "nb")):
            of = label.join(total, "label").select(F.col("id").alias(end), F.col("label").alias("new"), "total")
            above = above.join(of, end, "left").withColumn(end, F.coalesce("new", end)).withColumn(n, F.coalesce("total", n)).drop("new", "total")
        rest, level = low.unionByName(above.select(*low.columns)), level + 1
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    share = checkpointed(every.groupBy("part").applyInPandas(lambda e: _condense(e, least), "kind string, of string, cluster string, w double, n long"))
    # "@part" stands for a part's last cluster; a part takes at most one such step for each level
    last = share.filter("kind = 't' and cluster is not null").select(F.concat(F.lit("@"), "of").alias("sign"), F.col("cluster").alias("to"))
    for _ in range(level):
        further = last.select(F.col("sign").alias("to"), F.col("to").alias("next"))
        last = checkpointed(last.join(further, "to", "left").select("sign", F.coalesce("next", "to").alias("to")))
    told = lambda df, c: df.join(last.select(F.col("sign").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to") if level else df
    grown = told(told(share.filter("kind = 'c'").select(F.col("of").alias("c"), F.col("cluster").alias("parent"), "w", "n"), "c"), "parent")
    left = told(share.filter("kind = 'v'").select(F.col("of").alias("v"), F.col("cluster").alias("c"), "w"), "c")
    for label in reversed(inside):  # what leaves as one vertex is all that it stands for
        left = left.join(label.select(F.col("label").alias("v"), F.col("id").alias("each")), "v", "left").withColumn("v", F.coalesce("each", "v")).drop("each")
    points = checkpointed(left.select(F.substring("v", 2, 30).cast("long").alias("id"), "c", "w"))
    names = points.select("c").unionByName(grown.select("c")).unionByName(grown.select(F.col("parent").alias("c"))).distinct()
    return checkpointed(names.join(grown, "c", "left").select("c", "parent", "w", "n")), points


# ----------------------------------------------------------------- choice of clusters
def _chosen(clusters: DataFrame, alone: bool) -> DataFrame:
    """c, chosen: of each cluster (c, parent, n, s) the chosen cluster that it is in, if any."""
    s = F.when(F.col("parent").isNotNull() | F.lit(alone), F.col("s")).otherwise(F.lit(-1.0))
    kids = clusters.filter("parent is not null")
    heavy = kids.groupBy("parent").agg(F.max(F.struct("n", "c")).alias("m")).select("parent", F.col("m.c").alias("c"))
    path = _labels(heavy.select(F.col("c").alias("a"), F.col("parent").alias("b")))
    rows = clusters.select("c", "parent", F.coalesce("n", F.lit(1 << 62)).alias("n"), s.alias("s")).join(path.withColumnRenamed("id", "c"), "c", "left")
    rows = checkpointed(rows.select("c", "parent", "n", "s", F.coalesce("label", "c").alias("path")))
    # a path hangs from the parent of its top
    top = rows.groupBy("path").agg(F.max_by(F.struct("c", "parent"), "n").alias("t")).select("path", F.col("t.c").alias("c"), F.col("t.parent").alias("at"))
    hung = checkpointed(top.join(rows.select(F.col("c").alias("at"), F.col("path").alias("over")), "at", "left").select("path", "c", "at", "over"))
    up, down = Window.partitionBy("path").orderBy("n"), Window.partitionBy("path").orderBy(F.desc("n"))
    todo, value, known = hung, None, None
    while not todo.isEmpty():
        ready = checkpointed(todo.join(todo.select(F.col("over").alias("path")).filter("path is not null").distinct(), "path", "left_anti"))
        some = rows.join(ready.select("path"), "path", "left_semi")
        light = F.lit(0.0)
        if value is not None:
            some = some.join(value.groupBy(F.col("at").alias("c")).agg(F.sum("v").alias("l")), "c", "left")
            light = F.coalesce("l", F.lit(0.0))
        some = some.withColumn("l", light).withColumn("sum", F.sum("l").over(up))
        some = some.withColumn("v", F.col("sum") + F.max(F.col("s") - F.col("sum")).over(up))
        some = checkpointed(some.withColumn("own", F.col("s") >= F.col("l") + F.coalesce(F.lag("v").over(up), F.lit(0.0))).select("c", "path", "n", "v", "own"))
        known = some if known is None else known.unionByName(some)
        more = ready.join(some.select("c", "v"), "c").select("at", "v")
        value = checkpointed(more if value is None else value.unionByName(more))
        todo = checkpointed(todo.join(ready.select("path"), "path", "left_anti"))
    own = checkpointed(known.withColumn("chosen", F.first(F.when(F.col("own"), F.col("c")), ignorenulls=True).over(down)).select("c", "path", "chosen"))
    # what is chosen above a path's place takes all of it
    above = checkpointed(hung.join(own.select(F.col("c").alias("at"), F.col("chosen").alias("by")), "at", "left").select("path", "over", "by"))
    while True:
        nxt = above.join(above.select(F.col("path").alias("over"), F.col("by").alias("higher"), F.col("over").alias("next")), "over", "left")
        above = checkpointed(nxt.select("path", F.col("next").alias("over"), F.coalesce("higher", "by").alias("by")))
        if above.filter("over is not null").isEmpty():
            break
    return own.join(above.select("path", "by"), "path").select("c", F.coalesce("by", "chosen").alias("chosen"))


def hierarchical_clusters(df: DataFrame, key: str, vector: str, least_members: int = 5, samples: int = 5, alone: bool = False) -> DataFrame:
    """id, label, membership, persistence of each row of ``df`` by Euclidean distance. ``label``: the least id of the cluster, -1 for noise.

    A point's core distance reaches ``samples`` points, itself included. A cluster has ``least_members`` at least; those of greatest excess of mass are chosen,
    the whole only if ``alone`` says so. Membership: how deep in its cluster a point is (0 to 1, noise 0); persistence: the cluster's stability over its
    members times the greatest density (0 to 1, noise 0). Copies count as ``LEAST_WEIGHT`` apart. Rows without an id, and vectors that are null or empty,
    of an uncommon length or with null or non-finite entries, are noise; of several vectors of one id the least counts. Empty table: empty result.
    """
    ids = df.select(F.col(f"`{key}`").cast("long").alias("id"))
    noise = ids.select("id", F.lit(-1).cast("long").alias("label"), F.lit(0.0).alias("membership"), F.lit(0.0).alias("persistence"))
    found = dealt(df, key, vector)
    if found is None:
        return noise
    points, apart, n, radius = found
    if n.sum() < max(2, least_members):
        return noise
    k = int(min(max(samples - 1, NEIGHBOURS), n.sum() - 1))
    blocks = packed(points)
    near = nearest(blocks, k, apart, n, radius)
    core = F.lit(0.0) if samples < 2 else F.get("d", F.lit(min(samples - 1, k) - 1))
    near = checkpointed(near.withColumn("core", core))
    e = near.select(F.col("id").alias("a"), "core", F.explode(F.arrays_zip("nbr", "d")).alias("z")).select("a", "core", F.col("z.nbr").alias("b"), F.col("z.d").alias("d"))
    e = e.join(near.select(F.col("id").alias("b"), F.col("core").alias("core_b")), "b")
    e = checkpointed(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.greatest("core", "core_b", "d").alias("w")).distinct())
    beyond = F.greatest("core", F.element_at("d", -1)) if k < n.sum() - 1 else F.lit(float("inf"))
    points = checkpointed(points.drop("x").join(near.select("id", "core", beyond.alias("least")), "id"))
    clusters, left = condensed_tree(spanning_tree(points, blocks, apart, radius, e), least_members)

    density = lambda w: 1 / F.greatest(w, F.lit(LEAST_WEIGHT))
    born = clusters.select("c", F.coalesce(density(F.col("w")), F.lit(0.0)).alias("born"))
    out = left.groupBy("c").agg(F.sum(density(F.col("w"))).alias("mass"), F.count("*").alias("m"), F.max(density(F.col("w"))).alias("most"))
    kids = clusters.filter("parent is not null").groupBy(F.col("parent").alias("c")).agg(F.sum(F.col("n") * density(F.col("w"))).alias("mass"), F.sum("n").alias("m"), F.max(density(F.col("w"))).alias("most"))
    mass = out.unionByName(kids).groupBy("c").agg(F.sum("mass").alias("mass"), F.sum("m").alias("m"), F.max("most").alias("most"))
    stable = checkpointed(clusters.join(born, "c").join(mass, "c").select("c", "parent", "n", "w", "most", "m", (F.col("mass") - F.col("m") * F.col("born")).alias("s")))
    if stable.isEmpty():
        return noise
    at = checkpointed(_chosen(stable, alone))
    greatest = stable.agg(F.max("most")).first()[0]
    held = left.join(at, "c").filter("chosen is not null").select("id", F.col("chosen").alias("c"), density(F.col("w")).alias("depth"))
    named = held.groupBy("c").agg(F.min("id").alias("label"), F.count("*").alias("members")).join(stable.select("c", "s", "most"), "c")
    named = named.select("c", "label", "most", (F.col("s") / (F.col("members") * F.lit(greatest))).alias("persistence"))
    found = held.join(named, "c").select("id", "label", (F.least("depth", "most") / F.col("most")).alias("membership"), "persistence")
    return ids.join(found, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("membership", "persistence")])
