"""Graph traversal, ranking, components, communities, structural likeness and salience over edge lists.

Every iteration writes its round to the shared folder, so a plan never grows with the number of rounds and a lost executor costs one round.
"""

from __future__ import annotations

import tempfile
import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import moves

SOLVED = 1 << 19  # nodes and edges (in both directions) of a graph that a task takes at once


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir (a temporary one only where a local session names none)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='kelpwood-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kelpwood/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def undirected(triples: DataFrame) -> DataFrame:
    e = triples.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b")).filter("a <> b")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def k_hop(triples: DataFrame, seed: str, hops: int) -> DataFrame:
    """Nodes within ``hops`` of the seed, with their distance; the seed itself is left out."""
    e = checkpointed(undirected(triples))
    seen = last = checkpointed(e.filter(F.col("a") == seed).limit(1).select(F.col("a").alias("id"), F.lit(0).alias("hop")))
    for h in range(1, hops + 1):
        near = e.join(last.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        last = checkpointed(near.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(h)))
        seen = seen.unionByName(last)
    return seen.filter("hop > 0")


def _steps(triples: DataFrame, least: float) -> DataFrame:
    t = triples.filter((F.col("predicate") != "related_to") & (F.col("confidence") >= least))
    return t.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b"), "confidence")


def _longer(path: DataFrame, t: DataFrame, hop: int) -> DataFrame:
    path = path.join(t, F.col("at") == F.col("a")).filter(~F.array_contains("nodes", F.col("b")))
    score = F.col("score") * F.col("confidence") * 0.85
    return path.select(F.concat("nodes", F.array("b")).alias("nodes"), F.col("b").alias("at"), score.alias("score"), F.lit(hop).alias("hops"))


def chains(triples: DataFrame, start: str, end: str, hops: int = 4, least: float = 0.1, best: int = 10) -> DataFrame:
    """The ``best`` simple directed paths by product of confidences and 0.85 for each further hop.

    A path that can no longer come among the best that are found (each hop multiplies its score by 0.85 at most) isn't followed.
    """
    t = checkpointed(_steps(triples, least))
    path = t.filter(F.col("a") == start).select(F.array("a", "b").alias("nodes"), F.col("b").alias("at"), F.col("confidence").alias("score"), F.lit(1).alias("hops"))
    path = checkpointed(path)
    found = path.filter(F.col("at") == end)
    for h in range(2, hops + 1):
        top = found.orderBy(F.desc("score")).limit(best).agg(F.when(F.count("*") == best, F.min("score")).otherwise(0.0).alias("floor"))
        alive = path.filter(F.col("at") != end).join(F.broadcast(top)).filter(F.col("score") * 0.85 >= F.col("floor")).drop("floor")
        path = checkpointed(_longer(alive, t, h))
        found = found.unionByName(path.filter(F.col("at") == end))
    return found.select(F.array_join("nodes", ">").alias("path"), "score", "hops").orderBy(F.desc("score"), "path").limit(best)


def explore(triples: DataFrame, seeds: list[str], hops: int = 3, least: float = 0.1, best: int = 10) -> DataFrame:
    """The ``best`` simple directed paths of two edges or more from any seed: path, score, hops.

    As scores only fall along a path, each round keeps what can still reach the tenth best so far.
    """
    t = checkpointed(_steps(triples, least))
    path = checkpointed(t.filter(F.col("a").isin(*seeds)).select(F.array("a", "b").alias("nodes"), F.col("b").alias("at"), F.col("confidence").alias("score"), F.lit(1).alias("hops")))
    found = None
    for h in range(2, hops + 1):
        if found is not None:
            top = found.orderBy(F.desc("score")).limit(best).agg(F.when(F.count("*") == best, F.min("score")).otherwise(0.0).alias("floor"))
            path = path.join(F.broadcast(top)).filter(F.col("score") * 0.85 >= F.col("floor")).drop("floor")
        path = checkpointed(_longer(path, t, h))
        found = path if found is None else found.unionByName(path)
    return found.select(F.array_join("nodes", ">").alias("path"), "score", "hops").orderBy(F.desc("score"), "path").limit(best)


def pagerank(triples: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """Fixed rounds; nodes without out-edges give nothing on."""
    e = triples.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b")).distinct()
    e = checkpointed(e.join(e.groupBy("a").agg(F.count("*").alias("d")), "a"))
    nodes = checkpointed(e.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    n = max(nodes.count(), 1)
    rank = nodes.withColumn("r", F.lit(1.0 / n))
    for _ in range(rounds):
        got = e.join(rank.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.sum(F.col("r") / F.col("d")).alias("in"))
        rank = checkpointed(nodes.join(got, "id", "left").select("id", (F.lit((1 - damping) / n) + damping * F.coalesce("in", F.lit(0.0))).alias("r")))
    return rank


def _spread(edges: DataFrame) -> DataFrame:
    """id, label (least reachable id) by label propagation with jumps over labels; written out every round.

    What a node sees at its neighbours is told to the node that its label names, and all of that label take it from there: so a group joins another one as a whole,
    and rounds grow with the logarithm of a path's length. Labels only fall, so there is a last round.
    """
    e = checkpointed(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = checkpointed(e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")))
    while True:
        near = e.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        low = label.join(near, "id").select("id", "label", F.least("label", "m").alias("new"))
        told = low.select("id", "new").unionByName(low.select(F.col("label").alias("id"), "new")).groupBy("id").agg(F.min("new").alias("new"))
        nxt = checkpointed(label.join(told.withColumnRenamed("id", "label"), "label").select("id", F.col("new").alias("label"), (F.col("label") != F.col("new")).alias("moved")))
        settled = nxt.filter("moved").isEmpty()
        label = nxt.select("id", "label")
        if settled:
            return label


def components(edges: DataFrame) -> DataFrame:
    """Least reachable id of every node.

    Labels spread along two edges of each node first (to its least and its greatest neighbour), so rounds move rows of nodes, not of edges. Of the other edges
    only those with an end outside the largest group can link groups that are found; they are edges of groups, of which there are half as many at most.
    """
    e = checkpointed(edges.select("a", "b").filter("a is not null and b is not null"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = checkpointed(both.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")))
    label = _spread(ends.select("a", F.explode(F.array("low", "high")).alias("b")))
    top = label.groupBy("label").count().orderBy(F.desc("count"), "label").first()
    rest = label.filter(F.col("label") != F.lit(top.label)) if top else label
    if rest.isEmpty():
        return label
    # an edge within the largest group has both ends there
    out = checkpointed(rest)
    far = out.select(F.col("id").alias("a"), F.col("label").alias("la")), out.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    cross = e.join(far[0], "a", "left").join(far[1], "b", "left").select(F.coalesce("la", F.lit(top.label)).alias("a"), F.coalesce("lb", F.lit(top.label)).alias("b"))
    cross = checkpointed(cross.filter("a <> b").distinct())
    if cross.isEmpty():
        return label
    further = components(cross).select(F.col("id").alias("label"), F.col("label").alias("least"))
    return label.join(further, "label", "left").select("id", F.coalesce("least", "label").alias("label"))


def _surrounded(e: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of ``moves``: edges (part, id, label and total of the other end's community, weight) and nodes (``state`` with ``may``)."""
    s = state.join(state.groupBy("label").agg(F.sum("k").alias("total")), "label")
    own = s.select("part", "id", "label", "total", F.lit(0.0).alias("weight"), F.struct("k", "loop", "h", "may").alias("own"))
    near = e.join(s.select(F.col("id").alias("b"), "label", "total"), "b").select("part", F.col("a").alias("id"), "label", "total", "weight")
    return near.unionByName(own, allowMissingColumns=True)


def _moved(e: DataFrame, state: DataFrame, m: float, sweeps: int, least: float, parts: int, level: int) -> tuple[DataFrame, float, bool]:
    """Local moving of nodes (``state``: id, h, k, loop, label) over edges in both directions: state, modularity, and whether moves add no more than ``least`` to it.

    Nodes are dealt into ``parts``. In a sweep half of the nodes (by a hash of node, level and sweep) may move to the neighbouring community of the greatest gain, ties to the
    lesser label: those of a part in turn, and as the others stood before. A level ends after a sweep that adds no more than ``least``, if any has raised modularity. If none has,
    half as many may move, all at once, and at last only moves are made that are the best of both communities that they touch. Those don't meddle with each
    other, so their gains add up and each round is taken.

    The edges are joined once for each state, to what every part has around it: its modularity and the next moves both follow from that.
    """

    def around(s: DataFrame, sweep: int) -> tuple[DataFrame, float, bool]:
        """MOVED; modularity; whether any move adds."""
        s = s.select("id", "h", "k", "loop", "label", _part(parts, level), (F.pmod(F.xxhash64("h", F.lit(level), F.lit(sweep)), F.lit(2)) == 0).alias("may"))
        seen = checkpointed(_surrounded(e, s).groupBy("part").applyInArrow(moves.block_moves(m), moves.MOVED))
        each = seen.groupBy("label").agg(F.sum("k").alias("k"), F.sum(F.col("inner") + F.col("loop")).alias("within"), F.max("more").alias("more"))
        r = each.agg(F.sum("within").alias("within"), F.sum(F.pow(F.col("k") / (2 * m), F.lit(2))).alias("by"), F.max("more").alias("more")).first()
        return seen, r.within / (2 * m) - r.by, r.more is not None and r.more > moves.LEAST_GAIN

    (state, best, any_), share, apart = around(state, 0), 2, False
    risen = False
    for sweep in range(sweeps):
        if not any_:  # no share of the nodes has a move
            return state, best, True
        chosen = state.filter(F.col("more") > moves.LEAST_GAIN).select("id", F.col("label").alias("old"), "new", "more", "h")
        if apart:
            rank = F.struct("more", "h", "id")
            first = chosen.select(F.col("old").alias("c"), rank.alias("r")).unionByName(chosen.select(F.col("new").alias("c"), rank.alias("r"))).groupBy("c").agg(F.max("r").alias("r"))
            win = lambda c: first.select(F.col("c").alias(c), F.col("r.id").alias(f"{c}_best"))
            moved = chosen.join(win("old"), "old").join(win("new"), "new").filter("id = old_best and id = new_best").select("id", F.col("new").alias("to"))
            nxt = checkpointed(state.select("id", "h", "k", "loop", "label").join(moved, "id", "left").select("id", "h", "k", "loop", F.coalesce("to", "label").alias("label")))
        elif share > 2:
            may = (F.col("more") > moves.LEAST_GAIN) & (F.pmod(F.xxhash64("h", F.lit(level), F.lit(sweep)), F.lit(share)) == 0)
            nxt = state.select("id", "h", "k", "loop", F.when(may, F.col("new")).otherwise(F.col("label")).alias("label"))
        else:
            nxt = state.select("id", "h", "k", "loop", F.col("to").alias("label"))
        nxt, q, further = around(nxt, sweep + 1)
        more = q - best
        if more > 1e-12:
            state, best, any_, risen = nxt, q, further, True
        if more <= least and (apart or risen):
            return state, best, True
        if more <= least:
            share *= 2
            apart = share > 16
    return state, best, False


def _numbered(ids: DataFrame) -> DataFrame:
    """id, n: a long for each distinct id, in the order of ids."""
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(ids.repartitionByRange(parts, "id").sortWithinPartitions("id").withColumn("n", F.monotonically_increasing_id()))


def _part(parts: int, level: int):
    return F.pmod(F.xxhash64("h", F.lit(level)), F.lit(parts)).cast("int").alias("part")


def community_levels(edges: DataFrame, sweeps: int = 100, least: float = 1e-3) -> DataFrame:
    """id, level (from 1), label, quality: communities in levels, each level's being nodes of the next; the last level has no successor of higher modularity.

    ``edges``: a, b, weight (clamped to 0.05 .. 1; loops don't count). A label is the least node of its community. Quality is the level's modularity, which
    rises with the level. A level ends where a round of moves adds no more than ``least``; one that doesn't in ``sweeps`` is an error. From the level on whose nodes and edges are no more than ``SOLVED``
    one task finds all further levels, each until no move adds. Nodes without an edge aren't there; no edges: no rows.
    """
    w = F.least(F.greatest(F.col("weight"), F.lit(0.05)), F.lit(1.0))
    one = edges.filter("a <> b").select("a", "b", w.alias("weight"))
    one = checkpointed(one.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight")))
    names = _numbered(one.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    to = lambda c: names.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"))
    one = one.join(to("a"), "a").join(to("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"), "weight")
    e = checkpointed(one.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("z"), "weight").select("z.*", "weight"))
    degree = e.groupBy(F.col("a").alias("n")).agg(F.sum("weight").alias("k"))
    # moves are drawn by a hash of the id itself, so that they don't depend on the numbers
    state = checkpointed(degree.join(names, "n").select(F.col("n").alias("id"), F.xxhash64("id").alias("h"), "k", F.lit(0.0).alias("loop"), F.col("n").alias("label")))
    m = float(state.agg(F.sum("k")).first()[0] or 0) / 2
    whole, out, before = state.select("id", F.col("id").alias("node")), None, None
    for level in count(1):
        if not m:
            break
        size = e.count()
        if size + state.count() <= SOLVED:
            s = state.select("id", "h", "k", "loop", "label", F.lit(0).alias("part"), F.lit(True).alias("may"))
            rest = checkpointed(_surrounded(e.withColumn("part", F.lit(0)), s).groupBy("part").applyInArrow(moves.all_levels(m, before), moves.LEVELS))
            rows = whole.join(rest, "node").select("id", (F.col("level") + (level - 1)).alias("level"), "label", "quality")
            out = rows if out is None else out.unionByName(rows)
            break
        parts = -(-size // SOLVED)
        dealt = checkpointed(e.join(state.select(F.col("id").alias("a"), _part(parts, level)), "a").repartition("part"))
        state, q, settled = _moved(dealt, state, m, sweeps, least, parts, level)
        if not settled:
            raise RuntimeError(f"level {level} did not settle in {sweeps} sweeps")
        if before is not None and q <= before + 1e-12:
            break
        low = state.groupBy("label").agg(F.min(F.struct("id", "h")).alias("least"))
        to = checkpointed(state.select("id", "k", "loop", "label").join(low, "label").select("id", "k", "loop", F.col("least.id").alias("label"), F.col("least.h").alias("h")))
        whole = checkpointed(whole.join(to.select(F.col("id").alias("node"), "label"), "node").select("id", F.col("label").alias("node")))
        rows = whole.select("id", F.lit(level).alias("level"), F.col("node").alias("label"), F.lit(q).alias("quality"))
        out, before = rows if out is None else out.unionByName(rows), q
        joined = e.join(to.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(to.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
        joined = checkpointed(joined.groupBy("la", "lb").agg(F.sum("weight").alias("weight")))
        loop = joined.filter("la = lb").select(F.col("la").alias("id"), F.col("weight").alias("inner"))
        e = joined.filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"), "weight")
        sums = to.groupBy("label").agg(F.first("h").alias("h"), F.sum("k").alias("k"), F.sum("loop").alias("loop")).withColumnRenamed("label", "id")
        state = checkpointed(sums.join(loop, "id", "left").select("id", "h", "k", (F.col("loop") + F.coalesce("inner", F.lit(0.0))).alias("loop"), F.col("id").alias("label")))
    if out is None:
        return names.select("id", F.lit(1).alias("level"), F.col("id").alias("label"), F.lit(0.0).alias("quality")).limit(0)
    named = names.select(F.col("n").alias("label"), F.col("id").alias("to"))
    return out.join(names.select(F.col("n").alias("id"), F.col("id").alias("of")), "id").join(named, "label").select(F.col("of").alias("id"), "level", F.col("to").alias("label"), "quality")


def communities(edges: DataFrame, sweeps: int = 100, least: float = 1e-3) -> DataFrame:
    """id, label of the last of ``community_levels``."""
    found = checkpointed(community_levels(edges, sweeps, least=least))
    return found.join(F.broadcast(found.agg(F.max("level").alias("level"))), "level").select("id", "label")


def modularity(edges: DataFrame, label: DataFrame) -> DataFrame:
    la, lb = label.select(F.col("id").alias("a"), F.col("label").alias("la")), label.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    j = edges.join(la, "a").join(lb, "b")
    inside = j.agg(F.sum(F.when(F.col("la") == F.col("lb"), F.col("weight"))).alias("inside"), F.sum("weight").alias("m"))
    ends = j.select(F.col("la").alias("l"), "weight").unionByName(j.select(F.col("lb").alias("l"), "weight"))
    degree = ends.groupBy("l").agg(F.sum("weight").alias("d"))
    share = F.max(F.coalesce("inside", F.lit(0.0)) / F.col("m")) - F.sum(F.pow(F.col("d") / (2 * F.col("m")), F.lit(2)))
    return degree.join(F.broadcast(inside)).agg(share.alias("q"))


# ----------------------------------------------------------------- structural likeness
def _patterns(triples: DataFrame, types: DataFrame) -> DataFrame:
    """id, other, pattern: the predicate, its direction and the type of the other end, for both ends of every edge."""
    t = triples.filter("predicate <> 'related_to'")
    both = t.select(F.col("subject_id").alias("id"), F.col("object_id").alias("other"), F.concat("predicate", F.lit("->")).alias("p"))
    both = both.unionByName(t.select(F.col("object_id").alias("id"), F.col("subject_id").alias("other"), F.concat("predicate", F.lit("<-")).alias("p")))
    j = both.join(types.select(F.col("id").alias("other"), "entity_type"), "other", "left")
    return j.select("id", "other", F.concat("p", F.coalesce("entity_type", F.lit("unknown"))).alias("pattern"))


def fingerprints(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """id, entity_type, hop1, hop2: sorted sets of patterns one and two edges away.

    The second hop is the union of the neighbours' sets, so it is joined as one small array for each edge; that an edge leads back to where
    it came from is only known from the ends: a pattern of the neighbour counts if it has an edge other than the one back, which its least and
    greatest ends tell. Edges are exchanged once for those ends and once for the second hop.
    """
    p = checkpointed(_patterns(triples, entities.select("id", "entity_type")))
    ends = p.groupBy("id", "pattern").agg(F.min("other").alias("only"), F.max("other").alias("last"))
    near = ends.groupBy("id").agg(F.collect_list(F.struct("pattern", (F.col("only") != F.col("last")).alias("more"), "only")).alias("near"))
    near = checkpointed(near)
    one = near.select("id", F.array_sort(F.transform("near", lambda x: x["pattern"])).alias("hop1"))
    step = p.select("id", "other").join(near.withColumnRenamed("id", "other"), "other")
    kept = F.filter("near", lambda x: x["more"] | (x["only"] != F.col("id")))
    two = step.select("id", F.explode(F.transform(kept, lambda x: x["pattern"])).alias("pattern")).distinct()
    two = two.groupBy("id").agg(F.array_sort(F.collect_set("pattern")).alias("hop2"))
    out = entities.select("id", "entity_type").join(one, "id").join(two, "id", "left")
    return out.withColumn("hop2", F.coalesce("hop2", F.expr("cast(array() as array<string>)")))


def likeness(a: str, b: str):
    """0.6 of the first hop's Jaccard, 0.3 of the second's and 0.1 for equal types, of two struct columns."""
    from ..functions.scalars import jaccard

    part = lambda name: jaccard(F.col(f"{a}.{name}"), F.col(f"{b}.{name}"))
    same = F.when(F.col(f"{a}.entity_type") == F.col(f"{b}.entity_type"), 0.1).otherwise(0.0)
    return F.least(0.6 * part("hop1") + 0.3 * part("hop2") + same, F.lit(1.0))


def shapes(fp: DataFrame) -> DataFrame:
    """Classes of equal fingerprints: shape, entity_type, hop1, hop2, members. Typed patterns are few, so classes are few, whatever the entities."""
    shape = F.sha2(F.to_json(F.struct("entity_type", "hop1", "hop2")), 256)
    return fp.groupBy("entity_type", "hop1", "hop2").agg(F.count("*").alias("members"), F.min("id").alias("first")).withColumn("shape", shape)


def analogies(triples: DataFrame, entities: DataFrame, of: list[str], k: int = 10, least: float = 0.1) -> DataFrame:
    """The ``k`` entities most like each of a stated few: query_id, id, score; ties to the lesser id."""
    from pyspark.sql import Window

    fp = checkpointed(fingerprints(triples, entities))
    pack = F.struct("entity_type", "hop1", "hop2")
    asked = fp.filter(F.col("id").isin(*of)).select(F.col("id").alias("query_id"), pack.alias("q"))
    s = fp.select("id", pack.alias("x")).join(F.broadcast(asked)).filter("id <> query_id").select("query_id", "id", F.round(likeness("q", "x"), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return s.filter(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
