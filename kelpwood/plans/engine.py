"""Questions answered end to end: each is planned, and one plan unites the lists that the plans ask for; a list that no question asks for isn't built.

Questions are a stated set, planned on the driver and broadcast; seeds of the graph are at most a list's length for each question. Nothing else is bounded or broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import retrieval as Q
from ..operators import vectors as V
from ..operators.graph import checkpointed
from ..operators.policy import ARMS
from .planner import Plan, plan, should_retrieve

#: Smoothing of ranks, least likeness below which few hits count as none, what a fallback's scores are worth, the least of them, the arms of plain and of chained questions.
SMOOTH, POOR, FADED, LEAST, NARROW, CHAIN = 60.0, 0.3, 0.6, 0.15, 0, 2


@dataclass(frozen=True)
class Planned:
    """A question's plan and arm; ``k`` is 0 where the gate says that nothing need be looked up."""

    query_id: int
    plan: Plan
    arm: int
    k: int
    hops: int
    wider: int  # length of the next arm's list

    @property
    def signals(self) -> int:
        return max(3, self.k // 2)


def planned(questions: dict[int, str], now: datetime, learned: int = 1) -> list[Planned]:
    """``learned`` is the bandit's arm (``bandit.replay``), taken where the plan doesn't say one."""
    out = []
    for i, text in questions.items():
        p = plan(text, now)
        arm = {"direct_lookup": NARROW, "relation_chain": CHAIN}.get(p.action, learned)
        if should_retrieve(text):
            out.append(Planned(i, p, arm, ARMS[arm][0], ARMS[arm][1], ARMS[arm + 1][0] if arm < 3 else 0))
    return out


def _broadcast(spark, rows, schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def found(vectors: DataFrame, entities: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """``vectors``: id, embedding; ``entities``: the ids that the view lets through; ``asked``: query_id, q, k, wider -> query_id, id, place, sim, own. ``most``: the longest list asked for.

    The ``k`` nearest of all vectors, less those without an entity. Where under three are left and nothing is like the question, the next arm's list follows with faded scores
    (a second step could never bring a score above the least one, so there is one).
    """
    near = vectors.filter("embedding is not null").join(asked).withColumn("sim", S.cosine(F.col("embedding"), F.col("q"))).filter("sim is not null")
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))).filter(F.col("place") <= most)
    few = ranked.filter(F.col("place") <= F.greatest("k", "wider")).select("query_id", "id", "place", "sim", "k")
    few = few.join(entities.select("id", F.lit(True).alias("known")), "id", "left")
    w = Window.partitionBy("query_id")
    own = F.col("place") <= F.col("k")
    few = few.withColumn("best", F.max(F.when(own, F.col("sim"))).over(w)).withColumn("n", F.count_if(own & F.col("known")).over(w))
    fallback = ~own & (F.greatest("best", F.lit(0.0)) < POOR) & (F.col("n") < 3) & (F.col("sim") * FADED >= LEAST)
    return few.filter(F.col("known") & (own | fallback)).select("query_id", "id", "place", "sim", own.alias("own"))


def fused(hits: DataFrame, usage: DataFrame, now: int) -> DataFrame:
    """``hits``: query_id, id, place, own; ``usage``: id, retrieved, succeeded, last (seconds) -> query_id, id, rank, fused: reciprocal ranks by likeness, worth, rarity and
    recency, ties of each list in order of likeness; unused entities count 0.5, 1 and 0. Hits of a fallback follow, without a score."""
    j = hits.join(usage, "id", "left")
    hours = F.floor((F.lit(now) - F.col("last")) / 60) / 60
    lists = (F.lit(0.0), F.coalesce(F.col("succeeded") / (F.col("retrieved") + 1), F.lit(0.5)), F.coalesce(1 / (F.col("retrieved") + 1), F.lit(1.0)), F.coalesce(S.recency(hours), F.lit(0.0)))
    parts = [F.when(F.col("own"), 1 / (F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("own"), F.desc(f"l{i}"), "place")) + SMOOTH)) for i in range(len(lists))]
    s = j.select("query_id", "id", "place", "own", *[v.alias(f"l{i}") for i, v in enumerate(lists)]).withColumn("fused", reduce(lambda a, b: a + b, parts))
    order = Window.partitionBy("query_id").orderBy(F.desc("own"), F.round("fused", 12).desc(), "place")
    return s.withColumn("rank", F.row_number().over(order)).select("query_id", "id", "rank", "fused")


def neighbours(seeds: DataFrame, triples: DataFrame, hops: int) -> DataFrame:
    """``seeds``: query_id, id, hops (at most a list's length for each question) -> query_id, id, hop of what lies within each question's hops and isn't a seed."""
    ends = F.array(F.struct(F.col("subject_id").alias("a"), F.col("object_id").alias("b")), F.struct(F.col("object_id").alias("a"), F.col("subject_id").alias("b")))
    both = triples.filter("subject_id <> object_id").select(F.inline(ends))
    seen = front = seeds.select("query_id", "id", "hops", F.lit(0).alias("hop"))
    for h in range(1, hops + 1):
        here = front.filter(F.col("hops") >= h).select("query_id", "hops", F.col("id").alias("a"))
        step = both.join(F.broadcast(here) if h == 1 else here, "a").select("query_id", F.col("b").alias("id"), "hops").distinct()
        front = checkpointed(step.join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("hop", F.lit(h)))
        seen = seen.unionByName(front)
    return seen.filter("hop > 0").select("query_id", "id", "hop")


def temporal(signals: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    """``asked``: query_id, q, k, start, end (seconds). The captures of each question's time, by 0.6 of likeness and 0.4 of recency by weeks: query_id, id, rank, score."""
    rows = signals.join(asked, (F.col("created_at") >= F.col("start")) & (F.col("created_at") < F.col("end")))
    age = (F.lit(now) - F.col("created_at")) / 86400
    s = rows.withColumn("score", 0.6 * S.cosine(F.col("embedding"), F.col("q")) + 0.4 * S.half_life(age, 7.0))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= F.col("k")).select("query_id", "id", "rank", "score")


def search(questions: dict[int, str], asked: DataFrame, vectors: DataFrame, entities: DataFrame, usage: DataFrame, triples: DataFrame, signals: DataFrame, now: datetime, dim: int, learned: int = 1, diversity: float = 0.3) -> DataFrame:
    """Rows of all lists: query_id, kind (entity, neighbour, signal, temporal), id (text), rank (a neighbour's is its hop), score (null for neighbours and a fallback's hits).

    ``asked``: query_id, q (the questions' vectors); ``vectors``: id, embedding; ``entities``: id, those of the view; ``usage``: see ``fused``; ``signals``: see
    ``retrieval.signal_hits``. A question that the gate turns away, or without a vector, has no rows. With ``diversity`` 0 the fused order stays.
    """
    spark, at = asked.sparkSession, int(now.replace(tzinfo=UTC).timestamp())
    plans = planned(questions, now, learned)
    empty = spark.createDataFrame([], "query_id long, kind string, id string, rank int, score double")
    if not plans:
        return empty
    spec = _broadcast(spark, [(p.query_id, questions[p.query_id], p.k, p.hops, p.wider) for p in plans], "query_id long, query string, k int, hops int, wider int")
    ask = F.broadcast(asked.join(spec, "query_id"))
    out = [empty]

    def add(df: DataFrame, kind: str, rank: str = "rank", score: str | None = "score") -> None:
        value = F.col(score).cast("double") if score else F.lit(None).cast("double")
        out.append(df.select("query_id", F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.col(rank).cast("int").alias("rank"), value.alias("score")))

    hits = fused(found(vectors, entities, ask.select("query_id", "q", "k", "wider"), max(max(p.k, p.wider) for p in plans)), usage, at)
    if diversity > 0:
        scored = hits.join(vectors.select("id", F.col("embedding").alias("v")), "id")
        hits = V.mmr(scored.select("query_id", "id", "rank", "v"), diversity).join(hits.select("query_id", "id", "fused"), ["query_id", "id"])
    hits = checkpointed(hits)
    add(hits, "entity", score="fused")
    if any(p.hops for p in plans):
        seeds = hits.join(spec.filter("hops > 0").select("query_id", "hops"), "query_id").select("query_id", "id", "hops")
        add(neighbours(seeds, triples, max(p.hops for p in plans)), "neighbour", "hop", None)
    for pool in sorted({max(4 * p.signals, 32) for p in plans}):  # questions of one size of pool share a job
        of = [p for p in plans if max(4 * p.signals, 32) == pool]
        own = _broadcast(spark, [(p.query_id, p.signals) for p in of], "query_id long, most int")
        h = Q.signal_hits(signals, ask.join(own.select("query_id"), "query_id").select("query_id", "q", "query"), F.lit(at), max(p.signals for p in of), dim)
        add(h.join(own, "query_id").filter("rank <= most"), "signal")
    timed = [(p.query_id, *(int(b.replace(tzinfo=UTC).timestamp()) for b in p.plan.window)) for p in plans if p.plan.window]
    if timed:
        spans = _broadcast(spark, timed, "query_id long, start long, end long")
        add(temporal(signals, F.broadcast(ask.join(spans, "query_id").select("query_id", "q", "k", "start", "end")), at), "temporal")
    return reduce(DataFrame.unionByName, out)
