"""Feedback, retrieval policies and their search: weights, archives of candidates, diagnosis, proposals and gates."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import first_match

#: What each kind of feedback is worth, and where it goes.
WEIGHTS = {"helpful": 0.3, "cited": 0.3, "not_related": -1.0, "bridge": -1.0, "miss": -0.5, "card_accept": 1.0, "card_dismiss": -1.0}
#: Arms as (k, hops, episodic, late interaction).
ARMS = ((5, 0, False, False), (10, 1, False, False), (15, 2, False, False), (20, 2, True, False), (10, 1, False, True), (12, 2, False, True))
#: Weights of the spaces by verb.
VERBS = {
    "recall": {"text": 0.534, "lexical": 0.311, "recency": 0.078, "confidence": 0.078},
    "plan": {"text": 0.3, "lexical": 0.2, "recency": 0.35, "confidence": 0.15},
    "contradict": {"text": 0.35, "lexical": 0.3, "recency": 0.15, "confidence": 0.2},
    "reflect": {"text": 0.25, "lexical": 0.15, "recency": 0.45, "confidence": 0.15},
}


def feedback_weight(kind: Column) -> Column:
    return first_match([(kind == k, F.lit(w)) for k, w in WEIGHTS.items()], F.lit(0.0))


def feedback_target(kind: Column) -> Column:
    """positive, negative or behaviour."""
    return F.when(feedback_weight(kind) > 0, "positive").when(feedback_weight(kind) < 0, "negative").otherwise("behaviour")


def arm_parameters(spark) -> DataFrame:
    rows = [(i, *a) for i, a in enumerate(ARMS)]
    return spark.createDataFrame(rows, "arm int, k int, hops int, episodic boolean, late_interaction boolean")


def normalised(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total > 0 else dict.fromkeys(weights, 1 / max(1, len(weights)))


# ----------------------------------------------------------------- the archive
def best_per_instance(scores: DataFrame) -> DataFrame:
    return scores.groupBy("instance").agg(F.max("score").alias("best"))


def frontier_ceiling(scores: DataFrame) -> DataFrame:
    """A hundred times the mean of each instance's best score: what choosing the best candidate everywhere would give."""
    return best_per_instance(scores).agg((100 * F.avg("best")).alias("ceiling"))


def unsolved(scores: DataFrame, threshold: float) -> DataFrame:
    return best_per_instance(scores).filter(F.col("best") < threshold).select("instance")


def parents(archive: DataFrame, n: int) -> DataFrame:
    """``archive``: candidate, owned, mean. Those that own most instances, then of the highest mean."""
    return archive.orderBy(F.desc("owned"), F.desc("mean"), "candidate").limit(n)


# ----------------------------------------------------------------- diagnosis and proposals
def diagnose(runs: DataFrame, share: float = 0.4) -> DataFrame:
    """``runs``: candidate, f1, recall, latency. What at least ``share`` of the failures (F1 below 0.5) have in common: ``diagnosis``, in fixed order."""
    f = runs.filter(F.col("f1") < 0.5).groupBy("candidate")
    a = f.agg(F.count("*").alias("failed"), F.avg((F.col("recall") < 0.3).cast("double")).alias("missing"), F.avg((F.col("recall") >= 0.3).cast("double")).alias("ranked_low"), F.avg((F.col("latency") > 200).cast("double")).alias("slow"))
    rules = [(F.col("missing") >= share, F.lit("not_retrieved")), (F.col("slow") >= share, F.lit("too_slow")), (F.col("ranked_low") >= share, F.lit("ranked_low"))]
    return a.withColumn("diagnosis", first_match(rules, F.lit("mixed")))


@dataclass(frozen=True)
class Policy:
    """Weights of the spaces, the least score and the pool's factor."""

    weights: dict[str, float] = field(default_factory=lambda: dict(VERBS["recall"]))
    floor: float = 0.15
    multiplier: int = 4

    def fingerprint(self) -> str:
        w = normalised(self.weights)
        return "|".join([*(f"{k}={w[k]:.3f}" for k in sorted(w)), f"floor={self.floor:.3f}", f"pool={self.multiplier}"])

    def merge(self, other: Policy, bias: float = 0.5) -> Policy:
        """Between the two: ``bias`` of this one."""
        mix = lambda a, b: bias * a + (1 - bias) * b
        keys = {*self.weights, *other.weights}
        w = {k: mix(self.weights.get(k, 0.0), other.weights.get(k, 0.0)) for k in keys}
        return Policy(normalised(w), mix(self.floor, other.floor), round(mix(self.multiplier, other.multiplier)))

    def score(self, spaces: dict[str, Column]) -> Column:
        """Fused score of candidates as an expression; None below the floor."""
        from .answers import space_score

        s = space_score(spaces, self.weights)
        return F.when(s >= self.floor, s)


def propose(parent: Policy, diagnosis: str, step: float = 0.1) -> list[Policy]:
    """Changes that the diagnosis suggests, then one of each weight up and down."""
    out = []
    if diagnosis == "not_retrieved":
        out += [replace(parent, multiplier=parent.multiplier * 2), replace(parent, floor=max(0.0, parent.floor - step / 2))]
    elif diagnosis == "too_slow":
        out.append(replace(parent, multiplier=max(1, parent.multiplier // 2)))
    elif diagnosis == "ranked_low":
        out.append(replace(parent, floor=parent.floor + step / 2))
    for name, sign in itertools.product(sorted(parent.weights), (1, -1)):
        w = {**parent.weights, name: max(0.0, parent.weights[name] + sign * step)}
        out.append(replace(parent, weights=normalised(w)))
    return out


@dataclass
class Round:
    policy: Policy
    mean: float
    diagnosis: str
    accepted: bool


def optimize(seed: Policy, scorer: Callable[[Policy], tuple[float, str]], rounds: int = 5, step: float = 0.1, least_gain: float = 1e-6) -> list[Round]:
    """Reflective search: each round scores the best policy's proposals and the merge of the two best; a proposal is accepted if its mean rises.

    ``scorer`` runs a Spark job and gives a policy's mean score and diagnosis; nothing but these comes to the driver. Policies are scored once.
    """
    seen: dict[str, tuple[float, str]] = {}

    def scored(p: Policy) -> tuple[float, str]:
        return seen.setdefault(p.fingerprint(), None) or seen.__setitem__(p.fingerprint(), scorer(p)) or seen[p.fingerprint()]

    mean, diagnosis = scored(seed)
    history = [Round(seed, mean, diagnosis, True)]
    for _ in range(rounds):
        ranked = sorted((r for r in history if r.accepted), key=lambda r: -r.mean)
        options = propose(ranked[0].policy, ranked[0].diagnosis, step)
        if len(ranked) > 1:
            options.append(ranked[0].policy.merge(ranked[1].policy))
        fresh = [p for p in options if p.fingerprint() not in seen]
        if not fresh:
            break
        new = [Round(p, *scored(p), False) for p in fresh]
        top = max(new, key=lambda r: r.mean)
        top.accepted = top.mean > ranked[0].mean + least_gain
        history += new
        if not top.accepted:
            break
    return history


def dominant_diagnosis(history: list[Round]) -> str | None:
    """The commonest, ties to the first in order of names."""
    count = Counter(r.diagnosis for r in history)
    return min(count, key=lambda d: (-count[d], d)) if count else None


# ----------------------------------------------------------------- rewards and reflection
def pending_reward(relevance: Column, positive: Column, negative: Column) -> Column:
    """Relevance and what was signalled, between -1 and 1; null without any signal."""
    value = F.least(F.greatest(relevance + F.coalesce(positive, F.lit(0.0)) - F.abs(F.coalesce(negative, F.lit(0.0))), F.lit(-1.0)), F.lit(1.0))
    return F.when(positive.isNotNull() | negative.isNotNull(), value)


def nearest_successful_arm(trajectories: DataFrame, similarity: Column, least: float = 0.7, least_reward: float = 0.5) -> DataFrame:
    """The arm of the most similar trajectory that did well: arm, similarity (no row if there is none)."""
    s = trajectories.withColumn("similarity", similarity).filter((F.col("similarity") > least) & (F.col("reward") > least_reward))
    return s.orderBy(F.desc("similarity"), "id").limit(1).select("arm", "similarity")


def reflect(sessions: DataFrame) -> DataFrame:
    """``sessions``: session_id, arm, queries, positive, negative -> hit_rate and a line of text."""
    rate = F.when(F.col("queries") > 0, F.col("positive") / F.col("queries")).otherwise(0.0)
    word = F.when(rate >= 0.6, "good").when(rate >= 0.3, "mixed").otherwise("poor")
    text = F.concat(F.lit("session "), F.col("session_id").cast("string"), F.lit(": "), word, F.lit(", "), F.col("positive").cast("string"), F.lit(" of "), F.col("queries").cast("string"))
    return sessions.withColumn("hit_rate", F.round(rate, 6)).withColumn("narrative", text)


def suggest_arm(reflections: DataFrame, below: float = 0.3, last_arm: int = 5) -> DataFrame:
    """The arm behind the commonest one among poor sessions, at most the last: arm (no row without poor sessions)."""
    poor = reflections.filter(F.col("hit_rate") < below).groupBy("arm").agg(F.count("*").alias("n"))
    return poor.orderBy(F.desc("n"), "arm").limit(1).select(F.least(F.col("arm") + 1, F.lit(last_arm)).alias("arm"))
