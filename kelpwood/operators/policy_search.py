"""Search over retrieval policies: all proposals of a round in one job, parents from the frontier of instances.

What comes to the driver is one row for each proposal of a round; scores by instance stay in tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed
from .learning import frontier
from .policy import Policy, parents, propose

#: Rounds, parents a round, first step and the least one, the greatest loss (in points) against the seed.
ROUNDS, PARENTS, STEP, LEAST_STEP, MOST_LOSS = 6, 2, 0.12, 0.02, 0.5


@dataclass
class Tried:
    round: int
    candidate: int
    parent: int | None
    policy: Policy
    mean: float
    diagnosis: str
    accepted: bool
    reason: str


def score_matrix(rows: DataFrame, instance: str, spaces: dict[str, Column], good: Column, policies: dict[int, Policy], cut: float = 0.5) -> DataFrame:
    """candidate, instance, n, score (share of rows that the policy puts on the right side of ``cut``), false (share put above it wrongly).

    One scan and one aggregate for all policies and instances: sums by instance first, which are then unfolded.
    """
    sums = [F.count("*").alias("n")]
    for i, p in policies.items():
        above = F.coalesce(p.score(spaces) >= cut, F.lit(False))
        sums += [F.count_if(above == good).alias(f"hit{i}"), F.count_if(above & ~good).alias(f"false{i}")]
    wide = rows.groupBy(F.col(instance).alias("instance")).agg(*sums)
    cells = F.array(*[F.struct(F.lit(i).alias("candidate"), (F.col(f"hit{i}") / F.col("n")).alias("score"), (F.col(f"false{i}") / F.col("n")).alias("false")) for i in policies])
    return wide.select("instance", "n", F.inline(cells)).select("candidate", "instance", "n", "score", "false")


def summary(matrix: DataFrame) -> dict[int, tuple[float, str]]:
    """Mean score over the instances, and what a policy's errors have in common."""
    a = matrix.groupBy("candidate").agg(F.avg("score").alias("mean"), F.avg("false").alias("false")).collect()
    return {r["candidate"]: (r["mean"], "ranked_low" if r["false"] > 0.1 else "not_retrieved") for r in a}


def policy_search(
    rows: DataFrame, instance: str, spaces: dict[str, Column], good: Column, seed: Policy | None = None, rounds: int = ROUNDS, most_loss: float = MOST_LOSS, proposals: Callable = propose,
) -> tuple[list[Tried], DataFrame | None]:
    """All that was tried, and candidate, instance, n, score, false of what was accepted (None without rows).

    A round changes the policies that own most instances, by what the best one's errors say, in steps that shrink to ``LEAST_STEP``. A proposal is accepted if its mean isn't more
    than ``most_loss`` points below the seed's and it belongs to the frontier of all accepted before and all that pass in this round. The search ends after a round without any.
    """
    seed = seed or Policy()
    known, policies = {seed.fingerprint()}, {0: seed}
    archive = checkpointed(score_matrix(rows, instance, spaces, good, policies))
    first = summary(archive)
    if not first:
        return [], None
    base, best = first[0][0], first[0]
    tried = [Tried(0, 0, None, seed, *first[0], True, "seed")]
    for n in range(rounds):
        step = max(LEAST_STEP, STEP * (1 - n / rounds))
        of = [r["candidate"] for r in parents(frontier(archive), PARENTS).collect()]
        fresh: dict[int, tuple[int, Policy]] = {}
        for parent in of:
            for p in proposals(policies[parent], best[1], step):
                if p.fingerprint() not in known:
                    known.add(p.fingerprint())
                    fresh[len(tried) + len(fresh)] = (parent, p)
        if not fresh:
            break
        matrix = checkpointed(score_matrix(rows, instance, spaces, good, {i: p for i, (_, p) in fresh.items()}))
        means = summary(matrix)
        passed = [i for i in fresh if 100 * (base - means[i][0]) <= most_loss]
        both = archive.unionByName(matrix.filter(F.col("candidate").isin(passed)))
        kept = {r["candidate"] for r in frontier(both).filter("kept").collect()}
        accepted = [i for i in passed if i in kept]
        for i, (parent, p) in fresh.items():
            reason = "accepted" if i in accepted else "dominated" if i in passed else f"lost {100 * (base - means[i][0]):.2f} points"
            tried.append(Tried(n + 1, i, parent, p, *means[i], i in accepted, reason))
        if not accepted:
            break
        policies |= {i: fresh[i][1] for i in accepted}
        best = max([best, *(means[i] for i in accepted)], key=lambda m: m[0])
        archive = checkpointed(archive.unionByName(matrix.filter(F.col("candidate").isin(accepted))))
    return tried, archive
