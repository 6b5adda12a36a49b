"""A contextual bandit with diagonal upper-confidence arms, replayed over logged events.

Which arm was pulled and what it gave are in the log, so a key's state before an event is an affine function of its state some events earlier: the weights and
biases move by ``s + rate * (reward - u.s) * g``. A key of any number of events is therefore cut at the borders of range partitions; a cut piece is summed up
as one affine map, the maps of a key are applied one after the other, and every piece is then replayed from its own first state, all pieces at once. A task
holds one state (and one map, for keys that are cut) beside an Arrow batch. What one key brings together is one map for each partition it lies in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed

#: Breadth and depth of each arm, first and least share of exploration, its decay by pull, step of learning, worth of a hint.
ARM_FEATURES = ((0.25, 0.0), (0.50, 0.33), (0.75, 0.67), (1.00, 1.00), (0.50, 0.50), (0.80, 0.80))
ALPHA, LEAST_ALPHA, DECAY, RATE, HINT = 0.5, 0.05, 0.995, 0.01, 0.1


def kernel(features=ARM_FEATURES) -> np.ndarray:
    """How much an arm's error moves each arm's bias: exp(-3 * distance of their features)."""
    f = np.asarray(features, float)
    return np.exp(-3 * np.sqrt(((f[:, None] - f[None]) ** 2).sum(axis=2)))


class Arms:
    """The state of one key: weights, sums of squares and pulls of each arm, biases, and the exploration that pulls wear down."""

    def __init__(self, dim: int, features=ARM_FEATURES):
        self.near, n = kernel(features), len(features)
        self.dim, self.w, self.v, self.bias, self.pulls = dim, np.zeros((n, dim)), np.zeros((n, dim)), np.zeros(n), np.zeros(n)

    @property
    def alpha(self) -> float:
        return max(LEAST_ALPHA, ALPHA * DECAY ** float(self.pulls.sum()))

    def select(self, x: np.ndarray | None, hint: int | None = None) -> int:
        """The best arm, the first of equals; arms never pulled come first. Without a context the arms take turns by the number of pulls."""
        if x is None:
            return int(self.pulls.sum()) % len(self.bias)
        score = self.w @ x + self.bias + self.alpha * np.sqrt((x**2 / (self.v + 1)).sum(axis=1))
        if hint is not None and 0 <= hint < len(score):
            score[hint] += HINT
        return int(np.argmax(np.where(self.pulls == 0, np.inf, score)))

    def reward(self, arm: int, x: np.ndarray, value: float) -> None:
        """Learn from a reward, cut to 0 to 1."""
        step = RATE * (min(1.0, max(0.0, value)) - float(self.w[arm] @ x + self.bias[arm]))
        self.w[arm] += step * x
        self.v[arm] += x**2
        self.bias += step * self.near[arm]
        self.pulls[arm] += 1

    def dump(self) -> np.ndarray:
        return np.concatenate([self.w.ravel(), self.bias, self.v.ravel(), self.pulls])

    def load(self, flat) -> Arms:
        n, a = self.w.size, len(self.bias)
        flat = np.asarray(flat, float)
        self.w, self.bias = flat[:n].reshape(self.w.shape).copy(), flat[n : n + a].copy()
        self.v, self.pulls = flat[n + a : 2 * n + a].reshape(self.w.shape).copy(), flat[2 * n + a :].copy()
        return self


class Piece:
    """The affine map (m, c) of weights and biases over a run of events, and what they add to the sums of squares and the pulls."""

    def __init__(self, dim: int, features=ARM_FEATURES):
        self.near, self.arms, self.dim = kernel(features), len(features), dim
        n = self.arms * (dim + 1)
        self.m, self.c, self.added = np.eye(n), np.zeros(n), np.zeros(n)

    def reward(self, arm: int, x: np.ndarray, value: float) -> None:
        own, first = slice(arm * self.dim, (arm + 1) * self.dim), self.arms * self.dim
        seen = x @ self.m[own] + self.m[first + arm]
        error = min(1.0, max(0.0, value)) - float(x @ self.c[own] + self.c[first + arm])
        for at, g in ((own, x), (slice(first, None), self.near[arm])):
            self.m[at] -= RATE * np.outer(g, seen)
            self.c[at] += RATE * error * g
        self.added[own] += x**2
        self.added[first + arm] += 1

    def dump(self) -> np.ndarray:
        return np.concatenate([self.m.ravel(), self.c, self.added])


def after(state: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """A dumped state after a dumped piece."""
    n = len(state) // 2
    piece = np.asarray(piece, float)
    return np.concatenate([piece[: n * n].reshape(n, n) @ state[:n] + piece[n * n : n * n + n], state[n:] + piece[n * n + n :]])


def _context(x, dim: int) -> np.ndarray | None:
    if x is None or len(x) != dim:
        return None
    x = np.asarray([np.nan if v is None else v for v in x], float)
    return x if np.isfinite(x).all() else None


def _learns(arm, value, x, arms: int) -> bool:
    return x is not None and not pd.isna(arm) and not pd.isna(value) and 0 <= int(arm) < arms


def _segments(events: DataFrame, key: str, order: list[str], parts: int | None) -> DataFrame:
    """The events by key and time in range partitions, with the number of their partition; a null key is a key like others."""
    e = events.withColumn("__k", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))
    e = e.repartitionByRange(*([parts] if parts else []), "__k", *order)
    return checkpointed(e.withColumn("__segment", F.spark_partition_id()))


def _starts(e: DataFrame, order: list[str], dim: int, features) -> DataFrame:
    """__segment, __k, __state: the first state of each piece of the keys that partition borders cut."""
    ends = e.groupBy("__segment").agg(F.min("__k").alias("lo"), F.max("__k").alias("hi"))
    cut = ends.select(F.col("lo").alias("__k")).intersect(ends.select(F.col("hi").alias("__k")))  # at most one key for each partition
    rows = e.join(F.broadcast(cut), "__k", "left_semi").repartition("__segment", "__k").sortWithinPartitions("__segment", "__k", *order)
    n = len(features) * (dim + 1)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, piece = None, None
        for b in batches:
            for seg, k, x, arm, value in zip(b["__segment"], b["__k"], b["x"], b["arm"], b["reward"], strict=True):
                if (seg, k) != at:
                    if at:
                        yield pd.DataFrame([(*at, piece.dump())], columns=["__segment", "__k", "map"])
                    at, piece = (seg, k), Piece(dim, features)
                x = _context(x, dim)
                if _learns(arm, value, x, len(features)):
                    piece.reward(int(arm), x, float(value))
        if at:
            yield pd.DataFrame([(*at, piece.dump())], columns=["__segment", "__k", "map"])

    def along(maps: pd.DataFrame) -> pd.DataFrame:
        state, out = np.zeros(2 * n), []
        for r in maps.sort_values("__segment").itertuples(index=False):
            out.append((r[0], r[1], state))
            state = after(state, r[2])
        return pd.DataFrame(out, columns=["__segment", "__k", "__state"])

    maps = rows.select("__segment", "__k", *order, "x", "arm", "reward").mapInPandas(pieces, "__segment int, __k string, map array<double>")
    return maps.groupBy("__k").applyInPandas(along, "__segment int, __k string, __state array<double>")


def _replayed(events: DataFrame, key: str, order: list[str], dim: int, features, parts: int | None) -> DataFrame:
    """__segment, __k, the columns of ``order``, arm, reward, chosen; and a row with __state for the end of each piece."""
    e = _segments(events, key, order, parts)
    if "hint" not in e.columns:
        e = e.withColumn("hint", F.lit(None).cast("int"))
    names = ["__segment", "__k", *order, "x", "arm", "reward", "hint", "__state"]
    rows = e.withColumn("__state", F.lit(None).cast("array<double>")).select(*names, F.lit(1).alias("__n"))
    first = _starts(e, order, dim, features).withColumn("__n", F.lit(0))
    both = rows.unionByName(first, allowMissingColumns=True).repartition("__segment", "__k").sortWithinPartitions("__segment", "__k", "__n", *order)
    kinds = {f.name: f.dataType.simpleString() for f in e.schema.fields}
    schema = ", ".join(["__segment int", "__k string", *(f"`{c}` {kinds[c]}" for c in order), "arm int", "reward double", "chosen int", "__state array<double>"])

    def play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, arms = None, None

        def end():
            empty = dict.fromkeys([*order, "arm", "reward", "chosen"], [None])
            return pd.DataFrame({"__segment": [at[0]], "__k": [at[1]], **empty, "__state": [arms.dump()]})

        for b in batches:
            chosen = np.full(len(b), -1)
            for i, (seg, k, x, arm, value, hint, state) in enumerate(zip(b["__segment"], b["__k"], b["x"], b["arm"], b["reward"], b["hint"], b["__state"], strict=True)):
                if (seg, k) != at:
                    if at:
                        yield end()
                    at, arms = (seg, k), Arms(dim, features)
                if state is not None:
                    arms.load(state)
                    continue
                x = _context(x, dim)
                chosen[i] = arms.select(x, None if pd.isna(hint) else int(hint))
                if _learns(arm, value, x, len(features)):
                    arms.reward(int(arm), x, float(value))
            out = b[["__segment", "__k", *order, "arm", "reward"]].assign(chosen=chosen, __state=None)
            yield out[chosen >= 0]
        if at:
            yield end()

    return both.mapInPandas(play, schema)


def replay(events: DataFrame, key: str, order: list[str], dim: int, features=ARM_FEATURES, parts: int | None = None) -> DataFrame:
    """``events``: ``key``, the columns of ``order`` (together one row's own within a key), x array<double>, arm int, reward double and maybe hint int.

    Each event with ``chosen``: the arm that the key's bandit would have pulled, having learned from the key's earlier events. Returned are ``key`` (as text), ``order``,
    arm, reward, chosen. Events whose arm is null or unknown, whose reward is null, or whose context is null, of another length or not finite teach nothing; without such a
    context the arms take turns. A null key is a key. No events: no rows.
    """
    r = _replayed(events, key, order, dim, features, parts).filter("chosen is not null")
    return r.select(F.expr("nullif(substr(__k, 2), '')").alias(key), *order, "arm", "reward", "chosen")


def states(events: DataFrame, key: str, order: list[str], dim: int, features=ARM_FEATURES, parts: int | None = None) -> DataFrame:
    """What each key's bandit knows after all its events: ``key`` (as text), arm, pulls, weight (mean size of its weights), bias, alpha; a row for each arm."""
    n = len(features)
    r = _replayed(events, key, order, dim, features, parts).filter("__state is not null")
    last = r.groupBy("__k").agg(F.max_by("__state", "__segment").alias("s"))
    size = lambda a: F.aggregate(F.transform(F.slice("s", a * dim + 1, dim), F.abs), F.lit(0.0), lambda t, x: t + x) / dim
    pulls = F.slice("s", n * (2 * dim + 1) + 1, n)
    alpha = F.greatest(F.lit(LEAST_ALPHA), ALPHA * F.pow(F.lit(DECAY), F.aggregate(pulls, F.lit(0.0), lambda t, x: t + x)))
    each = last.withColumn("alpha", alpha).select("__k", "s", "alpha", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("arm"))
    return each.select(
        F.expr("nullif(substr(__k, 2), '')").alias(key), "arm", F.element_at(pulls, F.col("arm") + 1).cast("long").alias("pulls"),
        size(F.col("arm")).alias("weight"), F.element_at("s", F.lit(n * dim + 1) + F.col("arm")).alias("bias"), "alpha",
    )


def value_of(replayed: DataFrame, by: list[str]) -> DataFrame:
    """Off-policy worth of the arms chosen: n, agreed (events where the log pulled the chosen arm), logged (mean reward of the log) and estimate (mean reward where it
    agreed, each weighed by the inverse share of its arm in the log; null where it never did). Sums only, by group and pair of arms first."""
    cells = replayed.filter("arm is not null and reward is not null").groupBy(*by, "arm", "chosen").agg(F.count("*").alias("n"), F.sum(F.least(F.greatest("reward", F.lit(0.0)), F.lit(1.0))).alias("r"))
    share = cells.groupBy(*by, "arm").agg(F.sum("n").alias("of_arm"))
    on = [F.col(f"c.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*by, "arm"]]
    j = cells.alias("c").join(share.alias("s"), on).select("c.*", "s.of_arm")
    hit, weight = F.col("arm") == F.col("chosen"), 1 / F.col("of_arm")
    a = j.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("agreed"), (F.sum("r") / F.sum("n")).alias("logged"),
        (F.sum(F.when(hit, F.col("r") * weight)) / F.sum(F.when(hit, F.col("n") * weight))).alias("estimate"),
    )
    return a
