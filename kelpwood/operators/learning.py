"""Outcome models and policies: softmax regression, judging of policy runs, the Pareto front of candidates."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CELLS = 100_000  # combinations of features and class that a model is fitted on at most


def _sample(cells: DataFrame, features: list[str], most: int) -> list:
    """At most ``most`` cells, those of the least hashes of their features: all where there are no more, else an even sample that doesn't depend on the order."""
    return cells.orderBy(F.xxhash64(*features), *features).limit(most).collect()


class SoftmaxModel:
    """Full-batch gradient descent on one-hot features; uniform below six distinct rows of training data.

    Rows are grouped by their features first, so what comes to the driver is one row per combination of features and class. Of more than ``most`` of them an
    even sample is fitted on; of more than ``levels`` values of a column the commonest are told apart, others count as unknown ones do.
    """

    def __init__(self, rate: float = 0.1, l2: float = 1e-3, epochs: int = 400, most: int = 20_000, levels: int = 100):
        self.rate, self.l2, self.epochs, self.most, self.levels = rate, l2, epochs, most, levels
        self.columns: list[str] = []

    def fit(self, df: DataFrame, columns: list[str], label: str) -> SoftmaxModel:
        rows = _sample(df.groupBy(*columns, label).agg(F.count("*").alias("n")), [*columns, label], self.most)
        self.columns, self.classes = columns, sorted({r[label] for r in rows})
        seen = {c: Counter() for c in columns}
        for r in rows:
            for c in columns:
                seen[c][str(r[c])] += r["n"]
        self.values = {c: sorted(sorted(v, key=lambda x: (-v[x], x))[: self.levels]) for c, v in seen.items()}
        self.weights = np.zeros((1 + sum(map(len, self.values.values())), len(self.classes)))
        if sum(r["n"] for r in rows) < 6 or len(self.classes) < 2:
            return self
        x = np.array([self._row(r.asDict()) for r in rows])
        y = np.eye(len(self.classes))[[self.classes.index(r[label]) for r in rows]]
        n = np.array([r["n"] for r in rows], float)[:, None]
        for _ in range(self.epochs):
            p = self._softmax(x @ self.weights)
            self.weights -= self.rate * (x.T @ (n * (p - y)) / n.sum() + self.l2 * self.weights)
        return self

    def _row(self, r: dict) -> list[float]:
        return [1.0] + [float(str(r[c]) == v) for c in self.columns for v in self.values[c]]

    @staticmethod
    def _softmax(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with probabilities array<double> (in order of the classes) and predicted, as expressions in the plan."""
        logits = []
        for k in range(len(self.classes)):
            z, at = F.lit(float(self.weights[0, k])), 1
            for c in self.columns:
                for v in self.values[c]:
                    z = z + F.when(F.col(c).cast("string") == v, float(self.weights[at, k])).otherwise(0.0)
                    at += 1
            logits.append(z)
        from ..functions.scalars import softmax

        out = df.withColumn("__z", F.array(*logits)).withColumn("probabilities", softmax(F.col("__z"))).drop("__z")
        labels = F.array(*[F.lit(c) for c in self.classes])
        return out.withColumn("predicted", F.element_at(labels, F.array_position("probabilities", F.array_max("probabilities")).cast("int")))


def judge(before: DataFrame, after: DataFrame, most_loss: float = 0.5, most_latency: float = 1.5) -> DataFrame:
    """``before`` / ``after``: id, f1, latency. One row: change of F1, fixed, broke, and whether the new policy passes."""
    j = before.select("id", F.col("f1").alias("f0"), F.col("latency").alias("l0")).join(after, "id", "full")
    a = j.agg((100 * (F.avg("f1") - F.avg("f0"))).alias("delta"), F.count_if((F.col("f0") < 0.5) & (F.col("f1") >= 0.5)).alias("fixed"), F.count_if((F.col("f0") >= 0.5) & (F.col("f1") < 0.5)).alias("broke"), (F.avg("latency") / F.avg("l0")).alias("slower"))
    return a.withColumn("passes", (F.col("delta") >= -most_loss) & (F.col("slower") <= most_latency))


def frontier(scores: DataFrame) -> DataFrame:
    """``scores``: candidate, instance, score -> candidate, owned (instances where it equals the best), mean, kept (owns any, or has the best mean)."""
    best = scores.groupBy("instance").agg(F.max("score").alias("best"))
    per = scores.join(best, "instance").groupBy("candidate").agg(F.count_if(F.col("score") == F.col("best")).alias("owned"), F.avg("score").alias("mean"))
    return per.join(F.broadcast(per.agg(F.max("mean").alias("top")))).select("candidate", "owned", "mean", ((F.col("owned") > 0) | (F.col("mean") >= F.col("top") - 1e-6)).alias("kept"))


# ----------------------------------------------------------------- outcome models over dense features
#: One-hot features in order; tags follow.
STAKES, BANDS, KINDS = ("low", "medium", "high", "reversible"), ("morning", "afternoon", "evening", "night"), ("intent", "decision", "hypothesis")
CLASSES = (-1, 0, 1)


def tag_vocabulary(rows: DataFrame, tag: str, most: int = 16) -> list[str]:
    """The commonest tags, ties in order of the alphabet."""
    top = rows.filter(F.col(tag).isNotNull()).groupBy(tag).agg(F.count("*").alias("n")).orderBy(F.desc("n"), tag).limit(most)
    return [r[tag] for r in top.collect()]


def outcome_features(vocabulary: list[str]):
    """array<double> of stakes, time band, whether there is a horizon and a choice, confidence, kind and tags."""
    from ..functions.scalars import time_band

    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    flags = [one(F.col("stakes") == s) for s in STAKES] + [one(time_band(F.col("made_at")) == b) for b in BANDS]
    flags += [one(F.col("horizon").isNotNull()), one(F.col("options") > 1), F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0))]
    flags += [one(F.col("kind") == k) for k in KINDS] + [one(F.col("tag") == t) for t in vocabulary]
    return F.array(*[F.coalesce(f, F.lit(0.0)) for f in flags])


def split(df: DataFrame, share: float = 0.2, least: int = 6, n: int | None = None) -> DataFrame:
    """``held``: a fifth of the rows by a hash of the id, none where there are fewer than twice ``least``."""
    n = df.count() if n is None else n
    held = F.pmod(F.xxhash64("id"), F.lit(1000)) < int(share * 1000)
    return df.withColumn("held", held if n >= 2 * least else F.lit(False))


class OutcomeModel:
    """Softmax regression, or one hidden layer of rectified units, by full-batch descent with patience on held-out rows.

    Rows with equal features and class are one weighted row; of more than ``most`` such rows an even sample is fitted on. Below six
    rows or two classes it stays uniform.
    """

    def __init__(self, hidden: int = 0, rate: float = 0.1, l2: float = 1e-3, epochs: int = 400, patience: int = 25, seed: int = 7, most: int = MOST_CELLS):
        self.hidden, self.rate, self.l2, self.epochs, self.patience, self.seed, self.most = hidden, rate, l2, epochs, patience, seed, most
        self.layers: list[np.ndarray] = []
        self.report: dict[str, float] = {}

    def fit(self, df: DataFrame, features: str = "x", label: str = "polarity", held: str = "held") -> OutcomeModel:
        rows = _sample(df.groupBy(features, label, held).agg(F.count("*").alias("n")), [features, label, held], self.most)
        rows.sort(key=lambda r: (r[features], r[label]))
        if sum(r["n"] for r in rows) < 6 or len({r[label] for r in rows}) < 2:
            return self
        x = np.array([r[features] for r in rows])
        y = np.eye(len(CLASSES))[[CLASSES.index(r[label]) for r in rows]]
        n, out = np.array([float(r["n"]) for r in rows]), np.array([r[held] for r in rows])
        rng, dim = np.random.default_rng(self.seed), x.shape[1]
        sizes = [dim, self.hidden, len(CLASSES)] if self.hidden else [dim, len(CLASSES)]
        self.layers = [rng.normal(0, 0.3, (a + 1, b)) if self.hidden else np.zeros((a + 1, b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
        w = np.where(out, 0.0, n)
        w /= max(w.sum(), 1.0)
        best, kept, idle = np.inf, [v.copy() for v in self.layers], 0
        for epoch in range(self.epochs):
            acts = self._layers(x)
            grad = (acts[-1] - y) * w[:, None]
            for i in range(len(self.layers) - 1, -1, -1):
                below = np.hstack([acts[i], np.ones((len(x), 1))])
                step = below.T @ grad + self.l2 * self.layers[i]
                if i:
                    grad = (grad @ self.layers[i][:-1].T) * (acts[i] > 0)
                self.layers[i] -= self.rate * step
            watch = np.where(out, n, 0.0) if out.any() else n
            loss = float(-(watch * np.log(np.maximum((self._layers(x)[-1] * y).sum(1), 1e-12))).sum() / watch.sum())
            if loss < best - 1e-6:
                best, kept, idle = loss, [v.copy() for v in self.layers], 0
            else:
                idle += 1
                if idle >= self.patience:
                    break
        self.layers = kept
        self.report = {"epochs": epoch + 1, "loss": best, "rows": float(n.sum()), "held": float(n[out].sum())}
        return self

    def _layers(self, x: np.ndarray) -> list[np.ndarray]:
        acts = [x]
        for i, v in enumerate(self.layers):
            z = acts[-1] @ v[:-1] + v[-1]
            if i < len(self.layers) - 1:
                acts.append(np.maximum(z, 0))
            else:
                e = np.exp(z - z.max(axis=1, keepdims=True))
                acts.append(e / e.sum(axis=1, keepdims=True))
        return acts

    def chances(self, x):
        """array<double> of the classes' chances, as an expression in the plan; uniform without training."""
        from ..functions.scalars import dot, softmax

        if not self.layers:
            return F.array(*[F.lit(1 / len(CLASSES))] * len(CLASSES))
        lit = lambda col: F.array(*[F.lit(float(a)) for a in col])
        acts = x
        for i, v in enumerate(self.layers):
            z = F.array(*[dot(acts, lit(v[:-1, k])) + float(v[-1, k]) for k in range(v.shape[1])])
            acts = F.transform(z, lambda a: F.greatest(a, F.lit(0.0))) if i < len(self.layers) - 1 else softmax(z)
        return acts

    def contributions(self, features: list[float], of: int, k: int = 5) -> list[tuple[int, float]]:
        """The ``k`` features that move a class's score most: weight by value along the active path, by size, ties to the first."""
        if not self.layers:
            return []
        x, j = np.asarray(features, float), CLASSES.index(of)
        if len(self.layers) == 1:
            parts = x * self.layers[0][:-1, j]
        else:
            active = (x @ self.layers[0][:-1] + self.layers[0][-1]) > 0
            parts = x * (self.layers[0][:-1] * active @ self.layers[1][:-1, j])
        order = np.lexsort((np.arange(len(parts)), -np.abs(parts)))[:k]
        return [(int(i), float(parts[i])) for i in order if parts[i]]


def scored(df: DataFrame, chances, label: str = "polarity") -> DataFrame:
    """Log loss and accuracy of chances against labels."""
    p = F.element_at(chances, F.col(label).cast("int") + 2)
    said = F.array_position(chances, F.array_max(chances)).cast("int") - 2
    return df.agg(F.count("*").alias("n"), F.avg(-F.log(F.greatest(p, F.lit(1e-12)))).alias("loss"), F.avg((said == F.col(label)).cast("double")).alias("accuracy"))


def out_of_sample(pairs: DataFrame, trained_at, observed: str = "observed_at") -> DataFrame:
    """Rows that were seen after a model was trained."""
    return pairs.filter(F.col(observed) > trained_at)
