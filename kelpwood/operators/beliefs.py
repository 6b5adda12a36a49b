"""Truth maintenance: beliefs, justifications and propagation to a fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed


def verdicts(targets: DataFrame, justifications: DataFrame, status: DataFrame) -> DataFrame:
    """id, new: what the justifications of ``targets`` (target) say; ``status``: premise, status of all premises that are known.

    A justification holds if all its premises are in; one without a premise (null) holds. A defeat that holds: out; else a support that holds: in; else
    out. Beliefs without justifications have no verdict: what was asserted stays.
    """
    mine = justifications.join(targets, "target", "left_semi").join(status, "premise", "left")
    met = F.col("premise").isNull() | F.coalesce(F.col("status") == "in", F.lit(False))
    holds = mine.groupBy("jid", "target", "kind").agg(F.bool_and(met).alias("holds"))
    out = holds.groupBy(F.col("target").alias("id")).agg(F.bool_or((F.col("kind") == "defeat") & F.col("holds")).alias("defeated"), F.bool_or((F.col("kind") == "support") & F.col("holds")).alias("supported"))
    return out.select("id", F.when(~F.col("defeated") & F.col("supported"), "in").otherwise("out").alias("new"))


def propagate(beliefs: DataFrame, justifications: DataFrame, roots: DataFrame | None = None, passes: int | None = None, rounds: int = 50) -> DataFrame:
    """id, status once changes have spread. ``beliefs``: id, status ('in' / 'out' / 'contradicted'). ``justifications``: jid, target, kind ('support' / 'defeat'), premise.

    Semi-naive: a round looks only at beliefs of which a premise changed in the round before (first: at those that lean on ``roots`` (id), or at all), by the
    statuses before it; beliefs that don't exist aren't added. Only the changes are written, never the whole state. A belief passes changes on ``passes``
    times at most (once with ``roots``, which count as having done so), so cycles end; without that bound an unsettled state is an error.
    """
    j = checkpointed(justifications.select("jid", "target", "kind", "premise").distinct())
    base = beliefs.select("id", "status")
    most = passes if passes is not None else (1 if roots is not None else None)
    spark = beliefs.sparkSession
    log = spark.createDataFrame([], f"id {base.schema['id'].dataType.simpleString()}, status string, round int")
    passed = roots.select("id").distinct().select("id", F.lit(1).alias("n")) if roots is not None else None
    moved = roots.select("id").distinct() if roots is not None else None

    def now(ids: DataFrame) -> DataFrame:
        last = log.groupBy("id").agg(F.max_by("status", "round").alias("latest"))
        return ids.join(base, "id").join(last, "id", "left").select("id", F.coalesce("latest", "status").alias("status"))

    for number in range(rounds):
        targets = (j if moved is None else j.join(moved.withColumnRenamed("id", "premise"), "premise", "left_semi")).select("target").distinct()
        asked = j.join(targets, "target", "left_semi").select(F.col("premise").alias("id")).filter("id is not null").distinct()
        verdict = verdicts(targets, j, now(asked).withColumnRenamed("id", "premise"))
        new = now(verdict.select("id")).join(verdict, "id").filter("status <> new").select("id", F.col("new").alias("status"), F.lit(number).alias("round"))
        log = checkpointed(log.unionByName(new))
        moved = log.filter(F.col("round") == number).select("id")
        if most is not None:
            before = passed if passed is not None else spark.createDataFrame([], f"id {base.schema['id'].dataType.simpleString()}, n int")
            moved = checkpointed(moved.join(before.filter(F.col("n") >= most), "id", "left_anti"))
            passed = checkpointed(before.unionByName(moved.select("id", F.lit(1).alias("n"))).groupBy("id").agg(F.sum("n").cast("int").alias("n")))
        if moved.isEmpty():
            return now(base.select("id"))
    raise RuntimeError("beliefs did not settle")


def contradicting(pairs: DataFrame, below: float = -0.8) -> DataFrame:
    """Pairs (a, b, similarity) under the threshold, as unordered pairs."""
    return pairs.filter(F.col("similarity") < below).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").distinct()


def resolve(beliefs: DataFrame, retracted: DataFrame) -> DataFrame:
    """Beliefs named by ``retracted`` (id) are out."""
    gone = retracted.select("id", F.lit(True).alias("gone")).distinct()
    return beliefs.join(gone, "id", "left").withColumn("status", F.when(F.col("gone"), "out").otherwise(F.col("status"))).drop("gone")


def asserted(log: DataFrame, rows: DataFrame) -> DataFrame:
    """``log``: statement, id, status, seq; ``rows``: statement. Beliefs that an assertion adds: a statement that is in already, or stated twice, adds none; one whose last belief is out is held anew."""
    last = log.groupBy("statement").agg(F.max_by("status", F.struct("seq", "id")).alias("status"))
    return rows.select("statement").distinct().join(last, "statement", "left").filter(F.col("status").isNull() | (F.col("status") == "out")).select("statement", F.lit("in").alias("status"))


def justified(justifications: DataFrame, beliefs: DataFrame) -> DataFrame:
    """Justifications of which the target and all premises exist; others are refused whole."""
    ids = beliefs.select("id")
    j = justifications.join(ids.select(F.col("id").alias("target")), "target", "left_semi")
    missing = j.join(ids.select(F.col("id").alias("premise")), "premise", "left_anti").select("jid").distinct()
    return j.join(missing, "jid", "left_anti").select(*justifications.columns)


def dependents(justifications: DataFrame, premise: int) -> DataFrame:
    return justifications.filter(F.col("premise") == premise).select("target").distinct()


def resolve_pairs(pairs: DataFrame, choices: DataFrame) -> DataFrame:
    """``pairs``: a, b; ``choices``: a, b in either order and ``keep`` ('a', 'b', 'both', 'none', of the choice's own order). The ids that are retracted, each once."""
    canon = choices.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("a").alias("x"), F.col("b").alias("y"), "keep")
    j = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(canon, ["a", "b"])
    gone = F.when(F.col("keep") == "a", F.array("y")).when(F.col("keep") == "b", F.array("x")).when(F.col("keep") == "none", F.array("x", "y")).otherwise(F.array().cast("array<long>"))
    return j.select(F.explode(gone).alias("id")).distinct()
