"""Bitemporal facts: half-open intervals of validity and of recording, null for no end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _within(at: Column, start: str, end: str) -> Column:
    return (F.col(start).isNull() | (F.col(start) <= at)) & (F.col(end).isNull() | (at < F.col(end)))


def query_at(facts: DataFrame, valid: Column, recorded: Column) -> DataFrame:
    """What was held at ``recorded`` to be true at ``valid``."""
    return facts.filter(_within(recorded, "recorded_at", "superseded_at") & _within(valid, "valid_from", "valid_to"))


def query_range(facts: DataFrame, start: Column, end: Column) -> DataFrame:
    """Facts that are held now and overlap [start, end)."""
    return facts.filter(F.col("superseded_at").isNull() & (F.col("valid_from").isNull() | (F.col("valid_from") < end)) & (F.col("valid_to").isNull() | (F.col("valid_to") > start)))


def entity_at(facts: DataFrame, valid: Column) -> DataFrame:
    """For each entity the last recorded version whose validity holds at ``valid``, whether superseded or not."""
    return facts.filter(_within(valid, "valid_from", "valid_to")).groupBy("entity_id").agg(F.max_by("fact_id", F.struct("recorded_at", "fact_id")).alias("fact_id"))


def current(facts: DataFrame) -> DataFrame:
    return facts.filter("superseded_at is null").groupBy("entity_id").agg(F.max_by("fact_id", F.struct("recorded_at", "fact_id")).alias("fact_id"))


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, since: str, value: str) -> DataFrame:
    """Each left row with the right row of its key that began last at or before it: one shuffle by key, a window over both sides."""
    from pyspark.sql import Window

    a = left.withColumn("__side", F.lit(1)).withColumn("__at", F.col(at))
    b = right.select(key, F.col(since).alias("__at"), F.col(value), F.lit(0).alias("__side"))
    w = Window.partitionBy(key).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(value, F.last(F.when(F.col("__side") == 0, F.col(value)), ignorenulls=True).over(w)).filter("__side = 1").drop("__side", "__at")


def update_facts(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """Append ``changes`` (same columns): open facts of the changed entities are superseded when the change is recorded."""
    first = changes.groupBy("entity_id").agg(F.min("recorded_at").alias("__when"))
    old = facts.join(first, "entity_id", "left").withColumn("superseded_at", F.coalesce("superseded_at", "__when")).select(*facts.columns)
    return old.unionByName(changes.select(*facts.columns))


def close_validity(facts: DataFrame, closed: DataFrame) -> DataFrame:
    """``closed``: entity_id, valid_to. Ends the validity of its open rows."""
    end = closed.select("entity_id", F.col("valid_to").alias("__end"))
    return facts.join(end, "entity_id", "left").withColumn("valid_to", F.coalesce("valid_to", "__end")).select(*facts.columns)


# ----------------------------------------------------------------- confidence dynamics
def decay(df: DataFrame, factor: float, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Confidence times ``factor``, and how many fall below the threshold (nothing is deleted)."""
    out = df.withColumn("confidence", F.col("confidence") * factor)
    return out, out.agg(F.count_if(F.col("confidence") < threshold).alias("below"), F.count("*").alias("rows"))


def consolidate(df: DataFrame) -> DataFrame:
    """recency, novelty, confidence -> retention, confidence after strengthening or decay, and action."""
    from ..functions.scalars import retention

    r = retention(F.col("recency"), F.col("novelty"))
    out = df.withColumn("retention", r)
    strong, weak = (F.col("retention") > 0.7) & (F.col("recency") > 0.5), F.col("retention") < 0.3
    conf = F.when(strong, F.least(F.col("confidence") + 0.02 * F.col("retention"), F.lit(1.0))).when(weak, F.greatest(F.col("confidence") - 0.1 * (1 - F.col("retention")), F.lit(0.0))).otherwise(F.col("confidence"))
    out = out.withColumn("confidence", conf)
    return out.withColumn("action", F.when(weak & (F.col("confidence") < 0.05), "prune").when(strong, "strengthen").when(weak, "decay").otherwise("keep"))


TRANSITIONS = {"open": ("acted", "abandoned", "superseded", "completed"), "acted": ("completed", "abandoned")}


def allowed_transition(old: Column, new: Column) -> Column:
    out = F.lit(False)
    for state, targets in TRANSITIONS.items():
        out = F.when(old == state, new.isin(*targets)).otherwise(out)
    return out
