"""Store verbs over append-only logs: a table's current state is a view on its log, so writes are appends and nothing is updated in place.

Each verb takes and returns DataFrames: what is appended, or the table as it is after the write. All are joins by key and grouped aggregates; hot keys are
handled by partial aggregation and by the skew handling of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import latest

STRIKES = 3


# ----------------------------------------------------------------- reads
def point(df: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key: an equality that reaches the scan."""
    return df.filter(F.col(key) == value)


def newest(df: DataFrame, n: int, *order) -> DataFrame:
    """The first ``n`` rows in an order: a top-k, not a sort of everything."""
    return df.orderBy(*order).limit(n)


def newest_each(df: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    """The first ``n`` rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", rank).filter(F.col("__n") <= n).drop("__n")


def with_default(keys: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """``keys`` with the table's value, or the default where it has no row."""
    return keys.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


# ----------------------------------------------------------------- writes
def append(log: DataFrame, rows: DataFrame, seq: str = "seq") -> DataFrame:
    """The log with rows behind it, numbered from its last number on."""
    last = log.agg(F.coalesce(F.max(seq), F.lit(0)).alias("__last"))
    number = F.row_number().over(Window.orderBy(*rows.columns))
    stamped = rows.withColumn("__n", number).join(F.broadcast(last)).withColumn(seq, F.col("__last") + F.col("__n"))
    return log.unionByName(stamped.select(*log.columns))


def current(log: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """The last row of each key; keys whose last row is a tombstone (column ``deleted``) are gone."""
    out = latest(log, key, [F.col(seq)])
    return out.filter(~F.coalesce(F.col("deleted"), F.lit(False))).drop("deleted") if "deleted" in log.columns else out


def change(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The table after updates: of each key that it has, columns of ``changes`` that aren't null replace its own."""
    fields = [c for c in changes.columns if c not in key]
    new = changes.groupBy(*key).agg(*[F.max(c).alias(f"__{c}") for c in fields])  # of several changes of one key the greatest values
    pick = lambda c: F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c)
    return table.join(new, key, "left").select(*[pick(c) for c in table.columns])


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the table doesn't have, each key once."""
    return rows.dropDuplicates(key).join(table.select(*key).distinct(), key, "left_anti").select(*rows.columns)


def remove(table: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return table.join(gone.select(*key).distinct(), key, "left_anti").select(*table.columns)


def versioned(table: DataFrame, rows: DataFrame, key: list[str], version: str = "version") -> DataFrame:
    """``rows`` with the version behind the table's last of that key, 1 for a new key."""
    last = table.groupBy(*key).agg(F.max(version).alias("__last"))
    return rows.join(last, key, "left").withColumn(version, F.coalesce("__last", F.lit(0)) + 1).drop("__last")


def decide(table: DataFrame, decisions: DataFrame, key: str, status: str = "status", only: str = "pending") -> DataFrame:
    """``decisions``: key and ``decided``. Rows that are still ``only`` take the decision; all others stay."""
    j = table.join(decisions.groupBy(key).agg(F.max("decided").alias("decided")), key, "left")
    new = F.when((F.col(status) == only) & F.col("decided").isNotNull(), F.col("decided")).otherwise(F.col(status))
    return j.withColumn(status, new).select(*table.columns)


def purge(table: DataFrame, kept: Column) -> DataFrame:
    """The table without rows for which ``kept`` is false; null is kept."""
    return table.filter(F.coalesce(kept, F.lit(True)))


def keep_newest(table: DataFrame, n: int, *order) -> DataFrame:
    """Retention: the newest ``n`` rows (0 clears)."""
    return table.limit(0) if n == 0 else newest(table, n, *order)


# ----------------------------------------------------------------- logs to state
def counters(log: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """One count per flag and key, over an event log."""
    return log.groupBy(key).agg(*[F.count_if(c).alias(name) for name, c in flags.items()])


def extended(log: DataFrame, key: list[str], since: str, until: str, reason: str) -> DataFrame:
    """Silences: the last start, the furthest end, and the last reason that was given."""
    last_reason = F.max_by(reason, F.when(F.col(reason).isNotNull(), F.col(since)))
    return log.groupBy(*key).agg(F.max(since).alias(since), F.max(until).alias(until), last_reason.alias(reason))


def strikes(pairs: DataFrame, a: str, b: str, least: int = STRIKES) -> DataFrame:
    """Unordered pairs with how often they were struck, blocked from ``least`` on."""
    c = pairs.filter(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.count("*").alias("strikes"))
    return c.withColumn("blocked", F.col("strikes") >= least)


def moving_average(log: DataFrame, key: str, order: list[str], value: str, keep: float = 0.8) -> DataFrame:
    """Exponential moving average by key from 0.5, as a fold over each key's values in order: key, value after the last, n.

    The fold's weights are powers of ``keep`` by how far a value is from the last, so it is a sum with partial aggregation behind one rank.
    """
    back = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])) - 1
    x = log.select(key, F.col(value).alias("__v"), back.alias("__back"))
    weighted = F.sum((1 - keep) * F.pow(F.lit(keep), F.col("__back")) * F.col("__v"))
    return x.groupBy(key).agg((0.5 * F.pow(F.lit(keep), F.count("*")) + weighted).alias(value), F.count("*").alias("n"))


def cascade(entity_tables: dict[str, tuple[DataFrame, list[str]]], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows that name a deleted id in any of its columns."""
    ids = gone.select(F.col("id")).distinct()
    out = {}
    for name, (df, columns) in entity_tables.items():
        kept = df
        for c in columns:
            kept = kept.join(ids.withColumnRenamed("id", c), c, "left_anti")
        out[name] = kept.select(*df.columns)
    return out


# ----------------------------------------------------------------- memory tiers
def accesses(log: DataFrame, key: str, at: str) -> DataFrame:
    """An access counts one, is the last if later, and makes the memory hot."""
    return log.groupBy(key).agg(F.count("*").alias("access_count"), F.max(at).alias("last_accessed")).withColumn("tier", F.lit("hot"))


def retier(entries: DataFrame, now: Column) -> DataFrame:
    """Tier by age of the last access in seconds (a day: hot, a week: warm); pinned memories stay hot. Column ``new_tier``."""
    age = (now - F.col("last_accessed")) / 86400
    new = F.when(F.col("pinned"), "hot").when(age < 1, "hot").when(age < 7, "warm").otherwise("cold")
    return entries.withColumn("new_tier", new)
