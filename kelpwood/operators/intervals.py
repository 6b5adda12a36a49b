"""Rows of one key whose intervals overlap: pairs by a join on dyadic blocks of time, and counts by a sweep.

Two intervals overlap where the later start lies in the other one. An interval is covered by few aligned blocks (two of each size at most), a start lies in one
block of each size, and both meet on key, size and block: so rows of a key that don't overlap never meet, and a busy key is dealt over its time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed

LEVELS = 12  # blocks of the finest size: two to this power over the whole range
CELLS = 1024  # parts of the range that a sweep takes one by one


def axis(df: DataFrame, c: str) -> Column:
    """Dates as days, times as microseconds, whole numbers as they are."""
    kind = df.schema[c].dataType.simpleString()
    if kind == "date":
        return F.unix_date(F.col(f"`{c}`")).cast("long")
    if kind == "timestamp_ntz":
        return F.unix_micros(F.to_timestamp_ltz(F.date_format(F.col(f"`{c}`"), "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    return F.unix_micros(F.col(f"`{c}`")) if kind == "timestamp" else F.col(f"`{c}`").cast("long")


def _ranged(facts: DataFrame, key: list[str], value: str, start: str, end: str) -> tuple[DataFrame, int, int]:
    """Rows with s and e on the axis (null: the range's ends), the range's low end, and the size of its finest block."""
    rows = facts.select(*[F.col(f"`{k}`") for k in key], F.col(f"`{value}`").alias("v"), F.col(f"`{start}`").alias("from"), F.col(f"`{end}`").alias("to"), axis(facts, start).alias("s"), axis(facts, end).alias("e"))
    lo, hi = rows.agg(F.least(F.min("s"), F.min("e")), F.greatest(F.max("s"), F.max("e"))).first()
    lo, hi = lo or 0, hi or 0
    lo -= 1  # before all that has a time
    unit = max(1, -(-(hi - lo + 2) // (1 << LEVELS)))
    return rows.withColumn("s", F.coalesce("s", F.lit(lo))).withColumn("e", F.coalesce("e", F.lit(hi + 1))), lo, unit


def overlapping(facts: DataFrame, key: list[str], value: str, start: str, end: str) -> DataFrame:
    """Pairs of rows of one key with value_a < value_b whose half-open intervals overlap (null: unbounded): key, value_a, from_a, to_a, value_b, from_b, to_b.

    A row whose key or value is null is in no pair; repeated rows pair each. An interval that ends before it starts overlaps those that reach over both ends.
    """
    rows, lo, unit = _ranged(facts, key, value, start, end)
    cell = lambda c: F.floor((c - lo) / unit)

    def cover(level: int) -> list[Column]:
        """The blocks of a size inside the interval that no larger one inside it takes in: an odd one at the low end, an even one at the high end."""
        low, high = F.shiftright(F.col("first") + (1 << level) - 1, level), F.shiftright(F.col("last") + 1, level)
        one = lambda n, odd: F.when((low < high) & (odd % 2 == 1), F.struct(F.lit(level).alias("level"), n.alias("block")))
        return [one(low, low), one(high - 1, high)]

    def on(df: DataFrame, blocks: list[Column], mark: str) -> DataFrame:
        named = [F.col(c).alias(f"{c}{mark}") for c in ("v", "from", "to", "s", "e")]
        return df.select(*[F.col(f"`{k}`") for k in key], *named, F.explode(F.filter(F.array(*blocks), lambda b: b.isNotNull())).alias("b")).select("*", "b.*").drop("b")

    spans = rows.withColumn("first", cell(F.col("s"))).withColumn("last", cell(F.greatest(F.col("e") - 1, F.col("s"))))
    spans = on(spans, [b for level in range(LEVELS + 2) for b in cover(level)], "1")
    starts = rows.withColumn("c", cell(F.col("s")))
    starts = on(starts, [F.struct(F.lit(level).alias("level"), F.shiftright("c", level).alias("block")) for level in range(LEVELS + 2)], "2")
    met = spans.join(starts, [*key, "level", "block"]).filter("v1 <> v2 and s1 < e2 and s2 < e1 and (s1 < s2 or s1 = s2 and v1 < v2)")
    swap = F.col("v1") > F.col("v2")
    pick = lambda x: [F.when(swap, F.col(f"{x}2")).otherwise(F.col(f"{x}1")), F.when(swap, F.col(f"{x}1")).otherwise(F.col(f"{x}2"))]
    (va, vb), (fa, fb), (ta, tb) = pick("v"), pick("from"), pick("to")
    return met.select(*key, va.alias("value_a"), fa.alias("from_a"), ta.alias("to_a"), vb.alias("value_b"), fb.alias("from_b"), tb.alias("to_b"))


def overlap_counts(facts: DataFrame, key: list[str], value: str, start: str, end: str) -> DataFrame:
    """key, value, from, to, overlaps of every row: how many rows of its key with another value overlap it; no pair is formed.

    What starts before a row ends, without what has ended when it starts. Running counts are taken in cells of the range, so that a busy key isn't one sort.
    Rows with a null key or value, and rows whose interval is empty, aren't returned and count nothing.
    """
    rows, lo, unit = _ranged(facts, key, value, start, end)
    full = checkpointed(rows.dropna(subset=[*key, "v"]).filter("s < e").withColumn("row", F.monotonically_increasing_id()))
    width = unit * (1 << LEVELS) // CELLS

    def running(groups: list[str]) -> DataFrame:
        g = [F.col(f"`{c}`") for c in groups]
        event = lambda t, kind, order: full.select(*g, "row", t.alias("t"), F.lit(kind).alias("kind"), F.lit(order).alias("o"))
        # at one time: ends, then who asks what has ended; who asks what has started, then starts
        events = event(F.col("e"), "end", 0).unionByName(event(F.col("s"), "ended?", 1)).unionByName(event(F.col("e"), "started?", 2)).unionByName(event(F.col("s"), "start", 3))
        events = events.withColumn("cell", F.floor((F.col("t") - lo) / width)).withColumn("i", F.when(F.col("kind") == "start", 1).otherwise(0)).withColumn("j", F.when(F.col("kind") == "end", 1).otherwise(0))
        names = [f"`{c}`" for c in groups]
        sums = events.groupBy(*names, "cell").agg(F.sum("i").alias("ci"), F.sum("j").alias("cj"))
        before = Window.partitionBy(*names).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(*g, "cell", F.coalesce(F.sum("ci").over(before), F.lit(0)).alias("pi"), F.coalesce(F.sum("cj").over(before), F.lit(0)).alias("pj"))
        within = Window.partitionBy(*names, "cell").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = events.withColumn("ri", F.sum("i").over(within)).withColumn("rj", F.sum("j").over(within)).filter("kind in ('ended?', 'started?')")
        placed = seen.join(sums, [*groups, "cell"])
        n = F.sum(F.when(F.col("kind") == "started?", F.col("ri") + F.col("pi")).otherwise(-(F.col("rj") + F.col("pj"))))
        return placed.groupBy("row").agg(n.alias("n"))

    every, own = running(key).withColumnRenamed("n", "all"), running([*key, "v"]).withColumnRenamed("n", "own")
    out = full.join(every, "row").join(own, "row")
    return out.select(*key, F.col("v").alias("value"), "from", "to", (F.col("all") - F.col("own")).alias("overlaps"))
