"""Exact quantiles of groups of any size: no task holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, by: list[str], value: str, ps: list[float], ranges: int = 256) -> DataFrame:
    """``by``, n (values that aren't null), mean and q0, q1, ...: for each of ``ps`` the least value of which that share of the group's values is no greater.

    Equal values are counted first. A sketch cuts each group's distinct values into about ``ranges`` ranges, whose counts say in which one the wanted place lies; only that
    one is sorted. The sketch decides on the work, never on the result. A null group is a group; one without values has n 0 and nulls; NaN is the greatest value.
    """
    all_ = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    cells = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = cells.groupBy(*by).agg(F.array_sort(F.array_distinct(F.percentile_approx("__v", at, 4 * ranges))).alias("__cuts"))

    def same(a: str, b: str, extra=()):
        return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in [*by, *extra]]

    place = F.size(F.filter("__cuts", lambda x: x < F.col("__v")))
    placed = cells.alias("a").join(cuts.alias("b"), same("a", "b")).select("a.*", place.alias("__r"))
    counts = placed.groupBy(*by, "__r").agg(F.sum("__c").alias("__in"))
    w = Window.partitionBy(*by)
    upto = counts.withColumn("__to", F.sum("__in").over(w.orderBy("__r"))).withColumn("__n", F.sum("__in").over(w))  # at most ``ranges`` rows a group
    wanted = upto.select(*by, "__r", "__in", "__to", "__n", F.posexplode(F.array(*[F.lit(float(p)) for p in ps])).alias("__i", "__p"))
    need = F.col("__p") * F.col("__n")
    before = F.col("__to") - F.col("__in")
    wanted = wanted.filter((F.col("__to") >= need) & ((before < need) | (before == 0))).select(*by, "__r", "__i", need.alias("__need"), before.alias("__before"))
    inside = placed.alias("a").join(wanted.alias("b"), same("a", "b", ["__r"])).select("a.*", "b.__i", "b.__need", "b.__before")
    run = F.col("__before") + F.sum("__c").over(Window.partitionBy(*by, "__i").orderBy("__v"))
    found = inside.withColumn("__run", run).filter(F.col("__run") >= F.col("__need")).groupBy(*by).agg(*[F.min(F.when(F.col("__i") == i, F.col("__v"))).alias(f"q{i}") for i in range(len(ps))])
    return all_.alias("a").join(found.alias("b"), same("a", "b"), "left").select("a.*", *[f"b.q{i}" for i in range(len(ps))])
