"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _low(e: DataFrame, with_self: bool) -> DataFrame:
    """Least neighbour of each u."""
    m = e.groupBy("u").agg(F.min("v").alias("m"))
    return m.select("u", F.least("u", "m").alias("m")) if with_self else m


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (a long, b long) -> (node long, comp long): comp is the least node that is reachable.

    Nodes are those of the edges. Each round is written to the shared folder, so that a lost executor
    costs one round at most; only a count and a checksum come to the driver. Stars of any size are
    handled by sums over the key with partial aggregation. Rounds grow with the logarithm of the
    largest component; if the bound on rounds is passed an error is raised rather than a partial result.
    """
    e = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = materialize(e, "cc"), None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_low(both, True), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = _low(large, False)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = materialize(small.filter("u <> v").distinct(), "cc")
        now = tuple(e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if now == seen:
            root = e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(root)
        seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
