"""Clusters once they are found: centroids, nearest centroids, what is left, labels. They are found by ``neighbours`` (single link) and ``hierarchy`` (density)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine

def persisted(df: DataFrame, label: DataFrame, key: str, vector: str) -> DataFrame:
    """label, members, centroid (unit mean) of all clusters but noise, by sums over places with partial aggregation."""
    j = df.select(F.col(key).alias("id"), F.col(vector).alias("v")).join(label.filter("label >= 0"), "id")
    means = j.select("label", F.posexplode("v").alias("at", "x")).groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("at", "m"))).alias("s"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n"))
    return j.groupBy("label").agg(F.count("*").alias("members")).join(packed, "label").select("label", "members", F.transform("s", lambda x: x["m"] / F.col("n")).alias("centroid"))


def nearest(df: DataFrame, centres: DataFrame, key: str, vector: str, most: int = 4096) -> DataFrame:
    """id, label, score of the nearest centroid by cosine, ties to the lesser label; vectors of another length score 0.

    Centroids are counted and broadcast in blocks of ``most``, so more of them mean more passes and never a larger broadcast.
    """
    blocks = max(1, -(-centres.count() // most))
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    numbered = centres.select("label", "centroid", F.pmod(F.xxhash64("label"), F.lit(blocks)).alias("block"))
    best = None
    for block in range(blocks):
        few = F.broadcast(numbered.filter(F.col("block") == block).drop("block"))
        s = rows.join(few).select("id", "label", cosine(F.col("vector"), F.col("centroid")).alias("score"))
        top = s.groupBy("id").agg(F.max(F.struct("score", (-F.col("label")).alias("minus"))).alias("m"))
        best = top if best is None else best.unionByName(top)
    return best.groupBy("id").agg(F.max("m").alias("m")).select("id", (-F.col("m.minus")).alias("label"), F.col("m.score").alias("score"))


def newest_noise(df: DataFrame, label: DataFrame, at: str, since, n: int) -> DataFrame:
    """What no cluster took since a time, newest first."""
    return label.filter("label = -1").join(df, "id").filter(F.col(at) >= since).orderBy(F.desc(at), "id").limit(n)


def longest_text(texts: DataFrame, label: DataFrame, least: int = 1) -> DataFrame:
    """label, members, id of the member with most words, ties to the least id; groups of ``least`` members."""
    words = F.size(F.split(F.trim("text"), "\\s+"))
    j = texts.join(label, "id").withColumn("n", words)
    return j.groupBy("label").agg(F.count("*").alias("members"), F.max_by("id", F.struct("n", -F.col("id"))).alias("id")).filter(F.col("members") >= least)


def ranks(df: DataFrame, by: str, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
