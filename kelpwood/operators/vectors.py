"""Vector search and fusion: exact top-k, SimHash in two stages, centroids, reciprocal ranks, diversification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine
from .clustering import nearest


def cosine_topk(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """``queries``: a stated set of rows with query_id and q. Each task keeps its own k best of a query before anything moves.

    The queries are broadcast: callers pass a bounded set.
    """
    s = df.join(F.broadcast(queries)).filter(F.col(key) != F.col("query_id")).select("query_id", F.col(key).alias("id"), cosine(F.col(vector), F.col("q")).alias("score"))
    part = Window.partitionBy("query_id", "__p").orderBy(F.desc("score"), "id")
    local = s.withColumn("__p", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= k)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return local.drop("__p").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Unit mean of each group's vectors: sums by place with partial aggregation, then one row per group."""
    part = df.select(F.col(group).alias("grp"), F.posexplode(vector).alias("at", "x")).groupBy("grp", "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = part.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("at", "m"))).alias("s"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("len"))
    return packed.select("grp", F.transform("s", lambda x: x["m"] / F.col("len")).alias("centroid"))


def assign(df: DataFrame, centres: DataFrame, key: str, vector: str, least: float = 0.55, most: int = 4096) -> DataFrame:
    """Nearest centroid by cosine, ties to the lesser group, -1 below ``least``; centroids are broadcast in blocks of ``most``."""
    best = nearest(df, centres.withColumnRenamed("grp", "label"), key, vector, most)
    return best.select("id", F.when(F.col("score") >= least, F.col("label")).otherwise(-1).alias("grp"), "score")


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """``lists``: query_id, list, id, score -> query_id, id, fused: sums of 1 / (k + rank)."""
    w = Window.partitionBy("query_id", "list").orderBy(F.desc("score"), "id")
    return lists.withColumn("rank", F.row_number().over(w)).groupBy("query_id", "id").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("fused"))


def planes(dim: int, seed: int = 42) -> np.ndarray:
    """64 hyperplanes with entries in [-1, 1)."""
    x = (np.arange(64 * dim, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float).reshape(64, dim) / 2.0**52 - 1


def simhash(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """``df`` with simhash long: a bit for each hyperplane that the vector isn't behind."""
    normal = planes(dim)

    @F.pandas_udf("long")
    def sign(v: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(a, float) for a in v]) if len(v) else np.zeros((0, dim))
        return pd.Series(np.packbits(x @ normal.T >= 0, axis=1).view(">i8").reshape(-1).astype(np.int64))

    return df.withColumn("simhash", sign(F.col(vector)))


def two_stage(df: DataFrame, queries: DataFrame, key: str, vector: str, dim: int, k: int, pool: int = 256) -> DataFrame:
    """The ``max(8 k, pool)`` rows nearest by Hamming distance, reranked by cosine. ``queries``: query_id, q (a stated set)."""
    hashed = simhash(df, vector, dim)
    qs = simhash(queries, "q", dim).select("query_id", "q", F.col("simhash").alias("qh"))
    near = hashed.join(F.broadcast(qs)).withColumn("d", F.bit_count(F.col("simhash").bitwiseXOR(F.col("qh"))))
    w = Window.partitionBy("query_id").orderBy("d", key)
    cut = near.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= max(8 * k, pool)).filter(F.col(key) != F.col("query_id"))
    s = cut.select("query_id", F.col(key).alias("id"), cosine(F.col(vector), F.col("q")).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def mmr(ranked: DataFrame, penalty: float = 0.3) -> DataFrame:
    """``ranked``: query_id, id, rank, v (at most some tens of rows a query). Greedy reordering: 1 / place less ``penalty`` times the greatest cosine to what is chosen."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        v = np.stack([np.asarray(x, float) for x in pdf["v"]])
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        chosen, left = [0], list(range(1, len(v)))
        while left:
            gain = [1 / (i + 1) - penalty * float((v[chosen] @ v[i]).max()) for i in left]
            chosen.append(left.pop(int(np.argmax(gain))))
        return pd.DataFrame({"query_id": pdf["query_id"], "id": pdf["id"].to_numpy()[chosen], "rank": np.arange(1, len(v) + 1)})

    return ranked.groupBy("query_id").applyInPandas(one, f"query_id long, id {ranked.schema['id'].dataType.simpleString()}, rank int")


def maxsim(q, d):
    """Sum over the query's tokens of the best cosine with a document's token; arrays of arrays."""
    best = F.transform(q, lambda a: F.array_max(F.transform(d, lambda b: cosine(a, b))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)
