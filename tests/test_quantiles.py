"""Exact quantiles against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from kelpwood.operators.quantiles import exact_quantiles

PS = [0.0, 0.01, 0.5, 0.95, 1.0]


def plain(values, p):
    values = sorted(values)
    return next(v for i, v in enumerate(values, 1) if i >= p * len(values))


@pytest.mark.parametrize("ranges", [2, 16, 256])
def test_equal_to_sorting(spark, ranges):
    """A hot group, ties, a group of one value, a null group, nulls; the number of ranges changes nothing."""
    rnd = random.Random(8)
    rows = [("hot", rnd.random()) for _ in range(3000)] + [("ties", float(rnd.randrange(3))) for _ in range(500)] + [("one", 7.0)] + [(None, float(i)) for i in range(10)]
    rows += [("hot", None), ("empty", None)]
    got = {r["g"]: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", PS, ranges).collect()}
    for g in ("hot", "ties", "one", None):
        values = [v for k, v in rows if k == g and v is not None]
        assert got[g]["n"] == len(values) and [got[g][f"q{i}"] for i in range(len(PS))] == [plain(values, p) for p in PS]
        assert got[g]["mean"] == pytest.approx(sum(values) / len(values))
    assert got["empty"]["n"] == 0 and got["empty"]["q0"] is None and len(got) == 5


def test_empty_and_many_columns(spark):
    assert exact_quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", [0.5]).collect() == []
    df = spark.range(1000).select((F.col("id") % 3).alias("a"), (F.col("id") % 2).alias("b"), F.col("id").alias("v"), F.lit(1).alias("n"))
    got = {(r["a"], r["b"]): r["q0"] for r in exact_quantiles(df, ["a", "b"], "v", [0.5]).collect()}
    assert got == {(a, b): plain([i for i in range(1000) if i % 3 == a and i % 2 == b], 0.5) for a in range(3) for b in range(2)}
