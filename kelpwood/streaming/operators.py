"""Structured Streaming forms of the ingest side: deduplication, rate limits, windows. Each takes and returns a (streaming) DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedup(stream: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """First row of each key within the watermark: state is bounded by it."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, at: str, width: str, by: str, late: str = "1 hour", step: str | None = None) -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, width, step or width), by).agg(F.count("*").alias("n"))


def token_bucket(stream: DataFrame, key: str, at: str, rate_per_minute: float, burst: float) -> DataFrame:
    """Rows with ``admitted``: a bucket for each key that holds ``burst`` tokens and gains ``rate_per_minute``.

    Within a micro-batch a key's rows are taken in order of time.
    """
    schema = stream.schema.simpleString()[7:-1]
    names = stream.columns

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        level, last = state.get if state.exists else (burst, None)
        admitted = []
        for t in rows[at]:
            now = t.timestamp()
            if last is not None:
                level = min(burst, level + max(0.0, now - last) * rate_per_minute / 60)
            last = max(now, last) if last is not None else now
            admitted.append(level >= 1)
            level -= 1 if level >= 1 else 0
        state.update((float(level), float(last)))
        yield rows[names].assign(admitted=admitted)

    return stream.groupBy(key).applyInPandasWithState(step, ",".join(f"{p}" for p in schema.split(",")) + ",admitted boolean", "level double, last double", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is and return its rows, from a table in the shared folder."""
    from .state import shared, start_into, table

    spark: SparkSession = stream.sparkSession
    folder = shared(spark, name)
    start_into(stream, folder, mode).awaitTermination()
    return table(spark, folder, stream.schema, mode)


def expiring(stream: DataFrame, key: str, at: str, ttl: str) -> DataFrame:
    """Sessions of each key that end ``ttl`` after their last row: what is held until then is the state, and what comes later starts anew."""
    return stream.withWatermark(at, "0 seconds").groupBy(F.session_window(at, ttl), key).agg(F.count("*").alias("n"), F.max(at).alias("last"))


def admitted(stream: DataFrame, key: str, at: str, rest_seconds: float) -> DataFrame:
    """Rows of a key at least ``rest_seconds`` after the last that was admitted; within a micro-batch in order of time."""
    schema, names = stream.schema.simpleString()[7:-1], stream.columns

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        last, keep = state.get[0] if state.exists else None, []
        for t in rows[at]:
            now = t.timestamp()
            keep.append(last is None or now - last >= rest_seconds)
            last = now if keep[-1] else last
        state.update((float(last),))
        yield rows[keep][names]

    return stream.groupBy(key).applyInPandasWithState(step, schema, "last double", "append", GroupStateTimeout.NoTimeout)


def two_speed(backlog: DataFrame, tier: str, fast, slow, folder: str, fast_every: str = "30 seconds", slow_every: str = "300 seconds", once: bool = False):
    """Two streams over one backlog: ``fast`` for each micro-batch of tier 2, ``slow`` for those of tier 3; ``folder`` keeps their progress."""
    out = []
    for level, action, every in ((2, fast, fast_every), (3, slow, slow_every)):
        w = backlog.filter(F.col(tier) == level).writeStream.foreachBatch(action).option("checkpointLocation", f"{folder}/tier-{level}")
        out.append((w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start())
    return out


def bounded(spark: SparkSession, schema, folder: str, files: int) -> DataFrame:
    """A source that takes ``files`` files at most for each micro-batch: what waits stays in the folder, and nothing is dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
