"""Keyed state with timers, and streams that end in tables.

Rows of a key wait in its state until the watermark has passed them and are then taken in order of time, whatever order they came in: the results are those of
a batch job over the same rows up to the watermark. A timer wakes a key when its next row is due, or when what it holds has expired; state that has expired is
cleared, so that only live keys take room. State is kept by RocksDB and its changes in the stream's checkpoint, which a restart resumes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    """Waiting rows (``at`` in microseconds, ``id``) of each key, and what the fold carries: two numbers and the time until which they matter."""

    def __init__(self, fold, kept_us: int):
        self.fold, self.kept = fold, kept_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "at array<long>, id array<long>")
        self.held = handle.getValueState("held", "level double, last long")

    def _wake(self, at: list[int], last: int | None) -> None:
        """One timer: for the first row that waits, else for the end of what is held."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = min(at) if at else (last + self.kept if last is not None else None)
        if due is not None:
            self.handle.registerTimer(due // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, ids = self.waiting.get() if self.waiting.exists() else ([], [])
        at, ids = list(at), list(ids)
        for b in rows:
            at += b["us"].tolist()
            ids += b["id"].tolist()
        self.waiting.update((at, ids))
        self._wake(at, None)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        at, ids = self.waiting.get() if self.waiting.exists() else ([], [])
        rows = sorted(zip(at, ids, strict=True))
        state = tuple(self.held.get()) if self.held.exists() else None
        done = [r for r in rows if r[0] < mark]
        out = []
        for us, i in done:
            if state is not None and us - state[1] >= self.kept:
                state = None
            verdict, state = self.fold(us, state)
            out.append((key[0], i, us, verdict))
        rest = rows[len(done) :]
        if rest:
            self.waiting.update(([r[0] for r in rest], [r[1] for r in rest]))
        else:
            self.waiting.clear()
        if state is not None and state[1] + self.kept < mark:
            state = None
        if state is None:
            self.held.clear()
        else:
            self.held.update((float(state[0]), int(state[1])))
        self._wake([r[0] for r in rest], state[1] if state else None)
        if out:
            yield pd.DataFrame(out, columns=["key", "id", "us", "verdict"]).astype({"key": object})

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, key: str, id: str, at: str, late: str, fold, kept_seconds: float) -> DataFrame:
    """``fold(us, state) -> (verdict, state)`` over each key's rows in order of time, ties by id; a state is (level, us) or None, and expires ``kept_seconds`` after its time.

    Returned are key (text), id, at and verdict of the rows that the watermark has passed; rows that come later than ``late`` are dropped, as everywhere. A row without a
    time or an id is left out; a null key is a key.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    s = stream.filter(F.col(at).isNotNull() & F.col(id).isNotNull()).withWatermark(at, late)
    s = s.select(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("key"), F.col(id).cast("long").alias("id"), F.unix_micros(at).alias("us"), F.col(at).alias("at"))
    out = s.groupBy("key").transformWithStateInPandas(_InOrder(fold, int(kept_seconds * 1_000_000)), "key string, id long, us long, verdict boolean", "Append", "EventTime")
    return out.select(F.expr("nullif(substr(key, 2), '')").alias("key"), "id", F.timestamp_micros("us").alias("at"), "verdict")


def cooldown(stream: DataFrame, key: str, id: str, at: str, rest_seconds: float, late: str) -> DataFrame:
    """verdict: at least ``rest_seconds`` after the key's last row of which that was said (a miss of a cache of that age; a prompt after its rest)."""
    return in_order(stream, key, id, at, late, lambda us, state: (state is None, state or (0.0, us)), rest_seconds)


def bucket(stream: DataFrame, key: str, id: str, at: str, rate_per_minute: float, burst: float, late: str) -> DataFrame:
    """verdict: the key's bucket, which holds ``burst`` tokens and gains ``rate_per_minute``, had one left. A bucket that has had time to fill is forgotten."""

    def fold(us, state):
        level = burst if state is None else min(burst, state[0] + (us - state[1]) / 60e6 * rate_per_minute)
        return level >= 1, (level - 1 if level >= 1 else level, us)

    return in_order(stream, key, id, at, late, fold, 60 * burst / rate_per_minute)


# ----------------------------------------------------------------- tables
def shared(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir (see ``graph.checkpointed``)."""
    from ..operators.graph import shared_folder

    return f"{shared_folder(spark)}/kelpwood/{name}-{uuid.uuid4().hex}"


def start_into(stream: DataFrame, folder: str, mode: str = "append", once: bool = True):
    """Write each micro-batch under its number, so that a batch done again after a failure replaces itself: every row is there once. The progress is kept in ``folder`` too."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")

    w = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/progress")
    return (w.trigger(availableNow=True) if once else w).start()


def table(spark: SparkSession, folder: str, schema, mode: str = "append") -> DataFrame:
    """What a stream has written: all batches, or the last one of a stream that writes its whole result each time."""
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.parquet")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], schema)
    names = [f.name for f in schema.fields]
    if mode == "complete":
        last = spark.read.schema(schema.add("batch", "long") if "batch" not in names else schema).parquet(f"{folder}/rows").agg(F.max("batch").alias("n")).first()["n"]
        return rows.parquet(f"{folder}/rows/batch={last}") if last is not None else spark.createDataFrame([], schema)
    return rows.parquet(f"{folder}/rows/batch=*")
