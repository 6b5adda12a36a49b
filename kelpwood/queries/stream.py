"""Queries that run a stream over a table's files once, and planner queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..plans.planner import plan
from ..registry import query
from ..sources.tables import Tables
from ..streaming import operators as O
from ..streaming import state as S


def _events(t: Tables):
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder).withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream, mode="append"):
    return O.run_available(stream, "q" + uuid.uuid4().hex, mode)


@query("select user_id, event_type, count(*) as n from (select distinct user_id, event_type from events) group by 1, 2")
def dedup_stream(t: Tables):
    """One row per key within a watermark of a year: the same as distinct."""
    return _run(O.dedup(_events(t), ["user_id", "event_type"], "ts", "365 days").select("user_id", "event_type")).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("select event_type, time_bucket(interval 1 day, ts) as day, count(*) as n from events group by 1, 2")
def windowed_counts(t: Tables):
    return _run(O.counts(_events(t), "ts", "1 day", "event_type"), "complete").select("event_type", F.col("window.start").alias("day"), "n")


@query()
def token_bucket(t: Tables):
    return _run(O.token_bucket(_events(t).select("event_id", "user_id", "ts"), "user_id", "ts", 1 / 600, 3))


_PASSED = "ts < (select max(ts) - interval 1 day from events)"


@query(f"""with e as (select user_id, list([epoch_us(ts)] order by ts, event_id) as l from events where {_PASSED} group by 1),
a as (select user_id, unnest(list_reduce(l, lambda s, x: case when x[1] - s[-1] >= 43200000000 then list_append(s, x[1]) else s end)) as us from e)
select user_id::varchar as user_id, us, count(*) as n from a group by 1, 2""")
def cooldown_stream(t: Tables):
    """Times at which a key that rests for twelve hours speaks, of all rows that the watermark has passed."""
    s = S.cooldown(_events(t).select("event_id", "user_id", "ts"), "user_id", "event_id", "ts", 43200, "1 day")
    return _run(s).filter("verdict").groupBy(F.col("key").alias("user_id"), F.unix_micros("at").alias("us")).agg(F.count("*").alias("n"))


@query(f"""with e as (select user_id, list([0, 3.0, epoch_us(ts)]::double[] order by ts, event_id) as l from events where {_PASSED} group by 1),
f as (select user_id, list_reduce(list_prepend([0, 3.0, -1]::double[], l), lambda s, x: [s[1] + case when (case when s[3] < 0 then 3.0 else least(3.0, s[2] + (x[3] - s[3]) / 36e9) end) >= 1 then 1 else 0 end,
  case when (case when s[3] < 0 then 3.0 else least(3.0, s[2] + (x[3] - s[3]) / 36e9) end) >= 1 then (case when s[3] < 0 then 3.0 else least(3.0, s[2] + (x[3] - s[3]) / 36e9) end) - 1 else (case when s[3] < 0 then 3.0 else least(3.0, s[2] + (x[3] - s[3]) / 36e9) end) end, x[3]]) as r, len(l) as n from e)
select user_id::varchar as user_id, n::bigint as n, r[1]::bigint as admitted from f""")
def bucket_stream(t: Tables):
    """Rows that a bucket of three tokens, one every ten hours, lets pass."""
    s = S.bucket(_events(t).select("event_id", "user_id", "ts"), "user_id", "event_id", "ts", 1 / 600, 3, "1 day")
    return _run(s).groupBy(F.col("key").alias("user_id")).agg(F.count("*").alias("n"), F.count_if("verdict").alias("admitted"))


@query("select * from (values ('what did I promise last week', 'temporal'), ('merge duplicates now please', 'direct_lookup'), ('how is a related to b', 'relation_chain'), ('consolidate memory', 'consolidate')) v(question, action)")
def plan_questions(t: Tables):
    asked = ["what did I promise last week", "merge duplicates now please", "how is a related to b", "consolidate memory"]
    return t.spark.createDataFrame([(q, plan(q).action) for q in asked], "question string, action string")
