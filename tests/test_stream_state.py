"""Keyed state with timers and streams into tables, against plain folds over the same rows."""

import random

from pyspark.sql import functions as F

from kelpwood.streaming import state

SCHEMA = "id long, k string, t double"


def batch_rows(seed, n, spread):
    """Rows whose order of arrival differs from that of time by less than ``spread`` seconds; ties, null keys."""
    rnd = random.Random(seed)
    times = sorted(round(rnd.random() * 20_000, 1) // 5 * 5 for _ in range(n))
    rows = [(i, rnd.choice(["a", "a", "a", "b", None]), t) for i, t in enumerate(times)]
    return sorted(rows, key=lambda r: r[2] + rnd.random() * spread)


def write(spark, rows, folder, n):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")


def source(spark, folder):
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    return s.withColumn("at", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))


def run(spark, stream, folder):
    state.start_into(stream, folder).awaitTermination()
    return {r["id"]: (r["key"], r["verdict"]) for r in state.table(spark, folder, stream.schema).collect()}


def plain_cooldown(rows, rest):
    last, out = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        ok = k not in last or t - last[k] >= rest
        if ok:
            last[k] = t
        out[i] = (k, ok)
    return out


def plain_bucket(rows, rate, burst):
    held, out = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        level, last = held.get(k, (burst, t))
        level = min(burst, level + (t - last) / 60 * rate)
        out[i] = (k, level >= 1)
        held[k] = (level - (level >= 1), t)
    return out


def passed(rows, late):
    end = max(r[2] for r in rows) - late
    return {r[0] for r in rows if r[2] < end}


def test_stream_is_batch_whatever_the_order(spark, tmp_path):
    """Five files, one a micro-batch, out of order by up to ten minutes under a watermark of an hour."""
    rows = batch_rows(1, 400, 600)
    for n in range(5):
        write(spark, rows[n * 80 : (n + 1) * 80], str(tmp_path / "in"), n)
    s = source(spark, str(tmp_path / "in"))
    seen = passed(rows, 3600)
    got = run(spark, state.cooldown(s, "k", "id", "at", 300, "1 hour"), str(tmp_path / "a"))
    assert got == {i: v for i, v in plain_cooldown(rows, 300).items() if i in seen} and len({v for _, v in got.values()}) == 2
    got = run(spark, state.bucket(s, "k", "id", "at", 0.5, 2, "1 hour"), str(tmp_path / "b"))
    assert got == {i: v for i, v in plain_bucket(rows, 0.5, 2).items() if i in seen} and len({v for _, v in got.values()}) == 2


def test_restart_resumes_state(spark, tmp_path):
    """A second run takes up what the first one held: the table is that of one run over all files, each row once."""
    rows = batch_rows(2, 300, 600)
    write(spark, rows[:150], str(tmp_path / "in"), 0)
    stream = lambda: state.cooldown(source(spark, str(tmp_path / "in")), "k", "id", "at", 900, "1 hour")
    first = run(spark, stream(), str(tmp_path / "out"))
    assert set(first) == passed(rows[:150], 3600)
    write(spark, rows[150:], str(tmp_path / "in"), 1)
    both = run(spark, stream(), str(tmp_path / "out"))
    assert both == {i: v for i, v in plain_cooldown(rows, 900).items() if i in passed(rows, 3600)} and first.items() <= both.items()
    assert state.table(spark, str(tmp_path / "out"), stream().schema).count() == len(both)
    assert run(spark, stream(), str(tmp_path / "out")) == both


def test_a_batch_done_again_replaces_itself(spark, tmp_path):
    """The last commit of the progress is lost: its batch runs again and the table stays the same."""
    write(spark, [(1, "a", 1.0), (2, "b", 2.0)], str(tmp_path / "in"), 0)
    plain = lambda: source(spark, str(tmp_path / "in")).select("id", "k")
    folder = tmp_path / "out"
    state.start_into(plain(), str(folder)).awaitTermination()
    commits = sorted((folder / "progress" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (folder / "progress" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    state.start_into(plain(), str(folder)).awaitTermination()
    assert sorted(map(tuple, state.table(spark, str(folder), plain().schema).collect())) == [(1, "a"), (2, "b")]


def test_empty_and_odd_rows(spark, tmp_path):
    """No rows: an empty table of the same columns; rows without time or id are left out."""
    write(spark, [], str(tmp_path / "none"), 0)
    s = state.cooldown(source(spark, str(tmp_path / "none")), "k", "id", "at", 60, "0 seconds")
    assert run(spark, s, str(tmp_path / "a")) == {} and state.table(spark, str(tmp_path / "never"), s.schema).columns == ["key", "id", "at", "verdict"]
    write(spark, [(1, "a", None), (None, "a", 5.0), (2, None, 7.0), (3, "a", 9.0), (4, "z", 500.0)], str(tmp_path / "odd"), 0)
    s = state.cooldown(source(spark, str(tmp_path / "odd")), "k", "id", "at", 60, "0 seconds")
    assert run(spark, s, str(tmp_path / "b")) == {2: (None, True), 3: ("a", True)}


def test_whole_results_keep_the_last_batch(spark, tmp_path):
    for n in range(2):
        write(spark, [(n, "a", float(n)), (n + 5, "b", 1.0)], str(tmp_path / "in"), n)
    s = source(spark, str(tmp_path / "in")).groupBy("k").agg(F.count("*").alias("n"))
    state.start_into(s, str(tmp_path / "out"), "complete").awaitTermination()
    assert sorted(map(tuple, state.table(spark, str(tmp_path / "out"), s.schema, "complete").collect())) == [("a", 2), ("b", 2)]
