"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Keys are inserted in the order of their place on the ring; a key goes to the first shard clockwise that is not full. All keys
between two virtual nodes meet the same shards in the same order, so only the number of keys of each arc decides how many of
them go where: a fold over the arcs (as many as virtual nodes, whatever the data) gives for each arc its runs of keys, and a key's rank
on its arc tells the run. Ranks are counted in cells, fixed slices of the ring, so that no task sorts more than a cell. A key that holds more than
``1 / HOT_KEYS`` of all rows is dealt into parts behind its cell, by a hash of the whole row, so that it is many tasks.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import internal

RING = 1 << 32
CELL_BITS = 19  # RING >> CELL_BITS: 8192 slices
HOT_KEYS, PARTS = 1024, 32  # so many keys at most can be hot, whatever the rows; parts of each


def ring_nodes(shards: int, virtual: int) -> list[tuple[int, list[int]]]:
    """Each virtual node's place and the shards from it clockwise, each once."""
    at = sorted((int(hashlib.md5(f"shard-{s}-{v}".encode()).hexdigest()[:8], 16), s) for s in range(shards) for v in range(virtual))
    out = []
    for i, (place, _) in enumerate(at):
        order: list[int] = []
        for j in range(len(at)):
            s = at[(i + j) % len(at)][1]
            if s not in order:
                order.append(s)
                if len(order) == shards:
                    break
        out.append((place, order))
    return out


def place_of(key) -> F.Column:
    """A key's place on the ring: the first 32 bits of its text's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = 8, virtual: int = 128, epsilon: float = 0.0) -> DataFrame:
    """All columns of ``df`` and shard int, slot long (gapless from 0 in each shard, in ring order).

    A shard holds at most ceil((1 + epsilon) * rows / shards) rows. With ``epsilon`` 0 capacities add up to the rows exactly, so counts are at
    most one apart; a larger ``epsilon`` moves fewer keys when shards are added. Rows of one key sit side by side; any number of equal
    keys may overflow to the next shards. Null keys are one key. Ties and repeated rows are told apart by no column: any order of
    them gives the same shards. Very long keys are hashed whole. Empty table: empty result. Columns named shard or slot are replaced; all
    others may have any name.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ("shard", "slot")])
    spark, names = df.sparkSession, df.columns
    place, arc, cell, hot, part = (internal(df, x) for x in ("place", "arc", "cell", "hot", "part"))
    rank, first, within, before, runs_of, run_of = (internal(df, x) for x in ("rank", "first", "within", "before", "runs", "run"))
    nodes = ring_nodes(shards, virtual)
    starts = [p for p, _ in nodes]
    # the arc of a place: the first virtual node at or after it; a lookup by slice, then over the few nodes in the slice
    slices = RING >> CELL_BITS
    lower = [bisect_left(starts, i << CELL_BITS) for i in range(slices + 1)]
    rows = [(i, lower[i], starts[lower[i] : lower[i + 1]]) for i in range(slices)]
    table = F.broadcast(spark.createDataFrame(rows, f"{cell} long, {first} int, {within} array<long>"))  # ``slices`` rows
    base = df.withColumn(place, place_of(F.col(f"`{key}`"))).withColumn(cell, F.shiftright(place, CELL_BITS))

    def on_arc(d: DataFrame) -> DataFrame:
        passed = F.size(F.filter(within, lambda x: x < F.col(place)))
        return d.join(table, cell).withColumn(arc, (F.col(first) + passed) % len(nodes)).drop(first, within)

    by_place = base.groupBy(F.col(place).alias(hot)).agg(F.count("*").alias("n"))
    share = F.broadcast(base.agg((F.count("*") / HOT_KEYS).alias("share")))
    hot_places = F.broadcast(by_place.join(share).filter("n > share and n > 10000").select(hot))  # HOT_KEYS rows at most
    whole_row = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    parts = on_arc(base).join(hot_places, F.col(place) == F.col(hot), "left").withColumn(hot, F.coalesce(hot, F.lit(-1)))
    parts = parts.withColumn(part, F.when(F.col(hot) < 0, 0).otherwise(F.pmod(F.xxhash64(*whole_row), F.lit(PARTS))))
    counts = parts.groupBy(cell, arc, hot, part).agg(F.count("*").alias("n"))
    # a slice before the first node and one after the last are of one arc: ring order of cells starts behind the last node
    turn = F.when((F.col(arc) == 0) & (F.col(cell) > (starts[0] >> CELL_BITS)), F.col(cell) - slices).otherwise(F.col(cell))
    so_far = F.sum("n").over(Window.partitionBy(arc).orderBy("turn", hot, part).rowsBetween(Window.unboundedPreceding, -1))
    cells = counts.withColumn("turn", turn).withColumn(before, F.coalesce(so_far, F.lit(0)))

    order = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(nodes)], f"{arc} int, prefer array<int>")
    arcs = cells.groupBy(arc).agg(F.sum("n").alias("n")).join(F.broadcast(order), arc)
    listed = arcs.agg(F.sort_array(F.collect_list(F.struct(F.col(arc).alias("arc"), "n", "prefer"))).alias("arcs"), F.sum("n").alias("total"))
    each = F.sequence(F.lit(0), F.lit(shards - 1))
    if epsilon:
        room = F.transform(each, lambda s: F.ceil(F.col("total") * (1 + epsilon) / shards).cast("long"))
    else:
        one_more = lambda s: F.when(s < F.col("total") % shards, 1).otherwise(0)
        room = F.transform(each, lambda s: (F.floor(F.col("total") / shards) + one_more(s)).cast("long"))
    visit = lambda a: F.transform(a["prefer"], lambda s: F.struct(a["arc"].alias("arc"), a["n"].alias("n"), s.alias("s"), (s == a["prefer"][0]).alias("new")))
    steps = F.flatten(F.transform("arcs", visit))
    none = F.expr("cast(array() as array<struct<arc:int,shard:int,start:bigint,n:bigint,slot:bigint>>)")
    zero = F.struct(F.lit(0).cast("long").alias("left"), F.col("room"), none.alias("runs"))

    def step(acc, x):
        left = F.when(x["new"], x["n"]).otherwise(acc["left"])
        have = F.get(acc["room"], x["s"])
        take = F.least(left, have)
        run = F.struct(x["arc"].alias("arc"), x["s"].alias("shard"), (x["n"] - left).alias("start"), take.alias("n"), have.alias("slot"))
        return F.struct(
            (left - take).alias("left"),
            F.when(take > 0, F.transform(acc["room"], lambda r, i: F.when(i == x["s"], r - take).otherwise(r))).otherwise(acc["room"]).alias("room"),
            F.when(take > 0, F.concat(acc["runs"], F.array(run))).otherwise(acc["runs"]).alias("runs"),
        )

    folded = listed.withColumn("room", room).withColumn("full", room).select("full", F.aggregate(steps, zero, step).getField("runs").alias("runs"))
    slot = (F.get("full", F.col("r.shard")) - F.col("r.slot")).alias("slot")
    runs = folded.select("full", F.explode("runs").alias("r")).select(F.col("r.arc").alias(arc), F.struct("r.start", "r.n", "r.shard", slot).alias("r"))
    # at most a row for each slice, node and part of a hot key
    plan = cells.select(cell, arc, hot, part, before).join(runs.groupBy(arc).agg(F.collect_list("r").alias(runs_of)), arc)

    w = Window.partitionBy(cell, arc, hot, part).orderBy(place, F.col(f"`{key}`").asc_nulls_first())
    ranked = parts.withColumn(rank, F.row_number().over(w) - 1)
    got = ranked.join(F.broadcast(plan), [cell, arc, hot, part]).withColumn(rank, F.col(rank) + F.col(before))
    mine = F.filter(runs_of, lambda r: (F.col(rank) >= r["start"]) & (F.col(rank) < r["start"] + r["n"]))[0]
    slot = (F.col(f"{run_of}.slot") + F.col(rank) - F.col(f"{run_of}.start")).cast("long")
    return got.withColumn(run_of, mine).select(*[F.col(f"`{c}`") for c in names], F.col(f"{run_of}.shard").alias("shard"), slot.alias("slot"))
