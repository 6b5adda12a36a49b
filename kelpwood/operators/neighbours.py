"""Joins of vectors with their neighbours, exact: the k nearest of each, and the groups that likeness links.

Vectors are dealt into blocks by their nearest pivot, and blocks are compared in pairs. Pairs that the triangle inequality rules out are never formed; on
vectors without structure it rules out little, and the work is quadratic. Blocks that are searched are written once, and read again by each task that compares
them with a part of ``HELD`` bytes: what is exchanged is one list of found rows for each block and part, not the blocks of each pair.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed, components

ROWS = 1024  # of a block
PIVOTS = 1024
HELD = 64 << 20  # bytes of blocks that a task holds
BLOCK = "block long, cell int, ids binary, x binary"
FOUND = "block long, ids binary, nbr binary, d binary"


# ----------------------------------------------------------------- blocks
def dealt(df: DataFrame, key: str, vector: str, unit: bool = False) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray] | None:
    """id, x, cell, block of the usable vectors (scaled to length 1 if ``unit``); distances between pivots; rows and radius of each pivot's cell."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & (F.abs(e) < 1e150))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")).filter(fine & F.col("id").isNotNull())
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return None
    rows = rows.filter(F.size("v") == common.n).groupBy("id").agg(F.min("v").alias("v"))
    if unit:
        size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))
        rows = rows.withColumn("n", size).filter("n > 0").select("id", F.transform("v", lambda e: e / F.col("n")).alias("v"))
    rows = checkpointed(rows)
    count = rows.count()
    if not count:
        return None
    few = rows.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, math.ceil(math.sqrt(count)))).collect()
    pivot = np.array([r.v for r in few])
    middle = pivot.mean(axis=0)
    pivot -= middle

    def near(batches):
        for batch in batches:
            x = np.asarray(batch.column("v").flatten()).reshape(-1, len(middle)) - middle
            d = (x * x).sum(1)[:, None] + (pivot * pivot).sum(1) - 2 * x @ pivot.T
            cell = d.argmin(axis=1)
            r = np.sqrt(((x - pivot[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([e.tobytes() for e in x], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(r)], ["id", "x", "cell", "r"])

    placed = checkpointed(rows.mapInArrow(near, "id long, x binary, cell int, r double"))
    n, radius = np.zeros(len(pivot), np.int64), np.zeros(len(pivot))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("r")).collect():
        n[r.cell], radius[r.cell] = r.n, r.r
    parts = F.lit([math.ceil(c / ROWS) or 1 for c in n.tolist()])
    block = F.col("cell").cast("long") * (1 << 32) + F.pmod(F.xxhash64("id"), F.get(parts, "cell"))
    apart = np.sqrt(np.maximum((pivot * pivot).sum(1)[:, None] + (pivot * pivot).sum(1) - 2 * pivot @ pivot.T, 0))
    return placed.select("id", "x", "cell", block.alias("block")), apart, n, radius * (1 + 1e-9)


def packed(points: DataFrame) -> DataFrame:
    """One row for each block of points (id, x, cell, block), its ids ascending."""

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, x = pa.array([t.column("id").to_numpy().tobytes()], pa.binary()), pa.array([b"".join(t.column("x").to_pylist())], pa.binary())
        return pa.table([t.column("block")[:1], t.column("cell")[:1], ids, x], ["block", "cell", "ids", "x"])

    return checkpointed(points.select("id", "x", "cell", "block").groupBy("block", "cell").applyInArrow(one, BLOCK))


def pairs(blocks: DataFrame, cells: np.ndarray) -> DataFrame:
    """Pairs of blocks, each once, of the wanted pairs of cells (a boolean matrix; at most PIVOTS squared)."""
    i, j = np.nonzero(np.triu(cells | cells.T))
    spark = blocks.sparkSession
    wanted = F.broadcast(spark.createDataFrame(pd.DataFrame({"cell": i.astype(np.int32), "other": j.astype(np.int32)}), "cell int, other int"))
    other = blocks.select(*[F.col(c).alias("other" if c == "cell" else f"{c}2") for c in blocks.columns])
    return blocks.join(wanted, "cell").join(other, "other").filter((F.col("cell") != F.col("other")) | (F.col("block") <= F.col("block2")))


def met(blocks: DataFrame, cells: np.ndarray) -> DataFrame:
    """Each block with each that it is to be compared with (columns ending in 2), itself too, of the wanted pairs of cells (a boolean matrix, in both orders).

    Those of one block follow each other in a task. The blocks (a written table) are read again for each part of them, not exchanged.
    """
    cells = cells | cells.T
    some = np.flatnonzero(cells.any(axis=1))
    wanted = pd.DataFrame({"cell": some.astype(np.int32), "near": [cells[c].tobytes() for c in some]})
    mine = blocks.join(F.broadcast(blocks.sparkSession.createDataFrame(wanted, "cell int, near binary")), "cell")
    other = mine.drop("near").select(*[F.col(c).alias(f"{c}2") for c in blocks.columns])
    held = blocks.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    other = other.coalesce(math.ceil(held / HELD) or 1).hint("shuffle_replicate_nl")
    return mine.join(other, F.substring("near", F.col("cell2") + 1, F.lit(1)) == F.lit(b"\x01")).drop("near")


def unpacked(row: dict, mark: str = "") -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"ids{mark}"], np.int64)
    return ids, np.frombuffer(row[f"x{mark}"], np.float64).reshape(len(ids), -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))


def by_row(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: v[0] for c, v in batch.slice(i, 1).to_pydict().items()}


def by_block(batches):
    """The rows of ``met``, those of each block together."""
    return (rows for _, rows in groupby(by_row(batches), lambda r: r["block"]))


# ----------------------------------------------------------------- the k-nearest join
class _Best:
    """The ``k`` nearest of a block's points among those of the blocks seen."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k, self.size = ids, x, k, (x * x).sum(1)
        self.d, self.nbr = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def see(self, its: np.ndarray, y: np.ndarray, same: bool) -> None:
        n, size = len(self.ids), (y * y).sum(1)
        m = self.size[:, None] + size - 2 * self.x @ y.T
        if same:
            np.fill_diagonal(m, np.inf)
        worst = self.d[:, -1]
        near = m <= (worst * worst * (1 + 1e-9) + 1e-11 * (self.size + size.max()))[:, None]  # these distances are rounded
        some = self.k + 8
        if np.count_nonzero(near) <= n * some:
            i, j = np.nonzero(near)
        else:
            some = min(some, len(its))
            i = np.repeat(np.arange(n), some)
            j = np.argpartition(m, some - 1, axis=1)[:, :some].ravel() if some < len(its) else np.tile(np.arange(len(its)), n)
        d = np.sqrt(((self.x[i] - y[j]) ** 2).sum(1))
        keep = (d <= worst[i]) & (self.ids[i] != its[j])
        self.new.append((i[keep], its[j[keep]], d[keep]))
        self.waiting += len(self.new[-1][0])
        if self.waiting >= n * self.k:
            self.fold()

    def fold(self) -> None:
        n, k = self.d.shape
        i, nbr, d = (np.concatenate(c) for c in zip((np.repeat(np.arange(n), k), self.nbr.ravel(), self.d.ravel()), *self.new, strict=True))
        order = np.lexsort((nbr, d, i))
        count = np.bincount(i, minlength=n)
        order = order[np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count) < k]
        self.nbr, self.d, self.new, self.waiting = nbr[order].reshape(n, k), d[order].reshape(n, k), [], 0


def _nearest_rows(k: int):
    def run(batches):
        for rows in by_block(batches):
            best = None
            for row in rows:
                best = best or _Best(*unpacked(row), k)
                best.see(*unpacked(row, "2"), row["block"] == row["block2"])
            best.fold()
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), *[pa.array([z.tobytes()], pa.binary()) for z in (best.ids, best.nbr, best.d)]], ["block", "ids", "nbr", "d"])

    return run


def _merged(k: int):
    def one(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        ids = np.frombuffer(rows[0]["ids"], np.int64)
        nbr = np.concatenate([np.frombuffer(r["nbr"], np.int64).reshape(len(ids), -1) for r in rows], axis=1)
        d = np.concatenate([np.frombuffer(r["d"], np.float64).reshape(len(ids), -1) for r in rows], axis=1)
        order = np.lexsort((nbr, d), axis=1)[:, :k]
        out = [np.take_along_axis(z, order, 1) for z in (nbr, d)]
        return pa.table([t.column("block")[:1], pa.array([rows[0]["ids"]], pa.binary()), *[pa.array([z.tobytes()], pa.binary()) for z in out]], ["block", "ids", "nbr", "d"])

    return one


def _lists(batches):
    for row in by_row(batches):
        ids = np.frombuffer(row["ids"], np.int64)
        nbr, d = np.frombuffer(row["nbr"], np.int64), np.frombuffer(row["d"], np.float64)
        ends = pa.array(np.arange(0, len(nbr) + 1, len(nbr) // len(ids), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(ends, pa.array(nbr)), pa.ListArray.from_arrays(ends, pa.array(d))], ["id", "nbr", "d"])


def nearest(blocks: DataFrame, k: int, apart: np.ndarray, n: np.ndarray, radius: np.ndarray) -> DataFrame:
    """id, nbr, d: the k nearest others of each point of the ``packed`` blocks, nearest first, exactly."""
    there = n > 0
    reach = np.where(there, apart + radius, np.inf)
    order = np.argsort(reach, axis=1)
    enough = (np.cumsum(n[order], axis=1) > k).argmax(axis=1)
    most = radius + np.take_along_axis(reach, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0]  # all of a cell have k others within it
    least = apart - radius[:, None] - radius
    wanted = there[:, None] & there & (least <= np.maximum(most[:, None], most) * (1 + 1e-9))
    merged = met(blocks, wanted).mapInArrow(_nearest_rows(k), FOUND).groupBy("block").applyInArrow(_merged(k), FOUND)
    return checkpointed(merged.mapInArrow(_lists, "id long, nbr array<long>, d array<double>"))


def k_nearest(df: DataFrame, key: str, vector: str, k: int, unit: bool = True) -> DataFrame:
    """id, nbr, d: the ``k`` nearest others (all, if fewer), nearest first, ties to the lesser id; by cosine if ``unit`` (d is the distance of unit vectors).

    Rows without an id, and vectors that are null or empty, of an uncommon length, with null or non-finite entries, or zero if ``unit``, take no part.
    """
    found = dealt(df, key, vector, unit)
    if found is None or found[2].sum() < 2:
        return df.sparkSession.createDataFrame([], "id long, nbr array<long>, d array<double>")
    points, apart, n, radius = found
    return nearest(packed(points), int(min(k, n.sum() - 1)), apart, n, radius)


def _linking_rows(far: float):
    """Links that span what is within ``far`` of each other in a pair of blocks: at most one for each of its points."""

    def run(batches):
        for row in by_row(batches):
            (ids, x), (ids2, y) = unpacked(row), unpacked(row, "2")
            near = distances(x, y) <= far
            label = np.arange(len(ids))
            while True:
                other = np.where(near, label[:, None], len(ids)).min(axis=0)
                new = np.minimum(label, np.where(near, other, len(ids)).min(axis=1))
                if (new == label).all():
                    break
                label = new
            some = other < len(ids)
            a, b = np.concatenate([ids, ids2[some]]), ids[np.concatenate([label, other[some]])]
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    return run


def like_groups(df: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """id, label: single-link groups of all rows by a cosine of ``least`` at least; the label is the least id. Vectors that take no part (see ``k_nearest``) are groups of one."""
    ids = df.select(F.col(f"`{key}`").cast("long").alias("id")).distinct()
    found = dealt(df, key, vector, True)
    if found is None:
        return ids.select("id", F.col("id").alias("label"))
    points, apart, n, radius = found
    far = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-12
    wanted = (n > 0)[:, None] & (n > 0) & (apart - radius[:, None] - radius <= far)
    blocks = packed(points)
    label = components(checkpointed(pairs(blocks, wanted).mapInArrow(_linking_rows(far), "a long, b long").distinct()))
    return ids.join(label, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
