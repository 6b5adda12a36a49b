"""Approximate nearest neighbours: inverted lists, product-quantised residuals, asymmetric distances, exact reranking.

* Fit: coarse centroids (about the square root of the rows) and 256 codewords for each part of the residual, by k-means on a bounded sample
  (``sample`` rows, equal vectors once). How many lists are probed is learned there as well: what held-out sample queries need for the target recall.
* Index: every row goes to its nearest centroid's list with its residual's code, beside the vector itself; written to the shared folder.
* Search: each query probes the lists with the largest inner products of their centroids. A list's rows and its queries are
  dealt in blocks of bounded size, so a list that holds a third of all rows, or of all queries, is many tasks. In a block, scores are summed
  from tables of the query's products with the codewords; the codes that score best are reranked by exact products in double precision.
* Check: a list can hold more of a query's nearest only where the product with its centroid, plus the query's length times the list's radius, reaches the
  last score found (nor can it where the lengths alone don't). Such lists are compared exactly, in the same blocks, so nothing is missed,
  whatever the sample and the queries are like. Where vectors cluster that is few lists; without structure it is most of them, which is quadratic work.

The model sees vectors times a power of two, so that single precision holds them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PARTS = 16
BLOCK = 8192  # rows or queries that a task holds at once


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (c * c).sum(1) / 2
    for i in range(0, len(x), 8192):
        out[i : i + 8192] = (x[i : i + 8192] @ c.T - half).argmax(1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


class Quantizer:
    """Coarse centroids and codewords of residuals."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int = PARTS):
        x = np.unique(sample.astype(np.float32), axis=0)
        self.dim = x.shape[1]
        self.parts = next(p for p in range(min(parts, self.dim), 0, -1) if self.dim % p == 0)
        self.coarse = kmeans(x, lists)
        rest = (x - self.coarse[_nearest(x, self.coarse)]).reshape(len(x), self.parts, -1)
        self.words = []
        for p in range(self.parts):
            c = kmeans(np.ascontiguousarray(rest[:, p]), 256, rounds=8)
            self.words.append(np.vstack([c, np.zeros((256 - len(c), c.shape[1]), np.float32)]) if len(c) < 256 else c)
        self.words = np.array(self.words)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = _nearest(x, self.coarse)
        rest = (x - self.coarse[at]).reshape(len(x), self.parts, -1)
        return at, np.stack([_nearest(np.ascontiguousarray(rest[:, p]), self.words[p]) for p in range(self.parts)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of each query's parts with the codewords: queries x parts x 256."""
        return np.einsum("qpd,pwd->qpw", q.reshape(len(q), self.parts, -1), self.words, optimize=True)


def _matrix(col, dtype) -> np.ndarray:
    """Fixed-width rows of a binary column."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.array([np.frombuffer(v.as_buffer(), dtype) for v in col]) if len(col) else np.zeros((0, 1), dtype)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id long, v array<double>: vectors without null or non-finite components that aren't zero, of the most common length."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    base = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    base = base.filter(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    top = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return base.filter(F.size("v") == (top[0]["d"] if top else -1))


def _pack_rows(batches):
    for b in batches:
        lists = b.column("v")
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        d = len(flat) // max(1, b.num_rows)
        rows = flat.reshape(b.num_rows, d)
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([r.tobytes() for r in rows], pa.binary())], ["vec_id", "v"])


def probes_needed(quant: Quantizer, x: np.ndarray, k: int, target: float, asked: int = 256) -> int:
    """The least number of lists in which ``asked`` rows of a sample have ``target`` of their ``k`` nearest among the others, on average."""
    x = x.astype(np.float32)
    q = x[:asked]
    score = q @ x.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    order = np.argsort(-(q @ quant.coarse.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    need = np.take_along_axis(place, _nearest(x, quant.coarse)[near], axis=1)
    return int(np.searchsorted(np.cumsum(np.bincount(need.reshape(-1), minlength=len(quant.coarse))), target * need.size)) + 1


def search(df: DataFrame, queries: DataFrame | None = None, k: int = 20, key: str = "vec_id", vector: str = "embedding", sample: int = 32768, most_lists: int = 4096, target: float = 0.96, rerank: int = 128) -> DataFrame:
    """The ``k`` rows of ``df`` with the largest inner product with each query: query_id long, rank int, vec_id long, score double.

    ``queries``: rows of ``df`` that are the queries, by default those whose id is divisible by 20. A query's own row is no candidate.
    Nearest first, ties to the smaller id. So many lists are probed that held-out sample queries find ``target`` of their neighbours there, and always lists
    with 20 * k rows; ``rerank`` distinct codes in each block are reranked exactly, and what lists may hold beyond that is checked exactly. Vectors that are null, zero, of another length than most or
    hold null or non-finite components take no part, nor do rows without an id. Rows with one id count once (their best); of several vectors of a query's id the
    greatest asks. Repeated and equal vectors share a code, and all of them are reranked. Empty table: empty result.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    base = usable(df, key, vector)
    n = base.count()
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    h = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    share = min(1.0, 1.3 * sample / n)
    some = base.filter(h < int(share * (1 << 30))).limit(2 * sample).mapInArrow(_pack_rows, "vec_id long, v binary").select(h.alias("h"), "vec_id", "v").collect()
    some = sorted((r["h"], r["vec_id"], bytes(r["v"])) for r in some)[:sample]  # even over all ids
    if not some:
        some = [(0, r["vec_id"], np.array(r["v"]).tobytes()) for r in base.limit(sample).collect()]
    most = base.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    scale = 2.0 ** float(np.clip(-np.ceil(np.log2(most)), -1000, 1000))
    x = np.array([np.frombuffer(v, np.float64) for *_, v in some]) * scale
    quant = Quantizer(x, max(1, min(most_lists, len(x) // 8, round(n**0.5))))
    lists, centres = len(quant.coarse), quant.coarse.astype(np.float64)
    probes = min(lists, probes_needed(quant, x, k, target))

    def index_rows(batches):
        for b in _pack_rows(batches):
            if b.num_rows:
                x = _matrix(b.column("v"), np.float64) * scale
                at, code = quant.encode(x.astype(np.float32))
                far, size = np.linalg.norm(x - centres[at], axis=1), np.linalg.norm(x, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column("vec_id"), pa.array([c.tobytes() for c in code], pa.binary()), b.column("v"), pa.array(far), pa.array(size)], ["list", "vec_id", "code", "v", "far", "size"])

    index = materialize(base.mapInArrow(index_rows, "list int, vec_id long, code binary, v binary, far double, size double"), "ann")
    held, radius, longest = np.zeros(lists, np.int64), np.zeros(lists), np.zeros(lists)
    for r in index.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("size").alias("size")).collect():  # at most most_lists rows
        held[r["list"]], radius[r["list"]], longest[r["list"]] = r["n"], r["far"], r["size"]
    # lists share a cell up to BLOCK rows; a larger list has a cell of its own, dealt in blocks
    cell, rows_in = np.zeros(lists, np.int64), 0
    for i in range(1, lists):
        rows_in += held[i - 1]
        cell[i] = cell[i - 1] + (rows_in + held[i] > BLOCK)
        rows_in = 0 if cell[i] > cell[i - 1] else rows_in
    in_cell = np.bincount(cell, weights=held).astype(int)

    def probed_cells(b: pa.RecordBatch, who: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        """One row for each query (a place in ``b``) and cell, with the lists ``at`` there."""
        full = held[at] > 0
        who, at = who[full], at[full]
        order = np.lexsort((at, cell[at], who))
        who, at = who[order], at[order]
        new = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (cell[at][1:] != cell[at][:-1])])) if len(who) else np.zeros(0, int)
        lists_at = pa.ListArray.from_arrays(pa.array(np.append(new, len(who)).astype(np.int32)), pa.array(at.astype(np.int32)))
        mine = pa.array(who[new])
        return pa.RecordBatch.from_arrays([pa.array(cell[at[new]].astype(np.int32)), b.column("query_id").take(mine), b.column("v").take(mine), b.column("least").take(mine), lists_at], ["cell", "query_id", "v", "least", "lists"])

    def probe_rows(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q = _matrix(b.column("v"), np.float64) * scale
            order = np.argsort(-(q @ centres.T), axis=1, kind="stable")
            seen = np.cumsum(held[order], axis=1)
            need = np.maximum(probes, 1 + (seen < 20 * k).sum(axis=1)).clip(max=lists)
            yield probed_cells(b, np.repeat(np.arange(len(q)), need), np.concatenate([o[:m] for o, m in zip(order, need, strict=True)]))

    def check_rows(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q = _matrix(b.column("v"), np.float64) * scale
            size = np.linalg.norm(q, axis=1)[:, None]
            bound = np.minimum(q @ centres.T + size * radius, size * longest) + 1e-9 * size * (longest + radius)
            who, at = np.nonzero(~(bound < b.column("least").to_numpy(zero_copy_only=False)[:, None] * scale * scale))
            yield probed_cells(b, who, at)

    spark = df.sparkSession
    of = spark.createDataFrame([(i, int(c)) for i, c in enumerate(cell)], "list int, cell int")
    keys = ("cell", "block", "chunk")

    def compared(asked: DataFrame, probe, score) -> DataFrame:
        """query_id, vec_id, score of the rows that ``score`` finds in the lists that ``probe`` names for each query."""
        probed = materialize(asked.mapInArrow(probe, "cell int, query_id long, v binary, least double, lists array<int>"), "ann")
        asks = {r["cell"]: r["count"] for r in probed.groupBy("cell").count().collect()}
        plan = spark.createDataFrame([(i, -(-int(in_cell[i]) // BLOCK), -(-asks[i] // BLOCK)) for i in asks], "cell int, blocks int, chunks int")
        rows = index.join(F.broadcast(of), "list").join(F.broadcast(plan), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*keys, "list", "vec_id", "code", "v")
        ask = probed.join(F.broadcast(plan), "cell").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
        ask = ask.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*keys, "query_id", "v", "least", "lists")
        return rows.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInArrow(score, "query_id long, vec_id long, score double")

    asked = index.filter(F.col("vec_id") % 20 == 0) if queries is None else index.join(queries.select(F.col(f"`{key}`").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    asked = asked.groupBy(F.col("vec_id").alias("query_id")).agg(F.max("v").alias("v"))
    none = pa.table({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    def best_rows(own: int, ids: np.ndarray, vecs: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best of some rows by exact products: ids, scores."""
        exact = (vecs * q).sum(axis=1)
        exact[ids == own] = -np.inf
        top = np.lexsort((ids, -exact))
        first = np.sort(np.unique(ids[top], return_index=True)[1])  # repeated rows count once
        top = top[first]
        top = top[ids[top] != own][:k]
        return ids[top], exact[top]

    def table_of(found: list) -> pa.Table:
        return pa.table({"query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64), "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])}) if found else none

    def sides(left: pa.Table, right: pa.Table):
        """List, id and vector of the rows in order of id; id and vector of the queries; whether a query probes a list."""
        ids = left.column("vec_id").combine_chunks().to_numpy()
        order = np.argsort(ids, kind="stable")
        qid, probing = right.column("query_id").combine_chunks().to_numpy(), right.column("lists").combine_chunks()
        probed = np.zeros((len(qid), lists), bool)
        probed[np.repeat(np.arange(len(qid)), np.diff(probing.offsets.to_numpy())), probing.flatten().to_numpy()] = True
        return order, left.column("list").combine_chunks().to_numpy()[order], ids[order], _matrix(left.column("v"), np.float64)[order], qid, _matrix(right.column("v"), np.float64), probed

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return none
        order, of_row, ids, vecs, qid, q, probed = sides(left, right)
        codes = _matrix(left.column("code"), np.uint8)[order]
        # rows of one list and code share an approximate score, so repeated vectors are all reranked
        distinct, number = np.unique(np.column_stack([of_row.astype("<u4").view(np.uint8).reshape(-1, 4), codes]), axis=0, return_inverse=True)
        number = number.reshape(-1)
        by_code = np.argsort(number, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(distinct)))])
        at = np.ascontiguousarray(distinct[:, :4]).view("<u4").reshape(-1).astype(np.int64)
        here, place = np.unique(at, return_inverse=True)
        found = []
        for s in range(0, len(q), 256):
            some = q[s : s + 256] * scale
            part = quant.tables(some.astype(np.float32))
            approx = (some @ centres[here].T)[:, place]
            for p in range(quant.parts):
                approx += part[:, p, distinct[:, 4 + p]]
            approx[~probed[s : s + 256][:, here][:, place]] = -np.inf
            best = np.argpartition(-approx, rerank, axis=1)[:, :rerank] if len(distinct) > rerank else np.tile(np.arange(len(distinct)), (len(part), 1))
            for i in range(len(part)):
                mine = best[i][approx[i, best[i]] > -np.inf]
                rows_at = np.concatenate([by_code[bounds[c] : bounds[c + 1]] for c in mine]) if len(mine) else by_code[:0]
                found.append((qid[s + i], *best_rows(qid[s + i], ids[rows_at], vecs[rows_at], q[s + i])))
        return table_of(found)

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return none
        _, of_row, ids, vecs, qid, q, probed = sides(left, right)
        least = right.column("least").combine_chunks().to_numpy(zero_copy_only=False)
        scaled = (vecs * scale).T
        slack = 1e-9 * np.linalg.norm(scaled, axis=0).max()
        found = []
        for s in range(0, len(q), 256):
            some = q[s : s + 256] * scale
            near = some @ scaled
            bar = least[s : s + 256] * scale * scale - slack * np.linalg.norm(some, axis=1)
            near = ~(near < bar[:, None]) & probed[s : s + 256][:, of_row]
            for i in np.flatnonzero(near.any(axis=1)):
                rows_at = np.flatnonzero(near[i])
                found.append((qid[s + i], *best_rows(qid[s + i], ids[rows_at], vecs[rows_at], q[s + i])))
        return table_of(found)

    def ranked(found: DataFrame) -> DataFrame:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    none_yet = F.lit(float("-inf"))
    first = materialize(ranked(compared(asked.withColumn("least", none_yet), probe_rows, score)), "ann")
    last = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("last"))
    again = asked.join(last, "query_id", "left").select("query_id", "v", F.coalesce("last", none_yet).alias("least"))
    return ranked(first.select("query_id", "vec_id", "score").unionByName(compared(again, check_rows, check)))
