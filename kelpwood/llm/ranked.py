"""Ranked lexical search: exact top-k over dual-sorted wavelet trees, one for each shard of documents.

A shard is a run of documents of bounded size; texts are never exchanged. Its postings are sorted by term and falling impact, and the sequence of
their documents (numbered by id) is kept as a wavelet tree: a bit for each posting and level, partitioned stably by the bits of the document's
number. So each term's postings are an interval in every node, in order of impact (the first one is the greatest), while nodes are ranges of ids.

A search starts with each term's interval in the root and expands nodes best first: a node's bound is the sum, over the terms that meet there, of
weight times first impact; in a leaf it is the document's score. It ends when no node's bound can beat the k-th score found. Ties go to smaller ids.

Shards of a task share the k best found so far. Before the others, the shards of a root-sized part are searched: their k-th scores bound all
that follow, which drops no document of the result. Items are searched in blocks of bounded size, so what is sent to the tasks is bounded too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Words, as_array, materialize, slices, text_array, tidy

SHARD_BYTES = 32 << 20  # of text
SHARD_ROWS = 1 << 16  # documents' numbers have 16 bits
BLOCK_TERMS = 200_000  # terms of all items of a block
TOGETHER = 48  # nodes expanded at once
INDEX = "shard long, ids array<long>, terms array<string>, ends binary, impacts binary, bits binary"

#: Terms are runs of bytes that aren't ASCII, or are ASCII letters or digits; only A-Z are lower-cased.
_INSIDE = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_FOLD = np.where(_INSIDE, np.arange(256), 0x20).astype(np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


# ----------------------------------------------------------------- terms
def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    t = text_array(texts)
    bufs = t.buffers()
    off = np.frombuffer(bufs[1], np.int32)[t.offset : t.offset + len(t) + 1] if len(t) else np.zeros(1, np.int32)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def count_terms(texts: pa.Array) -> np.ndarray:
    data, off = _bytes(texts)
    inside = _INSIDE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = off[:-1][off[:-1] < len(data)]
    first[at] = inside[at]
    seen = np.concatenate([[0], np.cumsum(first)])
    return np.diff(seen[off])


def terms(texts: pa.Array) -> Words:
    data, off = _bytes(texts)
    return Words(pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(_FOLD[data])))


def _counts(batches):
    docs = total = 0
    for batch in batches:
        for part in slices(batch, "text"):
            n = count_terms(part.column("text"))
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([total])], ["docs", "total"])


# ----------------------------------------------------------------- the index of a shard
def lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """The share of a document's length in its impacts: 50 + 50 * n * docs div total."""
    if len(n) and 50 * int(n.max()) * docs >= 1 << 63:
        return np.array([50 + 50 * int(x) * docs // total for x in n], np.int64)
    return 50 + 50 * n.astype(np.int64) * docs // max(1, total)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def levels_of(docs: int) -> int:
    return max(1, (docs - 1).bit_length())


def wavelet(docs: np.ndarray, levels: int) -> np.ndarray:
    """Bits of each level (rows), in words of 64; a level's postings are in the order of the documents' bits above it, else as given."""
    out = np.zeros((levels, len(docs) // 64 + 1), np.uint64)
    order = slice(None)
    for level in range(levels):
        down = levels - 1 - level
        packed = np.packbits(((docs[order] >> down) & 1).astype(np.uint8), bitorder="little")
        out[level].view(np.uint8)[: len(packed)] = packed
        order = np.argsort((docs >> down).astype(np.uint16), kind="stable")
    return out


class _Shard:
    """Documents of a shard as they come; their postings wait as numbers, not as texts."""

    def __init__(self):
        self.ids, self.n, self.parts, self.words, self.rows, self.bytes = [], [], [], [], 0, 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        w = terms(texts)
        key, tf = np.unique(w.docs() * max(1, len(w.dictionary)) + w.codes, return_counts=True)
        doc, code = np.divmod(key, max(1, len(w.dictionary)))
        self.parts.append(((doc + self.rows).astype(np.int32), code.astype(np.int32), tf.astype(np.int32)))
        self.words.append(w.dictionary)
        self.ids.append(ids)
        self.n.append(w.lengths)
        self.rows += len(ids)
        self.bytes += len(w.codes) * 8

    def row(self, number: int, docs: int, total: int) -> pa.RecordBatch:
        ids, n = pa.concat_arrays(self.ids), np.concatenate(self.n)
        by_id = pc.sort_indices(ids, sort_keys=[("", "ascending")], null_placement="at_end").to_numpy(zero_copy_only=False)
        place = np.empty(len(by_id), np.int32)
        place[by_id] = np.arange(len(by_id), dtype=np.int32)
        every = pa.chunked_array(self.words, pa.string()).dictionary_encode().combine_chunks()
        lexicon, code_of = every.dictionary, every.indices.to_numpy(zero_copy_only=False)
        starts = np.cumsum([0] + [len(w) for w in self.words])
        doc, tf = np.concatenate([p[0] for p in self.parts]), np.concatenate([p[2] for p in self.parts])
        code = np.concatenate([code_of[p[1] + s] for p, s in zip(self.parts, starts, strict=False)]).astype(np.int64)
        impact = impacts(tf.astype(np.int64), lengths(n, docs, total)[doc])
        doc = place[doc]
        first = np.argsort(doc.astype(np.uint16), kind="stable")
        order = first[np.argsort((code[first] << 20) - impact[first], kind="stable")]  # impacts are at most 1,000,000
        doc, impact = doc[order], impact[order].astype(np.int32)
        ends = np.cumsum(np.bincount(code, minlength=len(lexicon))).astype(np.int64)
        bits = wavelet(doc, levels_of(len(ids)))
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        raw = lambda a: pa.array([a.tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([number]), one(ids.take(pa.array(by_id))), one(lexicon), raw(ends), raw(impact), raw(bits)], ["shard", "ids", "terms", "ends", "impacts", "bits"])


def _shards(docs: int, total: int):
    def run(batches):
        shard, number = _Shard(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", rows=1 << 14):
                shard.add(as_array(part.column("id")), part.column("text"))
                if shard.bytes >= SHARD_BYTES or shard.rows > SHARD_ROWS - (1 << 14):
                    yield shard.row(number, docs, total)
                    shard, number = _Shard(), number + 1
        if shard.rows:
            yield shard.row(number, docs, total)
        tidy()

    return run


class Index:
    """``docs`` with at least one term, ``total`` terms, and a table of one row for each shard (columns as in INDEX)."""

    def __init__(self, docs: int, total: int, shards: DataFrame):
        self.docs, self.total, self.shards = docs, total, shards


def build_index(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> Index:
    """Indexes every row of ``docs``: two passes over the texts, no exchange. Null texts have no terms."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = rows.select("text").mapInArrow(_counts, "docs long, total long").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).first()
    n, total = int(found.docs or 0), int(found.total or 0)
    return Index(n, total, materialize(rows.mapInArrow(_shards(n, total), INDEX), "shards"))


# ----------------------------------------------------------------- search in a shard
class Tree:
    """A shard's wavelet tree with what its navigation needs: ranks, and the impacts in each level's order."""

    def __init__(self, ids: int, ends: bytes, impacts: bytes, bits: bytes):
        self.ends = np.frombuffer(ends, np.int64)
        root = np.frombuffer(impacts, np.int32)
        self.size, self.levels = len(root), levels_of(ids)
        self.words = np.frombuffer(bits, np.uint64).reshape(self.levels, -1)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.ones = np.concatenate([np.zeros((self.levels, 1), np.int32), np.cumsum(ones, axis=1, dtype=np.int32)[:, :-1]], axis=1).reshape(-1)
        self.width, self.words = self.words.shape[1], self.words.reshape(-1)
        self.impacts = np.zeros((self.levels + 1, max(1, self.size)), np.int32)
        self.impacts[0, : self.size] = root
        above = np.zeros(self.size, np.uint16)
        for level in range(self.levels):
            bit = np.unpackbits(self.words[level * self.width : (level + 1) * self.width].view(np.uint8), bitorder="little", count=self.size)
            above = (above << 1) | bit
            order = np.argsort(above, kind="stable")
            above = above[order]
            self.impacts[level + 1, : self.size] = self.impacts[level, : self.size][order]
        self.impacts = self.impacts.reshape(-1)

    def interval(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.where(code > 0, self.ends[code - 1], 0), self.ends[code]

    def zeros(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of a level's first ``at`` bits are zero."""
        word = level * self.width + (at >> 6)
        below = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return at - self.ones[word] - np.bitwise_count(below)

    def best(self, code: np.ndarray, weight: np.ndarray, k: int, least: int = 0, limit: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the k best documents, best first. Only scores above ``least``, or equal to it for numbers under ``limit``, are asked for."""
        a, b = self.interval(code)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        level, number = np.zeros(1, np.int64), np.zeros(1, np.int64)
        span, ends = np.stack([a, b])[:, None, :], np.array([[0], [self.size]])
        bound = (weight * self.impacts[np.minimum(a, self.size - 1)]).sum(keepdims=True) if self.size else np.zeros(1, np.int64)
        while True:
            first = number << (self.levels - level)
            hope = (bound > least) | ((bound == least) & (first < limit))
            if not hope.all():
                level, number, bound, span, ends, first = level[hope], number[hope], bound[hope], span[:, hope], ends[:, hope], first[hope]
            if not len(bound):
                return docs, scores
            now = np.zeros(len(bound), bool)
            now[np.lexsort((first, -bound))[:TOGETHER]] = True
            later = ~now
            kept = level[later], number[later], bound[later], span[:, later], ends[:, later]
            level, number, span, ends = level[now], number[now], span[:, now], ends[:, now]
            zero_ends = self.zeros(level, ends)
            zero_span = self.zeros(level[:, None], span) - zero_ends[0][:, None]
            start, some = ends[0], zero_ends[1] - zero_ends[0]
            left = start[:, None] + zero_span
            right = (start + some)[:, None] + (span - start[:, None]) - zero_span
            span = np.concatenate([left, right], axis=1)
            ends = np.concatenate([np.stack([start, start + some]), np.stack([start + some, ends[1]])], axis=1)
            level, number = np.tile(level + 1, 2), np.concatenate([number << 1, (number << 1) | 1])
            held = span[0] < span[1]
            bound = np.where(held, weight * self.impacts[level[:, None] * self.size + np.minimum(span[0], self.size - 1)], 0).sum(axis=1)
            leaf = level == self.levels
            if leaf.any():
                good = leaf & ((bound > least) | ((bound == least) & (number < limit)))
                docs, scores = np.concatenate([docs, number[good]]), np.concatenate([scores, bound[good]])
                order = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[order], scores[order]
                if len(docs) == k:
                    least, limit = scores[-1], docs[-1]  # what ties with the k-th must have a smaller number
                inner = ~leaf
                level, number, bound, span, ends = level[inner], number[inner], bound[inner], span[:, inner], ends[:, inner]
            level, number, bound = np.concatenate([level, kept[0]]), np.concatenate([number, kept[1]]), np.concatenate([bound, kept[2]])
            span, ends = np.concatenate([span, kept[3]], axis=1), np.concatenate([ends, kept[4]], axis=1)


# ----------------------------------------------------------------- search over all shards
def _holding(vocabulary: pa.Array):
    """How many documents of the task's shards hold each term."""

    def run(batches):
        df = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                ends = np.frombuffer(batch.column("ends")[i].as_buffer(), np.int64)
                code = pc.index_in(vocabulary, value_set=batch.column("terms")[i].values)
                at = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
                code = code.drop_null().to_numpy(zero_copy_only=False)
                df[at] += np.diff(ends, prepend=0)[code]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(df[at])], ["term", "df"])

    return run


def _merge(best: tuple, ids: pa.Array, scores: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    ids, scores = pa.concat_arrays([best[0], ids]), np.concatenate([best[1], scores])
    t = pa.table({"s": scores, "d": ids})
    order = pc.sort_indices(t, sort_keys=[("s", "descending"), ("d", "ascending")], null_placement="at_end")[:k]
    return ids.take(order), scores[order.to_numpy()]


def _search(names: list, kind: pa.DataType, vocabulary: pa.Array, item_terms: list[np.ndarray], weight: np.ndarray, k: int, known: dict[int, tuple]):
    """The k best of a task's shards for each item. ``known``: for items, a score and an id that are the k-th best of other shards."""

    def run(batches):
        best = {}
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                tree = Tree(len(ids), batch.column("ends")[i].as_py(), batch.column("impacts")[i].as_py(), batch.column("bits")[i].as_py())
                code = pc.fill_null(pc.index_in(vocabulary, value_set=batch.column("terms")[i].values), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                numbered = ids.drop_null().to_numpy(zero_copy_only=False)
                for item, its in enumerate(item_terms):
                    some = its[(code[its] >= 0) & (weight[its] > 0)]
                    if not len(some):
                        continue
                    least, limit = 0, 0
                    for score, last in [known[item]] if item in known else []:
                        least, limit = score, (np.searchsorted(numbered, last) if last is not None else len(numbered))
                    if item in best and len(best[item][1]) == k:
                        score, last = int(best[item][1][-1]), best[item][0][-1].as_py()
                        at = np.searchsorted(numbered, last) if last is not None else len(numbered)
                        least, limit = max((least, -limit), (score, -at))
                        limit = -limit
                    docs, scores = tree.best(code[some], weight[some], k, least, int(limit))
                    if len(docs):
                        best[item] = _merge(best.get(item, (pa.array([], pa.int64()), np.zeros(0, np.int64))), ids.take(pa.array(docs)), scores, k)
                del tree
            tidy()
        for item, (ids, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([names[item]] * len(ids), kind), ids, pa.array(scores)], ["item_id", "doc_id", "score"])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def item_terms(items: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row for each item: ``item_id`` and its distinct terms. Rows of one id are one item."""
    low = F.translate(F.col(f"`{text_col}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = items.select(F.col(f"`{item_col}`").alias("item_id"), F.explode(F.regexp_extract_all(low, F.lit(TERM), 0)).alias("term")).distinct()
    return each.groupBy("item_id").agg(F.collect_list("term").alias("terms"))


def search(index: Index, items: DataFrame, k: int = 50, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The k best documents of each item with a score above 0: ``item_id``, ``rank`` (int, from 1), ``doc_id``, ``score``; other columns don't matter.

    Scores add up floor(1000 ln((2 N + 2) / (2 df + 1))) times the posting's impact, in whole numbers, over an item's distinct terms. Each row
    of the documents is ranked, so repeated ids can fill several ranks; rows without an id come last among equal scores. Items without text or
    without a term of the index have no rows; rows of one item id count as one item.
    """
    kind, spark = items.select(F.col(f"`{item_col}`")).schema[0].dataType, items.sparkSession
    asked = materialize(item_terms(items, text_col, item_col).withColumn("n", F.size("terms")), "items")
    blocks = math.ceil((asked.agg(F.sum("n")).first()[0] or 0) / BLOCK_TERMS)
    parts = max(1, math.ceil(math.sqrt(index.shards.count())))
    schema = f"item_id {kind.simpleString()}, doc_id long, score long"
    found = spark.createDataFrame([], schema)
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        every = pa.array([t for r in rows for t in r.terms], pa.string()).dictionary_encode()
        vocabulary, at = every.dictionary, every.indices.to_numpy()
        its = np.split(at, np.cumsum([len(r.terms) for r in rows])[:-1])
        df = np.zeros(len(vocabulary), np.int64)
        for r in index.shards.select("terms", "ends").mapInArrow(_holding(vocabulary), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r.term] = r.df
        weight = np.array([math.floor(1000 * math.log((2 * index.docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        names, part = [r.item_id for r in rows], F.pmod(F.xxhash64("shard"), F.lit(parts))
        run = lambda shards, known: shards.mapInArrow(_search(names, to_arrow_type(kind), vocabulary, its, weight, k, known), schema)  # noqa: E731, B023
        some = materialize(run(index.shards.filter(part == 0), {}), "first")
        number = {name: i for i, name in enumerate(names)}
        known = {number[r.item_id]: (r.score, r.doc_id) for r in _top(some, k).filter(F.col("rank") == k).collect()}
        found = found.unionByName(some).unionByName(run(index.shards.filter(part != 0), known))
    return _top(found, k).select("item_id", "rank", "doc_id", "score")
