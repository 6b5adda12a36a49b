"""Substring duplicates by relative Lempel-Ziv parsing against an index of every reference block.

The corpus is dealt into blocks of bounded text size (by a hash of the row). Each block is a reference and
a thing to be parsed; the index that all blocks share is spread by hash, so no block meets any other directly:

1. Every block announces its distinct anchors: the least 4-word hash inside each window of ``window`` words.
   Equal windows have equal anchors, so only windows whose anchor is in another document can be copies.
2. For those windows a block announces each distinct one once, with the place where it first stands (least doc_id, least place), which
   makes the index: a window's reference is the first place of it in the whole corpus.
3. Each document is then parsed greedily, left to right: a factor starts at a window with a reference in an earlier document and grows by
   a word as long as the next window's reference is the next place of the same document. A window over a factor's end is looked up like all
   others, so that what one reference breaks off another carries on, and the words of all factors are exactly those of all windows found. Words
   between factors are literals.

Windows are told apart by 80 bits, of two hashes that are independent from the words' bytes on, where their anchors' 64 bits are shared as well. A passage in a third of all rows is announced once for
each block, not once for each row: the rows of one window or anchor are some tens of bytes for each block of ``block_bytes`` of text, which a task streams and
spills. Three sweeps read one exchange of the texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, gram_hashes, internal, signed, text_array, text_bytes, trimmed

SEED_WORDS = 4
CHECK_BITS = 16  # of the second hash
NO_ID = np.iinfo(np.int64).max
FACTOR = "array<struct<start:int,length:int,ref_doc:bigint,ref_start:int>>"
#: What is exchanged of a window: its hash, and in one number the second hash and the place, as rows of few columns pack better.
INDEX = "w long, spot long, block long, doc long"


def _windows(texts: pa.Array, window: int, check: bool = True):
    """Words, and for each window: anchor, hash, second hash (if ``check``), text's number, first word's place in the array."""
    w = Words(texts)
    h, doc = w.hashes(), w.docs()
    n = len(h) - window + 1
    if n <= 0:
        none = np.zeros(0, np.uint64)
        return w, none, none, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    seed = gram_hashes(h, min(SEED_WORDS, window))
    span = window - min(SEED_WORDS, window) + 1
    low, have = seed, 1
    while have * 2 <= span:
        low, have = np.minimum(low[:-have], low[have:]), have * 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    at = np.flatnonzero(doc[:n] == doc[window - 1 :])
    if not check:
        return w, low[at], None, None, doc[at], at
    low, full = low[at], gram_hashes(h, window)[at]
    del h, seed
    second = (gram_hashes(w.hashes(1), window, 1) >> np.uint64(64 - CHECK_BITS)).astype(np.int64)[at]
    return w, low, full, second, doc[at], at


def _ids(col) -> np.ndarray:
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return a.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _anchors(low: np.ndarray, doc: np.ndarray):
    """Distinct anchors in order, and which of them are in several texts."""
    if not len(low):
        return low, np.zeros(0, bool)
    first = np.concatenate([[True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])])
    low, doc = low[first], doc[first]
    order = np.argsort(low, kind="stable")
    key, doc = low[order], doc[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at], np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)


def _found(values: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(within):
        return np.zeros(len(values), bool)
    return within[np.minimum(np.searchsorted(within, values), len(within) - 1)] == values


def _firsts(full: np.ndarray, second: np.ndarray, spot: np.ndarray):
    """Each distinct window: hash, second hash, least spot; and each row's window number."""
    if not len(full):
        return full, second, spot, np.zeros(0, np.int64)
    order = np.argsort(full, kind="stable")
    k, c = full[order], second[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    if (c[1:] != c[:-1])[~new[1:]].any():  # equal first hashes of different windows
        order = np.lexsort((second, full))
        k, c = full[order], second[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
    at = np.flatnonzero(new)
    number = np.empty(len(full), np.int64)
    number[order] = np.cumsum(new) - 1
    return k[at], c[at], np.minimum.reduceat(spot[order], at), number


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, np.int64)


def _lookup(full: np.ndarray, second: np.ndarray, known: pa.Table) -> np.ndarray:
    """For each distinct window its row of ``known`` (w, spot with the second hash in its upper bits), or -1."""
    out = np.full(len(full), -1)
    if not known.num_rows or not len(full):
        return out
    w, c = _column(known, "w").view(np.uint64), _column(known, "spot").view(np.uint64) >> np.uint64(64 - CHECK_BITS)
    order = np.argsort(w, kind="stable")
    w, c = w[order], c[order]
    low, high = np.searchsorted(w, full), np.searchsorted(w, full, side="right")
    for step in range(int((high - low).max())):  # more than one step only where hashes collide
        at = np.minimum(low + step, len(w) - 1)
        hit = (low + step < high) & (c[at] == second)
        out[hit] = order[at[hit]]
    return out


def factors(place: np.ndarray, doc: np.ndarray, ref: np.ndarray, ref_place: np.ndarray, window: int) -> np.ndarray:
    """Greedy factors of windows with references, in order: rows of text's number, start, length, reference document, its place.

    Factors of a text are apart: one begins where the last ended, if they would overlap.
    """
    if not len(place):
        return np.zeros((0, 5), np.int64)
    goes_on = (doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + 1) & (ref[1:] == ref[:-1]) & (ref_place[1:] == ref_place[:-1] + 1)
    first = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    last = np.append(first[1:], len(place)) - 1
    start, end, d = place[first], place[last] + window, doc[first]
    before = np.concatenate([[0], np.where(d[1:] == d[:-1], end[:-1], 0)])
    cut = np.maximum(before - start, 0)
    return np.stack([d, start + cut, end - start - cut, ref[first], ref_place[first] + cut], axis=1)


def substring_dedup(docs: DataFrame, window: int = 13, block_bytes: int = 8 << 20, respace: bool = False) -> DataFrame:
    """Remove each word that a window covers whose words also start in a document with a smaller doc_id.

    Returns all columns of ``docs`` with ``text`` as it is left, and n_words long, n_removed long,
    factors array<struct<start, length, ref_doc, ref_start>> (the words removed, and of which earlier document's words they are copies: the
    first in the corpus). Windows are judged on the input. Texts that lose nothing stay as they are unless ``respace``; the others
    have the words left, joined by one space.

    Defined cases: null text: stays null, no words. Null doc_id: later than all others, and never a reference. Rows with one doc_id
    are one document: they aren't references for each other, and a place in it is a place in one of them. Very long texts are a block of their own size.
    Empty table: empty result. Other columns pass through; those named like an output are replaced.
    """
    out = {"n_words": "bigint", "n_removed": "bigint", "factors": FACTOR}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in out])
    size = text_bytes(docs)
    blocks = max(1, math.ceil(size / block_bytes), min(64, math.ceil(size / (1 << 18))))
    block = internal(docs, "block")
    base = docs.withColumn(block, F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    if blocks > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        base = base.repartition(blocks, block)  # so that tasks don't grow with the corpus
    dealt = base.groupBy(block)

    def number_of(t: pa.Table) -> int:
        return t.column(block)[0].as_py()

    @trimmed
    def announce_anchors(t: pa.Table) -> pa.Table:
        _, low, _, _, doc, _ = _windows(text_array(t.column("text")), window, check=False)
        anchor = _anchors(low, doc)[0]
        return pa.table({"anchor": signed(anchor), "block": np.full(len(anchor), number_of(t))})

    asked = dealt.applyInArrow(announce_anchors, "anchor long, block long")
    by_anchor = Window.partitionBy("anchor")
    shared = asked.withColumn("n", F.count("*").over(by_anchor)).filter("n > 1").select("block", "anchor")

    @trimmed
    def announce_windows(t: pa.Table, known: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({c: np.zeros(0, np.int64) for c in ("w", "spot", "block", "doc")})
        w, low, full, second, doc, at = _windows(text_array(t.column("text")), window)
        anchor, twice = _anchors(low, doc)
        here = _found(low, anchor[twice]) | _found(low, np.sort(_column(known, "anchor").view(np.uint64)))
        ids, rank = np.unique(_ids(t.column("doc_id")), return_inverse=True)
        spot = (rank.reshape(-1)[doc[here]] << 32) + at[here] - w.offsets[doc[here]]
        key, check, spot, _ = _firsts(full[here], second[here], spot)
        packed = check << (64 - CHECK_BITS) | spot & 0xFFFFFFFF
        return pa.table({"w": signed(key), "spot": packed, "block": np.full(len(key), number_of(t)), "doc": ids[spot >> 32]})

    told = dealt.cogroup(shared.groupBy("block")).applyInArrow(announce_windows, INDEX).repartition("w")
    by_window = Window.partitionBy("w", F.shiftrightunsigned("spot", 64 - CHECK_BITS))
    index = told.withColumn("first", F.min(F.struct("doc", "spot")).over(by_window)).filter("first.doc < doc")
    earlier = index.select("block", "w", F.col("first.spot").alias("spot"), F.col("first.doc").alias("ref"))

    keep = [f for f in base.schema.fields if f.name != block]
    schema = T.StructType([*keep, *T._parse_datatype_string(", ".join(f"`{k}` {v}" for k, v in out.items())).fields])

    def parse(t: pa.Table, known: pa.Table) -> pa.Table:
        w, _, full, second, doc, at = _windows(text_array(t.column("text")), window)
        ids, rank = np.unique(_ids(t.column("doc_id")), return_inverse=True)
        own, place = rank.reshape(-1)[doc], at - w.offsets[doc]
        key, check, spot, number = _firsts(full, second, (own << 32) + place)
        ref, ref_place = ids[spot >> 32] if len(spot) else spot, spot & 0xFFFFFFFF
        row = _lookup(key, check, known)
        other = row >= 0
        ref[other], ref_place[other] = _column(known, "ref")[row[other]], _column(known, "spot")[row[other]] & 0xFFFFFFFF
        copied = np.flatnonzero(ref[number] < ids[own]) if len(number) else number
        number = number[copied]
        made = factors(place[copied], doc[copied], ref[number], ref_place[number], window)

        start = w.offsets[made[:, 0]] + made[:, 1]
        edge = np.zeros(len(w.codes) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + made[:, 2], -1)
        covered = np.cumsum(edge)[:-1] > 0
        gone = np.concatenate([[0], np.cumsum(covered)])
        removed = gone[w.offsets[1:]] - gone[w.offsets[:-1]]
        texts = t.column("text").combine_chunks().to_pylist()
        for i, x in enumerate(texts):
            if removed[i]:
                parts = x.encode().split()
                texts[i] = b" ".join([parts[j] for j in np.flatnonzero(~covered[w.offsets[i] : w.offsets[i + 1]])]).decode()
            elif respace and x is not None:
                texts[i] = b" ".join(x.encode().split()).decode()
        bounds = np.searchsorted(made[:, 0], np.arange(w.n + 1)).astype(np.int32)
        fields = [pa.array(made[:, i].astype(k)) for i, k in ((1, np.int32), (2, np.int32), (3, np.int64), (4, np.int32))]
        spans = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(fields, ["start", "length", "ref_doc", "ref_start"]))
        cols = {f.name: t.column(f.name) for f in keep} | {"text": pa.array(texts, pa.string())}
        return pa.table(cols | {"n_words": w.lengths.astype(np.int64), "n_removed": removed.astype(np.int64), "factors": spans})

    @trimmed
    def parse_block(t: pa.Table, known: pa.Table) -> pa.Table:
        return parse(t, known) if t.num_rows else pa.table({f.name: [] for f in schema.fields}).slice(0, 0)

    return dealt.cogroup(earlier.groupBy("block")).applyInArrow(parse_block, schema)
