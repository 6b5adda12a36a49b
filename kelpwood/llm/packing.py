"""Hierarchical packing of documents into training sequences of several context sizes.

Each task packs the documents of its own partition, so nothing is shuffled:

1. Documents longer than the largest window give full windows; what is left is routed, like all others, to the least tier that holds it.
2. From the largest tier down, each document opens a window of its tier. The gap is filled from the shorter tiers,
   longest fitting document first, and closed by a cut of the shortest document at hand, whose rest goes back to its tier.
3. The documents left at a partition's end fill ever smaller windows, so that every sequence has a power of two of tokens.
4. Sequences of one flush are dealt into steps of equal token counts; sizes nest, so all steps but the last are exactly even.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 8 * 4096
FLUSH_TOKENS = 1 << 20
TOKEN_SLICE = 2 << 20  # text bytes that are tokenised at once

Piece = tuple[int, int, int]  # document, start, length


def pack(sizes: list[int], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences of pieces, and pieces left over (none if ``last``). sizes: each document's tokens, at least 1."""
    top = tiers[-1]
    done: list[list[Piece]] = []
    pool: list[tuple[int, int, int]] = []  # length, document, start
    for d, n in enumerate(sizes):
        whole = n // top * top
        done += [[(d, s, top)] for s in range(0, whole, top)]
        if n > whole:
            pool.append((n - whole, d, whole))
    pool.sort()
    left: list[Piece] = []
    stock = sum(p[0] for p in pool)
    while pool:
        size, d, s = pool.pop()
        tier = next(t for t in tiers if t >= size)
        if stock < tier:  # not enough to fill it
            pool.append((size, d, s))
            break
        window, gap = [(d, s, size)], tier - size
        while gap:
            at = bisect_right(pool, (gap, len(sizes), 0)) - 1
            if at >= 0:
                n, d, s = pool.pop(at)
                window.append((d, s, n))
            else:
                n, d, s = pool.pop(0)
                window.append((d, s, gap))
                insort(pool, (n - gap, d, s + gap))
                n = gap
            gap -= n
        stock -= tier
        done.append(window)
    rest = [(d, s, n) for n, d, s in reversed(pool)]
    if not last:
        return done, rest
    fringe, size = [], 0
    for d, s, n in rest:
        while n:
            size = size or 1 << (stock.bit_length() - 1)
            take = min(n, size)
            fringe.append((d, s, take))
            s, n, size, stock = s + take, n - take, size - take, stock - take
            if not size:
                done.append(fringe)
                fringe = []
    return done, left


class _Packer:
    """Buffers documents of one task and emits pieces."""

    def __init__(self, tiers, task: int):
        self.tiers, self.seq, self.step, self.base = tiers, 0, 0, task << 40
        self.ids, self.keys, self.starts, self.totals, self.tokens = [], [], [], [], 0

    def add(self, key, ids: np.ndarray):
        self.ids.append(ids)
        self.keys.append(key)
        self.starts.append(0)
        self.totals.append(len(ids))
        self.tokens += len(ids)

    def flush(self, last: bool) -> pa.RecordBatch | None:
        if not self.ids:
            return None
        done, left = pack([len(x) for x in self.ids], self.tiers, last)
        done.sort(key=lambda s: -sum(p[2] for p in s))
        cols: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group")}
        filled = 0
        for seq in done:
            size, offset = sum(p[2] for p in seq), 0
            for d, s, n in seq:
                for c, v in zip(cols, (self.keys[d], self.starts[d] + s, n, self.ids[d][s : s + n].tobytes(), self.totals[d], self.base + self.seq, offset, size, self.base + self.step + filled // STEP_TOKENS), strict=True):
                    cols[c].append(v)
                offset += n
            filled += size
            self.seq += 1
        self.step += -(-filled // STEP_TOKENS)
        kept = [(self.keys[d], self.ids[d][s : s + n], self.starts[d] + s, self.totals[d]) for d, s, n in left]
        self.keys, self.ids, self.starts, self.totals = ([k[i] for k in kept] for i in range(4))
        self.tokens = sum(len(x) for x in self.ids)
        return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in cols.items()], list(cols)) if done else None


def _pack_rows(path: str, end_id: int, tiers: tuple[int, ...]):
    def run(batches):
        from .wordtokens import tokenizer

        tok, packer = tokenizer(path), _Packer(tiers, TaskContext.get().partitionId())
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for part in slices(batch, "text", TOKEN_SLICE):
                ids, bounds = tok.encode(part.column("text"))
                for i, key in enumerate(part.column("doc_id").to_pylist()):
                    packer.add(key, np.concatenate([ids[bounds[i] : bounds[i + 1]], end]))
                    if packer.tokens >= FLUSH_TOKENS and (out := packer.flush(False)) is not None:
                        yield out
        if (out := packer.flush(True)) is not None:
            yield out

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset, sequence_tokens, step_group (all long but ids).

    ``tiers``: context sizes, powers of two, ascending. Every token of every row is in exactly one piece; each
    sequence is filled by its pieces from offset 0 without a gap and has a power of two of tokens, at most the largest tier.
    Sequence numbers are unique, not dense: the task's number is in the upper bits.

    Defined cases: null and empty text: the end token alone. Null doc_id: null in the pieces. Repeated rows are packed
    each, and rows of equal length keep the order of their task. Very long texts are read whole and fill windows of their own. Only doc_id and text
    are read, so other columns may have any name. Empty table: empty result.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers):
        raise ValueError("tiers must be ascending powers of two")
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long"
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_pack_rows(tokenizer_path, end_id, tuple(tiers)), schema)
