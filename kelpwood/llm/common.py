"""Shared helpers: shared-folder tables, word splitting and hashing over Arrow buffers.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``. All hashes are 64-bit, computed with
numpy over whole Arrow batches; a batch is cut into slices of bounded text size first, so that the
memory of a Python worker doesn't follow the length of texts or batches.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
try:
    _TRIM = ctypes.CDLL(None).malloc_trim  # glibc only
except (AttributeError, OSError):
    _TRIM = None
_GOLD = np.uint64(0x9E3779B97F4A7C15)


# ----------------------------------------------------------------- tables
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a local session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='kelpwood-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, hint: str = "t") -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kelpwood/{hint}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ----------------------------------------------------------------- Arrow slices
def as_array(col) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def text_array(col) -> pa.Array:
    """A plain string array without nulls (null: empty)."""
    a = as_array(col)
    if not pa.types.is_string(a.type):
        a = a.cast(pa.string())
    return pc.fill_null(a, "") if a.null_count else a


def slices(batch: pa.RecordBatch, text_col: str, most: int = SLICE_BYTES, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of at most ``most`` text bytes and ``rows`` rows each (one row at least)."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start, n = np.cumsum(size + 8), 0, batch.num_rows
    while start < n:
        base = ends[start - 1] if start else 0
        stop = min(max(start + 1, int(np.searchsorted(ends, base + most, side="right"))), start + rows)
        yield batch.slice(start, stop - start)
        start = stop
    tidy()


def tidy() -> None:
    """Give freed memory back, as a Python worker outlives its tasks and would keep the peak of each."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def trimmed(f):
    """``f`` of one group, or of two that belong together, after which freed memory is given back."""

    def one(t):
        try:
            return f(t)
        finally:
            tidy()

    def two(t, other):
        try:
            return f(t, other)
        finally:
            tidy()

    return one if f.__code__.co_argcount == 1 else two


# ----------------------------------------------------------------- words
class Words:
    """The words of some texts: ``codes`` into ``dictionary``; ``offsets`` has the bounds of each text."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = text_array(texts)
        if lower:
            texts = pc.ascii_lower(texts)
        parts = pc.ascii_split_whitespace(texts)
        flat = parts.flatten()
        off = parts.offsets.to_numpy().astype(np.int64)
        off = off - off[0]
        full = pc.greater(pc.binary_length(flat), 0)
        if not pc.all(full).as_py() and len(flat):
            keep = full.to_numpy(zero_copy_only=False)
            off = np.concatenate([[0], np.cumsum(keep)])[off]
            flat = flat.filter(full)
        coded = flat.dictionary_encode()
        self.n = len(texts)
        self.offsets = off
        self.lengths = np.diff(off)
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.dictionary = coded.dictionary

    def hashes(self, seed: int = 0) -> np.ndarray:
        return word_hashes(self.dictionary, seed)[self.codes] if len(self.codes) else np.zeros(0, np.uint64)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.lengths)


def _mix_here(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix(x: np.ndarray) -> np.ndarray:
    """A finalising permutation of 64-bit values."""
    return _mix_here(x.astype(np.uint64, copy=True))


_TABLES = [mix((np.arange(64 * 256, dtype=np.uint64) + np.uint64((seed << 32) + 1)) * _GOLD) for seed in range(2)]


def word_hashes(dictionary: pa.Array, seed: int = 0) -> np.ndarray:
    """Tabulation hash of each string's bytes (by place and byte); seeds 0 and 1 give independent ones."""
    n = len(dictionary)
    if n == 0:
        return np.zeros(0, np.uint64)
    bufs = dictionary.buffers()
    off = np.frombuffer(bufs[1], np.int32)[dictionary.offset : dictionary.offset + n + 1].astype(np.int64)
    size = np.diff(off)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    place = np.arange(len(data)) - np.repeat(off[:-1] - off[0], size)
    value = _TABLES[seed][((place & 63) << 8) | data] * (2 * (place >> 6) + 1).astype(np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    at = off - off[0]
    return mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64) * _GOLD)


_MULS = (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def gram_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of the n words from each place on, over the whole array (len(h) - n + 1 values; texts' bounds are the caller's)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    mul = _MULS[seed]
    part = _powers(mul, len(h))
    part *= h
    s = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(part, out=s[1:])
    del part
    s = s[n:] - s[:-n]
    s *= _powers(pow(mul, -1, 1 << 64), len(s))
    s += np.uint64(n * int(_GOLD) % (1 << 64))
    return _mix_here(s)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def internal(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name in taken:
        name += "_"
    return name


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    return int(df.select(F.sum(F.octet_length(F.col(text_col)) + F.lit(8))).first()[0] or 0)
