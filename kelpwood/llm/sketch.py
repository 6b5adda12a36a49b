"""A filter of bounded size in front of a join: most rows without a partner never reach the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import internal

BITS = 26  # 2**26 bits are 2**20 words of 64: some 30 MB on each executor at most, however many ids there are


def maybe_in(df: DataFrame, key: str, ids: DataFrame, bits: int = BITS) -> tuple[DataFrame, str]:
    """``df`` with a boolean column (its name is returned) that is true for every row whose key is in ``ids`` (column ``key``).

    It is also true for a share of other rows, which grows with the ids: about ids / 2**bits. The words that hold a bit are broadcast; there are 2**(bits - 6) at most.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    word, mark, bit = (internal(df, x) for x in ("word", "maybe", "bits"))
    words = ids.select(place(F.col(key)).alias("p")).groupBy(F.shiftright("p", 6).alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias(bit))
    placed = df.withColumn(mark, place(F.col(key))).withColumn(word, F.shiftright(mark, 6))
    joined = placed.join(F.broadcast(words), word, "left")
    hit = F.col(bit).isNotNull() & (F.expr(f"shiftright(`{bit}`, cast(`{mark}` & 63 as int)) & 1") == 1)
    return joined.withColumn(mark, hit).select(*[F.col(f"`{c}`") for c in df.columns], mark), mark
