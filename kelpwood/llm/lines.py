"""Line dedup: lines that many documents share (menus, notices, licences) leave every document.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased. Lines are exploded, keys hashed (128 bits), the
distinct documents of each hash counted, and lines of frequent keys dropped; what stays is put together by position.

* A hot line is no hot group: pairs of key and document are dealt by both, and counted before the second exchange. The join that marks lines
  has one row for each frequent key on its right side, so a skewed key on its left side can be split.
* Texts are exchanged once, by document and fingerprint, to meet the positions that go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import internal, materialize

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(SPACE))
    # without bytes above 0x7F, lower() touches A-Z only and is faster
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Hashes (h1, h2) of the keys of at least ``min_chars`` code points that at least ``min_docs`` distinct documents hold, and ``n_docs``."""
    line = docs.select(F.col(f"`{id_col}`").alias("d"), F.explode(_split(F.col(f"`{text_col}`"))).alias("line"))
    key = line.select("d", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return key.select("d", *_hashes(F.col("key"))).distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the kept text in ``text_col``, and ``n_lines`` (before dropping) and ``n_dropped``.

    Null or empty text: one empty line, and an empty text is returned. A key shorter than ``min_chars`` never counts. Rows of one id are one
    document when documents are counted (rows without an id too), but each row is returned, with its own lines. Of columns named ``n_lines``
    or ``n_dropped`` the operator's take the place; all others pass through whatever their names. An empty table gives an empty table.
    A text's lines are held by one row, so memory follows the longest text alone.
    """
    often = materialize(frequent_lines(docs, min_docs, min_chars, text_col, id_col).select("h1", "h2"), "lines")
    text, at = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    mark = F.xxhash64(F.coalesce(text, F.lit("")))
    line = docs.select(at.alias("d"), mark.alias("f"), F.posexplode(_split(text)).alias("pos", "line"))
    key = line.select("d", "f", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    hit = key.select("d", "f", "pos", *_hashes(F.col("key"))).join(often, ["h1", "h2"], "left_semi")
    gone = hit.groupBy("d", "f").agg(F.sort_array(F.collect_set("pos")).alias("gone"))

    d, f, cut, lines = (internal(docs, x) for x in ("d", "f", "gone", "lines"))
    gone = gone.select(F.col("d").alias(d), F.col("f").alias(f), F.col("gone").alias(cut))
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")], mark.alias(f"{f}x"))
    met = rows.join(gone, at.eqNullSafe(F.col(d)) & (F.col(f"{f}x") == F.col(f)), "left")
    counted = met.withColumn(lines, _split(text)).withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_dropped", F.coalesce(F.size(cut), F.lit(0)).cast("long"))
    # what lies between two dropped lines is one slice, so the work is linear in the lines
    start = lambda i: F.coalesce(F.get(cut, i - 1) + 1, F.lit(0))
    part = lambda i: F.slice(lines, start(i) + 1, F.coalesce(F.get(cut, i), F.size(lines)) - start(i))
    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut)), part)), "\n")
    whole = F.when(F.col("n_dropped") > 0, kept).otherwise(F.coalesce(text, F.lit("")))
    names = [c for c in rows.columns if c != f"{f}x"]
    return counted.select(*[whole.alias(c) if c == text_col else F.col(f"`{c}`") for c in names], "n_lines", "n_dropped")
