"""Where users plug in their own code: extractors, answer backends and scorers, each in Arrow batches so that no row crosses to Python alone."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,length:int,label:string,score:double>>"


def extract(docs: DataFrame, key: str, text: str, extractor: Callable[[list[str]], Iterable[list[tuple[int, int, str, float]]]]) -> DataFrame:
    """``extractor``: texts -> the spans (start, length, label, score) of each. doc, start, length, label, score; null texts have none."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("label", pa.string()), ("score", pa.float64())]))
    fields = ("start", "length", "label", "score")

    def run(batches):
        for b in batches:
            found = extractor([x or "" for x in b.column("text").to_pylist()])
            spans = [[dict(zip(fields, s, strict=True)) for s in row] for row in found]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(spans, kind)], ["doc", "spans"])

    base = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return base.mapInArrow(run, f"doc long, spans {SPANS}").select("doc", F.explode("spans").alias("s")).select("doc", "s.*")


def answer(grounding: DataFrame, backend: Callable[[str, list[str]], str]) -> DataFrame:
    """``grounding``: query_id, question, n, chunk (some tens of rows a question). query_id, answer."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        return pd.DataFrame({"query_id": [pdf["query_id"].iloc[0]], "answer": [backend(pdf["question"].iloc[0], pdf["chunk"].tolist())]})

    return grounding.groupBy("query_id").applyInPandas(one, "query_id long, answer string")


def embed(docs: DataFrame, key: str, text: str, embedder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """``embedder``: texts -> vectors, a batch at a time. id, embedding array<double>."""

    def run(batches):
        for b in batches:
            v = embedder([x or "" for x in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(v, pa.list_(pa.float64()))], ["id", "embedding"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id long, embedding array<double>")


def hash_embedding(text, dim: int = 384):
    """A unit vector that only equal texts share, as an expression: the text's 64-bit hash is mixed anew for each place."""
    from ..functions.scalars import let, unit

    place = lambda h: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.pmod(F.xxhash64(h, i), F.lit(1 << 52)).cast("double") / float(1 << 51) - 1)
    return unit(let(F.xxhash64(text), place))
