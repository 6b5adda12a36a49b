"""A corpus pipeline: documents to packed training sequences, in five stages over one another's results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpwood.llm.common import materialize, table
from kelpwood.llm.langid import UNKNOWN, identify, train_split
from kelpwood.llm.minhash import near_duplicates
from kelpwood.llm.packing import pack_documents
from kelpwood.llm.quality import score_quality, train
from kelpwood.llm.sketch import maybe_in
from kelpwood.llm.substring import substring_dedup

LEAST_LANGUAGE_SCORE = 0.3
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
REPEATED_WORDS = 25


def _wrapped(docs: DataFrame) -> DataFrame:
    """The columns that stages work with, and all of a row but its text in one more, so that columns of any name neither clash nor change."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang", "source", F.struct(*rest).alias("row"))


def _unwrapped(rows: DataFrame, like: DataFrame) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in like.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts too), or with no language that the model holds likely, go.

    Where no row has both a text and a language nothing can be learned, and all go. Each row is judged by its own text: repeated rows stay or go alike.
    """
    out = identify(_wrapped(docs).select("text", "row"), train_split(docs))
    return _unwrapped(out.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)), docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior says poor or toxic go. Host: the source; path: source and language; a null one is the site without a name.

    Null and empty texts go. Repeated rows count and are judged each. Ties at the threshold stay.
    """
    rows = _wrapped(docs).withColumn("path", F.concat_ws("/", "source", "lang"))
    return _unwrapped(score_quality(rows, train(docs, table(spark, sf_dir, "labels")), "source", "path", ["text", "row"]).filter("keep"), docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least id.

    Rows of one id are one document, of which the row with the least text (then the least other columns) stays. Rows without an id, and texts without
    words, have no near-duplicates and stay.
    """
    rows = _wrapped(docs).select("doc_id", "text", "row")
    gone = near_duplicates(rows.select("doc_id", "text"), k=SHINGLE_WORDS, percent=SIMILARITY_PERCENT).filter("not kept").select("doc_id").distinct()
    near, mark = maybe_in(rows, "doc_id", gone)  # rows that can't be gone aren't shuffled
    some = near.filter(mark).drop(mark).join(gone, "doc_id", "left_anti").select("doc_id", "text", "row")
    out = near.filter(f"not {mark}").drop(mark).unionByName(some)
    again = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not again.isEmpty():
        near, mark = maybe_in(out, "doc_id", again)
        order = Window.partitionBy("doc_id").orderBy("text", F.to_json("row"))
        first = near.filter(f"{mark} and doc_id is not null").withColumn("n", F.row_number().over(order)).filter("n = 1").select("doc_id", "text", "row")
        out = near.filter(f"not {mark} or doc_id is null").select("doc_id", "text", "row").unionByName(first)
    return _unwrapped(out, docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has are cut, with ``n_chars`` counted anew where it is a column; documents of which nothing is left go.

    Texts that lose nothing stay as they are, null and empty ones too. Rows of one id are one document; rows without an id come last.
    """
    out = substring_dedup(_wrapped(docs).select("doc_id", "text", "row"), window=REPEATED_WORDS, block_bytes=4 << 20)
    out = out.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    if "n_chars" in docs.columns:
        counted = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
        out = out.withColumn("row", F.col("row").withField("n_chars", counted))
    return _unwrapped(out, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their token ids. A null text is an empty one: its end mark alone. Repeated rows are packed each."""
    from public_tokenizers import path

    return pack_documents(docs.select("doc_id", "text"), path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("quality", quality), ("minhash_near_dedup", minhash_near_dedup), ("substring_dedup", substring), ("packing", packing)]
#: No stage but the filters on its results can be said in SQL (trained models, token ids); tests hold it against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
