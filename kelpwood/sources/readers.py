"""Readers: JSON lines, notes, shell history, captures and question sets. All are Spark readers, so paths can be in any store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import strip_frontmatter

SKIPPED_FOLDERS = ("node_modules", ".git", "target", "dist", "build", "__pycache__", ".venv")
TRIVIAL = "^(ls|cd|pwd|clear|exit|history)( |$)"


def read_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """A JSON-lines log. Strict: one bad line fails the read; else bad lines are left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_notes(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("md", "txt"), most_kb: int = 512) -> DataFrame:
    """path, text: files below a folder, by extension and size, without vendored folders; front matter dropped, the path put first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    end = F.lower(F.substring_index("path", ".", -1))
    skipped = F.col("path").rlike("/(" + "|".join(x.replace(".", "\\.") for x in SKIPPED_FOLDERS) + ")/")
    text = strip_frontmatter(F.col("content").cast("string"))
    name = F.substring_index("path", "/", -1)
    return files.filter(end.isin(*extensions) & (F.col("length") <= most_kb * 1024) & ~skipped).select("path", F.concat(F.lit("[File: "), name, F.lit("]\n"), text).alias("text"))


def read_shell_history(spark: SparkSession, path: str, since_epoch: int = 0) -> DataFrame:
    """ts, seconds, command of an extended history (``: time:seconds;command``), oldest first kept by ts; trivial commands are left out."""
    lines = spark.read.text(path)
    part = lambda i: F.regexp_extract("value", "^: (\\d+):(\\d+);(.*)$", i)
    rows = lines.filter(part(1) != "").select(F.timestamp_seconds(part(1).cast("long")).alias("ts"), part(2).cast("long").alias("seconds"), F.trim(part(3)).alias("command"))
    return rows.filter((F.unix_seconds("ts") >= since_epoch) & ~F.col("command").rlike(TRIVIAL))


def read_captures(spark: SparkSession, folder: str, streaming: bool = False) -> DataFrame:
    """url, title, selection as JSON files -> text ``url title — selection``, in batch or as a stream."""
    reader = (spark.readStream if streaming else spark.read).schema("url string, title string, selection string")
    return reader.json(folder).select("url", F.concat_ws(" — ", F.concat_ws(" ", "url", "title"), F.nullif(F.col("selection"), F.lit(""))).alias("text"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, id, question, answers, category of a conversational question set (one JSON document)."""
    schema = "samples array<struct<sample_id:string,questions:array<struct<id:string,question:string,answers:array<string>,category:string>>>>"
    s = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("samples").alias("s"))
    return s.select("s.sample_id", F.explode("s.questions").alias("q")).select("sample_id", "q.*")


def recent(df: DataFrame, n: int, *order) -> DataFrame:
    """The newest n rows: a top-k, not a sort of everything."""
    return df.orderBy(*order).limit(n)


def read_cases(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``dialogue``: id, category, context_turns, question, gold_answer, gold_spans; ``claims``: id, two claims, a question and the answer after the second; ``store``: what
    is stored, the question and its answers. One JSON array."""
    schemas = {
        "dialogue": "id string, category string, context_turns array<string>, question string, gold_answer string, gold_spans array<string>",
        "claims": "id string, initial_claim string, contradicting_claim string, query string, expected_answer string, contradiction_should_surface boolean",
        "store": "id string, store string, query string, answers array<string>",
    }
    return spark.read.schema(schemas[kind]).option("multiLine", "true").json(path)


def mini_fixtures(spark: SparkSession) -> DataFrame:
    """Facts, what contradicts them, and what is true afterwards."""
    rows = [
        ("mini-1", "Mina lives in Oslo.", "Mina moved to Turin.", "Where does Mina live?", "Turin"),
        ("mini-2", "The review is on Tuesday.", "The review was put off to Thursday.", "When is the review?", "Thursday"),
        ("mini-3", "Jon keeps the garden.", "Since May Rosa keeps the garden.", "Who keeps the garden?", "Rosa"),
    ]
    return spark.createDataFrame(rows, "id string, fact string, contradiction string, question string, expected string")


def import_plan(notes: DataFrame) -> DataFrame:
    """What an import of notes would take, without taking it: extension, files, characters."""
    end = F.lower(F.substring_index("path", ".", -1))
    return notes.groupBy(end.alias("extension")).agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("characters"))


def read_clipboard(spark: SparkSession, folder: str, streaming: bool = False) -> DataFrame:
    """Texts that a clipboard watcher drops as files, each file one row: path, text."""
    reader = (spark.readStream if streaming else spark.read).format("text").option("wholetext", "true")
    return reader.load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
