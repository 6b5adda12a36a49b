"""Writers: change logs, bounded rings, markdown and portable JSON. Tables are appended to; the latest rows are a view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import redact, slug
from ..operators.relational import latest


def append(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def upsert(log: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """The log with changes appended, each stamped with the key's next version."""
    last = log.groupBy(*key).agg(F.max(version).alias("__last"))
    stamped = changes.join(last, key, "left").withColumn(version, F.coalesce(F.col("__last"), F.lit(0)) + 1).select(*log.columns)
    return log.unionByName(stamped)


def current(log: DataFrame, key: list[str], version: str) -> DataFrame:
    return latest(log, key, [F.col(version)])


def insert_if_absent(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.dropDuplicates(key).join(table.select(*key), key, "left_anti").select(*table.columns)


def compact_ring(df: DataFrame, capacity: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(capacity)


def delete_entity(entities: DataFrame, triples: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities without those in ``gone`` (id), and triples with neither end in it."""
    ends = gone.select("id")
    kept = triples.join(ends.withColumnRenamed("id", "subject_id"), "subject_id", "left_anti").join(ends.withColumnRenamed("id", "object_id"), "object_id", "left_anti")
    return entities.join(ends, "id", "left_anti"), kept.select(*triples.columns)


def markdown(entities: DataFrame, triples: DataFrame, mask: bool = False) -> DataFrame:
    """file, text: one page per entity with links to what it points to."""
    link = F.concat(F.lit("- "), "predicate", F.lit(" [["), "object_id", F.lit("]]"))
    links = triples.groupBy(F.col("subject_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(link)), "\n").alias("links"))
    body = F.concat(F.lit("# "), "name", F.lit("\n\ntype: "), "entity_type", F.lit("\n\n"), F.coalesce("links", F.lit("")))
    page = entities.join(links, "id", "left").select(F.concat(slug(F.concat("id", F.lit("-"), "name")), F.lit(".md")).alias("file"), body.alias("text"))
    return page.withColumn("text", redact(F.col("text"))) if mask else page


def portable(nodes: DataFrame, edges: DataFrame, least_support: int = 2) -> DataFrame:
    """One JSON line for each node and for each edge of enough support with both ends among the nodes; tokens: a quarter of the length."""
    ids = nodes.select("id").distinct()
    inside = edges.filter(F.col("support") >= least_support).join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("id", F.substring("label", 1, 80).alias("label"))).alias("json"))
    e = inside.select(F.lit("edge").alias("kind"), F.to_json(F.struct("from_id", "to_id", "support")).alias("json"))
    return n.unionByName(e).withColumn("tokens", F.floor(F.length("json") / 4))


def compact(spark, path: str, to: str, files: int) -> None:
    """A table's small files as ``files`` larger ones, written beside it; the caller swaps the folders."""
    spark.read.parquet(path).repartition(files).write.parquet(to)


def purge_folder(df: DataFrame, kept, to: str) -> None:
    """What a retention rule keeps, written as a new table."""
    df.filter(F.coalesce(kept, F.lit(True))).write.parquet(to)
