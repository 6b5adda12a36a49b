"""Object and link types: versions, bindings, domains and their compatibility, proposals from clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import first_match

#: The builtin object types, and the domains that go together besides equal ones.
OBJECT_TYPES = ("person", "organization", "project", "task", "event", "document", "place", "technology", "concept", "decision", "goal", "source")
DOMAINS = {"person": "social", "organization": "social", "project": "work", "task": "work", "event": "time", "document": "information", "place": "space", "technology": "technical", "concept": "abstract"}
COMPATIBLE = (("social", "work"), ("social", "space"), ("social", "time"), ("work", "technical"), ("work", "time"), ("work", "information"), ("information", "technical"), ("information", "abstract"))
FICTION = "\\b(novel|character|fictional|wizard|dragon|saga)\\b"


def domain(entity_type: Column, name: Column) -> Column:
    """The domain of a type; names that sound like fiction are fictional."""
    by_type = first_match([(entity_type == k, F.lit(v)) for k, v in DOMAINS.items()], F.lit("unknown"))
    return F.when(F.lower(name).rlike(FICTION), "fictional").otherwise(by_type)


def compatible(a: Column, b: Column) -> Column:
    """Equal domains, named pairs in either order, and anything with an unknown one; fiction only goes with fiction."""
    pairs = first_match([((a == x) & (b == y) | (a == y) & (b == x), F.lit(True)) for x, y in COMPATIBLE], F.lit(False))
    fiction = (a == "fictional") | (b == "fictional")
    return F.when(fiction, a == b).otherwise((a == b) | (a == "unknown") | (b == "unknown") | pairs)


def builtin(spark) -> DataFrame:
    return spark.createDataFrame([(n, 1) for n in OBJECT_TYPES], "name string, version int")


def seed(types: DataFrame) -> DataFrame:
    """The builtin types where a table has none at all."""
    spark = types.sparkSession
    empty = types.agg((F.count("*") == 0).alias("empty"))
    return types.select("name", "version").unionByName(builtin(spark).join(F.broadcast(empty)).filter("empty").drop("empty"))


def proposed_types(terms: DataFrame, sizes: DataFrame, least_members: int = 5, least_score: float = 0.02) -> DataFrame:
    """``terms``: grp, term, score; ``sizes``: grp, members. A type for each large cluster whose best term is telling: name in camel case, support."""
    best = terms.groupBy("grp").agg(F.max(F.struct("score", "term")).alias("t"))
    j = best.join(sizes, "grp").filter((F.col("members") >= least_members) & (F.col("t.score") >= least_score))
    name = F.regexp_replace(F.initcap(F.regexp_replace("t.term", "[^A-Za-z0-9]+", " ")), " ", "")
    return j.select("grp", name.alias("name"), F.col("members").alias("support"))


def merged_proposals(log: DataFrame) -> DataFrame:
    """Pending proposals of one kind and name as one: support counts one at least each time."""
    p = log.filter("status = 'pending'")
    support = F.sum(F.greatest(F.col("support"), F.lit(1))).alias("support")
    return p.groupBy("kind", "name").agg(support, F.max_by("id", F.struct("created_at", "id")).alias("evidence"))


def unknown_proposals(proposals: DataFrame, types: DataFrame, log: DataFrame) -> DataFrame:
    """Proposals whose name is neither a type nor was rejected."""
    rejected = log.filter("status = 'rejected'").select("name").distinct()
    return proposals.join(types.select("name"), "name", "left_anti").join(rejected, "name", "left_anti")
