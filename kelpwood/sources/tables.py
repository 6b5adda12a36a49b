"""The engine's concepts as views over the star-schema tables, and the same views as SQL.

Ids of entities are a letter for the kind and the key. Confidence, context and creation time are fixed expressions of the key, so that
any engine computes the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import Memory

HIGH, MEDIUM = ("1-URGENT", "2-HIGH"), ("3-MEDIUM",)
COMMITMENT_DAYS = 30


def confidence(k):
    return (k * 37 % 100) / 100.0


class Tables(Memory):
    """Lazily read tables of one folder and the views on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def entities(self) -> DataFrame:
        """id, name, entity_type, k, confidence, context_id (null: unscoped), created_at."""

        def kind(df, letter, key, name, entity_type):
            return df.select(F.concat(F.lit(letter), key).alias("id"), F.col(name).alias("name"), F.lit(entity_type).alias("entity_type"), F.col(key).cast("long").alias("k"))

        parts = [
            kind(self.customer, "c", "c_custkey", "c_name", "person"),
            kind(self.supplier, "s", "s_suppkey", "s_name", "organization"),
            kind(self.part, "p", "p_partkey", "p_name", "concept"),
            kind(self.nation, "n", "n_nationkey", "n_name", "place"),
            kind(self.region, "r", "r_regionkey", "r_name", "place"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select("*", confidence(F.col("k")).alias("confidence"), F.nullif(F.col("k") % 4, F.lit(0)).alias("context_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("k") % 365 * 86400).alias("created_at"))

    @cached_property
    def triples(self) -> DataFrame:
        """subject_id, predicate, object_id, confidence: orders as edges between customers, parts, suppliers, nations and regions."""

        def edge(df, s, sk, pred, o, ok):
            return df.select(F.concat(F.lit(s), sk).alias("subject_id"), F.lit(pred).alias("predicate"), F.concat(F.lit(o), ok).alias("object_id"), F.col(sk).cast("long").alias("a"), F.col(ok).cast("long").alias("b"))

        bought = self.orders.join(self.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey").distinct()
        parts = [
            edge(bought, "c", "o_custkey", "bought", "p", "l_partkey"),
            edge(self.lineitem.select("l_partkey", "l_suppkey").distinct(), "p", "l_partkey", "supplied_by", "s", "l_suppkey"),
            edge(self.supplier, "s", "s_suppkey", "located_in", "n", "s_nationkey"),
            edge(self.customer, "c", "c_custkey", "located_in", "n", "c_nationkey"),
            edge(self.nation, "n", "n_nationkey", "part_of", "r", "n_regionkey"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select("subject_id", "predicate", "object_id", ((F.col("a") * 13 + F.col("b") * 7) % 100 / 100.0).alias("confidence"))

    @cached_property
    def commitments(self) -> DataFrame:
        """id, source, statement, stakes, state, made_at, horizon."""
        o = F.col("o_orderpriority")
        return self.orders.select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("c"), "o_custkey").alias("source"),
            F.lower(F.substring_index(o, "-", -1)).alias("statement"),
            F.when(o.isin(*HIGH), "high").when(o.isin(*MEDIUM), "medium").otherwise("low").alias("stakes"),
            F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "acted").otherwise("open").alias("state"),
            F.col("o_orderdate").alias("made_at"),
            (F.col("o_orderdate") + F.make_dt_interval((COMMITMENT_DAYS + F.col("o_orderkey") % 60).cast("int"))).alias("horizon"),
        )

    @cached_property
    def outcomes(self) -> DataFrame:
        """commitment_id, polarity (-1, 0, 1), observed_at of completed commitments with lines."""
        done = self.orders.filter("o_orderstatus = 'F'").select("o_orderkey")
        agg = self.lineitem.join(done, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy(F.col("l_orderkey").alias("commitment_id")).agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("r"), F.sum(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).alias("a"), F.max("l_shipdate").alias("observed_at"))
        return agg.select("commitment_id", F.when(F.col("r") > F.col("a"), -1).when(F.col("a") > F.col("r"), 1).otherwise(0).alias("polarity"), "observed_at")

    @cached_property
    def facts(self) -> DataFrame:
        """Bitemporal: entity (customer), fact (order), valid [valid_from, valid_to), recorded_at, superseded_at (null: open)."""
        from pyspark.sql import Window

        w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        shipped = self.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("recorded_at"), F.max("l_shipdate").alias("last"))
        base = self.orders.join(shipped, "o_orderkey").withColumn("valid_to", F.lead("o_orderdate").over(w))
        return base.select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("fact_id"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("valid_from"), "valid_to", "recorded_at", F.when(F.col("o_orderstatus") == "P", F.col("last") + F.expr("interval 30 days")).alias("superseded_at"))


#: The views above as SQL, to be put before a query's own SELECT.
CTE = {
    "entities": """entities as (
  select id, name, entity_type, k, (k * 37 % 100) / 100.0::double as confidence, nullif(k % 4, 0) as context_id,
    make_timestamp((1704067200 + k % 365 * 86400) * 1000000) as created_at
  from (select 'c' || c_custkey as id, c_name as name, 'person' as entity_type, c_custkey::bigint as k from customer
    union all select 's' || s_suppkey, s_name, 'organization', s_suppkey::bigint from supplier
    union all select 'p' || p_partkey, p_name, 'concept', p_partkey::bigint from part
    union all select 'n' || n_nationkey, n_name, 'place', n_nationkey::bigint from nation
    union all select 'r' || r_regionkey, r_name, 'place', r_regionkey::bigint from region))""",
    "triples": """triples as (
  select subject_id, predicate, object_id, ((a * 13 + b * 7) % 100) / 100.0::double as confidence
  from (select 'c' || o_custkey as subject_id, 'bought' as predicate, 'p' || l_partkey as object_id, o_custkey::bigint as a, l_partkey::bigint as b from (select distinct o_custkey, l_partkey from orders join lineitem on o_orderkey = l_orderkey)
    union all select 'p' || l_partkey, 'supplied_by', 's' || l_suppkey, l_partkey, l_suppkey from (select distinct l_partkey, l_suppkey from lineitem)
    union all select 's' || s_suppkey, 'located_in', 'n' || s_nationkey, s_suppkey, s_nationkey from supplier
    union all select 'c' || c_custkey, 'located_in', 'n' || c_nationkey, c_custkey, c_nationkey from customer
    union all select 'n' || n_nationkey, 'part_of', 'r' || n_regionkey, n_nationkey, n_regionkey from nation))""",
    "commitments": """commitments as (
  select o_orderkey as id, 'c' || o_custkey as source, lower(split_part(o_orderpriority, '-', 2)) as statement,
    case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'high' when o_orderpriority = '3-MEDIUM' then 'medium' else 'low' end as stakes,
    case o_orderstatus when 'F' then 'completed' when 'P' then 'acted' else 'open' end as state,
    o_orderdate as made_at, o_orderdate + to_days((30 + o_orderkey % 60)::int) as horizon
  from orders)""",
    "outcomes": """outcomes as (
  select l_orderkey as commitment_id, case when r > a then -1 when a > r then 1 else 0 end as polarity, observed_at
  from (select l_orderkey, sum(case when l_returnflag = 'R' then 1 else 0 end) as r, sum(case when l_returnflag = 'A' then 1 else 0 end) as a, max(l_shipdate) as observed_at
    from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F') group by 1))""",
    "facts": """facts as (
  select o_custkey as entity_id, o.o_orderkey as fact_id, o_totalprice as value, o_orderdate as valid_from,
    lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o.o_orderkey) as valid_to,
    recorded_at, case when o_orderstatus = 'P' then last + interval 30 days end as superseded_at
  from orders o join (select l_orderkey, min(l_shipdate) as recorded_at, max(l_shipdate) as last from lineitem group by 1) l on l.l_orderkey = o.o_orderkey)""",
}


def with_views(*names: str) -> str:
    return "with " + ", ".join(CTE[n] for n in names) + " "
