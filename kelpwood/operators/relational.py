"""Joins, anti-joins, set algebra and change logs over entities, triples, contexts and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FUNCTIONAL = ("works_at", "depends_on", "has_property", "located_in")


def latest(log: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key of a change log (last write wins)."""
    fields = [c for c in log.columns if c not in key]
    newest = F.max_by(F.struct(*fields), F.struct(*order))
    return log.groupBy(*key).agg(newest.alias("__row")).select(*key, *[F.col(f"__row.{c}").alias(c) for c in fields])


def endpoints(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("subject_id", "object_id")).alias("id"))


def orphans(entities: DataFrame, triples: DataFrame) -> DataFrame:
    return entities.join(endpoints(triples), "id", "left_anti")


def triples_of(triples: DataFrame, entity_id: str) -> DataFrame:
    return triples.filter((F.col("subject_id") == entity_id) | (F.col("object_id") == entity_id))


def in_scope(df: DataFrame, context: int | None, cross_context: bool = False) -> DataFrame:
    """Rows without a context are always visible; without an active context all are."""
    return df if context is None or cross_context else df.filter(F.col("context_id").isNull() | (F.col("context_id") == context))


def apply_view(entities: DataFrame, members: DataFrame) -> DataFrame:
    """``members``: kind ('include' / 'exclude'), member_type ('entity' / 'context'), member_id. Excludes first; includes count only if there are any."""
    pick = lambda kind, what: members.filter((F.col("kind") == kind) & (F.col("member_type") == what)).select("member_id").distinct()
    out = entities.join(pick("exclude", "entity").withColumnRenamed("member_id", "id"), "id", "left_anti")
    bad = pick("exclude", "context").select(F.col("member_id").cast("long").alias("context_id"))
    out = out.join(bad, "context_id", "left_anti")
    has = members.filter("kind = 'include'").agg((F.count("*") > 0).alias("any"))
    ids = pick("include", "entity").select(F.col("member_id").alias("id"), F.lit(True).alias("by_id"))
    contexts = pick("include", "context").select(F.col("member_id").cast("long").alias("context_id"), F.lit(True).alias("by_context"))
    out = out.join(ids, "id", "left").join(contexts, "context_id", "left").join(F.broadcast(has))
    return out.filter(~F.col("any") | F.coalesce("by_id", "by_context", F.lit(False))).drop("any", "by_id", "by_context")


def functional_contradictions(triples: DataFrame, functional=FUNCTIONAL) -> DataFrame:
    """Pairs of objects of one subject and one single-valued predicate."""
    t = triples.filter(F.col("predicate").isin(*functional)).select("subject_id", "predicate", "object_id").distinct()
    return t.join(t.withColumnRenamed("object_id", "other_id"), ["subject_id", "predicate"]).filter("object_id < other_id")


def backlinks(triples: DataFrame, entities: DataFrame, target: str, limit: int, related_to: bool = False) -> DataFrame:
    """Edges into ``target`` without self-loops and dangling ends, most confident first."""
    t = triples.filter((F.col("object_id") == target) & (F.col("subject_id") != target))
    t = t if related_to else t.filter("predicate <> 'related_to'")
    return t.join(entities.select(F.col("id").alias("subject_id"), "name"), "subject_id").orderBy(F.desc("confidence"), "subject_id", "predicate").limit(limit)


def check_edges(triples: DataFrame, entities: DataFrame, links: DataFrame) -> DataFrame:
    """``links``: source_type, link, target_type. An edge is allowed if a link type of its name fits, or an endpoint has no type."""
    types = entities.select("id", "entity_type")
    t = triples.join(types.select(F.col("id").alias("subject_id"), F.col("entity_type").alias("source_type")), "subject_id", "left").join(types.select(F.col("id").alias("object_id"), F.col("entity_type").alias("target_type")), "object_id", "left")
    known = links.select("source_type", F.col("link").alias("predicate"), "target_type", F.lit(True).alias("known"))
    return t.join(F.broadcast(known), ["source_type", "predicate", "target_type"], "left").withColumn("allowed", F.coalesce("known", F.col("source_type").isNull() | F.col("target_type").isNull())).drop("known")


# ----------------------------------------------------------------- member lists of threads
def members_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tall membership (member_kind, member_id, ord): left order first, then what is only in b, whose order goes on behind the left's last (it may have gaps)."""
    both = a.select("member_kind", "member_id", F.lit(0).alias("side"), "ord").unionByName(b.select("member_kind", "member_id", F.lit(1).alias("side"), "ord"))
    first = both.groupBy("member_kind", "member_id").agg(F.min(F.struct("side", "ord")).alias("at"))
    last = F.broadcast(a.groupBy("member_kind").agg(F.max("ord").alias("last")))  # a row for each kind
    behind = F.when(F.col("at.side") == 1, F.coalesce("last", F.lit(0))).otherwise(0)
    return first.join(last, "member_kind", "left").select("member_kind", "member_id", (F.col("at.ord") + behind).alias("ord"))


def members_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("member_kind", "member_id"), ["member_kind", "member_id"], "left_semi")


def members_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("member_kind", "member_id"), ["member_kind", "member_id"], "left_anti")


def evaluate(expr: dict, thread) -> DataFrame:
    """A set expression as JSON: {"thread": id} | {"union" / "intersect" / "diff": [e, e]} | {"filter": e, "kind": k}.

    ``thread``: id -> membership. The whole expression becomes one plan.
    """
    (op,) = [k for k in expr if k != "kind"]
    if op == "thread":
        return thread(expr[op])
    if op == "filter":
        kind, inner = expr["kind"], evaluate(expr[op], thread)
        drop = {"only_captures": "commitment", "only_commitments": "capture"}.get(kind)
        return inner.filter(F.col("member_kind") != drop) if drop else inner.filter(F.col("member_kind") == kind)
    left, right = (evaluate(e, thread) for e in expr[op])
    return {"union": members_union, "intersect": members_intersect, "diff": members_diff}[op](left, right)


# ----------------------------------------------------------------- namespaces
def merge_contexts(df: DataFrame, merged: list[int], into: int) -> DataFrame:
    return df.withColumn("context_id", F.when(F.col("context_id").isin(*merged), F.lit(into)).otherwise(F.col("context_id")))


def split_context(entities: DataFrame, triples: DataFrame, context: int, entity_type: str, into: int) -> tuple[DataFrame, DataFrame]:
    """Move entities of a type, and with them the triples whose subject moved."""
    moves = (F.col("context_id") == context) & (F.col("entity_type") == entity_type)
    moved = entities.filter(moves).select(F.col("id").alias("subject_id"), F.lit(into).alias("moved"))
    return entities.withColumn("context_id", F.when(moves, F.lit(into)).otherwise(F.col("context_id"))), triples.join(moved, "subject_id", "left").withColumn("context_id", F.col("moved")).drop("moved")


def fuzzy_match(names: DataFrame, entities: DataFrame, most: int = 2) -> DataFrame:
    """``names``: query. The entity of equal fingerprint, else of the least edit distance up to ``most``.

    An entity's name is cut into ``most`` + 1 pieces, of which one is whole in any name within ``most`` edits, at most ``most`` places further left or
    right. Names are joined by length and piece (or by fingerprint) and never all with all, and none within the distance is lost.
    """
    from ..functions.scalars import fingerprint

    k, reach = most + 1, range(-most, most + 1)

    def piece(name, n, i, shift=0):
        at, end = F.floor(i * n / k) + shift, F.floor((i + 1) * n / k) + shift
        key = F.concat_ws(":", n.cast("string"), F.lit(str(i)), F.substring(name, (at + 1).cast("int"), (end - at).cast("int")))
        return F.when((n >= 0) & (at >= 0) & (end <= F.length(name)), key)

    def keyed(df, name, pieces):
        all_keys = F.array(F.concat(F.lit("f"), fingerprint(F.col(name))), *pieces)
        return df.withColumn("key", F.explode(F.array_distinct(F.array_compact(all_keys))))

    ql, nl = F.col("ql"), F.col("nl")
    q = keyed(names.select(F.lower("query").alias("ql"), "query"), "ql", [piece(ql, F.length("ql") + more, i, shift) for more in reach for i in range(k) for shift in reach])
    e = keyed(entities.select("id", F.lower("name").alias("nl"), "name"), "nl", [piece(nl, F.length("nl"), i) for i in range(k)])
    d = F.when(fingerprint(F.col("ql")) == fingerprint(F.col("nl")), 0).otherwise(F.levenshtein("ql", "nl"))
    hit = q.join(e, "key").filter(F.abs(F.length("ql") - F.length("nl")) <= most).withColumn("distance", d).filter(F.col("distance") <= most)
    return hit.groupBy("query").agg(F.min(F.struct("distance", "id")).alias("m")).select("query", F.col("m.id").alias("id"), F.col("m.distance").alias("distance"))


def merge_duplicates(entities: DataFrame, name) -> DataFrame:
    """One entity per normalised name: the most confident, which absorbs 0.3 of the others' confidence."""
    keyed = entities.withColumn("key", name)
    best = keyed.groupBy("key").agg(F.max_by(F.struct("id", "confidence"), F.struct("confidence", F.col("id"))).alias("b"), F.sum("confidence").alias("total"), F.count("*").alias("merged"))
    return best.select("key", F.col("b.id").alias("id"), F.least(F.lit(1.0), F.col("b.confidence") + 0.3 * (F.col("total") - F.col("b.confidence"))).alias("confidence"), "merged")
