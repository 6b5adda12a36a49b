"""Scans, joins, aggregations, set operations and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from ..operators.intervals import overlap_counts, overlapping
from ..operators.quantiles import exact_quantiles
from ..registry import query
from ..sources.tables import Tables, with_views

E, T, ET = with_views("entities"), with_views("triples"), with_views("entities", "triples")


# ----------------------------------------------------------------- sequences
def sequence(events, key: str, kind: str = "event_type"):
    """Consecutive pairs of different kinds within a key, with support."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    pairs = events.select(F.col(kind).alias("from_kind"), F.lead(kind).over(w).alias("to_kind"), "value").filter("to_kind is not null and from_kind <> to_kind")
    return pairs.groupBy("from_kind", "to_kind").agg(F.count("*").alias("support"), F.round(F.sum("value"), 4).alias("strength"))


_SEQ = """with s as (select event_type as from_kind, lead(event_type) over (partition by user_id order by ts, event_id) as to_kind, value from events)
select from_kind, to_kind, count(*) as support, round(sum(value), 4) as strength from s where to_kind is not null and from_kind <> to_kind group by 1, 2"""


@query(_SEQ + " having count(*) >= 2")
def sequence_edges(t: Tables):
    return sequence(t.events, "user_id").filter("support >= 2")


@query(_SEQ + " having count(*) >= 400")
def visible_edges(t: Tables):
    return sequence(t.events, "user_id").filter("support >= 400")


@query("select user_id, event_id, ts, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events qualify n <= 8")
def ring_tail(t: Tables):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.select("user_id", "event_id", "ts", F.row_number().over(w).alias("n")).filter("n <= 8")


@query("select event_id, greatest(0.2, 1 - 0.2 * (count(*) over (partition by user_id, event_type order by ts, event_id rows unbounded preceding) - 1)) as surprise from events")
def surprise_for(t: Tables):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.greatest(F.lit(0.2), 1 - 0.2 * (F.count("*").over(w) - 1)).alias("surprise"))


@query("select user_id, round(0.5 + least(1.0, greatest(0, sum(pow(0.9, n) * v) / sum(pow(0.9, n)))), 6) as factor from (select user_id, case when event_type = 'error' then 0.0 else 1.0 end as v, row_number() over (partition by user_id order by ts desc, event_id desc) - 1 as n from events) group by 1")
def feedback_aggregate(t: Tables):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = t.events.select("user_id", F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias("v"), (F.row_number().over(w) - 1).alias("n"))
    weight = F.pow(F.lit(0.9), F.col("n"))
    mean = F.sum(weight * F.col("v")) / F.sum(weight)
    return e.groupBy("user_id").agg(F.round(0.5 + F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)), 6).alias("factor"))


@query("select user_id, event_type, max_by(event_id, struct_pack(ts := ts, event_id := event_id)) as event_id, max(ts) as ts from events group by 1, 2")
def last_write_wins(t: Tables):
    return R.latest(t.events.select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])


@query("""with g as (select user_id, ts, event_id, value, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 6 hours then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),
n as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from g)
select user_id, min(ts) as started_at, max(ts) as last_at, count(*) as events, round(sum(value), 4) as value from n group by user_id, s""")
def session_windows(t: Tables):
    s = t.events.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_at"), F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return s.drop("session_window")


# ----------------------------------------------------------------- scans and filters
@query(E + "select id, name, entity_type from entities where lower(name) = 'customer#000000007'")
def find_entity_by_name_icase(t: Tables):
    return t.entities.filter(F.lower("name") == "customer#000000007").select("id", "name", "entity_type")


@query(E + "select id, name from entities where length(name) between 7 and 11 and entity_type <> 'person'")
def entities_near_length(t: Tables):
    return t.entities.filter(F.length("name").between(7, 11) & (F.col("entity_type") != "person")).select("id", "name")


@query(ET + "select * from triples where subject_id = 's1' or object_id = 's1'")
def get_triples_for_entity(t: Tables):
    return R.triples_of(t.triples, "s1")


@query(E + "select id, created_at from entities where created_at >= timestamp '2024-02-01' and created_at < timestamp '2024-03-01'")
def entities_by_time_range(t: Tables):
    return t.entities.filter("created_at >= timestamp'2024-02-01' and created_at < timestamp'2024-03-01'").select("id", "created_at")


@query("select distinct user_id from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-12'")
def accessed_in_range(t: Tables):
    return t.events.filter("ts >= timestamp'2024-01-10' and ts < timestamp'2024-01-12'").select("user_id").distinct()


@query(E + "select id, context_id from entities where context_id is null or context_id = 2")
def scope_filter(t: Tables):
    return R.in_scope(t.entities, 2).select("id", "context_id")


@query(E + """select id from entities where id not in ('c1', 'c6', 'p9') and (context_id is null or context_id <> 3) and (coalesce(context_id, -1) = 2 or id in ('s1', 's4'))""")
def view_filter(t: Tables):
    rows = [("exclude", "entity", "c1"), ("exclude", "entity", "c6"), ("exclude", "entity", "p9"), ("exclude", "context", "3"), ("include", "context", "2"), ("include", "entity", "s1"), ("include", "entity", "s4")]
    return R.apply_view(t.entities, t.spark.createDataFrame(rows, "kind string, member_type string, member_id string")).select("id")


@query(T + "select case when confidence >= 0.7 then 'accept' when confidence >= 0.3 then 'pending' else 'drop' end as route, count(*) as triples from triples group by 1")
def confidence_routing(t: Tables):
    return t.triples.groupBy(S.route(F.col("confidence")).alias("route")).agg(F.count("*").alias("triples"))


@query(E + "select id, case when k % 3 = 0 then confidence when k % 3 = 1 then confidence * 0.5 else 0.0 end as effective from entities")
def effective_confidence(t: Tables):
    status = F.when(F.col("k") % 3 == 0, "in").when(F.col("k") % 3 == 1, "contradicted").otherwise("out")
    return t.entities.select("id", S.effective_confidence(F.col("confidence"), status).alias("effective"))


# ----------------------------------------------------------------- joins
@query(ET + "select id from entities where id not in (select subject_id from triples where predicate = 'bought' union select object_id from triples where predicate = 'bought')")
def orphan_entities(t: Tables):
    """Entities that no purchase touches."""
    return R.orphans(t.entities, t.triples.filter("predicate = 'bought'")).select("id")


@query(ET + "select t.subject_id, t.predicate, e.name, t.confidence from triples t join entities e on e.id = t.subject_id where t.object_id = 'n3' and t.subject_id <> 'n3' order by t.confidence desc, t.subject_id, t.predicate limit 20")
def backlinks(t: Tables):
    return R.backlinks(t.triples, t.entities, "n3", 20).select("subject_id", "predicate", "name", "confidence")


@query(ET + "select s.entity_type as source_type, t.predicate, o.entity_type as target_type, count(*) as edges, round(avg(t.confidence), 6) as confidence from triples t join entities s on s.id = t.subject_id join entities o on o.id = t.object_id group by 1, 2, 3")
def object_type_star(t: Tables):
    types = t.entities.select("id", "entity_type")
    j = t.triples.join(types.select(F.col("id").alias("subject_id"), F.col("entity_type").alias("source_type")), "subject_id").join(types.select(F.col("id").alias("object_id"), F.col("entity_type").alias("target_type")), "object_id")
    return j.groupBy("source_type", "predicate", "target_type").agg(F.count("*").alias("edges"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(ET + "select t.predicate, count(*) as edges, sum(case when (s.entity_type, t.predicate, o.entity_type) in (('person', 'bought', 'concept'), ('person', 'located_in', 'place'), ('place', 'part_of', 'place')) then 1 else 0 end) as allowed from triples t join entities s on s.id = t.subject_id join entities o on o.id = t.object_id group by 1")
def link_type_check(t: Tables):
    links = t.spark.createDataFrame([("person", "bought", "concept"), ("person", "located_in", "place"), ("place", "part_of", "place")], "source_type string, link string, target_type string")
    return R.check_edges(t.triples, t.entities, links).groupBy("predicate").agg(F.count("*").alias("edges"), F.sum(F.col("allowed").cast("int")).alias("allowed"))


@query(T + "select a.subject_id, a.object_id, b.object_id as other_id from triples a join triples b on a.subject_id = b.subject_id and a.predicate = b.predicate and a.object_id < b.object_id where a.predicate = 'supplied_by'")
def functional_contradictions(t: Tables):
    return R.functional_contradictions(t.triples, ("supplied_by",)).drop("predicate")


_FACT_CONFLICT = """, p as (select entity_id, fact_id, valid_from, superseded_at from facts),
c as (select a.entity_id, a.fact_id as value_a, b.fact_id as value_b from p a join p b on a.entity_id = b.entity_id and a.fact_id < b.fact_id
  and (a.valid_from is null or b.superseded_at is null or a.valid_from < b.superseded_at) and (b.valid_from is null or a.superseded_at is null or b.valid_from < a.superseded_at)) """


#: Of facts that hold at some time.
_HELD_CONFLICT = _FACT_CONFLICT.replace("from facts),", "from facts where valid_from is null or superseded_at is null or valid_from < superseded_at),")


@query(with_views("facts") + _FACT_CONFLICT + "select entity_id, value_a, value_b from c")
def contradiction_overlap(t: Tables):
    return overlapping(t.facts, ["entity_id"], "fact_id", "valid_from", "superseded_at").select("entity_id", "value_a", "value_b")


@query(with_views("facts") + _HELD_CONFLICT + "select (select count(distinct entity_id) from c) as conflicted, (select count(distinct entity_id) from facts) as groups, round((select count(distinct entity_id) from c) / (select count(distinct entity_id) from facts), 6) as rate")
def contradiction_rate(t: Tables):
    """Of facts that hold at some time, by a sweep without pairs."""
    counts = overlap_counts(t.facts, ["entity_id"], "fact_id", "valid_from", "superseded_at")
    bad = counts.filter("overlaps > 0").agg(F.count_distinct("entity_id").alias("conflicted"))
    return bad.join(F.broadcast(t.facts.agg(F.count_distinct("entity_id").alias("groups")))).withColumn("rate", F.round(F.col("conflicted") / F.col("groups"), 6))


@query(with_views("facts") + _HELD_CONFLICT + ", n as (select v, count(*) as n from (select value_a as v from c union all select value_b from c) group by 1) select entity_id, fact_id, coalesce(n, 0) as overlaps from p left join n on v = fact_id")
def overlapping_facts(t: Tables):
    """How many other facts of its entity each fact overlaps, of facts that hold at some time; by a sweep without pairs."""
    return overlap_counts(t.facts, ["entity_id"], "fact_id", "valid_from", "superseded_at").select("entity_id", F.col("value").alias("fact_id"), "overlaps")


@query(E + "select key, max_by(id, struct_pack(c := confidence, id := id)) as id, round(least(1.0, max(confidence) + 0.3 * (sum(confidence) - max(confidence))), 6) as confidence, count(*) as merged from (select *, trim(regexp_replace(regexp_replace(lower(name), '[_-]', ' ', 'g'), ' +', ' ', 'g')) as key from entities) group by key")
def merge_duplicates(t: Tables):
    return R.merge_duplicates(t.entities, S.normalize_name(F.col("name"))).withColumn("confidence", F.round("confidence", 6))


_FUZZY = ("Supplier#000000003", "supplier#00000004", "xupplier#000000009", "suplier#000000005", "chima", "small rimg", "nobody")
_PRINT = "regexp_replace(trim(regexp_replace({}, '[^a-z0-9]+', ' ', 'g')), ' s$', '')"
_PRINT = f"(select case when length(y) < 3 then '' else y end from (select case when regexp_matches(x, '[^s]s$') then x[:-2] else x end as y from (select {_PRINT} as x)))"


@query(E + f""", q(query) as (values {', '.join(f"('{x}')" for x in _FUZZY)}),
d as (select query, id, lower(query) as ql, lower(name) as n from q, entities where abs(length(query) - length(name)) <= 2),
h as (select query, id, case when {_PRINT.format('ql')} = {_PRINT.format('n')} then 0 else levenshtein(ql, n) end as distance from d)
select query, arg_min(id, struct_pack(d := distance, id := id)) as id, min(distance)::int as distance from h where distance <= 2 group by query""")
def fuzzy_match(t: Tables):
    """A stated set of names against all entities, up to two edits."""
    return R.fuzzy_match(t.spark.createDataFrame([(x,) for x in _FUZZY], "query string"), t.entities, most=2)


# ----------------------------------------------------------------- aggregations
@query(ET + "select (select count(*) from entities) as entities, (select count(*) from triples) as triples, (select count(distinct predicate) from triples) as predicates")
def brief_counts(t: Tables):
    return t.entities.agg(F.count("*").alias("entities")).join(F.broadcast(t.triples.agg(F.count("*").alias("triples"), F.count_distinct("predicate").alias("predicates"))))


@query(E + "select context_id, count(*) as members from entities group by 1 order by members desc, context_id nulls first limit 10")
def cluster_buckets(t: Tables):
    return t.entities.groupBy("context_id").agg(F.count("*").alias("members")).orderBy(F.desc("members"), F.asc_nulls_first("context_id")).limit(10)


@query(E + "select entity_type, string_agg(name, ',' order by created_at desc, id) as sample from (select *, row_number() over (partition by entity_type order by created_at desc, id) as n from entities) where n <= 3 group by 1")
def community_samples(t: Tables):
    w = Window.partitionBy("entity_type").orderBy(F.desc("created_at"), "id")
    top = t.entities.withColumn("n", F.row_number().over(w)).filter("n <= 3")
    return top.groupBy("entity_type").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), ",").alias("sample"))


@query("select event_type, round(sum(value), 4) as score from events group by 1")
def verb_affinity(t: Tables):
    return t.events.groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("score"))


@query("select event_type, user_id % 10 as host, round(count(*) / sum(count(*)) over (partition by user_id % 10), 6) as p from events group by 1, 2")
def host_affinity(t: Tables):
    c = t.events.groupBy("event_type", (F.col("user_id") % 10).alias("host")).agg(F.count("*").alias("n"))
    return c.select("event_type", "host", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("host")), 6).alias("p"))


@query("select case when hour(ts) between 6 and 11 then 'morning' when hour(ts) between 12 and 17 then 'afternoon' when hour(ts) between 18 and 21 then 'evening' else 'night' end as band, event_type, count(*) as n from events group by 1, 2")
def time_bands(t: Tables):
    return t.events.groupBy(S.verb_band(F.col("ts")).alias("band"), "event_type").agg(F.count("*").alias("n"))


@query("select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by 1, 2")
def entity_trends(t: Tables):
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


_LAST = "(select max(ts) from events)"


@query(f"select user_id, round(exp(-0.05 * (floor((epoch({_LAST})::bigint - epoch(max(ts))::bigint) / 60) / 60)), 6) as recency, round(1 / (1 + ln(1 + count(*))), 6) as novelty, round(sum(case when event_type = 'purchase' then 1 else 0 end) / (count(*) + 1), 6) as value, round(1 / (count(*) + 1), 6) as frequency from events group by 1")
def batch_scores(t: Tables):
    """Recency, novelty, value and frequency of each key, against the newest event."""
    now = t.events.agg(F.max("ts").alias("now"))
    per = t.events.groupBy("user_id").agg(F.max("ts").alias("last"), F.count("*").alias("n"), F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("hits")).join(F.broadcast(now))
    hours = S.minutes_between(F.col("now"), F.col("last")) / 60
    return per.select("user_id", F.round(S.recency(hours), 6).alias("recency"), F.round(S.novelty(F.col("n")), 6).alias("novelty"), F.round(F.col("hits") / (F.col("n") + 1), 6).alias("value"), F.round(1 / (F.col("n") + 1), 6).alias("frequency"))


@query("select event_type, count(*) as n, round(avg(value), 6) as mean, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95 from events group by 1")
def percentile_latency(t: Tables):
    """Exact, without a task that holds a group."""
    q = exact_quantiles(t.events, ["event_type"], "value", [0.5, 0.95])
    return q.select("event_type", "n", F.round("mean", 6).alias("mean"), F.col("q0").alias("p50"), F.col("q1").alias("p95"))


@query("select coalesce(lang, 'all') as category, count(*) as n, round(avg(n_chars), 6) as mean_chars from documents group by rollup(lang)")
def rollup_metrics(t: Tables):
    return t.documents.rollup("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars")).select(F.coalesce("lang", F.lit("all")).alias("category"), "n", "mean_chars")


@query("select lang, count(*) as n from documents group by 1 order by n desc, lang limit 16")
def tag_vocab(t: Tables):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(16)


@query("select host, count(*) as calls, min(ts) as started_at, max(ts) as last_activity, max_by(event_type, struct_pack(ts := ts, id := event_id)) as label from (select *, user_id % 20 as host from events) group by 1")
def session_upsert(t: Tables):
    e = t.events.withColumn("host", F.col("user_id") % 20)
    return e.groupBy("host").agg(F.count("*").alias("calls"), F.min("ts").alias("started_at"), F.max("ts").alias("last_activity"), F.max_by("event_type", F.struct("ts", "event_id")).alias("label"))


@query("select least(a, b) as a, greatest(a, b) as b, count(*) as strikes, count(*) >= 3 as blocked from (select c_nationkey as a, s_nationkey as b from orders join customer on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey ) where a <> b group by 1, 2")
def context_strikes(t: Tables):
    """Unordered pairs with three strikes are blocked."""
    j = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    p = j.filter("c_nationkey <> s_nationkey").select(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b"))
    return p.groupBy("a", "b").agg(F.count("*").alias("strikes"), (F.count("*") >= 3).alias("blocked"))


@query("select class, id, kind from (select event_type as class, event_id as id, case when value > 50 then 'success' when value < 1 then 'failure' else 'unknown' end as kind, row_number() over (partition by event_type, case when value > 50 then 's' when value < 1 then 'f' else 'u' end order by case when value > 50 then value end, ts desc, event_id desc) as n from events) where n = 1 or kind = 'unknown'")
def contrastive_prune(t: Tables):
    """Of each class: the success of least size, the last failure, and all that are unknown."""
    kind = F.when(F.col("value") > 50, "success").when(F.col("value") < 1, "failure").otherwise("unknown")
    e = t.events.select(F.col("event_type").alias("class"), F.col("event_id").alias("id"), "value", "ts", kind.alias("kind"))
    best = e.filter("kind <> 'unknown'").groupBy("class", "kind").agg(F.min_by("id", F.struct(F.when(F.col("kind") == "success", F.col("value")).otherwise(0.0), -F.unix_micros(F.col("ts").cast("timestamp")), -F.col("id"))).alias("id"))
    return best.select("class", "id", "kind").unionByName(e.filter("kind = 'unknown'").select("class", "id", "kind"))


# ----------------------------------------------------------------- set algebra over threads
def _thread(t: Tables, user: int):
    w = Window.partitionBy("member_kind").orderBy("member_id")
    m = t.events.filter(F.col("user_id") == user).select("event_type", "event_id").withColumn("member_id", F.col("event_id") % 40).select(F.when(F.col("event_type") == "purchase", "commitment").when(F.col("event_type") == "view", "capture").otherwise("event").alias("member_kind"), "member_id").distinct()
    return m.withColumn("ord", F.row_number().over(w))


_MEM = """with m as (select distinct user_id, case event_type when 'purchase' then 'commitment' when 'view' then 'capture' else 'event' end as member_kind, event_id % 40 as member_id from events where user_id in (3, 4, 5)),
a as (select member_kind, member_id from m where user_id = 3), b as (select member_kind, member_id from m where user_id = 4), c as (select member_kind, member_id from m where user_id = 5) """


@query(_MEM + "select * from a union select * from b")
def compose_union(t: Tables):
    return R.members_union(_thread(t, 3), _thread(t, 4)).drop("ord")


@query(_MEM + "select * from a intersect select * from b")
def compose_intersect(t: Tables):
    return R.members_intersect(_thread(t, 3), _thread(t, 4)).drop("ord")


@query(_MEM + "select * from a except select * from b")
def compose_diff(t: Tables):
    return R.members_diff(_thread(t, 3), _thread(t, 4)).drop("ord")


@query(_MEM + "select * from (select * from a union (select * from b except select * from c)) where member_kind <> 'commitment'")
def compose_expression(t: Tables):
    return R.evaluate({"filter": {"union": [{"thread": 3}, {"diff": [{"thread": 4}, {"thread": 5}]}]}, "kind": "only_captures"}, lambda u: _thread(t, u)).drop("ord")


@query(E + "select id, case when context_id in (1, 2) then 9 else context_id end as context_id from entities")
def context_merge(t: Tables):
    return R.merge_contexts(t.entities, [1, 2], 9).select("id", "context_id")


@query(ET + ", moved as (select id from entities where context_id = 1 and entity_type = 'person') select subject_id, object_id, predicate, case when subject_id in (select id from moved) then 7 end as context_id from triples")
def context_split(t: Tables):
    _, moved = R.split_context(t.entities, t.triples, 1, "person", 7)
    return moved.select("subject_id", "predicate", "object_id", "context_id")
