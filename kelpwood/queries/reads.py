"""Point reads, scans, newest rows and small state views over what a memory system stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from ..operators import store as K
from ..registry import query
from ..sources.memory import memory_views as V
from ..sources.tables import Tables, with_views

E, T, ET, FA = with_views("entities"), with_views("triples"), with_views("entities", "triples"), with_views("facts")


# ----------------------------------------------------------------- entities and edges
@query(E + "select * from entities where id = 'c7'")
def get_entity(t: Tables):
    return K.point(t.entities, "id", "c7")


@query(E + "select id, name from entities where id in ('c7', 'nobody')")
def find_entity_by_id(t: Tables):
    """A point read that may find nothing."""
    return t.entities.filter(F.col("id").isin("c7", "nobody")).select("id", "name")


@query(E + "select id, name from entities where name = 'small ring' order by id limit 1")
def find_entity_by_name(t: Tables):
    return K.newest(K.point(t.entities, "name", "small ring"), 1, "id").select("id", "name")


@query(E + "select id, name, entity_type from entities")
def list_entity_types(t: Tables):
    return t.entities.select("id", "name", "entity_type")


@query(E + "select id, name, entity_type, confidence from entities")
def list_all_entities(t: Tables):
    return t.entities.select("id", "name", "entity_type", "confidence")


@query(T + "select * from triples")
def list_all_triples(t: Tables):
    return t.triples


@query(E + "select id, context_id from entities where id = 'c7'")
def entity_context_id(t: Tables):
    return K.point(t.entities, "id", "c7").select("id", "context_id")


_TC = "select *, nullif((length(subject_id) + length(object_id)) % 4, 0) as context_id from triples"


def _scoped(t: Tables):
    return t.triples.withColumn("context_id", F.nullif((F.length("subject_id") + F.length("object_id")) % 4, F.lit(0)))


@query(T + f"select subject_id, object_id, context_id from ({_TC}) where subject_id = 'c7'")
def triple_context_id(t: Tables):
    return K.point(_scoped(t), "subject_id", "c7").select("subject_id", "object_id", "context_id")


@query(T + f"select predicate, count(*) as n from ({_TC}) where context_id is null or context_id = 1 group by 1")
def triple_in_active_scope(t: Tables):
    return R.in_scope(_scoped(t), 1).groupBy("predicate").agg(F.count("*").alias("n"))


@query(V("signals") + "select id, context_id from signals where context_id is null or context_id = 1")
def signal_in_active_scope(t: Tables):
    return R.in_scope(t.view("signals"), 1).select("id", "context_id")


@query(E + "select id, name from entities where context_id = 2")
def list_entities_in_context(t: Tables):
    return K.point(t.entities, "context_id", 2).select("id", "name")


@query(T + f"select subject_id, predicate, object_id from ({_TC}) where context_id = 2")
def list_triples_in_context(t: Tables):
    return K.point(_scoped(t), "context_id", 2).select("subject_id", "predicate", "object_id")


@query(ET + "select t.subject_id, s.name as subject, t.predicate, t.object_id, o.name as object, t.confidence from triples t join entities s on s.id = subject_id join entities o on o.id = object_id where t.subject_id = 's1'")
def triple_detail(t: Tables):
    name = lambda side: t.entities.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(side))
    return K.point(t.triples, "subject_id", "s1").join(name("subject"), "subject_id").join(name("object"), "object_id").select("subject_id", "subject", "predicate", "object_id", "object", "confidence")


@query(T + "select * from triples where subject_id = 's1' and predicate = 'located_in'")
def find_triple_by_id(t: Tables):
    return t.triples.filter("subject_id = 's1' and predicate = 'located_in'")


@query("select vec_id as id, embedding[1] as first, len(embedding) as dim from embeddings where vec_id = 7")
def get_vector(t: Tables):
    return K.point(t.embeddings, "vec_id", 7).select(F.col("vec_id").alias("id"), F.col("embedding")[0].alias("first"), F.size("embedding").alias("dim"))


@query(V("tags") + "select tag from tags where entity_id = 'p7' order by tag")
def tags_for_entity(t: Tables):
    return K.point(t.view("tags"), "entity_id", "p7").orderBy("tag").select("tag")


@query("select vec_id as id, len(embedding) // 8 as tokens, 8 as dim from embeddings where vec_id in (select doc_id from labels)")
def batch_colbert_tokens(t: Tables):
    """Token matrices of a set of ids: rows of eight components."""
    return t.embeddings.join(t.labels.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("id"), F.floor(F.size("embedding") / 8).alias("tokens"), F.lit(8).alias("dim"))


# ----------------------------------------------------------------- signals
_BACKLOG = "cluster_id is null and embedding is not null"


@query(V("signals") + f"select id, tier, created_at from signals where {_BACKLOG} and tier < 4 order by created_at, id limit 40")
def unconsolidated_signals_by_tier(t: Tables):
    backlog = t.view("signals").filter(_BACKLOG).filter("tier < 4")
    return K.newest(backlog.select("id", "tier", "created_at"), 40, "created_at", "id")


@query(V("signals") + "select lower(lpad(to_hex(id), 16, '0')) as hash, embedding[1] as first from signals where embedding is not null and tier < 4 order by id desc limit 30")
def all_signals_with_embeddings(t: Tables):
    s = K.newest(t.view("signals").filter("embedding is not null and tier < 4"), 30, F.desc("id"))
    return s.select(F.lpad(F.lower(F.hex("id")), 16, "0").alias("hash"), F.col("embedding")[0].alias("first"))


@query(V("signals") + "select id, source, cluster_id from signals where cluster_id is null or cluster_id in (-1, -2) order by created_at desc, id limit 25")
def list_outlier_signals(t: Tables):
    out = t.view("signals").filter(F.col("cluster_id").isNull() | F.col("cluster_id").isin(-1, -2))
    return K.newest(out, 25, F.desc("created_at"), "id").select("id", "source", "cluster_id")


@query(V("signals") + "select id, source, tier from signals where id in (select doc_id from labels)")
def load_signals_by_ids(t: Tables):
    """The second stage's fetch: a semi-join with the candidates."""
    return t.view("signals").join(t.labels.select(F.col("doc_id").alias("id")), "id", "left_semi").select("id", "source", "tier")


@query(V("signals") + "select cluster_id, id from (select *, row_number() over (partition by cluster_id order by created_at desc, id) as n from signals where cluster_id >= 0) where n <= 3")
def cluster_samples(t: Tables):
    return K.newest_each(t.view("signals").filter("cluster_id >= 0"), ["cluster_id"], 3, F.desc("created_at"), "id").select("cluster_id", "id")


@query(V("signals") + "select cluster_id, count(*) as members from signals where cluster_id >= 0 group by 1")
def clusters(t: Tables):
    return t.view("signals").filter("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("members"))


@query(V("signals") + "select id, cluster_id from signals where id = 9")
def assignment_for(t: Tables):
    return K.point(t.view("signals"), "id", 9).select("id", "cluster_id")


@query(V("signals") + "select id from signals where cluster_id = -1 and created_at >= 1704067200 + 86400 order by created_at desc, id limit 20")
def outliers(t: Tables):
    return K.newest(t.view("signals").filter("cluster_id = -1 and created_at >= 1704067200 + 86400"), 20, F.desc("created_at"), "id").select("id")


@query(V("signals") + "select coalesce(max(cluster_id), 0) + 1 as next from signals")
def next_cluster_id(t: Tables):
    return t.view("signals").agg((F.coalesce(F.max("cluster_id"), F.lit(0)) + 1).alias("next"))


@query(V("signals") + "select cluster_id, count(*) as members, string_agg(id::varchar, ',' order by id) as ids from signals where cluster_id >= 0 group by 1")
def cluster_texts(t: Tables):
    s = t.view("signals").filter("cluster_id >= 0")
    return s.groupBy("cluster_id").agg(F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))


@query(V("signals") + """, a as (select cluster_id, max(created_at) as seen from signals where cluster_id >= 0 group by 1), n as (select max(created_at) as now from signals)
select cluster_id, round(exp(-(now - seen) / 86400.0 / 15), 6) as weight from a, n where now - seen <= 30 * 86400""")
def recent_centroids(t: Tables):
    """Clusters seen within thirty days, weighed by age with half that window as scale."""
    s = t.view("signals")
    seen = s.filter("cluster_id >= 0").groupBy("cluster_id").agg(F.max("created_at").alias("seen"))
    age = F.col("now") - F.col("seen")
    return seen.join(F.broadcast(s.agg(F.max("created_at").alias("now")))).filter(age <= 30 * 86400).select("cluster_id", F.round(F.exp(-age / 86400.0 / 15), 6).alias("weight"))


@query(V("signals") + """select context_id, count(*) as members, string_agg(case when n <= 3 then source end, ',' order by n) as sample from (select *, row_number() over (partition by context_id order by created_at desc, id) as n from signals) group by 1""")
def community_buckets(t: Tables):
    from pyspark.sql import Window

    s = t.view("signals").withColumn("n", F.row_number().over(Window.partitionBy("context_id").orderBy(F.desc("created_at"), "id")))
    listed = F.sort_array(F.collect_list(F.when(F.col("n") <= 3, F.struct("n", "source"))))
    return s.groupBy("context_id").agg(F.count("*").alias("members"), F.array_join(F.transform(listed, lambda x: x["source"]), ",").alias("sample"))


@query(V("signals") + """, l as (select cluster_id, min(source) as label from signals where cluster_id >= 0 group by 1)
select b.cluster_id, b.members, l.label from (select cluster_id, count(*) as members from signals group by 1 order by members desc, cluster_id nulls first limit 12) b left join l on l.cluster_id = b.cluster_id""")
def memory_garden(t: Tables):
    """The largest buckets with their labels."""
    s = t.view("signals")
    label = s.filter("cluster_id >= 0").groupBy("cluster_id").agg(F.min("source").alias("label"))
    big = K.newest(s.groupBy("cluster_id").agg(F.count("*").alias("members")), 12, F.desc("members"), F.asc_nulls_first("cluster_id"))
    return big.join(label, "cluster_id", "left")


# ----------------------------------------------------------------- traces, trajectories, procedures, captures
@query(V("traces") + "select id, event_type, seen_at from traces order by id desc limit 20")
def recent_traces(t: Tables):
    return K.newest(t.view("traces"), 20, F.desc("id")).select("id", "event_type", "seen_at")


@query(V("traces") + "select id, seen_at from traces where seen_at >= 1704153600 and seen_at < 1704240000")
def traces_in_range(t: Tables):
    return t.view("traces").filter("seen_at >= 1704153600 and seen_at < 1704240000").select("id", "seen_at")


@query(V("trajectories") + "select id, arm, reward from trajectories order by seen_at desc, id desc limit 20")
def recent_trajectories(t: Tables):
    return K.newest(t.view("trajectories"), 20, F.desc("seen_at"), F.desc("id")).select("id", "arm", "reward")


@query(V("trajectories") + "select id, actual from trajectories where actual is not null order by seen_at desc, id desc limit 50")
def pending_training(t: Tables):
    return K.newest(t.view("trajectories").filter("actual is not null"), 50, F.desc("seen_at"), F.desc("id")).select("id", "actual")


_LASTP = V("procedures") + ", p as (select * from (select *, row_number() over (partition by id order by seq desc) as n from procedures) where n = 1) "


def _procedures(t: Tables):
    return K.current(t.view("procedures"), ["id"])


@query(_LASTP + "select id, seq, name, status from p")
def load_procedures(t: Tables):
    """The last line of each id."""
    return _procedures(t).select("id", "seq", "name", "status")


@query(_LASTP + "select id, name from p where name = 'make small ring' order by seq desc limit 1")
def procedure_by_name(t: Tables):
    return K.newest(K.point(_procedures(t), "name", "make small ring"), 1, F.desc("seq")).select("id", "name")


@query(_LASTP + "select id, name from p where status <> 'deprecated'")
def list_active_procedures(t: Tables):
    return _procedures(t).filter("status <> 'deprecated'").select("id", "name")


@query(V("recent") + "select id, source, seen_at from recent order by seen_at desc, id desc limit 100")
def recent_captures(t: Tables):
    return K.newest(t.view("recent"), 100, F.desc("seen_at"), F.desc("id")).select("id", "source", "seen_at")


@query(V("recent") + "select source, count(*) as events, max(seen_at) as last from recent group by 1")
def record_event(t: Tables):
    """Counts and last times of the enabled sources."""
    return t.view("recent").groupBy("source").agg(F.count("*").alias("events"), F.max("seen_at").alias("last"))


@query(V("recent") + "select day, array_to_string(list_sort(list(distinct source)), ',') as sources from (select *, (seen_at - seen_at % 86400) as day from recent) group by 1 order by day desc limit 90")
def bump_usage(t: Tables):
    """The set of active sources of each of the last ninety days."""
    days = t.view("recent").groupBy((F.col("seen_at") - F.col("seen_at") % 86400).alias("day")).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return K.newest(days, 90, F.desc("day"))


@query(V("traces") + "select query, last from (select concat(event_type, ' ', session_id) as query, max(id) as last from (select * from traces order by id desc limit 200) group by 1) order by last desc limit 10")
def query_recent(t: Tables):
    """The newest distinct questions of the last two hundred traces."""
    last = K.newest(t.view("traces"), 200, F.desc("id")).groupBy(F.concat_ws(" ", "event_type", "session_id").alias("query")).agg(F.max("id").alias("last"))
    return K.newest(last, 10, F.desc("last"))


@query(V("traces", "trajectories") + """select 'trace ' || event_type as what, count(*)::double as n, round(avg(latency), 6) as mean from traces group by 1
union all select 'arm ' || arm, count(*), round(avg(reward), 6) from trajectories group by 1""")
def dashboard(t: Tables):
    a = t.view("traces").groupBy(F.concat(F.lit("trace "), "event_type").alias("what")).agg(F.count("*").cast("double").alias("n"), F.round(F.avg("latency"), 6).alias("mean"))
    b = t.view("trajectories").groupBy(F.concat(F.lit("arm "), F.col("arm").cast("string")).alias("what")).agg(F.count("*").cast("double").alias("n"), F.round(F.avg("reward"), 6).alias("mean"))
    return a.unionByName(b)


# ----------------------------------------------------------------- threads, contexts, views
@query(V("threads") + "select id, title from threads order by started_at desc, id limit 15")
def list_threads(t: Tables):
    return K.newest(t.view("threads"), 15, F.desc("started_at"), "id").select("id", "title")


@query(V("threads") + "select id, view_id from threads where id = 4")
def attached_view(t: Tables):
    return K.point(t.view("threads"), "id", 4).select("id", "view_id")


@query(V("threads") + "select id from threads where ended_at is null")
def active_threads(t: Tables):
    return t.view("threads").filter("ended_at is null").select("id")


@query(V("contexts") + "select id, name from contexts order by created_at desc, id")
def list_contexts(t: Tables):
    return t.view("contexts").orderBy(F.desc("created_at"), "id").select("id", "name")


@query(V("contexts") + "select id, name from contexts where name = 'nation_3'")
def get_context_by_name(t: Tables):
    return K.point(t.view("contexts"), "name", "nation_3").select("id", "name")


@query(V("views") + "select id, name, include_pending from views order by created_at, id")
def list_views(t: Tables):
    return t.view("views").orderBy("created_at", "id").select("id", "name", "include_pending")


@query(V("view_members") + "select kind, member_type, member_id from view_members where view_id = 3")
def list_members(t: Tables):
    return K.point(t.view("view_members"), "view_id", 3).select("kind", "member_type", "member_id")


@query(V("view_members") + "select view_id, kind, member_type, array_to_string(list_sort(list(distinct member_id)), ',') as members from view_members group by 1, 2, 3")
def load_filter(t: Tables):
    """Membership rows as one set for each view, kind and type."""
    m = t.view("view_members")
    return m.groupBy("view_id", "kind", "member_type").agg(F.array_join(F.array_sort(F.collect_set("member_id")), ",").alias("members"))


_V3 = "(select member_id from view_members where view_id = 3 and kind = '{}')"


@query(V("view_members").replace("with ", ET + ", ", 1).replace(ET + ", view_members", ET + ", view_members") + f"select id, id in {_V3.format('exclude')} or id not in {_V3.format('include')} as rejected from entities")
def rejects_entity(t: Tables):
    """Excluded, or not among the included."""
    m = K.point(t.view("view_members"), "view_id", 3)
    seen = R.apply_view(t.entities, m.select("kind", "member_type", "member_id")).select("id", F.lit(False).alias("rejected"))
    return t.entities.select("id").join(seen, "id", "left").select("id", F.coalesce("rejected", F.lit(True)).alias("rejected"))


@query(T + "select subject_id, object_id, predicate, confidence < 0.3 or object_id in ('p1', 'p2', 'p3') as rejected from triples")
def rejects_triple(t: Tables):
    """Under the view's floor, or excluded."""
    gone = F.col("object_id").isin("p1", "p2", "p3")
    return t.triples.select("subject_id", "object_id", "predicate", ((F.col("confidence") < 0.3) | gone).alias("rejected"))


@query(V("traces") + "select session_id, min(seen_at) as started, max(seen_at) as last, count(*) as calls from traces where session_id = 5 group by 1")
def get_session(t: Tables):
    return K.point(t.view("traces"), "session_id", 5).groupBy("session_id").agg(F.min("seen_at").alias("started"), F.max("seen_at").alias("last"), F.count("*").alias("calls"))


@query(V("traces") + "select host, session_id, last from (select *, row_number() over (partition by host order by last desc, session_id) as n from (select session_id % 5 as host, session_id, max(seen_at) as last from traces group by 1, 2)) where n <= 4")
def recent_sessions(t: Tables):
    s = t.view("traces").groupBy((F.col("session_id") % 5).alias("host"), "session_id").agg(F.max("seen_at").alias("last"))
    return K.newest_each(s, ["host"], 4, F.desc("last"), "session_id")


# ----------------------------------------------------------------- event graph
@query("select event_id, event_type from events order by ts desc, event_id desc limit 25")
def list_nodes(t: Tables):
    return K.newest(t.events, 25, F.desc("ts"), F.desc("event_id")).select("event_id", "event_type")


@query("select event_id, event_type, value from events where event_id = 42")
def get_node(t: Tables):
    return K.point(t.events, "event_id", 42).select("event_id", "event_type", "value")


@query("""select user_id as thread, from_id, to_id from (select user_id, event_id as from_id, lead(event_id) over (partition by user_id order by ts, event_id) as to_id from events) where to_id is not null and from_id <> to_id""")
def promote_thread_sequence_edges(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = t.events.select(F.col("user_id").alias("thread"), F.col("event_id").alias("from_id"), F.lead("event_id").over(w).alias("to_id"))
    return pairs.filter("to_id is not null and from_id <> to_id")


@query("select user_id as from_id, event_type as kind, user_id % 4 as context, round(sum(value), 4) as strength, count(*) as support, min(event_id) as first_seen, max(event_id) as last_seen from events group by 1, 2, 3")
def upsert_edge(t: Tables):
    """Edges as running sums over a log: strength, support, first and last."""
    e = t.events.groupBy(F.col("user_id").alias("from_id"), F.col("event_type").alias("kind"), (F.col("user_id") % 4).alias("context"))
    return e.agg(F.round(F.sum("value"), 4).alias("strength"), F.count("*").alias("support"), F.min("event_id").alias("first_seen"), F.max("event_id").alias("last_seen"))


@query(with_views("triples") + "select id, degree from (select subject_id as id, count(*) as degree from triples group by 1) where id = 'c7'")
def score_for(t: Tables):
    return K.point(t.triples, "subject_id", "c7").groupBy(F.col("subject_id").alias("id")).agg(F.count("*").alias("degree"))


@query(FA + "select (select count(*) from facts where superseded_at is not null) * 1.0 / count(*) < 0.5 as below from facts")
def below_target(t: Tables):
    """Whether the rate is strictly under its target."""
    return t.facts.agg((F.count_if(F.col("superseded_at").isNotNull()) / F.count("*") < 0.5).alias("below"))


# ----------------------------------------------------------------- memory tiers
@query(V("tiers") + "select o_custkey as memory_id, coalesce(tier, 'warm') as tier from (select distinct o_custkey from orders) left join tiers on memory_id = o_custkey")
def get_tier(t: Tables):
    keys = t.orders.select(F.col("o_custkey").alias("memory_id")).distinct()
    return K.with_default(keys, t.view("tiers"), "memory_id", "tier", "warm")


@query(V("tiers") + "select memory_id, last_accessed from tiers where tier = 'hot' order by last_accessed desc, memory_id")
def get_all_in_tier(t: Tables):
    return K.point(t.view("tiers"), "tier", "hot").orderBy(F.desc("last_accessed"), "memory_id").select("memory_id", "last_accessed")


@query(V("access_log") + "select entity_id, count(*) as access_count, max(seen_at) as last_accessed, 'hot' as tier from access_log group by 1")
def record_access(t: Tables):
    return K.accesses(t.view("access_log"), "entity_id", "seen_at")


_NOW = 1705000000


@query(V("tiers") + f"""select tier, case when pinned then 'hot' when ({_NOW} - last_accessed) / 86400.0 < 1 then 'hot' when ({_NOW} - last_accessed) / 86400.0 < 7 then 'warm' else 'cold' end as new_tier, count(*) as n from tiers group by 1, 2""")
def run_promotion_cycle(t: Tables):
    return K.retier(t.view("tiers"), F.lit(_NOW)).groupBy("tier", "new_tier").agg(F.count("*").alias("n"))


@query(V("tiers") + f"select memory_id, case when last_accessed <= {_NOW} - 7 * 86400 and not pinned then 'cold' else tier end as tier from tiers")
def demote_cold(t: Tables):
    old = (F.col("last_accessed") <= _NOW - 7 * 86400) & ~F.col("pinned")
    return t.view("tiers").select("memory_id", F.when(old, "cold").otherwise(F.col("tier")).alias("tier"))


@query(V("tiers") + "select memory_id, pinned or memory_id % 7 = 0 as pinned, case when memory_id % 7 = 0 then 'hot' else tier end as tier from tiers")
def pin(t: Tables):
    tiers = t.view("tiers")
    named = tiers.filter("memory_id % 7 = 0").select("memory_id", F.lit(True).alias("pinned"), F.lit("hot").alias("tier"))
    return K.change(tiers.select("memory_id", "pinned", "tier"), named, ["memory_id"])


@query(V("tiers") + "select memory_id, case when memory_id % 20 = 0 then false else pinned end as pinned from tiers")
def unpin(t: Tables):
    tiers = t.view("tiers")
    return K.change(tiers.select("memory_id", "pinned"), tiers.filter("memory_id % 20 = 0").select("memory_id", F.lit(False).alias("pinned")), ["memory_id"])


# ----------------------------------------------------------------- comparisons
@query("select round(avg(case when value > 20 then 1.0 else 0.0 end), 6) as ours, 0.4::double as theirs, avg(case when value > 20 then 1.0 else 0.0 end) < 0.5 * 0.4 as below_half from events")
def below_half(t: Tables):
    rate = F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0))
    return t.events.agg(F.round(rate, 6).alias("ours"), F.lit(0.4).alias("theirs"), (rate < 0.5 * 0.4).alias("below_half"))


@query("select json_extract_string(props, '$.k')::bigint % 10 as k, count(*) as n from events group by 1")
def props_to_entity(t: Tables):
    """Typed fields out of a JSON column, with defaults."""
    k = F.coalesce(F.from_json("props", "k long").getField("k"), F.lit(0)) % 10
    return t.events.groupBy(k.alias("k")).agg(F.count("*").alias("n"))


@query("select event_type, upper(substr(replace(event_type, '_', ' '), 1, 1)) || substr(event_type, 2) as label, count(*) as n from events group by 1, 2")
def label_from_names(t: Tables):
    label = F.concat(F.upper(F.substring("event_type", 1, 1)), F.expr("substring(event_type, 2)"))
    return t.events.groupBy("event_type", label.alias("label")).agg(F.count("*").alias("n"))


@query(T + "select predicate, lower(predicate) as key, replace(predicate, '_', ' ') as words, count(*) as n from triples group by 1, 2, 3")
def predicate_key(t: Tables):
    return t.triples.groupBy("predicate", F.lower("predicate").alias("key"), S.humanize(F.col("predicate")).alias("words")).agg(F.count("*").alias("n"))
