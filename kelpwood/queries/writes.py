"""Writes as appends: each query applies changes that are drawn from the tables and returns the state, or the rows, after the write."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from ..operators import store as K
from ..operators import temporal as T
from ..registry import query
from ..sources import writers as W
from ..sources.memory import memory_views as V
from ..sources.tables import Tables, with_views

E, TR, ET, FA = with_views("entities"), with_views("triples"), with_views("entities", "triples"), with_views("facts")


# ----------------------------------------------------------------- entities, edges, vectors
@query(E + "select id, case when k % 10 = 0 then name || ' (new)' else name end as name, case when k % 10 = 0 then 2 else 1 end as version from entities")
def upsert_entity(t: Tables):
    """A change log: every tenth entity gets a second version; the last one counts."""
    log = t.entities.select("id", "name", F.lit(1).cast("long").alias("version"))
    changes = t.entities.filter("k % 10 = 0").select("id", F.concat("name", F.lit(" (new)")).alias("name"))
    return W.current(W.upsert(log, changes.withColumn("version", F.lit(0).cast("long")), ["id"], "version"), ["id"], "version")


@query(ET + "select t.subject_id, t.predicate, t.object_id, least(greatest(t.confidence * 1.5, 0), 1) as confidence from triples t where subject_id in (select id from entities where entity_type <> 'place') and object_id in (select id from entities) and predicate <> 'part_of'")
def upsert_triple(t: Tables):
    """Edges that the ontology allows and of which both ends exist; weights clamped."""
    ids = t.entities.filter("entity_type <> 'place'").select(F.col("id").alias("subject_id"))
    rows = t.triples.filter("predicate <> 'part_of'").join(ids, "subject_id", "left_semi").join(t.entities.select(F.col("id").alias("object_id")), "object_id", "left_semi")
    return rows.select("subject_id", "predicate", "object_id", F.least(F.greatest(F.col("confidence") * 1.5, F.lit(0)), F.lit(1)).alias("confidence"))


@query("select vec_id as id, case when vec_id % 7 = 0 then embedding[2] else embedding[1] end as first, case when vec_id % 7 = 0 then 2 else 1 end as seq from embeddings")
def upsert_vector(t: Tables):
    old = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding")[0].alias("first"), F.lit(1).alias("seq"))
    new = t.embeddings.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("id"), F.col("embedding")[1].alias("first"), F.lit(2).alias("seq"))
    return K.current(old.unionByName(new), ["id"])


@query("select vec_id as id, 'm' || vec_id % 2 as model, len(embedding) // 8 as tokens from embeddings")
def upsert_colbert_tokens(t: Tables):
    """Token matrices by id and model: the last write of a pair counts."""
    tok = F.floor(F.size("embedding") / 8).alias("tokens")
    log = [t.embeddings.select(F.col("vec_id").alias("id"), F.concat(F.lit("m"), F.col("vec_id") % 2).alias("model"), c, F.lit(n).alias("seq")) for n, c in ((1, F.lit(0).cast("long").alias("tokens")), (2, tok))]
    return K.current(log[0].unionByName(log[1]), ["id", "model"]).drop("seq")


@query(ET + ", gone as (select id from entities where k % 9 = 0) select 'entities' as what, count(*) as n from entities where id not in (select id from gone) union all select 'triples', count(*) from triples where subject_id not in (select id from gone) and object_id not in (select id from gone) union all select 'log', count(*) from events where 'c' || user_id not in (select id from gone)")
def delete_entity(t: Tables):
    """With it go edges at either end and its log."""
    log = t.view("access_log").withColumnRenamed("id", "event_id")
    tables = {"entities": (t.entities, ["id"]), "triples": (t.triples, ["subject_id", "object_id"]), "log": (log, ["entity_id"])}
    kept = K.cascade(tables, t.entities.filter("k % 9 = 0"))
    count = lambda name: kept[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return count("entities").unionByName(count("triples")).unionByName(count("log"))


@query(E + "select id, case when k % 6 = 0 then 'project' else entity_type end as entity_type from entities")
def set_entity_type(t: Tables):
    e = t.entities.select("id", "entity_type")
    return K.change(e, t.entities.filter("k % 6 = 0").select("id", F.lit("project").alias("entity_type")), ["id"])


@query(E + "select id, case when k % 6 = 0 then 3 else context_id end as context_id from entities")
def set_entity_context(t: Tables):
    return K.change(t.entities.select("id", "context_id"), t.entities.filter("k % 6 = 0").select("id", F.lit(3).cast("long").alias("context_id")), ["id"])


@query(TR + "select subject_id, predicate, object_id, case when predicate = 'located_in' then 2 end as context_id from triples")
def set_triple_context(t: Tables):
    keys = ["subject_id", "predicate", "object_id"]
    return K.change(t.triples.select(*keys, F.lit(None).cast("int").alias("context_id")), t.triples.filter("predicate = 'located_in'").select(*keys, F.lit(2).alias("context_id")), keys)


@query(E + "select id, least(confidence + 0.15, 1.0) as confidence from entities where k % 3 = 0")
def reinforce_entity(t: Tables):
    return t.entities.filter("k % 3 = 0").select("id", F.least(F.col("confidence") + 0.15, F.lit(1.0)).alias("confidence"))


@query(E + "select entity_type, count(*) as made from entities group by 1")
def store_structured(t: Tables):
    """Entities and edges given by name: what isn't there yet is made, once each."""
    given = t.entities.select("name", "entity_type", "id").unionByName(t.entities.select("name", "entity_type", "id"))
    return K.insert_or_ignore(t.entities.limit(0).select("name", "entity_type", "id"), given, ["id"]).groupBy("entity_type").agg(F.count("*").alias("made"))


@query(TR + "select count(*) as n from triples where subject_id[1] = 's' or object_id[1] = 'n'")
def export_edges_of_context(t: Tables):
    return t.triples.filter(F.col("subject_id").startswith("s") | F.col("object_id").startswith("n")).agg(F.count("*").alias("n"))


@query(E + "select context_id, count(*) as entities, min(id) as first from entities where context_id = 2 group by 1")
def snapshot_context(t: Tables):
    """One namespace as JSON lines with its counts."""
    lines = K.point(t.entities, "context_id", 2).select("context_id", "id", F.to_json(F.struct("id", "name", "entity_type")).alias("json"))
    return lines.filter("json is not null").groupBy("context_id").agg(F.count("*").alias("entities"), F.min("id").alias("first"))


@query(ET + "select count(*) as pages, sum(links)::double as links from (select e.id, count(t.object_id) as links from entities e left join triples t on t.subject_id = e.id where e.context_id = 2 group by 1)")
def export_markdown(t: Tables):
    """Pages of one namespace, masked, with a link line for each edge."""
    pages = W.markdown(K.point(t.entities, "context_id", 2), t.triples, mask=True)
    links = F.size(F.filter(F.split("text", "\n"), lambda x: x.startswith("- ")))
    return pages.agg(F.count("*").alias("pages"), F.sum(links).cast("double").alias("links"))


@query("""with e as (select user_id as from_id, event_type as to_id, count(*) as support from events group by 1, 2), n as (select distinct user_id as id from events where user_id % 2 = 0)
select 'edge' as kind, count(*) as n from e where support >= 2 and from_id in (select id from n) and to_id in ('click', 'view') union all select 'node', count(*) + 2 from n""")
def export_portable(t: Tables):
    """Nodes and edges of enough support with both ends inside."""
    e = t.events.groupBy(F.col("user_id").cast("string").alias("from_id"), F.col("event_type").alias("to_id")).agg(F.count("*").alias("support"))
    n = t.events.filter("user_id % 2 = 0").select(F.col("user_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("label")).distinct()
    n = n.unionByName(t.spark.createDataFrame([("click", "c"), ("view", "v")], "id string, label string"))
    return W.portable(n, e).groupBy("kind").agg(F.count("*").alias("n"))


@query("select sum(length(text) // 4)::bigint as tokens from documents")
def approx_token_count(t: Tables):
    return t.documents.agg(F.sum(F.floor(F.length("text") / 4)).alias("tokens"))


# ----------------------------------------------------------------- signals and logs
@query(V("signals") + "select tier, count(*) as n, max(id) as last from (select tier, id from signals union all select 1, 1000000 + doc_id from documents) group by 1")
def insert_signal(t: Tables):
    """Signals with vectors, and bare ones behind them."""
    s = t.view("signals").select("tier", "id")
    return s.unionByName(t.documents.select(F.lit(1).cast("long").alias("tier"), (F.col("doc_id") + 1000000).alias("id"))).groupBy("tier").agg(F.count("*").alias("n"), F.max("id").alias("last"))


@query("select 1 + (select max(event_id) from events) + row_number() over (order by doc_id) - 1 as seq, doc_id from documents")
def log_signal(t: Tables):
    """Rows behind a log, numbered from its end."""
    log = t.events.select(F.col("event_id").alias("seq"), F.lit(None).cast("long").alias("doc_id"))
    return K.append(log, t.documents.select("doc_id")).filter("doc_id is not null")


@query(V("signals") + "select id, case when cluster_id is null and id % 4 = 0 then 77 else cluster_id end as cluster_id from signals")
def mark_signal_clustered(t: Tables):
    s = t.view("signals").select("id", "cluster_id")
    return K.change(s, s.filter("cluster_id is null and id % 4 = 0").select("id", F.lit(77).cast("long").alias("cluster_id")), ["id"])


@query(V("signals") + ", m as (select max(cluster_id) + 1 as next from signals) select id, case id % 3 when 0 then next when 1 then -2 else cluster_id end as cluster_id from signals, m where cluster_id is null or cluster_id < 0")
def assign_signal_to_cluster(t: Tables):
    """Triage of outliers: into a new cluster, ignored, or left."""
    s = t.view("signals").select("id", "cluster_id")
    top = s.agg((F.max("cluster_id") + 1).alias("next"))
    out = s.filter("cluster_id is null or cluster_id < 0").join(F.broadcast(top))
    return out.select("id", F.when(F.col("id") % 3 == 0, F.col("next")).when(F.col("id") % 3 == 1, -2).otherwise(F.col("cluster_id")).alias("cluster_id"))


@query(V("access_log") + "select entity_id, count(case when event_type = 'view' then 1 end) as retrieved, count(case when event_type = 'purchase' then 1 end) as succeeded from access_log group by 1")
def record_retrieval(t: Tables):
    """Counters over the access log."""
    return K.counters(t.view("access_log"), "entity_id", {"retrieved": F.col("event_type") == "view", "succeeded": F.col("event_type") == "purchase"})


@query(V("access_log") + "select entity_id, count(*) as succeeded from access_log where event_type = 'purchase' and entity_id in (select entity_id from access_log where event_type = 'view') group by 1")
def record_success(t: Tables):
    """A success counts only where there is a retrieval."""
    log = t.view("access_log")
    seen = log.filter("event_type = 'view'").select("entity_id")
    return log.filter("event_type = 'purchase'").join(seen, "entity_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("succeeded"))


@query(V("access_log") + "select max(id) + 1 as next, count(*) + 1 as rows from access_log")
def log_access(t: Tables):
    log = t.view("access_log").select(F.col("id").alias("seq"), "entity_id", "event_type")
    out = K.append(log, log.limit(1).select(F.lit("c1").alias("entity_id"), F.lit("view").alias("event_type")))
    return out.agg(F.max("seq").alias("next"), F.count("*").alias("rows"))


@query(V("tags") + "select 'p' || p_partkey as entity_id, 'size-' || p_size as tag, 'size' as origin from part where ('p' || p_partkey, 'size-' || p_size) not in (select entity_id, tag from tags)")
def upsert_entity_tags(t: Tables):
    """Tags that their entity doesn't have yet, each once."""
    size = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("entity_id"), F.concat(F.lit("size-"), "p_size").alias("tag"), F.lit("size").alias("origin"))
    again = t.view("tags").select("entity_id", "tag", "origin")
    return K.insert_or_ignore(t.view("tags"), size.unionByName(again).unionByName(size), ["entity_id", "tag"])


@query(V("tags") + "select entity_id, tag from tags where tag <> 'economy'")
def delete_entity_tag(t: Tables):
    tags = t.view("tags")
    return K.remove(tags, tags.filter("tag = 'economy'"), ["entity_id", "tag"]).select("entity_id", "tag")


@query(V("trajectories") + "select id, case when id % 11 = 0 then 'success' else outcome end as outcome, query_class from trajectories")
def tag_outcome(t: Tables):
    x = t.view("trajectories").select("id", "outcome", "query_class")
    return K.change(x, x.filter("id % 11 = 0").select("id", F.lit("success").alias("outcome")), ["id"])


@query(V("procedures") + "select id, max(version) + 1 as version from procedures group by 1")
def save_procedure(t: Tables):
    """A new version behind the last of each id."""
    p = t.view("procedures")
    return K.versioned(p.select("id", "version"), p.select("id").distinct(), ["id"]).select("id", "version")


@query(V("recent") + "select id, source from recent order by id desc limit 100")
def append_recent(t: Tables):
    """A ring of a hundred: appended, then cut to its newest."""
    return W.compact_ring(t.view("recent"), 100, F.desc("id")).select("id", "source")


@query(V("recent") + "select source, count(*) as n from recent where source <> 'shell' group by 1")
def capture_forget_source(t: Tables):
    """A source's rows of the ring go; what was made of them stays."""
    return K.purge(t.view("recent"), F.col("source") != "shell").groupBy("source").agg(F.count("*").alias("n"))


@query(V("traces") + "select id from traces order by id desc limit 500")
def truncate_traces(t: Tables):
    return K.keep_newest(t.view("traces"), 500, F.desc("id")).select("id")


@query(V("signals") + "select tier, count(*) as n from signals where tier < 4 and coalesce(cluster_id, -1) < 0 group by 1")
def clean_ephemeral(t: Tables):
    """Without signals of the last tier and those that are consolidated."""
    kept = (F.col("tier") < 4) & (F.coalesce("cluster_id", F.lit(-1)) < 0)
    return K.purge(t.view("signals"), kept).groupBy("tier").agg(F.count("*").alias("n"))


@query("select 'documents' as what, count(*) as rows from documents union all select 'events', count(*) from events union all select 'embeddings', count(*) from embeddings")
def storage_stats(t: Tables):
    one = lambda n: getattr(t, n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("what"), "rows")
    return one("documents").unionByName(one("events")).unionByName(one("embeddings"))


@query("select 0 as rows")
def reset_all(t: Tables):
    """What is left after a wipe."""
    return K.keep_newest(t.events, 0).agg(F.count("*").alias("rows"))


# ----------------------------------------------------------------- bitemporal writes
_OPEN = "superseded_at is null"


@query(FA + f"select entity_id, count(*) as rows, count(case when {_OPEN} then 1 end) as open from (select * from facts union all select entity_id, -fact_id, value, valid_from, valid_to, recorded_at, null from facts where fact_id % 50 = 0) group by 1")
def insert_fact(t: Tables):
    """Open rows behind the log."""
    new = t.facts.filter("fact_id % 50 = 0").withColumn("fact_id", -F.col("fact_id")).withColumn("superseded_at", F.lit(None).cast("timestamp_ntz"))
    return t.facts.unionByName(new).groupBy("entity_id").agg(F.count("*").alias("rows"), F.count_if(F.col("superseded_at").isNull()).alias("open"))


@query(FA + f", c as (select entity_id, min(recorded_at) as at_ from facts where fact_id % 50 = 0 group by 1) select count(*) + (select count(*) from facts where fact_id % 50 = 0) as rows, count(case when {_OPEN} and entity_id not in (select entity_id from c) then 1 end) + (select count(*) from facts where fact_id % 50 = 0) as open from facts")
def update_fact(t: Tables):
    """Changes supersede what is open of their entity and are appended."""
    new = t.facts.filter("fact_id % 50 = 0").withColumn("fact_id", -F.col("fact_id")).withColumn("superseded_at", F.lit(None).cast("timestamp_ntz"))
    return T.update_facts(t.facts, new).agg(F.count("*").alias("rows"), F.count_if(F.col("superseded_at").isNull()).alias("open"))


@query(FA + "select fact_id, case when superseded_at is null and fact_id % 5 = 0 then timestamp '2001-01-01' else superseded_at end as superseded_at from facts")
def retract_fact(t: Tables):
    """An end of record, set once."""
    ends = F.expr("timestamp_ntz'2001-01-01'")
    return t.facts.select("fact_id", F.coalesce("superseded_at", F.when(F.col("fact_id") % 5 == 0, ends)).alias("superseded_at"))


@query(FA + "select entity_id, count(*) as n from facts where valid_to is null and entity_id % 4 <> 0 group by 1")
def close_validity(t: Tables):
    closed = t.facts.filter("entity_id % 4 = 0").select("entity_id", F.expr("timestamp_ntz'2002-01-01'").alias("valid_to")).distinct()
    return T.close_validity(t.facts, closed).filter("valid_to is null").groupBy("entity_id").agg(F.count("*").alias("n"))


@query(TR + ", f as (select subject_id, predicate, min(object_id) as kept from triples where predicate in ('located_in', 'supplied_by') group by 1, 2) select t.subject_id, t.predicate, t.object_id from triples t join f using (subject_id, predicate) where t.object_id <> kept")
def supersede_triple(t: Tables):
    """Of a single-valued relation all objects but one are closed."""
    one = t.triples.filter("predicate in ('located_in', 'supplied_by')")
    kept = one.groupBy("subject_id", "predicate").agg(F.min("object_id").alias("kept"))
    return one.join(kept, ["subject_id", "predicate"]).filter("object_id <> kept").select("subject_id", "predicate", "object_id")


@query(FA + "select entity_id from (select distinct c_custkey as entity_id from customer) where entity_id not in (select entity_id from facts where superseded_at is null)")
def backfill_temporal(t: Tables):
    """Entities without a current fact get one."""
    have = t.facts.filter("superseded_at is null").select("entity_id")
    return t.customer.select(F.col("c_custkey").alias("entity_id")).distinct().join(have, "entity_id", "left_anti")


@query(TR + "select subject_id, predicate, arg_max(object_id, struct_pack(c := confidence, o := object_id)) as object_id from triples where predicate <> 'bought' group by 1, 2")
def triple_at(t: Tables):
    """The version of each edge that holds: by confidence where several do."""
    one = t.triples.filter("predicate <> 'bought'")
    return one.groupBy("subject_id", "predicate").agg(F.max_by("object_id", F.struct("confidence", "object_id")).alias("object_id"))


@query(FA + "select fact_id, row_number() over (partition by entity_id order by recorded_at, fact_id) as version, superseded_at is null as open from facts where entity_id = 7")
def triple_history(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("entity_id").orderBy("recorded_at", "fact_id")
    return K.point(t.facts, "entity_id", 7).select("fact_id", F.row_number().over(w).alias("version"), F.col("superseded_at").isNull().alias("open"))


# ----------------------------------------------------------------- pending relations
@query(V("pending") + "select id, confidence from pending where status = 'pending' order by confidence desc, id limit 30")
def pending_list(t: Tables):
    return K.newest(K.point(t.view("pending"), "status", "pending"), 30, F.desc("confidence"), "id").select("id", "confidence")


@query(V("pending") + "select id, subject_id, status from pending where id = 5")
def pending_get(t: Tables):
    return K.point(t.view("pending"), "id", 5).select("id", "subject_id", "status")


@query(TR + "select subject_id, predicate, object_id, confidence from triples where confidence >= 0.3 and confidence < 0.7")
def pending_insert(t: Tables):
    """Edges of middling confidence wait for a decision."""
    return t.triples.filter(S.route(F.col("confidence")) == "pending")


@query(V("pending") + ", a as (select subject_id, predicate, object_id, max(confidence) as confidence from pending where status = 'pending' and id % 2 = 0 group by 1, 2, 3) select * from a")
def accept_pending(t: Tables):
    """Accepted ones become edges."""
    p = K.decide(t.view("pending"), t.view("pending").filter("id % 2 = 0").select("id", F.lit("promoted").alias("decided")), "id")
    return p.filter("status = 'promoted'").groupBy("subject_id", "predicate", "object_id").agg(F.max("confidence").alias("confidence"))


@query(V("pending") + "select case when status = 'pending' and id % 2 = 1 then 'rejected' else status end as status, count(*) as n from pending group by 1")
def reject_pending(t: Tables):
    p = t.view("pending")
    return K.decide(p, p.filter("id % 2 = 1").select("id", F.lit("rejected").alias("decided")), "id").groupBy("status").agg(F.count("*").alias("n"))


@query(V("pending") + "select status, count(*) as n from pending where decided_at is null or decided_at >= 1705000000 group by 1")
def purge_decided(t: Tables):
    return K.purge(t.view("pending"), F.col("decided_at") >= 1705000000).groupBy("status").agg(F.count("*").alias("n"))


# ----------------------------------------------------------------- feedback and strikes
@query(V("feedback") + "select query_id, coalesce(sum(case when weight < 0 then weight end), 0) as negative, coalesce(sum(case when weight > 0 then weight end), 0) as positive from feedback group by 1")
def signal_weights(t: Tables):
    """Sums of negative and positive signals by question."""
    side = lambda c: F.coalesce(F.sum(F.when(c, F.col("weight"))), F.lit(0)).cast("double")
    return t.view("feedback").groupBy("query_id").agg(side(F.col("weight") < 0).alias("negative"), side(F.col("weight") > 0).alias("positive"))


@query(V("feedback") + "select coalesce(sum(weight), 0)::double as weight from feedback where query_id = 7 and weight < 0")
def negative_weight_for_query(t: Tables):
    return t.view("feedback").filter("query_id = 7 and weight < 0").agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("double").alias("weight"))


@query(V("feedback") + "select coalesce(sum(weight), 0)::double as weight from feedback where query_id = 7 and weight > 0")
def positive_weight_for_query(t: Tables):
    return t.view("feedback").filter("query_id = 7 and weight > 0").agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("double").alias("weight"))


@query(V("feedback") + "select id, class, weight from (select *, row_number() over (partition by class order by seen_at desc, id desc) as n from feedback) where n <= 5")
def recent_signals_by_class(t: Tables):
    return K.newest_each(t.view("feedback"), ["class"], 5, F.desc("seen_at"), F.desc("id")).select("id", "class", "weight")


@query(V("feedback") + "select id, class from feedback where hook_id = 6 order by seen_at, id")
def signals_for_hook(t: Tables):
    return K.point(t.view("feedback"), "hook_id", 6).orderBy("seen_at", "id").select("id", "class")


_KINDS = "case event_type when 'purchase' then 'helpful' when 'click' then 'cited' when 'error' then 'miss' when 'signup' then 'bridge' else 'verb_invoked' end"


@query(f"select kind, target, count(*) as n, round(sum(w), 4)::double as weight from (select {_KINDS} as kind, case event_type when 'purchase' then 'positive' when 'click' then 'positive' when 'view' then 'behaviour' else 'negative' end as target, case event_type when 'purchase' then 0.3 when 'click' then 0.3 when 'error' then -0.5 when 'signup' then -1.0 else 0 end as w from events) group by 1, 2")
def memory_feedback(t: Tables):
    """Kinds of feedback to weights and to the table that takes them."""
    from ..operators.policy import feedback_target, feedback_weight

    names = {"purchase": "helpful", "click": "cited", "error": "miss", "signup": "bridge"}
    kind = F.lit("verb_invoked")
    for event, name in names.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    e = t.events.select(kind.alias("kind"))
    return e.groupBy("kind", feedback_target(F.col("kind")).alias("target")).agg(F.count("*").alias("n"), F.round(F.sum(feedback_weight(F.col("kind"))), 4).alias("weight"))


@query("select least(user_id, event_id % 150) as a, greatest(user_id, event_id % 150) as b, count(*) as strikes, count(*) >= 3 as blocked from events where user_id <> event_id % 150 group by 1, 2")
def record_entity_strike(t: Tables):
    """The third strike blocks a pair, in whatever order its ends come."""
    return K.strikes(t.events.select("user_id", (F.col("event_id") % 150).alias("other")), "user_id", "other")


@query("with s as (select least(user_id, event_id % 150) as a, greatest(user_id, event_id % 150) as b, count(*) as strikes from events where user_id <> event_id % 150 group by 1, 2) select a, b from s where strikes >= 3 and a % 2 = 1")
def unblock_context_pair(t: Tables):
    s = K.strikes(t.events.select("user_id", (F.col("event_id") % 150).alias("other")), "user_id", "other").filter("blocked")
    return K.remove(s, s.filter("a % 2 = 0"), ["a", "b"]).select("a", "b")


@query("with p as (select user_id, count(*) as n from events group by 1) select count(case when n >= 3 then 1 end) as blocked, count(*) as pairs, count(case when n >= 3 then 1 end) / count(*) >= 0.9 as passes from p")
def context_true_negatives(t: Tables):
    """Pairs that enough strikes block, of all pairs; the bar is 0.9."""
    p = t.events.groupBy("user_id").agg((F.count("*") >= K.STRIKES).alias("blocked"))
    blocked = F.count_if(F.col("blocked"))
    return p.agg(blocked.alias("blocked"), F.count("*").alias("pairs"), (blocked / F.count("*") >= 0.9).alias("passes"))


@query("select subject, object, count(*) as n from (select 'c' || o_custkey as subject, 'p' || l_partkey as object from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R') where subject in (select 'c' || user_id from events) group by 1, 2 having count(*) >= 2")
def detect_store_contradictions(t: Tables):
    """New edges of a relation that the store holds otherwise."""
    new = t.orders.join(t.lineitem.filter("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("subject"), F.concat(F.lit("p"), "l_partkey").alias("object"))
    known = t.events.select(F.concat(F.lit("c"), "user_id").alias("subject"))
    return new.join(known, "subject", "left_semi").groupBy("subject", "object").agg(F.count("*").alias("n")).filter("n >= 2")


@query(V("view_members") + "select view_id, count(*) as n from (select distinct view_id, kind, member_type, member_id from (select * from view_members union all select l_suppkey, 'include', 'entity', 'p' || l_partkey from lineitem)) group by 1")
def add_member(t: Tables):
    m = t.view("view_members")
    new = t.lineitem.select(F.col("l_suppkey").alias("view_id"), F.lit("include").alias("kind"), F.lit("entity").alias("member_type"), F.concat(F.lit("p"), "l_partkey").alias("member_id"))
    key = ["view_id", "kind", "member_type", "member_id"]
    return m.unionByName(K.insert_or_ignore(m, new, key)).groupBy("view_id").agg(F.count("*").alias("n"))


@query(V("view_members") + "select view_id, count(*) as n from view_members where kind <> 'exclude' group by 1")
def remove_member(t: Tables):
    m = t.view("view_members")
    return K.remove(m, m.filter("kind = 'exclude'"), m.columns).groupBy("view_id").agg(F.count("*").alias("n"))


@query(V("views", "view_members") + "select count(distinct v.id) as views, count(m.member_id) as members from views v left join view_members m on m.view_id = v.id where v.id % 3 <> 0")
def delete_view(t: Tables):
    """A view goes with its members."""
    views, members = t.view("views"), t.view("view_members").withColumnRenamed("view_id", "id")
    kept = K.cascade({"views": (views, ["id"]), "members": (members, ["id"])}, views.filter("id % 3 = 0"))
    return kept["views"].join(kept["members"], "id", "left").agg(F.count_distinct("id").alias("views"), F.count("member_id").alias("members"))


@query(V("views") + "select id, name from (select id, name from views union all select 1000 + n_nationkey, n_name from nation where n_name not in (select name from views))")
def create_view(t: Tables):
    new = t.nation.select((F.col("n_nationkey") + 1000).cast("long").alias("id"), F.col("n_name").alias("name"))
    v = t.view("views").select("id", "name")
    return v.unionByName(K.insert_or_ignore(v, new, ["name"]))


@query(V("views") + "select id, case when id % 4 = 0 then 0.9 else confidence_floor end as confidence_floor, include_pending or id % 4 = 0 as include_pending from views")
def update_view_metadata(t: Tables):
    v = t.view("views").select("id", F.col("confidence_floor").cast("double"), "include_pending")
    return K.change(v, v.filter("id % 4 = 0").select("id", F.lit(0.9).alias("confidence_floor"), F.lit(True).alias("include_pending")), ["id"])


@query(V("threads") + "select id, case when ended_at is null and id % 5 = 0 then 1800000000 else ended_at end as ended_at from threads")
def end_thread(t: Tables):
    x = t.view("threads").select("id", "ended_at")
    return K.change(x, x.filter("ended_at is null and id % 5 = 0").select("id", F.lit(1800000000).cast("long").alias("ended_at")), ["id"])


@query(V("threads") + "select count(*) + (select count(*) from supplier) as threads from threads")
def start_thread(t: Tables):
    new = t.supplier.select((F.col("s_suppkey") + 10000000).alias("id"), F.col("s_name").alias("title"))
    x = t.view("threads").select("id", "title")
    return x.unionByName(K.insert_or_ignore(x, new, ["id"])).agg(F.count("*").alias("threads"))


@query(V("threads") + "select id, case when id % 7 = 0 then 3 else view_id end as view_id from threads")
def attach_view(t: Tables):
    x = t.view("threads").select("id", "view_id")
    return K.change(x, x.filter("id % 7 = 0").select("id", F.lit(3).alias("view_id")), ["id"])


@query(V("contexts") + "select name from contexts union select lower(r_name) from region")
def create_context(t: Tables):
    c = t.view("contexts").select("name")
    return c.unionByName(K.insert_or_ignore(c, t.region.select(F.lower("r_name").alias("name")), ["name"]))


@query("select event_type as kind, count(*) as events, count(distinct user_id) as members from events where user_id = 5 group by 1")
def materialize_thread(t: Tables):
    """The members of one thread by kind."""
    return K.point(t.events, "user_id", 5).groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("members"))


@query(ET + "select id from entities where k % 2 = 0 and entity_type in ('person', 'concept') and context_id is null union select id from entities where k % 3 = 0 and entity_type = 'concept' union select id from entities where k % 3 = 0 and context_id = 1 and entity_type is null")
def bridge(t: Tables):
    """Of the second thread only entities of an approved or no type join the first."""
    a = t.entities.filter("k % 2 = 0 and entity_type in ('person', 'concept') and context_id is null").select("id")
    b = t.entities.filter("k % 3 = 0").select("id", "entity_type").filter(F.col("entity_type").isNull() | F.col("entity_type").isin("concept"))
    return a.unionByName(b.select("id")).distinct()
