"""Policies, models, clusters, beliefs and decision networks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bandit as A
from ..operators import beliefs as B
from ..operators import clustering as C
from ..operators import learning as L
from ..operators import policy as P
from ..operators import policy_search as PS
from ..operators import store as K
from ..operators.hierarchy import hierarchical_clusters
from ..operators.neighbours import like_groups
from ..registry import query
from ..sources.memory import memory_views as V
from ..sources.tables import Tables, with_views

CO = with_views("commitments", "outcomes")
_COS = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform({0}, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform({1}, lambda x: x::double * x::double))))"


# ----------------------------------------------------------------- arms and policies
@query("select * from (values " + ", ".join(f"({i}, {k}, {h}, {str(e).lower()}, {str(c).lower()})" for i, (k, h, e, c) in enumerate(P.ARMS)) + ") v(arm, k, hops, episodic, late_interaction)")
def params_for_arm(t: Tables):
    return P.arm_parameters(t.spark)


@query("select verb, space, round(weight / sum(weight) over (partition by verb), 6)::double as weight from (values " + ", ".join(f"('{v}', '{s}', {w})" for v, ws in P.VERBS.items() for s, w in ws.items()) + ") v(verb, space, weight)")
def normalised_weights(t: Tables):
    rows = [(v, s, round(w, 6)) for v, ws in P.VERBS.items() for s, w in P.normalised(ws).items()]
    return t.spark.createDataFrame(rows, "verb string, space string, weight double")


_SCORES = "(select user_id % 7 as candidate, event_type as instance, max(value) as score from events group by 1, 2)"


def _scores(t: Tables):
    return t.events.groupBy((F.col("user_id") % 7).alias("candidate"), F.col("event_type").alias("instance")).agg(F.max("value").alias("score"))


@query(f"select round(100 * avg(best), 6) as ceiling from (select instance, max(score) as best from {_SCORES} group by 1)")
def frontier_ceiling(t: Tables):
    return P.frontier_ceiling(_scores(t)).select(F.round("ceiling", 6).alias("ceiling"))


@query(f"select instance from {_SCORES} group by 1 having max(score) < 350")
def unsolved(t: Tables):
    return P.unsolved(_scores(t), 350)


@query(f"with s as (select * from {_SCORES}), b as (select instance, max(score) as best from s group by 1) select candidate, count(case when score = best then 1 end) as owned, round(avg(score), 6) as mean from s join b using (instance) group by 1 order by owned desc, avg(score) desc, candidate limit 3")
def parents(t: Tables):
    return P.parents(L.frontier(_scores(t)).withColumn("mean", F.round("mean", 6)), 3).select("candidate", "owned", "mean")


_RUNS = "(select user_id % 7 as candidate, least(value / 100, 1.0) as f1, (event_id % 10) / 10.0::double as recall, value * 3 as latency from events)"


def _runs(t: Tables):
    return t.events.select((F.col("user_id") % 7).alias("candidate"), F.least(F.col("value") / 100, F.lit(1.0)).alias("f1"), (F.col("event_id") % 10 / 10.0).alias("recall"), (F.col("value") * 3).alias("latency"))


@query(f"select candidate, failed, case when missing >= 0.4 then 'not_retrieved' when slow >= 0.4 then 'too_slow' when ranked_low >= 0.4 then 'ranked_low' else 'mixed' end as diagnosis from (select candidate, count(*) as failed, avg(case when recall < 0.3 then 1.0 else 0.0 end) as missing, avg(case when recall >= 0.3 then 1.0 else 0.0 end) as ranked_low, avg(case when latency > 200 then 1.0 else 0.0 end) as slow from {_RUNS} where f1 < 0.5 group by 1)")
def diagnose(t: Tables):
    return P.diagnose(_runs(t)).select("candidate", "failed", "diagnosis")


@query(f"select mode(d) as diagnosis from (select candidate, case when avg(case when recall < 0.3 then 1.0 else 0.0 end) >= 0.4 then 'not_retrieved' when avg(case when latency > 200 then 1.0 else 0.0 end) >= 0.4 then 'too_slow' when avg(case when recall >= 0.3 then 1.0 else 0.0 end) >= 0.4 then 'ranked_low' else 'mixed' end as d from {_RUNS} where f1 < 0.5 group by 1)")
def dominant_diagnosis(t: Tables):
    d = P.diagnose(_runs(t)).groupBy("diagnosis").agg(F.count("*").alias("n"))
    return d.orderBy(F.desc("n"), "diagnosis").limit(1).select("diagnosis")


@query()
def optimize_policy(t: Tables):
    """A search over weights of three scores of all events against whether they are purchases: each policy is one aggregate job."""
    e = t.events.select((F.col("event_type") == "purchase").alias("good"), F.least(F.col("value") / 100, F.lit(1.0)).alias("text"), (F.col("event_id") % 10 / 10.0).alias("lexical"), S.half_life(F.col("event_id") % 30, 7.0).alias("recency"), F.lit(0.7).alias("confidence"))

    def score(p: P.Policy) -> tuple[float, str]:
        s = p.score({k: F.col(k) for k in ("text", "lexical", "recency", "confidence")})
        r = e.agg(F.avg((s.isNotNull() & (s >= 0.5) == F.col("good")).cast("double")).alias("mean"), F.avg((~F.col("good") & (s >= 0.5)).cast("double")).alias("false")).first()
        return float(r["mean"]), "ranked_low" if r["false"] > 0.1 else "not_retrieved"

    rounds = P.optimize(P.Policy(), score, rounds=2)
    return t.spark.createDataFrame([(i, r.policy.fingerprint(), r.mean, r.diagnosis, r.accepted) for i, r in enumerate(rounds)], "n int, policy string, mean double, diagnosis string, accepted boolean")


def _searched(t: Tables):
    """A short search over weights of three scores of all events against whether they are purchases; instances are users."""
    e = t.events.select("user_id", (F.col("event_type") == "purchase").alias("good"), F.least(F.col("value") / 100, F.lit(1.0)).alias("text"), (F.col("event_id") % 10 / 10.0).alias("lexical"), S.half_life(F.col("event_id") % 30, 7.0).alias("recency"), F.lit(0.7).alias("confidence"))
    return PS.policy_search(e, "user_id", {k: F.col(k) for k in ("text", "lexical", "recency", "confidence")}, F.col("good"), rounds=2)


@query()
def policy_rounds(t: Tables):
    """Every proposal with its parent, mean and what became of it."""
    rows = [(x.round, x.candidate, x.parent, x.policy.fingerprint(), x.mean, x.accepted, x.reason) for x in _searched(t)[0]]
    return t.spark.createDataFrame(rows, "round int, candidate int, parent int, policy string, mean double, accepted boolean, reason string")


_SEED = " + ".join(f"{P.VERBS['recall'][k]} * least(greatest({v}, 0), 1)" for k, v in (("text", "least(value / 100, 1.0)"), ("lexical", "(event_id % 10) / 10.0::double"), ("recency", "pow(2.0::double, -(event_id % 30) / 7.0::double)"), ("confidence", "0.7")))


@query(f"select user_id, count(*) as n, round(avg(case when (s >= 0.5) = (event_type = 'purchase') then 1.0 else 0.0 end), 6)::double as score from (select user_id, event_type, ({_SEED}) / {sum(P.VERBS['recall'].values())} as s from events) group by 1")
def policy_seed_scores(t: Tables):
    """The seed's row of the matrix, as the search returns it."""
    return _searched(t)[1].filter("candidate = 0").select(F.col("instance").alias("user_id"), "n", F.round("score", 6).alias("score"))


@query()
def policy_accepted_scores(t: Tables):
    """Scores of the accepted policies by instance."""
    return _searched(t)[1].withColumnRenamed("instance", "user_id")


@query(V("trajectories") + f"select arm, round(similarity, 6) as similarity from (select t.*, {_COS.format('e.embedding', 'q')} as similarity from trajectories t join embeddings e on e.vec_id = t.id, (select embedding as q from embeddings where vec_id = 1)) where similarity > 0.1 and reward > 0.2 order by similarity desc, id limit 1")
def nearest_successful_arm(t: Tables):
    q = F.broadcast(K.point(t.embeddings, "vec_id", 1).select(F.col("embedding").alias("q")))
    x = t.view("trajectories").join(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id").join(q)
    return P.nearest_successful_arm(x, S.cosine(F.col("embedding"), F.col("q")), 0.1, 0.2).select("arm", F.round("similarity", 6).alias("similarity"))


@query(V("feedback") + "select query_id, round(least(greatest(0.2 + coalesce(pos, 0) - abs(coalesce(neg, 0)), -1), 1), 6)::double as reward from (select query_id, sum(case when weight > 0 and hook_id < 20 then weight end) as pos, sum(case when weight < 0 and hook_id < 20 then weight end) as neg from feedback group by 1) where pos is not null or neg is not null")
def finalize_pending_reward(t: Tables):
    w = lambda c: F.sum(F.when(c & (F.col("hook_id") < 20), F.col("weight")))
    f = t.view("feedback").groupBy("query_id").agg(w(F.col("weight") > 0).alias("pos"), w(F.col("weight") < 0).alias("neg"))
    return f.select("query_id", F.round(P.pending_reward(F.lit(0.2), F.col("pos"), F.col("neg")), 6).alias("reward")).filter("reward is not null")


@query(V("traces") + "select entity_id, count(*) as credits from (select * from traces order by id desc limit 5) group by 1")
def explicit_feedback(t: Tables):
    """A good score credits the entities of the last traces."""
    return K.newest(t.view("traces"), 5, F.desc("id")).groupBy("entity_id").agg(F.count("*").alias("credits"))


def _pulls(t: Tables):
    """All trajectories as events: a context of the band of the day beside a constant."""
    hour = F.floor(F.col("seen_at") / 3600) % 24
    bands = [F.when(hour.between(lo, hi), 1.0).otherwise(0.0) for lo, hi in ((0, 5), (6, 11), (12, 17), (18, 23))]
    return t.view("trajectories").select("id", "query_class", "arm", F.col("reward").cast("double").alias("reward"), F.array(F.lit(1.0), *bands).alias("x"))


@query()
def bandit_replay(t: Tables):
    """The arm that each class of questions would have pulled at each trajectory, learned from the earlier ones."""
    return A.replay(_pulls(t), "query_class", ["id"], 5)


@query(V("trajectories") + "select query_class, arm::int as arm, count(reward) as pulls from trajectories group by 1, 2")
def bandit_pulls(t: Tables):
    """Pulls that the states hold after all trajectories."""
    return A.states(_pulls(t), "query_class", ["id"], 5).filter("pulls > 0").select("query_class", F.col("arm").cast("int").alias("arm"), "pulls")


@query()
def bandit_states(t: Tables):
    return A.states(_pulls(t), "query_class", ["id"], 5)


@query()
def bandit_value(t: Tables):
    """What the chosen arms are worth by the log, for each class."""
    return A.value_of(A.replay(_pulls(t), "query_class", ["id"], 5), ["query_class"])


_SESS = "(select user_id as session_id, user_id % 6 as arm, count(*) as queries, count(case when value > 40 then 1 end) as positive, count(case when value < 2 then 1 end) as negative from events group by 1, 2)"


def _sessions(t: Tables):
    return t.events.groupBy(F.col("user_id").alias("session_id"), (F.col("user_id") % 6).alias("arm")).agg(F.count("*").alias("queries"), F.count_if(F.col("value") > 40).alias("positive"), F.count_if(F.col("value") < 2).alias("negative"))


@query(f"select session_id, round(positive / queries, 6) as hit_rate, 'session ' || session_id || ': ' || case when positive / queries >= 0.6 then 'good' when positive / queries >= 0.3 then 'mixed' else 'poor' end || ', ' || positive || ' of ' || queries as narrative from {_SESS}")
def session_reflection(t: Tables):
    return P.reflect(_sessions(t)).select("session_id", "hit_rate", "narrative")


@query(f"select session_id, round(positive / queries, 6) as hit_rate from {_SESS} order by session_id desc limit 10")
def recent_reflections(t: Tables):
    return K.newest(P.reflect(_sessions(t)), 10, F.desc("session_id")).select("session_id", "hit_rate")


@query(f"select least(arm + 1, 5) as arm from (select arm, count(*) as n from {_SESS} where round(positive / queries, 6) < 0.3 group by 1) order by n desc, arm limit 1")
def suggest_arm(t: Tables):
    return P.suggest_arm(P.reflect(_sessions(t)))


@query("select verb, round(least(3.0, rate * n), 6) as multiplier from (select event_type as verb, count(*) / sum(count(*)) over () as rate, count(*) over () as n from events group by 1)")
def space_weight_adjustments(t: Tables):
    """Rate over the even rate, three at most."""
    c = t.events.groupBy(F.col("event_type").alias("verb")).agg(F.count("*").alias("c"))
    total = c.agg(F.sum("c").alias("total"), F.count("*").alias("n"))
    return c.join(F.broadcast(total)).select("verb", F.round(F.least(F.lit(3.0), F.col("c") / F.col("total") * F.col("n")), 6).alias("multiplier"))


@query("select event_type as verb, round(count(*) / sum(count(*)) over () * count(*) over (), 6) as score from events group by 1")
def affinity_scores(t: Tables):
    c = t.events.groupBy(F.col("event_type").alias("verb")).agg(F.count("*").alias("c"))
    total = c.agg(F.sum("c").alias("total"), F.count("*").alias("n"))
    return c.join(F.broadcast(total)).select("verb", F.round(F.col("c") / F.col("total") * F.col("n"), 6).alias("score"))


@query("select event_type as verb, count(*) as n from events group by 1 order by n desc, verb limit 3")
def top_verbs(t: Tables):
    return K.newest(t.events.groupBy(F.col("event_type").alias("verb")).agg(F.count("*").alias("n")), 3, F.desc("n"), "verb")


@query("select event_type as verb, user_id % 10 as host, case when hour(ts) between 6 and 11 then 'morning' when hour(ts) between 12 and 17 then 'afternoon' when hour(ts) between 18 and 21 then 'evening' else 'night' end as band, count(*) as n from events group by cube(1, 2, 3) having grouping_id(1, 2, 3) in (3, 1, 2)".replace("group by cube(1, 2, 3) having grouping_id(1, 2, 3) in (3, 1, 2)", "group by grouping sets ((1), (1, 2), (1, 3))"))
def observe_verbs(t: Tables):
    """Counts by verb, by verb and host, by verb and time band, in one pass."""
    e = t.events.select(F.col("event_type").alias("verb"), (F.col("user_id") % 10).alias("host"), S.verb_band(F.col("ts")).alias("band"))
    return e.groupingSets([[F.col("verb")], [F.col("verb"), F.col("host")], [F.col("verb"), F.col("band")]], "verb", "host", "band").agg(F.count("*").alias("n"))


# ----------------------------------------------------------------- causes
@query("select source, round(w, 6) as weight from (select event_type as source, avg(value) / sum(avg(value)) over () as w from events group by 1) order by w desc, source limit 3")
def top_attributions(t: Tables):
    a = t.events.groupBy(F.col("event_type").alias("source")).agg(F.avg("value").alias("m"))
    w = a.join(F.broadcast(a.agg(F.sum("m").alias("total")))).select("source", (F.col("m") / F.col("total")).alias("w"))
    return K.newest(w, 3, F.desc("w"), "source").select("source", F.round("w", 6).alias("weight"))


@query("select user_id, 'because of ' || string_agg(event_type || ' (' || n || ')', ', ' order by n desc, event_type) as text from (select user_id, event_type, count(*) as n from events group by 1, 2) group by 1")
def explain(t: Tables):
    """What led to a result, strongest first, as a sentence."""
    c = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    part = F.struct((-F.col("n")).alias("o"), "event_type", F.concat("event_type", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t"))
    return c.groupBy("user_id").agg(F.concat(F.lit("because of "), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), ", ")).alias("text"))


@query("select user_id, 'plan: direct_lookup > ' || string_agg(event_type, ' > ' order by ts, event_id) as narrative from (select *, row_number() over (partition by user_id order by ts, event_id) as n from events) where n <= 4 group by 1")
def reasoning_narrative(t: Tables):
    first = K.newest_each(t.events, ["user_id"], 4, "ts", "event_id")
    steps = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("user_id").agg(F.concat(F.lit("plan: direct_lookup > "), F.array_join(steps, " > ")).alias("narrative"))


# ----------------------------------------------------------------- outcome models
def _done(t: Tables):
    c = t.commitments.join(t.outcomes, F.col("id") == F.col("commitment_id"))
    return c.select("id", "stakes", "made_at", "horizon", F.lit(2).alias("options"), F.lit(0.5).alias("confidence"), F.when(F.col("id") % 3 == 0, "decision").otherwise("intent").alias("kind"), F.col("statement").alias("tag"), "polarity", "observed_at")


@query(CO + "select statement as tag, count(*) as n from commitments join outcomes on id = commitment_id group by 1 order by n desc, tag limit 16")
def tag_vocabulary(t: Tables):
    return K.newest(_done(t).groupBy("tag").agg(F.count("*").alias("n")), 16, F.desc("n"), "tag")


@query(CO + "select id, round((case when stakes in ('low', 'medium', 'high') then 1 else 0 end) + 1 + 1 + 1 + 0.5 + 1 + 1, 6)::double as total, 14 + (select count(distinct statement) from commitments join outcomes on id = commitment_id) as dim from commitments join outcomes on id = commitment_id")
def outcome_features(t: Tables):
    """Each commitment's feature vector: its sum and length."""
    d = _done(t)
    x = d.withColumn("x", L.outcome_features(L.tag_vocabulary(d, "tag")))
    return x.select("id", F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 6).alias("total"), F.size("x").alias("dim"))


def _trained(t: Tables, hidden: int):
    d = _done(t)
    x = L.split(d.withColumn("x", L.outcome_features(L.tag_vocabulary(d, "tag"))))
    return x, L.OutcomeModel(hidden=hidden).fit(x)


@query()
def outcome_linear(t: Tables):
    """Chances of a softmax regression (held against numpy in the tests)."""
    x, m = _trained(t, 0)
    return x.select("id", "polarity", m.chances(F.col("x")).alias("chances"))


@query()
def outcome_mlp(t: Tables):
    x, m = _trained(t, 8)
    return x.select("id", "polarity", m.chances(F.col("x")).alias("chances"))


@query(CO + "select count(*) as n, round(ln(3), 6) as loss, round(avg(case when polarity = -1 then 1.0 else 0.0 end), 6) as accuracy from commitments join outcomes on id = commitment_id")
def untrained_forward(t: Tables):
    """A model without training is uniform: its loss is ln 3, and ties go to the first class."""
    s = L.scored(_done(t), L.OutcomeModel().chances(None))
    return s.select("n", F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


@query(CO + "select case when observed_at > timestamp '1997-01-01' then 'after' else 'before' end as part, count(*) as n from commitments join outcomes on id = commitment_id where observed_at > timestamp '1997-01-01' group by 1")
def split_out_of_sample(t: Tables):
    return L.out_of_sample(_done(t), F.expr("timestamp_ntz'1997-01-01'")).groupBy(F.lit("after").alias("part")).agg(F.count("*").alias("n"))


@query()
def explain_top_k(t: Tables):
    """The features that speak most for a good outcome of one commitment."""
    x, m = _trained(t, 0)
    one = x.orderBy("id").limit(1).first()
    return t.spark.createDataFrame(m.contributions(one["x"], 1), "feature int, part double")


# ----------------------------------------------------------------- clusters
@query(V("signals").replace("with ", "with recursive ", 1) + f""", few as (select id, embedding from signals where cluster_id is null), p as (select a.id as a, b.id as b from few a join few b on a.id < b.id where {_COS.format('a.embedding', 'b.embedding')} >= 0.25),
e as materialized (select a, b from p union all select b, a from p), reach(id, to_id) as (select id, id from few union select reach.id, e.b from reach join e on e.a = to_id), l12 as (select id, min(to_id) as label from reach group by 1)"""
    + " select label, count(*) as members from l12 group by 1")
def cluster_by_similarity(t: Tables):
    """Single-link groups of the whole backlog."""
    backlog = t.view("signals").filter("cluster_id is null").select("id", "embedding")
    return like_groups(backlog, "id", "embedding", 0.25).groupBy("label").agg(F.count("*").alias("members"))


@query(V("signals").replace("with ", "with recursive ", 1) + f""", few as (select id, embedding, raw_text as text from signals where cluster_id is null and tier = 2), p as (select a.id as a, b.id as b from few a join few b on a.id < b.id where {_COS.format('a.embedding', 'b.embedding')} >= 0.25),
e as materialized (select a, b from p union all select b, a from p), reach(id, to_id) as (select id, id from few union select reach.id, e.b from reach join e on e.a = to_id), l12 as (select id, min(to_id) as label from reach group by 1)"""
    + " select label, count(*) as members, arg_max(id, struct_pack(n := len(regexp_split_to_array(trim(text), '\\s+')), m := -id)) as id from l12 join few using (id) group by 1")
def consolidate_priority(t: Tables):
    """The second tier's backlog as groups, singles too, each by its longest text."""
    backlog = t.view("signals").filter("cluster_id is null and tier = 2").select("id", "embedding", F.col("raw_text").alias("text"))
    label = like_groups(backlog, "id", "embedding", 0.25)
    return C.longest_text(backlog.select("id", "text"), label)


@query()
def recluster(t: Tables):
    """Hierarchical density clusters of all embeddings, of five members at least and by three samples (held against brute force in the tests)."""
    return hierarchical_clusters(t.embeddings, "vec_id", "embedding", least_members=5, samples=3)


_CEN = "(select label, list(m / len order by pos) as centroid, max(members) as members from (select label, i as pos, avg(embedding[i]::double) as m, count(*) as members from (select label, embedding, unnest(range(1, 65)) as i from embeddings) group by 1, 2) join (select label, sqrt(sum(m * m)) as len from (select label, i, avg(embedding[i]::double) as m from (select label, embedding, unnest(range(1, 65)) as i from embeddings) group by 1, 2) group by 1) using (label) group by 1)"


@query(f"select label, members, round(centroid[1], 6) as first from {_CEN}")
def persist_recluster(t: Tables):
    p = C.persisted(t.embeddings, t.embeddings.select(F.col("vec_id").alias("id"), "label"), "vec_id", "embedding")
    return p.select("label", "members", F.round(F.col("centroid")[0], 6).alias("first"))


@query(f"select vec_id as id, arg_max(c.label, struct_pack(s := {_COS.format('embedding', 'centroid')}, l := -c.label)) as label, round(max({_COS.format('embedding', 'centroid')}), 6) as score from embeddings, {_CEN} c group by 1")
def nearest_centroid(t: Tables):
    centres = C.persisted(t.embeddings, t.embeddings.select(F.col("vec_id").alias("id"), "label"), "vec_id", "embedding")
    return C.nearest(t.embeddings.select("vec_id", "embedding"), centres.select("label", "centroid"), "vec_id", "embedding").withColumn("score", F.round("score", 6))


@query("select label, case when label % 3 = 0 then 'topic ' || label else 'cluster ' || label end as name from embeddings group by 1")
def set_label(t: Tables):
    c = t.embeddings.select("label").distinct().withColumn("name", F.concat(F.lit("cluster "), F.col("label").cast("string")))
    return K.change(c, c.filter("label % 3 = 0").select("label", F.concat(F.lit("topic "), F.col("label").cast("string")).alias("name")), ["label"])


# ----------------------------------------------------------------- beliefs
@query(V("beliefs") + ", l as (select statement, arg_max(status, struct_pack(s := seq, i := id)) as status from beliefs group by 1), a as (select distinct 'p' || l_partkey || '|s' || l_suppkey as statement from lineitem union select 'p' || p_partkey || '|s0' from part) select a.statement, 'in' as status from a left join l using (statement) where l.status is null or l.status = 'out'")
def assert_belief(t: Tables):
    """What is held already isn't asserted again; what was retracted is held anew."""
    rows = t.lineitem.select(F.concat(F.lit("p"), "l_partkey", F.lit("|s"), "l_suppkey").alias("statement"))
    rows = rows.unionByName(t.part.select(F.concat(F.lit("p"), "p_partkey", F.lit("|s0")).alias("statement")))
    return B.asserted(t.view("beliefs"), rows)


@query(V("beliefs") + "select status, count(*) as n from (select case when id % 9 = 0 then 'out' else status end as status from beliefs) group by 1")
def retract_beliefs(t: Tables):
    b = t.view("beliefs")
    return B.resolve(b, b.filter("id % 9 = 0").select("id")).groupBy("status").agg(F.count("*").alias("n"))


def _justified(t: Tables):
    return t.lineitem.select(F.col("l_orderkey").alias("jid"), F.col("l_suppkey").alias("target"), F.when(F.col("l_orderkey") % 2 == 0, "support").otherwise("defeat").alias("kind"), F.col("l_partkey").alias("premise"))


@query("with j as (select l_orderkey as jid, l_suppkey as target, l_partkey as premise from lineitem), b as (select s_suppkey as id from supplier union select p_partkey from part where p_partkey % 5 > 0), ok as (select * from j where target in (select id from b)) select count(*) as n, count(distinct jid) as justifications from ok where jid not in (select jid from ok where premise not in (select id from b))")
def add_justification(t: Tables):
    """A justification with an unknown premise or target is refused."""
    b = t.supplier.select(F.col("s_suppkey").alias("id")).unionByName(t.part.filter("p_partkey % 5 > 0").select(F.col("p_partkey").alias("id"))).distinct()
    return B.justified(_justified(t), b).agg(F.count("*").alias("n"), F.count_distinct("jid").alias("justifications"))


@query("select distinct l_suppkey as target from lineitem where l_partkey = 7")
def dependents_of(t: Tables):
    return B.dependents(_justified(t), 7)


@query()
def propagate_beliefs(t: Tables):
    """Every second line's belief is retracted, and what leans on them follows (held against plain Python in the tests).

    A line is supported by the line before it, the first by the last (a cycle) and by the first of the next order; every fourth is defeated by the first two together.
    """
    line = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))
    last = line.groupBy("o").agg(F.max("n").alias("last"))
    each = line.join(last, "o")
    before = F.when(F.col("n") > 1, F.col("id") - 1).otherwise(F.col("o") * 10 + F.col("last"))
    support = each.select((F.col("id") * 10).alias("jid"), F.col("id").alias("target"), F.lit("support").alias("kind"), before.alias("premise")).filter("target <> premise")
    other = each.filter("n = 1").select((F.col("id") * 10 + 1).alias("jid"), F.col("id").alias("target"), F.lit("support").alias("kind"), ((F.col("o") + 1) * 10 + 1).alias("premise"))
    defeat = each.filter("n = 4").select((F.col("id") * 10 + 2).alias("jid"), F.col("id").alias("target"), F.lit("defeat").alias("kind"), F.explode(F.array(F.col("o") * 10 + 1, F.col("o") * 10 + 2)).alias("premise"))
    b = t.view("beliefs").select("id", "status")
    gone = b.filter("id % 10 = 2")
    return B.propagate(B.resolve(b, gone), support.unionByName(other).unionByName(defeat), gone.select("id"))


@query("with p as (select distinct least(user_id, event_id % 50) as a, greatest(user_id, event_id % 50) as b from events where user_id <> event_id % 50) select distinct case when (a + b) % 3 = 0 then b else a end as id from p where (a + b) % 3 < 2")
def resolve_by_triples(t: Tables):
    """Choices name a pair in either order."""
    p = t.events.filter("user_id <> event_id % 50").select(F.col("user_id").alias("a"), (F.col("event_id") % 50).alias("b")).distinct()
    sums = F.col("a") + F.col("b")
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    choices = p.filter(sums % 3 < 2).select(hi.alias("a"), lo.alias("b"), F.when(sums % 3 == 0, "b").otherwise("a").alias("keep")).distinct()
    return B.resolve_pairs(p, choices)


@query(V("beliefs") + "select count(*) as beliefs, count(case when status = 'in' then 1 end) as held from beliefs")
def rebuild_beliefs(t: Tables):
    return t.view("beliefs").agg(F.count("*").alias("beliefs"), F.count_if(F.col("status") == "in").alias("held"))


@query(f"select a.vec_id as a, b.vec_id as b, round({_COS.format('a.embedding', 'b.embedding')}, 6) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where {_COS.format('a.embedding', 'b.embedding')} < -0.1")
def record_contradiction(t: Tables):
    """Pairs of statements whose vectors point apart."""
    e = t.embeddings.select(F.col("vec_id").alias("a"), "embedding")
    pairs = e.join(t.embeddings.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("other")), "a")
    return B.contradicting(pairs.select("a", "b", S.cosine(F.col("embedding"), F.col("other")).alias("similarity")), below=-0.1).withColumn("similarity", F.round("similarity", 6))


# ----------------------------------------------------------------- decision networks
_WIN = "case when hour(ts) between 5 and 11 then 'morning' when hour(ts) between 12 and 17 then 'afternoon' when hour(ts) between 18 and 22 then 'evening' else 'night' end"


@query(f"select event_type as kind, {_WIN} as win, user_id % 3 as context, count(*) as n from events where ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-20' group by 1, 2, 3")
def observe_from_event_graph(t: Tables):
    """Counts of kinds under their parents, between two times, both included."""
    e = t.events.filter("ts >= timestamp'2024-01-05' and ts <= timestamp'2024-01-20'")
    return e.groupBy(F.col("event_type").alias("kind"), S.time_window(F.col("ts")).alias("win"), (F.col("user_id") % 3).alias("context")).agg(F.count("*").alias("n"))


@query(f"select kind, win, n from (select event_type as kind, null as win, count(*) as n from events group by 1 union all select event_type, {_WIN}, count(*) from events group by 1, 2)")
def observe(t: Tables):
    """Marginal counts, and counts for each value of the parent."""
    e = t.events.select(F.col("event_type").alias("kind"), S.time_window(F.col("ts")).alias("win"))
    return e.groupingSets([[F.col("kind")], [F.col("kind"), F.col("win")]], "kind", "win").agg(F.count("*").alias("n"))


@query(f"""with e as (select event_type as kind, {_WIN} as win from events), m as (select kind, count(*) as n from e group by 1), d as (select count(*) as dom, sum(n) as total from m), c as (select kind, count(*) as n from e where win = 'morning' group by 1),
s as (select m.kind, (m.n + 1) / (total + dom) * (coalesce(c.n, 0) + 1) / ((select count(*) from e where win = 'morning') + dom) as p, coalesce(c.n, 0) as support from m cross join d left join c on c.kind = m.kind)
select kind, round(p / sum(p) over (), 6) as p, sum(support) over ()::bigint as support from s order by p desc, kind limit 3""")
def anticipate(t: Tables):
    """The three likeliest kinds in the morning, and how many observations speak."""
    e = t.events.select(F.col("event_type").alias("kind"), S.time_window(F.col("ts")).alias("win"))
    c = e.groupBy("kind").agg(F.count("*").alias("m"), F.count_if(F.col("win") == "morning").alias("c"))
    total = c.agg(F.count("*").alias("dom"), F.sum("m").alias("total"), F.sum("c").alias("support"))
    p = (F.col("m") + 1) / (F.col("total") + F.col("dom")) * (F.col("c") + 1) / (F.col("support") + F.col("dom"))
    s = c.join(F.broadcast(total)).withColumn("p", p)
    s = s.withColumn("p", F.round(F.col("p") / F.sum("p").over(Window.partitionBy("dom")), 6))
    return K.newest(s, 3, F.desc("p"), "kind").select("kind", "p", "support")


_NET = (("event_kind", "time_window"), ("event_kind", "context"))


@query("""with v as (select case event_type when 'error' then 'context' else event_type end as variable, count(distinct user_id % 10)::int as values_ from events group by 1)
select * from v union all select * from (values ('event_kind', 5), ('time_window', 4), ('context', 3)) b(variable, values_) where variable not in (select variable from v where variable is not null)""")
def ensure_baseline_variables(t: Tables):
    """The variables that events speak of, and three variables where they aren't there yet."""
    name = F.when(F.col("event_type") == "error", "context").otherwise(F.col("event_type"))
    seen = t.events.groupBy(name.alias("variable")).agg(F.count_distinct(F.col("user_id") % 10).cast("int").alias("values_"))
    base = t.spark.createDataFrame([("event_kind", 5), ("time_window", 4), ("context", 3)], "variable string, values_ int")
    return seen.unionByName(K.insert_or_ignore(seen, base, ["variable"]))


@query("select variable, max(values_) as values_ from (values ('event_kind', 5), ('time_window', 4), ('event_kind', 6)) v(variable, values_) group by 1")
def upsert_variable(t: Tables):
    log = t.spark.createDataFrame([("event_kind", 5, 1), ("time_window", 4, 2), ("event_kind", 6, 3)], "variable string, values_ int, seq int")
    return K.current(log, ["variable"]).drop("seq")


@query("select * from (values ('event_kind', 'time_window'), ('event_kind', 'context')) v(child, parent)")
def upsert_dependency(t: Tables):
    log = t.spark.createDataFrame([(*r, i) for i, r in enumerate(_NET + _NET)], "child string, parent string, seq int")
    return K.current(log, ["child", "parent"]).drop("seq")


@query("select 'time_window' as parent union all select 'context'")
def parents_of(t: Tables):
    return K.point(t.spark.createDataFrame(list(_NET), "child string, parent string"), "child", "event_kind").select("parent")


# ----------------------------------------------------------------- procedures
_LASTP = V("procedures") + ", p as (select * from (select *, row_number() over (partition by id order by seq desc) as n from procedures) where n = 1)"


@query(_LASTP + "select id, round(succeeded / total, 6) as confidence, case when succeeded / total >= 0.8 then 'reinforced' when succeeded / total < 0.3 then 'degraded' else status end as status from p where total > 0")
def procedure_status(t: Tables):
    """Confidence as the share of successes, and the status that it makes."""
    c = F.col("succeeded") / F.col("total")
    status = F.when(c >= 0.8, "reinforced").when(c < 0.3, "degraded").otherwise(F.col("status"))
    return K.current(t.view("procedures"), ["id"]).filter("total > 0").select("id", F.round(c, 6).alias("confidence"), status.alias("status"))


@query(_LASTP + "select id, version + 1 as version, id as parent from p where status = 'active'")
def revise_procedure(t: Tables):
    return K.current(t.view("procedures"), ["id"]).filter("status = 'active'").select("id", (F.col("version") + 1).alias("version"), F.col("id").alias("parent"))


@query(_LASTP + "select id, '1. ' || name || '; 2. ' || steps as plan from p")
def dry_run(t: Tables):
    """The steps of each procedure as numbered text."""
    steps = F.transform(F.array("name", "steps"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return K.current(t.view("procedures"), ["id"]).select("id", F.array_join(steps, "; ").alias("plan"))
