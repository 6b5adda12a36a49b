"""Retrieval queries: signals, hits, reranking, recommendations, procedures, contexts and tools."""

from __future__ import annotations

from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph as G
from ..operators import retrieval as Q
from ..operators import store as K
from ..operators import vectors as V
from ..plans import engine as N
from ..plans import planner as P
from ..registry import query
from ..sources.memory import VIEWS
from ..sources.memory import memory_views
from ..sources.tables import CTE, Tables, with_views
from .graph import _pagerank_sql

E, T = with_views("entities"), with_views("triples")
_SIG = memory_views("signals")
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::double * z[2]::double))"
_COS = _DOT + " / (sqrt(list_sum(list_transform({0}, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform({1}, lambda x: x::double * x::double))))"
_LEX = "list_filter(list_transform(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\p{{L}}\\p{{N}}:.$''-]+'), lambda t: regexp_replace(regexp_replace(t, '''s$', ''), '^[.''-]+|[.''-]+$', '', 'g')), lambda t: t <> '')"
_TOK = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
ASKED = {0: "the tion of", 1: "die und der und", 2: "la de les"}
NOW = 1704067200 + 400 * 3600


def _asked(t: Tables):
    words = t.spark.createDataFrame(list(ASKED.items()), "query_id long, query string")
    return t.embeddings.filter(F.col("vec_id") < len(ASKED)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).join(F.broadcast(words), "query_id")


# ----------------------------------------------------------------- two stages
_BITS = "list_transform({}::double[][], lambda p: case when " + _DOT.format("p", "{}") + " >= 0 then 1 else 0 end)"


def _pool_sql(k: int, rows: str, clustered: str, asked: int = len(ASKED)) -> str:
    """qs (query_id, q, b), s (the rows with their bits), pool (query_id, id): both parts of the candidates."""
    planes = "(select v from planes)"
    return f"""planes as (select {[[float(x) for x in p] for p in V.planes(64)]} as v), qs as (select vec_id as query_id, embedding as q, {_BITS.format(planes, 'embedding')} as b from embeddings where vec_id < {asked}),
s as (select *, {_BITS.format(planes, 'embedding')} as b from {rows} where {clustered}),
d as (select query_id, id, list_sum(list_transform(list_zip(qs.b, s.b), lambda z: abs(z[1] - z[2]))) as d from qs, s),
pool as (select query_id, id from (select *, row_number() over (partition by query_id order by d, id) as n from d) where n <= {max(8 * k, 256)}
  union select query_id, id from qs, (select id from s order by id desc limit {max(4 * k, 128)}))"""


_OPEN = "cluster_id is null and embedding is not null and tier < 4"


@query(_SIG + ", " + _pool_sql(10, "signals", _OPEN) + f""", c as (select query_id, id, {_COS.format('s.embedding', 'qs.q')} as score from pool join s using (id) join qs using (query_id))
select query_id, id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, id)::int as rank from c where score >= 0.05) where rank <= 10""")
def search_signals(t: Tables):
    return Q.search_signals(t.view("signals"), _asked(t).select("query_id", "q"), 10, 0.05, 64).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(_SIG + ", " + _pool_sql(10, "signals", _OPEN) + " select query_id, id from pool")
def signal_ann_candidates(t: Tables):
    open_ = t.view("signals").filter(_OPEN)
    return Q.candidates(open_, _asked(t).select("query_id", "q"), 10, 64).select("query_id", "id")


_HITS_OF = f"""
c as (select query_id, id, raw_text, created_at, {_COS.format('s.embedding', 'qs.q')} as cosine from pool join s using (id) join qs using (query_id)),
p as (select * from (select *, row_number() over (partition by query_id order by cosine desc, id) as n from c where cosine >= 0) where n <= 32),
tk as (select query_id, id, {_LEX.format('raw_text')} as t from p), st as (select query_id, count(*) as n, avg(len(t)) as avgdl from tk group by 1),
qt as (select query_id, term, count(*) as times from (select query_id, unnest({_LEX.format('query')}) as term from ask) group by 1, 2),
tf as (select x.query_id, id, x.len, x.term, times, count(*) as tf from (select query_id, id, len(t) as len, unnest(t) as term from tk) x join qt using (query_id, term) group by 1, 2, 3, 4, 5),
df as (select query_id, term, count(*) as df from tf group by 1, 2),
raw as (select query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avgdl)) * times) as raw from tf join df using (query_id, term) join st using (query_id) group by 1, 2),
lx as (select query_id, id, raw / max(raw) over (partition by query_id) as lexical from raw),
f as (select query_id, id, (0.534 * least(greatest(cosine, 0.0), 1.0) + 0.311 * coalesce(lexical, 0) + 0.078 * pow(2.0, -(({NOW} - created_at) / 86400.0::double) / 30) + 0.078 * 0.7) / (0.534 + 0.311 + 0.078 + 0.078) as score from p left join lx using (query_id, id)),
h as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id)::int as rank from f where score >= 0.15)"""


def _hits_sql(asked: dict[int, str]) -> str:
    """h (query_id, id, score, rank): the hits of stated questions."""
    return _SIG + ", " + _pool_sql(32, "signals", _OPEN, len(asked)) + f", ask(query_id, query) as (values {', '.join(f"({i}, '{q}')" for i, q in asked.items())})," + _HITS_OF


_HITS = _hits_sql(ASKED)


@query(_HITS + " select query_id, id, round(score, 6) as score, rank from h where rank <= 8")
def search_signal_hits(t: Tables):
    """Hits by cosine, words (fitted on the pool), age and confidence."""
    h = Q.signal_hits(t.view("signals"), _asked(t), F.lit(NOW), 8, 64)
    return h.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(_HITS + " select id, round(max(score), 6) as score from h where rank <= 8 group by 1")
def query_decomposed(t: Tables):
    """Parts of a question as questions; each signal counts by its best."""
    return Q.ranked(Q.signal_hits(t.view("signals"), _asked(t), F.lit(NOW), 8, 64)).select("id", F.round("score", 6).alias("score"))


@query(_HITS + " select id, round(max(score), 6) as score from h where rank <= 8 group by 1 order by max(score) desc, id limit 5")
def rank_signal_hits(t: Tables):
    return Q.ranked(Q.signal_hits(t.view("signals"), _asked(t), F.lit(NOW), 8, 64)).limit(5).select("id", F.round("score", 6).alias("score"))


@query(_SIG + f", q as (select embedding as q from embeddings where vec_id = 1) select id, round(0.6 * {_COS.format('embedding', 'q')} + 0.4 * pow(2.0, -(({NOW} - created_at) / 86400.0::double) / 7), 6) as score from signals, q where created_at >= {NOW - 14 * 86400} and created_at < {NOW - 86400} order by 2 desc, id limit 10")
def query_temporal(t: Tables):
    q = [float(x) for x in K.point(t.embeddings, "vec_id", 1).first()["embedding"]]
    h = Q.temporal_hits(t.view("signals"), q, F.lit(NOW - 14 * 86400), F.lit(NOW - 86400), F.lit(NOW), 60)
    return h.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(10)


# ----------------------------------------------------------------- end to end
QUESTIONS = {0: "the tion of", 1: "how is the one related to the other", 2: "what happened last week", 3: "ls", 4: "which of these did they order in the end"}
_WHEN = datetime.fromtimestamp(NOW, UTC).replace(tzinfo=None)


def _search_sql() -> str:
    """The plans are worked out here as they are in ``plans.engine``; all lists, ranks and sums are SQL's."""
    plans = N.planned(QUESTIONS, _WHEN)
    spec = ", ".join(f"({p.query_id}, {p.k}, {p.hops}, {p.wider}, {p.signals})" for p in plans)
    spans = ", ".join(f"({p.query_id}, {int(p.plan.window[0].replace(tzinfo=UTC).timestamp())}, {int(p.plan.window[1].replace(tzinfo=UTC).timestamp())})" for p in plans if p.plan.window)
    return _hits_sql(QUESTIONS) + f""", spec(query_id, k, hops, wider, most) as (values {spec}), spans(query_id, lo, hi) as (values {spans}),
{CTE['entities']}, {CTE['triples']}, access_log as ({VIEWS['access_log'].replace('{events}', 'events')}),
near as (select query_id, 'c' || vec_id as id, k, wider, {_COS.format('e.embedding', 'qs.q')} as sim from embeddings e, qs join spec using (query_id)),
few as (select *, place <= k as own from (select *, row_number() over (partition by query_id order by sim desc, id) as place from near where sim is not null) where place <= greatest(k, wider)),
known as (select few.*, e.id is not null as ok from few left join (select id from entities where confidence >= 0.2) e using (id)),
kn as (select query_id, max(case when own then sim end) as best, count(case when own and ok then 1 end) as n from known group by 1),
hit as (select query_id, id, place, own from known join kn using (query_id) where ok and (own or (greatest(best, 0) < 0.3 and n < 3 and sim * 0.6 >= 0.15))),
used as (select entity_id as id, count(*) as retrieved, count(case when event_type = 'purchase' then 1 end) as succeeded, max(seen_at) as last from access_log group by 1),
ls as (select hit.*, coalesce(succeeded / (retrieved + 1), 0.5) as v, coalesce(1 / (retrieved + 1), 1.0) as r, coalesce(exp(-0.05 * (floor(({NOW} - last) / 60) / 60)), 0) as c from hit left join used using (id)),
pl as (select *, row_number() over (partition by query_id order by own desc, place) as a, row_number() over (partition by query_id order by own desc, v desc, place) as b,
  row_number() over (partition by query_id order by own desc, r desc, place) as d, row_number() over (partition by query_id order by own desc, c desc, place) as g from ls),
fu as (select query_id, id, place, own, case when own then 1 / (60.0::double + a) + 1 / (60.0::double + b) + 1 / (60.0::double + d) + 1 / (60.0::double + g) end as fused from pl),
ent as (select query_id, id, row_number() over (partition by query_id order by own desc, round(fused, 12) desc, place) as rank, fused from fu),
ed as (select subject_id as a, object_id as b from triples where subject_id <> object_id union all select object_id, subject_id from triples where subject_id <> object_id),
h1 as (select distinct query_id, b as id from ent join spec using (query_id) join ed on ed.a = ent.id where hops >= 1 and (query_id, b) not in (select query_id, id from ent)),
h2 as (select distinct query_id, b as id from h1 join spec using (query_id) join ed on ed.a = h1.id where hops >= 2 and (query_id, b) not in (select query_id, id from ent) and (query_id, b) not in (select query_id, id from h1)),
tm as (select query_id, id, k, 0.6 * {_COS.format('s.embedding', 'qs.q')} + 0.4 * pow(2.0, -(({NOW} - created_at) / 86400.0::double) / 7) as score from signals s join spans on created_at >= lo and created_at < hi join qs using (query_id) join spec using (query_id)),
tr as (select *, row_number() over (partition by query_id order by score desc, id) as rank from tm)
select query_id, 'entity' as kind, id, rank::int as rank, round(fused, 9) as score from ent
union all select query_id, 'neighbour', id, 1, null from h1 union all select query_id, 'neighbour', id, 2, null from h2
union all select query_id, 'signal', id::varchar, rank, round(score, 6) from h join spec using (query_id) where rank <= most
union all select query_id, 'temporal', id::varchar, rank::int, round(score, 6) from tr where rank <= k"""


def _search(t: Tables, diversity: float):
    log = t.view("access_log")
    usage = log.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("retrieved"), F.count_if(F.col("event_type") == "purchase").alias("succeeded"), F.max("seen_at").alias("last"))
    vectors = t.embeddings.select(F.concat(F.lit("c"), "vec_id").alias("id"), "embedding")
    asked = t.embeddings.filter(F.col("vec_id") < len(QUESTIONS)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    r = N.search(QUESTIONS, asked, vectors, t.entities.filter("confidence >= 0.2"), usage, t.triples, t.view("signals"), _WHEN, 64, diversity=diversity)
    return r.withColumn("score", F.when(F.col("kind") == "entity", F.round("score", 9)).otherwise(F.round("score", 6)))


@query(_search_sql())
def search_end_to_end(t: Tables):
    """Five questions: planned, gated, each with the lists its plan asks for, fused; in the fused order."""
    return _search(t, 0.0)


@query()
def search_diverse(t: Tables):
    """The same, reordered for diversity."""
    return _search(t, 0.3)


@query(_SIG + f""", qs as (select vec_id as query_id, embedding as q from embeddings where vec_id < {len(ASKED)}), v as (select query_id, id, {_COS.format('embedding', 'q')} as s, created_at from signals, qs where tier < 4),
l as (select query_id, 'vector' as list, id, round(s, 6) as score from v union all select query_id, 'newest', id, created_at from v),
r as (select *, row_number() over (partition by query_id, list order by score desc, id) as n from l),
f as (select query_id, id, round(sum(1 / (60.0::double + n)), 9) as fused from r where n <= 40 group by 1, 2)
select query_id, id, fused from (select *, row_number() over (partition by query_id order by fused desc, id) as n from f) where n <= 10""")
def hybrid_query(t: Tables):
    """Lists by likeness and by age, fused by reciprocal ranks."""
    s = t.view("signals").filter("tier < 4").join(F.broadcast(_asked(t).select("query_id", "q")))
    v = s.select("query_id", "id", F.round(S.cosine(F.col("embedding"), F.col("q")), 6).alias("s"), "created_at")
    lists = v.select("query_id", F.lit("vector").alias("list"), "id", F.col("s").alias("score")).unionByName(v.select("query_id", F.lit("newest").alias("list"), "id", F.col("created_at").cast("double").alias("score")))
    cut = lists.withColumn("g", F.concat_ws(":", "query_id", "list"))
    fused = V.rrf(Q.top(cut, "g", 40, F.desc("score"), "id").drop("rank", "g")).withColumn("fused", F.round("fused", 9))
    return Q.top(fused, "query_id", 10, F.desc("fused"), "id").drop("rank")


# ----------------------------------------------------------------- late interaction
_TWO = "[{0}[1:32], {0}[33:64]]"
_MAXSIM = "list_sum(list_transform(" + _TWO.format("q") + ", lambda x: list_max(list_transform(" + _TWO.format("embedding") + ", lambda y: " + _COS.format("x", "y") + "))))"


def _two(c):
    return F.array(F.slice(c, 1, 32), F.slice(c, 33, 32))


def _one_question(t: Tables):
    return t.embeddings.join(F.broadcast(K.point(t.embeddings, "vec_id", 0).select(F.col("embedding").alias("q"))))


@query(f"select vec_id as id, round(0.6 * {_MAXSIM} + 0.4 * (vec_id % 10) / 10.0::double, 6) as score from embeddings, (select embedding as q from embeddings where vec_id = 0) where vec_id % 3 > 0 union all select vec_id, round((vec_id % 10) / 10.0::double, 6) from embeddings where vec_id % 3 = 0")
def apply_colbert_maxsim(t: Tables):
    """0.6 of the late-interaction score where tokens are at hand."""
    d = F.when(F.col("vec_id") % 3 > 0, _two("embedding"))
    score = Q.rerank(t.embeddings, _two("q"), d, F.col("vec_id") % 10 / 10, 0.6)
    return _one_question(t).select(F.col("vec_id").alias("id"), F.round(score, 6).alias("score"))


@query(f"select vec_id as id, round(0.7 * {_MAXSIM} + 0.3 * (vec_id % 10) / 10.0::double, 6) as score from embeddings, (select embedding as q from embeddings where vec_id = 0) order by 2 desc, 1 limit 20")
def rerank(t: Tables):
    score = Q.rerank(t.embeddings, _two("q"), _two("embedding"), F.col("vec_id") % 10 / 10, 0.7)
    return _one_question(t).select(F.col("vec_id").alias("id"), F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query(f"select vec_id as id, round({_MAXSIM}, 6) as score from embeddings, (select embedding as q from embeddings where vec_id = 0) order by 2 desc, 1 limit 10")
def top_k_with_query_tokens(t: Tables):
    s = _one_question(t).select(F.col("vec_id").alias("id"), F.round(V.maxsim(_two("q"), _two("embedding")), 6).alias("score"))
    return s.orderBy(F.desc("score"), "id").limit(10)


_MEANS = "(select list(m order by i) as c from (select i, avg(embedding[i]::double) as m from (select embedding, unnest(range(1, 65)) as i from embeddings where vec_id between 1 and 10) group by 1))"
_MIX = "list_transform(list_zip(embedding, c), lambda z: 0.8 * z[1]::double + 0.2 * z[2]::double)"


@query(f"select vec_id as id, round(m[1] / sqrt(list_sum(list_transform(m, lambda x: x * x))), 6) as first, round(m[64] / sqrt(list_sum(list_transform(m, lambda x: x * x))), 6) as last from (select vec_id, {_MIX} as m from embeddings, {_MEANS})")
def blend_with_context(t: Tables):
    """Each vector as a question behind the same ten."""
    ten = t.embeddings.filter("vec_id between 1 and 10").select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = ten.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("c"))
    b = t.embeddings.join(F.broadcast(c)).withColumn("b", Q.blend(F.col("embedding"), F.col("c")))
    return b.select(F.col("vec_id").alias("id"), F.round(F.col("b")[0], 6).alias("first"), F.round(F.col("b")[63], 6).alias("last"))


@query("select vec_id as id, round((embedding[1]::double + embedding[33]::double) / 2, 6) as both, round(embedding[1]::double, 6) as one from embeddings")
def mean_pool(t: Tables):
    ones = lambda *m: F.array(*[F.lit(x) for x in m])
    first = lambda mask: F.round(Q.mean_pool(_two("embedding"), mask)[0], 6)
    return t.embeddings.select(F.col("vec_id").alias("id"), first(ones(1, 1)).alias("both"), first(ones(1, 0)).alias("one"))


@query("select user_id, round(sum(w * x) / sqrt(sum(w * x) * sum(w * x) + sum(w * y) * sum(w * y)), 6) as first from (select user_id, pow(2.0, -(30 - extract(day from ts)) / 7.0) as w, value as x, 1.0 as y from events) group by 1")
def topic_vector(t: Tables):
    """Recency-weighted mean of a user's (value, 1), at unit length."""
    w = S.half_life(30 - F.dayofmonth("ts"), 7.0)
    s = t.events.groupBy("user_id").agg(F.sum(w * F.col("value")).alias("x"), F.sum(w).alias("y"))
    return s.select("user_id", F.round(F.col("x") / F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), 6).alias("first"))


# ----------------------------------------------------------------- entities
@query(T + f""", q as (select embedding as q from embeddings where vec_id = 0), p as (select 'p' || vec_id as id, row_number() over (order by {_COS.format('embedding', 'q')} desc, vec_id) as rank from embeddings, q), prim as (select * from p where rank <= 8),
nb as (select id, min(seed) as seed from (select s.id as seed, object_id as id from triples join prim s on s.rank <= 5 and subject_id = s.id union all select s.id, subject_id from triples join prim s on s.rank <= 5 and object_id = s.id) where id not in (select id from prim) group by 1),
sc as (select nb.id, seed, greatest(coalesce({_COS.format('e.embedding', 'q')}, 0), 0) + 0.1 as score from nb left join embeddings e on 'p' || e.vec_id = nb.id, q)
select id, round(score, 6) as score, seed from sc order by score desc, id limit 5""")
def compute_related_entities(t: Tables):
    """Neighbours of the five nearest parts."""
    s = _one_question(t).select(F.concat(F.lit("p"), "vec_id").alias("id"), "vec_id", S.cosine(F.col("embedding"), F.col("q")).alias("s"))
    primary = s.orderBy(F.desc("s"), "vec_id").limit(8).withColumn("g", F.lit(0))
    primary = Q.top(primary, "g", 8, F.desc("s"), "vec_id").select("id", "rank")
    q = F.array(*[F.lit(float(x)) for x in K.point(t.embeddings, "vec_id", 0).first()["embedding"]])
    vectors = t.embeddings.select(F.concat(F.lit("p"), "vec_id").alias("id"), "embedding")
    return Q.related(t.triples, primary, vectors, q).select("id", F.round("score", 6).alias("score"), "seed")


_REC = _pagerank_sql(2) + f""", acc as (select 'c' || user_id as id, (1704067200 + max(event_id) * 60) as last, count(*) as n from events group by 1),
cand as (select 'c' || vec_id as id, {{rel}} as relevance, exp(-0.05 * (({1704067200 + 700000} - last) / 3600.0::double)) as recency, 1 / (1 + ln(1 + n)) as novelty, coalesce(r, 0) / (select max(r) from r2) as pr from {{rows}} join acc on acc.id = 'c' || vec_id left join r2 on r2.id = 'c' || vec_id),
sc as (select *, {{weights}} as score from cand)
select id, round(score, 6) as score, {{reason}} as reason from sc order by score desc, id limit 6"""
_REASON = """array_to_string(list_transform(list_sort(list_filter([case when relevance > 0 then struct_pack(v := -relevance, i := 0, t := round(relevance * 100)::int || '% match') end, case when pr > 0 then struct_pack(v := -pr, i := 1, t := 'PageRank ' || printf('%.2f', pr)) end,
case when recency > 0 then struct_pack(v := -recency, i := 2, t := case when recency > 0.7 then 'seen recently' when recency > 0.3 then 'seen this week' else 'older' end) end, case when novelty > 0 then struct_pack(v := -novelty, i := 3, t := case when novelty > 0.7 then 'brand new' when novelty > 0.4 then 'still rare' else 'well-known' end) end], lambda x: x is not null))[1:2], lambda x: x.t), ' · ')"""


def _candidates(t: Tables, rows):
    acc = t.view("access_log").groupBy(F.col("entity_id").alias("id")).agg(F.max("seen_at").alias("last"), F.count("*").alias("n"))
    rank = G.checkpointed(G.pagerank(t.triples, rounds=2))
    best = rank.agg(F.max("r").alias("best"))
    hours = (F.lit(1704067200 + 700000) - F.col("last")) / 3600.0
    j = rows.join(acc, "id").join(rank, "id", "left").join(F.broadcast(best))
    return j.select("id", "relevance", S.recency(hours).alias("recency"), S.novelty(F.col("n")).alias("novelty"), (F.coalesce("r", F.lit(0.0)) / F.col("best")).alias("pr"))


@query(_REC.format(rel="s", rows=f"(select vec_id, {_COS.format('embedding', 'q')} as s from embeddings, (select embedding as q from embeddings where vec_id = 0) order by s desc, vec_id limit 24)", weights="0.4 * relevance + 0.2 * recency + 0.2 * novelty + 0.2 * pr", reason=_REASON))
def recommendations(t: Tables):
    """Of the nearest four times six: likeness, recency, novelty and rank, with the two strongest reasons."""
    s = _one_question(t).select("vec_id", F.concat(F.lit("c"), "vec_id").alias("id"), S.cosine(F.col("embedding"), F.col("q")).alias("relevance"))
    rows = s.orderBy(F.desc("relevance"), "vec_id").limit(24)
    return Q.recommend(_candidates(t, rows), 6, (0.4, 0.2, 0.2, 0.2)).select("id", F.round("score", 6).alias("score"), "reason")


@query(_REC.format(rel="(vec_id * 37 % 100) / 100.0::double", rows="(select distinct user_id as vec_id from (select * from events order by event_id desc limit 20))", weights="0.2 * relevance + 0.3 * recency + 0.2 * novelty + 0.3 * pr", reason=_REASON))
def cold_start_recommendations(t: Tables):
    """Entities of the last twenty traces: confidence in place of likeness."""
    last = K.newest(t.events, 20, F.desc("event_id")).select("user_id").distinct()
    rows = last.select(F.concat(F.lit("c"), "user_id").alias("id"), (F.col("user_id") * 37 % 100 / 100.0).alias("relevance"))
    return Q.recommend(_candidates(t, rows), 6, (0.2, 0.3, 0.2, 0.3)).select("id", F.round("score", 6).alias("score"), "reason")


@query(f"select vec_id as id, {_COS.format('embedding', 'q')} > 0.35 or (vec_id % 10) / 10.0 > 0.5 as relevant from embeddings, (select embedding as q from embeddings where vec_id = 0)")
def is_relevant_for_ingestion(t: Tables):
    s = Q.relevant_for_ingestion(S.cosine(F.col("embedding"), F.col("q")), F.col("vec_id") % 10 / 10.0)
    return _one_question(t).select(F.col("vec_id").alias("id"), s.alias("relevant"))


@query("select event_type as host, user_id % 5 as session, case when user_id % 5 = 2 then 1.0::double else 0.0 end / 2 + case when event_type = 'view' then 1.0::double else 0.0 end / 2 as score, count(*) as n from events group by 1, 2")
def host_session_space(t: Tables):
    s = Q.host_session_space(F.col("user_id") % 5, F.when(F.col("event_type") == "view", 1).otherwise(0), 2, 1)
    return t.events.groupBy(F.col("event_type").alias("host"), (F.col("user_id") % 5).alias("session"), s.alias("score")).agg(F.count("*").alias("n"))


@query(E + "select entity_type, case when entity_type = 'person' then 1.0::double else 0.0 end as score, count(*) as n from entities group by 1, 2")
def entity_type_space(t: Tables):
    return t.entities.groupBy("entity_type", Q.entity_type_space(F.col("entity_type"), "person").alias("score")).agg(F.count("*").alias("n"))


# ----------------------------------------------------------------- procedures, contexts, tools
_LASTP = memory_views("procedures") + ", p as (select * from (select *, row_number() over (partition by id order by seq desc) as n from procedures) where n = 1)"
_W = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w <> ''))"
_ASK = "how to make a small widget economy"


@query(_LASTP + f""", w as (select *, {_W.format(repr(_ASK))} as q, {_W.format('name')} as a, {_W.format('steps')} as b from p where status <> 'deprecated'),
s as (select id, name, case when contains('{_ASK}', lower(name)) or contains(lower(name), '{_ASK}') then 1.0::double else len(list_intersect(q, a)) / len(list_distinct(list_concat(q, a))) + 0.5 * len(list_intersect(q, b)) / len(list_distinct(list_concat(q, b))) end as score from w)
select id, name, round(score, 6) as score from s where score > 0.2 order by score desc, id limit 3""")
def match_procedures(t: Tables):
    p = K.current(t.view("procedures"), ["id"]).filter("status <> 'deprecated'")
    return Q.match_procedures(p, _ASK).select("id", "name", F.round("score", 6).alias("score"))


@query(E + f"select context_id, count(*) as n, least(count(*) / 10, 0.95::double) as confidence from entities where context_id is not null and list_has_any({_TOK.format('name')}, ['small', 'widget']) group by 1 having count(*) >= 3 order by n desc, context_id limit 1")
def context_suggest(t: Tables):
    return Q.suggest_context(t.entities, "small widget")


@query(f"""with w as (select item_id as tool, unnest(list_distinct({_TOK.format('text')})) as w from benchmark), i as (select w, ln(1 + (select count(*) from benchmark) / count(*)) as idf from w group by 1),
u as (select conv_id * 1000 + turn as uid, unnest(list_distinct({_TOK.format('text')})) as w from conversations) select uid, tool, round(sum(idf), 6) as score from u join w using (w) join i using (w) group by 1, 2""")
def rank_tools(t: Tables):
    """Passages as tools' descriptions, turns as what is said."""
    said = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("uid"), "text")
    return Q.rank_tools(t.benchmark.select(F.col("item_id").alias("tool"), F.col("text").alias("description")), said).withColumn("score", F.round("score", 6))


@query("select count(case when value > 20 and event_type = 'purchase' then 1 end) as hit, count(case when value > 20 then 1 end) as found, count(case when event_type = 'purchase' then 1 end) as gold, round(count(case when value > 20 and event_type = 'purchase' then 1 end) / count(case when value > 20 then 1 end), 6) as precision, round(count(case when value > 20 and event_type = 'purchase' then 1 end) / count(case when event_type = 'purchase' then 1 end), 6) as recall, round(2 * count(case when value > 20 and event_type = 'purchase' then 1 end) / (count(case when value > 20 then 1 end) + count(case when event_type = 'purchase' then 1 end)), 6) as f1 from events")
def score_selection(t: Tables):
    """Selections above a value against the events that are purchases."""
    r = Q.precision_recall(t.events.filter("value > 20").select("event_id"), t.events.filter("event_type = 'purchase'").select("event_id"), ["event_id"])
    return r.select("hit", "found", "gold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


@query("with f as (select distinct conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) as name from conversations), g as (select distinct conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) as name from conversations), h as (select count(*) as hit from (select * from f intersect select * from g)) select hit, (select count(*) from f) as found, (select count(*) from g) as gold, round(2 * hit / ((select count(*) from f) + (select count(*) from g)), 6) as f1 from h")
def ner_evaluate(t: Tables):
    """Names found against the longer ones, as micro F1."""
    names = lambda p: t.conversations.select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("name"))
    return Q.precision_recall(names("[A-Z][a-z]+"), names("[A-Z][a-z]{3,}"), ["conv_id", "turn", "name"]).select("hit", "found", "gold", F.round("f1", 6).alias("f1"))


# ----------------------------------------------------------------- plans
_WORDS = "len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> ''))"


@query(f"select conv_id, turn, round(case when trim(text) = '' then 0 when {_WORDS} <= 2 then case when contains(text, '?') or regexp_matches(lower(text), '^(what|who|when|where|why|how|which)') then 0.6 else 0.1 end else 0.2 + 0.8 * len(list_distinct(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> ''))) / {_WORDS} end, 6)::double as entropy from conversations")
def query_entropy(t: Tables):
    return t.conversations.select("conv_id", "turn", F.round(P.query_entropy(F.col("text")), 6).alias("entropy"))


@query(f"select conv_id, turn, case when {_WORDS} >= 12 or contains(text, ',') or regexp_matches(lower(text), '\\b(and|but)\\b') then 'complex' else 'simple' end as complexity from conversations")
def assess_complexity(t: Tables):
    return t.conversations.select("conv_id", "turn", P.complexity(F.col("text")).alias("complexity"))


@query("select conv_id, turn, array_to_string(list_filter(list_distinct(regexp_split_to_array(text, '[^\\p{L}]+')), lambda w: regexp_full_match(w, '[A-Z][a-z]+') and w not in ('What', 'Who', 'When', 'Where', 'Why', 'How', 'Which', 'The')).list_sort(), ',') as hints from conversations")
def extract_entity_hints(t: Tables):
    return t.conversations.select("conv_id", "turn", F.array_join(F.array_sort(P.entity_hints(F.col("text"))), ",").alias("hints"))


_EXPANDED = (("Where did {} move after May?", "original,who:{},what:{},who:May"), ("what is it", "original"), ("{}'s car and its price today", "original,who:{}'s,what:{}'s,temporal-recent"))


def _filled(text: str) -> str:
    """A template as SQL, with the customer's name in it."""
    return "'" + text.replace("'", "''").replace("{}", "' || c_name || '") + "'"


@query("select c_custkey as id, " + ", ".join(f"case c_custkey % 3 {' '.join(f'when {i} then {_filled(r[c])}' for i, r in enumerate(_EXPANDED))} end as {name}" for c, name in enumerate(("question", "kinds"))) + " from customer")
def expand_queries(t: Tables):
    """Variants of a question about each customer."""

    @F.pandas_udf("string")
    def kinds(questions: pd.Series) -> pd.Series:
        return questions.map(lambda q: None if q is None else ",".join(v.kind for v in P.expand(q)))

    parts = [q.split("{}") for q, _ in _EXPANDED]
    texts = [F.lit(p[0]) if len(p) == 1 else F.concat(F.lit(p[0]), "c_name", F.lit(p[1])) for p in parts]
    q = F.element_at(F.array(*texts), (F.col("c_custkey") % 3 + 1).cast("int"))
    return t.customer.select(F.col("c_custkey").alias("id"), q.alias("question")).withColumn("kinds", kinds("question"))


_GATES = (("what did Ada say", None, False, True), ("ls", None, False, False), ("deploy it", "capture", False, False), ("who is Ada", None, True, False))


@query("select * from (values " + ", ".join(f"('{q}', {str(r).lower()})" for q, _, _, r in _GATES) + ") v(question, retrieve)")
def should_retrieve(t: Tables):
    rows = [(q, P.should_retrieve(q, host=h, held=w)) for q, h, w, _ in _GATES]
    return t.spark.createDataFrame(rows, "question string, retrieve boolean")


_ERRORS = (("0 entities found", "bandit_retrieval", 0.6), ("cascade exhausted", "direct_lookup", 0.0), ("something else", "bandit_retrieval", 0.56))


@query("select * from (values " + ", ".join(f"('{e}', '{a}', {c}::double)" for e, a, c in _ERRORS) + ") v(error, action, confidence)")
def replan_with_context(t: Tables):
    plans = [(e, P.replan_with_context(P.Plan("direct_lookup"), e)) for e, _, _ in _ERRORS]
    return t.spark.createDataFrame([(e, p.action, float(round(p.confidence, 6))) for e, p in plans], "error string, action string, confidence double")


@query("""select c_custkey as id, case when c_custkey % 2 = 0 then 'how is ' || c_name || ' linked to ' || n_name else 'what happened yesterday' end as question,
case when c_custkey % 2 = 0 then 'What is related to ' || c_name || '?' else 'What changed since then?' end as suggestion from customer join nation on n_nationkey = c_nationkey""")
def generate_suggestions(t: Tables):
    """The first follow-up question to one about each customer: of the customer and the nation, or of a time."""

    @F.pandas_udf("string")
    def first(questions: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([Q.suggestions(q, P.plan(q).action, list(n))[0] for q, n in zip(questions, names, strict=True)])

    both = F.col("c_custkey") % 2 == 0
    question = F.when(both, F.concat(F.lit("how is "), "c_name", F.lit(" linked to "), "n_name")).otherwise("what happened yesterday")
    j = t.customer.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey")).filter(F.col("c_name").isNotNull() & F.col("n_name").isNotNull())
    asked = j.select(F.col("c_custkey").alias("id"), question.alias("question"), F.when(both, F.array("c_name", "n_name")).otherwise(F.array().cast("array<string>")).alias("names"))
    return asked.select("id", "question", first("question", "names").alias("suggestion"))
