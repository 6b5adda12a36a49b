"""Whole pipelines and what older versions of a memory system did: ingest, governed retrieval, captures, terms, labels, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import answers as A
from ..operators import graph as G
from ..operators import hooks as H
from ..operators import ingest as I
from ..operators import policy as P
from ..operators import store as K
from ..operators import text as X
from ..registry import query, text_list
from ..sources.memory import memory_views as V
from ..sources.tables import Tables, with_views

E, T, ET = with_views("entities"), with_views("triples"), with_views("entities", "triples")
_COS = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform({0}, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform({1}, lambda x: x::double * x::double))))"
_TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_LEX = "list_filter(list_transform(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\p{L}\\p{N}:.$''-]+'), lambda t: regexp_replace(regexp_replace(t, '''s$', ''), '^[.''-]+|[.''-]+$', '', 'g')), lambda t: t <> '')"


def _re(p):
    return p.replace("'", "''")


_PII = f"(regexp_matches(text, '{_re(S.EMAIL)}') or regexp_matches(text, '{_re(S.SSN)}') or regexp_matches(text, '{_re(S.CARD)}'))"
_WORDS = f"len(list_filter({_TOK}, lambda w: not list_contains({text_list(I.STOPWORDS)}, w)))"
_TIER = f"case when regexp_matches(text, '{_re(S.MARKER)}') then 1 when sim >= 0.85 then 4 when sim < 0.4 or len(list_distinct({_TOK})) / greatest(len({_TOK}), 1) > 0.7 then 2 else 3 end"
_FAST = f"with f as (select text, min(doc_id) as id from documents group by text), g as (select id, text, (id % 100) / 100.0::double as sim from f), k as (select *, case when {_PII} then 'pii' when {_WORDS} < 3 then 'short' when sim > 0.95 then 'duplicate' else 'ok' end as gate from g)"


# ----------------------------------------------------------------- ingest
@query(_FAST + f" select gate, case when gate = 'ok' then {_TIER} end as tier, count(*) as n from k group by 1, 2")
def ingest_fast(t: Tables):
    """The quick path: equal texts once, gates, tiers."""
    return I.fast_path(t.documents, F.col("doc_id") % 100 / 100.0).groupBy("gate", "tier").agg(F.count("*").alias("n"))


@query(_FAST + " select gate, id from k where gate <> 'ok'")
def should_ingest(t: Tables):
    """What the gate keeps out, and why."""
    return I.fast_path(t.documents, F.col("doc_id") % 100 / 100.0).filter("gate <> 'ok'").select("gate", "id")


_SAID = "(select conv_id * 1000 + turn as id, 'Ada Byron ' || ['works at', 'uses', 'manages'][(conv_id + turn) % 3 + 1] || ' Engine House. ' || text as text from conversations)"


@query(f"select 'entities' as stage, count(distinct name) as n from (select unnest(regexp_extract_all(text, '([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)*)', 1)) as name from {_SAID} where not {_PII}) union all select 'triples', count(*) from {_SAID} where not {_PII} union all select 'accepted', count(*) from {_SAID} where not {_PII} union all select 'refused', count(*) from {_SAID} where {_PII}")
def ingest(t: Tables):
    """The slow path over every turn: gate, names, stated relations, routing."""
    verb = F.element_at(F.array(*[F.lit(v) for v in ("works at", "uses", "manages")]), ((F.col("conv_id") + F.col("turn")) % 3 + 1).cast("int"))
    docs = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("Ada Byron "), verb, F.lit(" Engine House. "), "text").alias("text"))
    s = I.slow_path(docs, "id", "text")
    one = lambda name, df, c=None: df.agg((F.count_distinct(c) if c else F.count("*")).alias("n")).select(F.lit(name).alias("stage"), "n")
    return one("entities", s["entities"], "name").unionByName(one("triples", s["triples"])).unionByName(one("accepted", s["accepted"])).unionByName(one("refused", s["refused"]))


@query("select doc_id as id, len(regexp_extract_all(text, '[A-Z][a-z]{4,}')) as spans from documents where len(regexp_extract_all(text, '[A-Z][a-z]{4,}')) > 0")
def extract_with_model(t: Tables):
    """A plugged-in extractor over all documents; here a pattern stands in for a model."""

    def extractor(texts):
        import re

        return [[(m.start(), len(m[0]), "name", 0.9) for m in re.finditer("[A-Z][a-z]{4,}", x)] for x in texts]

    return H.extract(t.documents, "doc_id", "text", extractor).groupBy(F.col("doc").alias("id")).agg(F.count("*").alias("spans"))


@query("select conv_id as query_id, count(*) || ' chunks' as answer from conversations group by 1")
def answer_backend(t: Tables):
    """A plugged-in backend over each conversation's turns."""
    g = t.conversations.select(F.col("conv_id").alias("query_id"), F.lit("what").alias("question"), F.col("turn").alias("n"), F.col("text").alias("chunk"))
    return H.answer(g, lambda question, chunks: f"{len(chunks)} chunks")


@query("select doc_id as id, length(text) as chars, 2 as dim from documents")
def embed_batch(t: Tables):
    """A plugged-in embedder, a batch at a time."""
    e = H.embed(t.documents, "doc_id", "text", lambda texts: [[float(len(x)), 1.0] for x in texts])
    return e.select("id", F.col("embedding")[0].cast("long").alias("chars"), F.size("embedding").alias("dim"))


@query("select count(distinct text) as vectors, 384 as dim, 1.0::double as norm from documents")
def hash_embed(t: Tables):
    """Vectors from hashes: as many as there are different texts, of unit length."""
    v = t.documents.select(H.hash_embedding(F.col("text")).alias("v"))
    return v.agg(F.count_distinct("v").alias("vectors"), F.max(F.size("v")).alias("dim"), F.round(F.avg(S.norm(F.col("v"))), 6).alias("norm"))


# ----------------------------------------------------------------- captures
_SRC = "case doc_id % 3 when 0 then 'clipboard' when 1 then 'shell' else 'browser' end"


@query(f"select source, count(*) as n from (select {_SRC} as source, text, row_number() over (partition by {_SRC}, text order by doc_id) as k from documents) where k = 1 and strlen(text) > 0 group by 1")
def clipboard_loop(t: Tables):
    """What a polling source takes: each text once for a source, empty ones not."""
    source = F.when(F.col("doc_id") % 3 == 0, "clipboard").when(F.col("doc_id") % 3 == 1, "shell").otherwise("browser")
    return t.documents.filter(F.octet_length("text") > 0).select(source.alias("source"), "text").distinct().groupBy("source").agg(F.count("*").alias("n"))


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n <= 20 and event_type not in ('error')")
def history_loop(t: Tables):
    """The last twenty lines of each history, without trivial ones."""
    return K.newest_each(t.events, ["user_id"], 20, F.desc("ts"), F.desc("event_id")).filter("event_type <> 'error'").select("user_id", "event_id")


@query("select page_id, url || ' ' || regexp_extract(html, '<title>([^<]*)</title>', 1) as text, strlen(html) <= 1048576 as accepted from pages")
def handle_capture(t: Tables):
    """A captured page as text; bodies over a mebibyte are refused."""
    return t.pages.select("page_id", F.concat_ws(" ", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("text"), (F.octet_length("html") <= 1048576).alias("accepted"))


@query("select * from (values ('clipboard', 60, 30), ('shell', 120, 60), ('notes', 30, 15), ('screenshot', 12, 6), ('browser', 60, 30), ('audio', 30, 15), ('calendar', 6, 3), ('other', 30, 15)) v(source, per_minute, burst)")
def rate_limits(t: Tables):
    return t.spark.createDataFrame([(s, a, b) for s, (a, b) in I.LIMITS.items()], "source string, per_minute int, burst int")


# ----------------------------------------------------------------- terms and labels
@query(f"select doc_id, len({_LEX}) as n, {_LEX}[1] as first from documents")
def tokenize(t: Tables):
    x = S.lexical_tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(x).alias("n"), F.get(x, 0).alias("first"))


_BM = f"""with d as (select doc_id as id, {_LEX} as t from documents), e as (select * from d where len(t) > 0), st as (select count(*) as n, avg(len(t)) as avgdl from e),
tf as (select id, len, term, count(*) as tf from (select id, len(t) as len, unnest(t) as term from e) where term in ('und', 'der') group by 1, 2, 3), df as (select term, count(*) as df from tf group by 1),
s as (select id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avgdl)) * case term when 'und' then 2 else 1 end) as score from tf join df using (term), st group by 1)"""


def _bm25(t: Tables):
    return X.bm25(t.documents, "doc_id", "text", t.spark.createDataFrame([(1, "und der und")], "query_id int, query string"))


@query(_BM + " select id, round(score, 6) as score from s")
def raw_score(t: Tables):
    """Repeated words of a question count again."""
    return _bm25(t).select("id", F.round("score", 6).alias("score"))


@query(_BM + " select id, round(score / (select max(score) from s), 6) as score from s")
def normalised_scores(t: Tables):
    s = G.checkpointed(_bm25(t))
    return s.join(F.broadcast(s.agg(F.max("score").alias("best")))).select("id", F.round(F.col("score") / F.col("best"), 6).alias("score"))


@query("select verb, text, lexical, recency, confidence, count(*) as n from events join (values " + ", ".join(f"({i}, '{v}', {w['text']}::double, {w['lexical']}::double, {w['recency']}::double, {w['confidence']}::double)" for i, (v, w) in enumerate(P.VERBS.items())) + f") v(i, verb, text, lexical, recency, confidence) on user_id % {len(P.VERBS)} = i group by all")
def default_verb_weights(t: Tables):
    """The weights that each logged question's verb has by default, and how many questions have that verb."""
    verb = F.element_at(F.array(*[F.lit(v) for v in P.VERBS]), (F.col("user_id") % len(P.VERBS) + 1).cast("int"))
    asked = t.events.select(verb.alias("verb")).groupBy("verb").agg(F.count("*").alias("n"))
    rows = [(v, w["text"], w["lexical"], w["recency"], w["confidence"]) for v, w in P.VERBS.items()]
    weights = t.spark.createDataFrame(rows, "verb string, text double, lexical double, recency double, confidence double")
    return weights.join(asked, "verb")


_OK = "(length({0}) >= 3 and not list_contains(" + text_list(X.STOPWORDS) + ", {0}) and not regexp_full_match({0}, '[0-9]+'))"


@query(f"select item_id as id, len(list_filter(t, lambda w: {_OK.format('w')})) + len(list_filter(range(1, len(t)), lambda i: {_OK.format('t[i]')} and {_OK.format('t[i+1]')})) as terms from (select item_id, {_TOK} as t from benchmark)")
def extend_tokens(t: Tables):
    """Words and pairs of words that may be a label."""
    return t.benchmark.select(F.col("item_id").alias("id"), F.size(X.label_terms(F.col("text"))).alias("terms"))


@query("select label as community_id, case when label % 2 = 0 then 'even ' || label else 'c' || label end as label, count(*) as size from embeddings group by 1, 2")
def community_label_map(t: Tables):
    """Labels as last set, with sizes."""
    c = t.embeddings.groupBy(F.col("label").alias("community_id")).agg(F.count("*").alias("size"))
    log = c.select("community_id", F.concat(F.lit("c"), F.col("community_id").cast("string")).alias("label"), F.lit(1).alias("seq"))
    log = log.unionByName(c.filter("community_id % 2 = 0").select("community_id", F.concat(F.lit("even "), F.col("community_id").cast("string")).alias("label"), F.lit(2).alias("seq")))
    return K.current(log, ["community_id"]).drop("seq").join(c, "community_id", "left")


@query("select lang as category, count(*) as n, round(avg(n_chars), 6) as mean from documents where lang is not null group by 1 union all select 'all', count(*), round(avg(n_chars), 6) from documents")
def results_report(t: Tables):
    by = t.documents.filter("lang is not null").groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))
    return by.unionByName(t.documents.agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean")).select(F.lit("all").alias("category"), "n", "mean"))


@query(E + "select id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug from entities")
def export_slug(t: Tables):
    return t.entities.select("id", S.slug(F.col("name")).alias("slug"))


@query(E + "select entity_type, count(distinct p) as prints from (select entity_type, (select case when length(y) < 3 then '' else y end from (select case when regexp_matches(x, '[^s]s$') then x[:-2] else x end as y from (select regexp_replace(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' s$', '') as x))) as p from entities) group by 1")
def entity_fingerprint(t: Tables):
    return t.entities.groupBy("entity_type").agg(F.count_distinct(S.fingerprint(F.col("name"))).alias("prints"))


@query("select conv_id, turn, case when regexp_matches(lower(text), '\\b(fail|failed|missed|broke|late)\\b') then -1 when regexp_matches(lower(text), '\\b(done|kept|finished|shipped)\\b') then 1 else 0 end as polarity from (select conv_id, turn, text || ['', ' we shipped', ' it failed'][turn % 3 + 1] as text from conversations)")
def sniff_polarity(t: Tables):
    end = F.element_at(F.array(F.lit(""), F.lit(" we shipped"), F.lit(" it failed")), (F.col("turn") % 3 + 1).cast("int"))
    return t.conversations.select("conv_id", "turn", S.polarity_of(F.concat("text", end)).alias("polarity"))


@query("select conv_id, turn, regexp_matches(lower(text), '\\b(today|yesterday|recently|last|ago|this (week|month|year))\\b') as temporal from (select conv_id, turn, text || ['', ' yesterday', ' this week'][turn % 3 + 1] as text from conversations)")
def has_temporal_intent(t: Tables):
    end = F.element_at(F.array(F.lit(""), F.lit(" yesterday"), F.lit(" this week")), (F.col("turn") % 3 + 1).cast("int"))
    return t.conversations.select("conv_id", "turn", F.lower(F.concat("text", end)).rlike("\\b(today|yesterday|recently|last|ago|this (week|month|year))\\b").alias("temporal"))


# ----------------------------------------------------------------- named end points
@query(T.replace("with ", "with recursive ", 1) + """, e as (select subject_id as a, object_id as b, confidence as c from triples where confidence >= 0.1), s as (select 'c' || c_custkey as id from customer where c_name = 'Customer#000000007'), d as (select 'n' || n_nationkey as id from nation where n_name = 'NATION_3'),
w(path, node, score, hops) as (select [a, b], b, c, 1 from e where a in (select id from s) union all select list_append(path, b), b, score * c * 0.85, hops + 1 from w join e on e.a = w.node where hops < 4 and w.node not in (select id from d) and not list_contains(path, b))
select array_to_string(path, '>') as path, round(score, 9) as score from w where node in (select id from d) order by score desc, array_to_string(path, '>') limit 10""")
def reason_chain(t: Tables):
    """Chains between two entities that are named."""
    one = lambda n: (K.newest(K.point(t.entities, "name", n), 1, "id").first() or {"id": ""})["id"]
    return G.chains(t.triples, one("Customer#000000007"), one("NATION_3")).select("path", F.round("score", 9).alias("score"))


# ----------------------------------------------------------------- governed and older retrieval
@query(f"""with q as (select embedding as q from embeddings where vec_id = 0), top as (select vec_id from embeddings, q where vec_id <> 0 order by {_COS.format('embedding', 'q')} desc, vec_id limit 3) select vec_id as id from embeddings where label in (select label from embeddings where vec_id in (select vec_id from top))""")
def expand_by_cluster(t: Tables):
    """All members of the clusters that the three nearest rows are of."""
    q = F.broadcast(K.point(t.embeddings, "vec_id", 0).select(F.col("embedding").alias("q")))
    top = t.embeddings.join(q).filter("vec_id <> 0").orderBy(F.desc(S.cosine(F.col("embedding"), F.col("q"))), "vec_id").limit(3)
    return t.embeddings.join(top.select("label").distinct(), "label", "left_semi").select(F.col("vec_id").alias("id"))


@query("select d.doc_id as id, d.source from documents d where d.source in (select source from documents where doc_id % 10 = 0) and d.doc_id % 4 < 3")
def acl_filter(t: Tables):
    """What a reader may see: sources that are granted, levels up to the reader's."""
    grants = t.documents.filter("doc_id % 10 = 0").select("source").distinct()
    return A.allowed(t.documents.withColumn("level", F.col("doc_id") % 4), grants, "source", 2).select(F.col("doc_id").alias("id"), "source")


@query("select source, count(*) as reads, sum(case when doc_id % 4 < 3 then 1 else 0 end)::bigint as granted from documents group by 1")
def audit_log(t: Tables):
    return t.documents.groupBy("source").agg(F.count("*").alias("reads"), F.count_if(F.col("doc_id") % 4 < 3).alias("granted"))


@query(V("feedback") + "select result_id as id, round(0.5 + 0.5 * least(greatest(avg(weight), -1), 1), 6) as score from feedback group by 1 order by 2 desc, 1 limit 20")
def feedback_rerank(t: Tables):
    """Results by the mean of what was said of them."""
    m = t.view("feedback").groupBy(F.col("result_id").alias("id")).agg(F.avg("weight").alias("w"))
    s = m.select("id", F.round(0.5 + 0.5 * F.least(F.greatest(F.col("w"), F.lit(-1.0)), F.lit(1.0)), 6).alias("score"))
    return s.orderBy(F.desc("score"), "id").limit(20)


@query(ET + f""", q as (select embedding as q from embeddings where vec_id = 0), v as (select 'p' || vec_id as id, 1 as step from (select vec_id from embeddings, q order by {_COS.format('embedding', 'q')} desc, vec_id limit 3)),
k as (select id, 2 as step from entities where lower(name) = 'blue bolt'), h as (select object_id as id, 3 as step from triples where subject_id in (select id from v))
select id, min(step) as step from (select * from v union all select * from k union all select * from h) where id in (select id from entities where k % 7 <> 0) group by 1""")
def layered_retrieve(t: Tables):
    """Nearest vectors, then names, then one edge on, then only what the reader may see."""
    q = F.broadcast(K.point(t.embeddings, "vec_id", 0).select(F.col("embedding").alias("q")))
    near = t.embeddings.join(q).orderBy(F.desc(S.cosine(F.col("embedding"), F.col("q"))), "vec_id").limit(3).select(F.concat(F.lit("p"), "vec_id").alias("id"))
    named = t.entities.filter(F.lower("name") == "blue bolt").select("id")
    onward = t.triples.join(F.broadcast(near.withColumnRenamed("id", "subject_id")), "subject_id").select(F.col("object_id").alias("id"))
    step = lambda df, n: df.select("id", F.lit(n).alias("step"))
    found = step(near, 1).unionByName(step(named, 2)).unionByName(step(onward, 3)).groupBy("id").agg(F.min("step").alias("step"))
    return found.join(t.entities.filter("k % 7 <> 0").select("id"), "id", "left_semi")


@query(E + "select id from entities where k % 11 <> 0")
def forget(t: Tables):
    """Tombstones: what is forgotten stays in the log and leaves the state."""
    log = t.entities.select("id", F.lit(1).alias("seq"), F.lit(False).alias("deleted"))
    stones = t.entities.filter("k % 11 = 0").select("id", F.lit(2).alias("seq"), F.lit(True).alias("deleted"))
    return K.current(log.unionByName(stones), ["id"]).select("id")


@query("select count(*) as cases, sum(case when expected <> initial then 1 else 0 end)::bigint as changed from (values ('Oslo', 'Turin'), ('Tuesday', 'Thursday'), ('Jon', 'Rosa')) v(initial, expected)")
def mini_fixtures(t: Tables):
    """Three facts that are contradicted, as rows."""
    from ..sources.readers import mini_fixtures as rows

    c = rows(t.spark)
    return c.agg(F.count("*").alias("cases"), F.count_if(~F.col("fact").contains(F.col("expected"))).alias("changed"))


@query(T + "select subject_id, object_id from triples where predicate = 'part_of' union select subject_id, object_id from triples where predicate = 'located_in' and confidence >= 0.5")
def union_ordered(t: Tables):
    """Two lists as one, each row at its first place."""
    a = t.triples.filter("predicate = 'part_of'").select("subject_id", "object_id", F.lit(0).alias("side"))
    b = t.triples.filter("predicate = 'located_in' and confidence >= 0.5").select("subject_id", "object_id", F.lit(1).alias("side"))
    first = a.unionByName(b).groupBy("subject_id", "object_id").agg(F.min("side").alias("side"))
    return first.orderBy("side", "subject_id", "object_id").select("subject_id", "object_id")


@query(ET + "select e.id, e.name, t.object_id as nation from entities e join triples t on t.subject_id = e.id and t.predicate = 'located_in' where t.object_id in ('n1', 'n2')")
def induced_members(t: Tables):
    """Entities by membership, as a join on keys in place of a search in text."""
    near = t.triples.filter("predicate = 'located_in'").filter(F.col("object_id").isin("n1", "n2")).select(F.col("subject_id").alias("id"), F.col("object_id").alias("nation"))
    return t.entities.select("id", "name").join(near, "id")


@query("select r.r_name, count(*) as members from region r join nation n on n.n_regionkey = r.r_regionkey join customer c on c.c_nationkey = n.n_nationkey group by 1")
def context_members(t: Tables):
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.count("*").alias("members"))
