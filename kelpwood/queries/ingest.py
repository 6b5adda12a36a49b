"""Queries of ingest, answer and learning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import answers as A
from ..operators import ingest as I
from ..operators import learning as L
from ..registry import query, text_list
from ..sources.tables import Tables, with_views

#: Openings and dues that are put around the turns of a conversation, which have none of their own.
_OPEN = ("I'll ", "todo: ", "well, I will ", "let me ", "no plan: ", "I promise to ", "remind me to ", "I'm going to ")
_DUE = (" by 2026-06-01", " tomorrow", " this week", " in 3 days", "", " by friday", " next monday", " in 2 weeks")
_SAID_SQL = f"""select conv_id, turn, {text_list(_OPEN)}[(conv_id + turn) % 8 + 1] || substr(text, 1, 1) || {text_list(_DUE)}[(conv_id + 3 * turn) % 8 + 1] || ' ' || text as text from conversations"""


def _said(t: Tables):
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % 8 + 1).cast("int"))
    c = t.conversations
    text = F.concat(pick(_OPEN, F.col("conv_id") + F.col("turn")), F.substring("text", 1, 1), pick(_DUE, F.col("conv_id") + 3 * F.col("turn")), F.lit(" "), F.col("text"))
    return c.select("conv_id", "turn", text.alias("text"))


def _commitment_sql() -> str:
    day = "date '2024-05-15'"  # a Wednesday
    until = lambda i: f"({day} + cast((({i} - (isodow({day}) - 1) + 7) % 7) as int))"
    q = lambda x: x.replace("'", "''")
    pattern = "case " + " ".join(f"when starts_with(low, '{q(p)}') then '{n}'" for p, n in I.PREFIXES) + " " + " ".join(f"when contains(low, '{q(p)}') then '{n}'" for p, n in I.INFIXES) + " end"
    due = f"case when regexp_matches(low, '(by|on|before) \\d{{4}}-\\d{{2}}-\\d{{2}}') then try_cast(regexp_extract(low, '(?:by|on|before) (\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) as date) "
    due += f"when regexp_matches(low, 'tonight|today') then {day} when contains(low, 'tomorrow') then {day} + 1 when regexp_matches(low, 'this week|eow|end of week') then {until(4)} "
    due += f"when regexp_matches(low, 'in \\d+ day') then {day} + cast(regexp_extract(low, 'in (\\d+) day', 1) as int) when regexp_matches(low, 'in \\d+ week') then {day} + 7 * cast(regexp_extract(low, 'in (\\d+) week', 1) as int) "
    for word in ("by", "next", "this"):
        for i, name in enumerate(I.WEEKDAYS):
            due += f"when contains(low, '{word} {name}') then {until(i)}" + (f" + case when {until(i)} - {day} < 7 then 7 else 0 end " if word == "next" else " ")
    base = "case when ends_with(pattern, '_mid') then 0.6 else 0.8 end"
    return f"""with s as ({_SAID_SQL}), l as (select conv_id, turn, lower(trim(text)) as low from s), p as (select *, {pattern} as pattern, {due} end as due from l)
select conv_id, turn, pattern, cast(due as varchar) as due, round(case when due is null then {base} else least({base} + 0.1, 0.95) end, 6)::double as confidence from p where pattern is not null"""


@query(_commitment_sql())
def detect_commitments(t: Tables):
    c = _said(t).select("conv_id", "turn", I.commitment(F.col("text"), F.lit("2024-05-15").cast("date")).alias("c")).filter("c is not null")
    return c.select("conv_id", "turn", "c.confidence", "c.pattern", F.col("c.due").cast("string").alias("due"))


_W = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


def _re(p):
    return p.replace("'", "''")


@query(f"""select doc_id, case when regexp_matches(text, '{_re(S.EMAIL)}') or regexp_matches(text, '{_re(S.SSN)}') or regexp_matches(text, '{_re(S.CARD)}') then 'pii'
when len(list_filter({_W}, lambda w: not list_contains({list(I.STOPWORDS)}, w))) < 3 then 'short' when (doc_id % 100) / 100.0 > 0.95 then 'duplicate' else 'ok' end as gate from documents""")
def ingest_gate(t: Tables):
    return t.documents.select("doc_id", I.gate(F.col("text"), F.col("doc_id") % 100 / 100.0).alias("gate"))


@query(f"""select tier, count(*) as n from (select case when regexp_matches(text, '{_re(S.MARKER)}') then 1 when s >= 0.85 then 4 when s < 0.4 or len(list_distinct(w)) / greatest(len(w), 1) > 0.7 then 2 else 3 end as tier from (select text, (doc_id % 100) / 100.0 as s, {_W} as w from documents)) group by 1""")
def classify_signal(t: Tables):
    return t.documents.groupBy(I.signal_tier(F.col("text"), F.col("doc_id") % 100 / 100.0).alias("tier")).agg(F.count("*").alias("n"))


@query("select op, count(*) as n from (select case when s < 0.4 then 'add' when s > 0.9 and same_name then case when same_type then 'noop' else 'update' end when s > 0.75 and same_name then 'update' else 'add' end as op from (select (event_id % 101) / 100.0 as s, event_id % 2 = 0 as same_name, event_id % 3 = 0 as same_type from events)) group by 1")
def decide_memory_op(t: Tables):
    e = t.events.select(S.memory_op(F.col("event_id") % 101 / 100.0, F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0).alias("op"))
    return e.groupBy("op").agg(F.count("*").alias("n"))


_FACTS = " ".join(f"when {i} then 'Ada Byron {verb} Engine House'" for i, (verb, _) in enumerate(I.RELATIONS))


@query(f"""with s as (select conv_id, turn, case (conv_id + turn) % {len(I.RELATIONS)} {_FACTS} end || '. ' || substr(text, 1, 0) as said from conversations)
select conv_id * 1000 + turn as id, 'Ada Byron' as subject, {[p for _, p in I.RELATIONS]}[(conv_id + turn) % {len(I.RELATIONS)} + 1] as predicate, 'Engine House' as object from s""")
def extract_triples(t: Tables):
    """Every turn of every conversation, each behind a sentence that states a relation."""
    verbs = F.array(*[F.lit(v) for v, _ in I.RELATIONS])
    verb = F.element_at(verbs, ((F.col("conv_id") + F.col("turn")) % len(I.RELATIONS) + 1).cast("int"))
    said = F.concat(F.lit("Ada Byron "), verb, F.lit(" Engine House. "), "text")
    docs = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), said.alias("text"))
    return I.triples_in(docs, "id", "text").select("id", "subject", "predicate", "object")


@query("select conv_id, turn, list_distinct(regexp_extract_all(text, '([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)*)', 1)) .list_sort() as names from conversations")
def extract_entities(t: Tables):
    return t.conversations.select("conv_id", "turn", F.array_sort(I.capitalised(F.col("text"))).alias("names"))


@query(with_views("entities") + "select 'note-2024-01-05' as subject_id, 'related_to' as predicate, id as object_id from entities where created_at::date = date '2024-01-05' and id <> 'c4'")
def daily_note(t: Tables):
    have = t.spark.createDataFrame([("note-2024-01-05", "related_to", "c4")], "subject_id string, predicate string, object_id string")
    return I.daily_note(t.entities, have, "2024-01-05")


@query(f"""with w as (select item_id, list_distinct({_W}) as x from benchmark), p as (select a.item_id as a, b.item_id as b, 2 * len(list_intersect(a.x, b.x)) / (len(a.x) + len(b.x)) as d from w a join w b on b.item_id = a.item_id + 1)
select a, b, round(d, 6) as dice, d between 0.3 and 0.8 as possible from p""")
def contradiction_summary(t: Tables):
    n = t.benchmark.select(F.col("item_id").alias("a"), F.col("text").alias("ta")).join(t.benchmark.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.col("text").alias("tb")), "a")
    return n.select("a", "b", F.round(A.dice(F.col("ta"), F.col("tb")), 6).alias("dice"), A.possible_contradiction(F.col("ta"), F.col("tb")).alias("possible"))


@query("select user_id, case when max(value) / 400 >= 0.35 then 'found' when count(*) > 66 then 'uncertain' else 'not_stored' end as class from events group by 1")
def classify_grounding(t: Tables):
    return t.events.groupBy("user_id").agg(A.grounding(F.max("value") / 400, F.greatest(F.count("*") - 66, F.lit(0))).alias("class"))


@query("""select event_id, round(case when event_id % 50 = 0 then 1.0 else least(1.0, greatest(0.0, (0.534 * v + case when r is null then 0.0 else 0.311 * r end + 0.155 * c) / (0.534 + case when r is null then 0.0 else 0.311 end + 0.155))) end, 6) as score
from (select event_id, least(value / 100, 1.0) as v, case when event_id % 4 = 0 then null else pow(2.0, -(event_id % 30) / 7) end as r, (event_id % 10) / 10.0::double as c from events)""")
def composed_score(t: Tables):
    e = t.events
    spaces = {"similarity": F.least(F.col("value") / 100, F.lit(1.0)), "recency": F.when(F.col("event_id") % 4 != 0, S.half_life(F.col("event_id") % 30, 7.0)), "confidence": F.col("event_id") % 10 / 10.0}
    return e.select("event_id", F.round(A.space_score(spaces, {"similarity": 0.534, "recency": 0.311, "confidence": 0.155}, F.col("event_id") % 50 == 0), 6).alias("score"))


@query("""with s as (select user_id % 7 as candidate, event_type as instance, max(value) as score from events group by 1, 2), b as (select instance, max(score) as best from s group by 1), p as (select candidate, count_if(score = best) as owned, avg(score) as mean from s join b using (instance) group by 1)
select candidate, owned, round(mean, 6) as mean, owned > 0 or mean >= (select max(mean) from p) - 1e-6 as kept from p""")
def policy_frontier(t: Tables):
    s = t.events.groupBy((F.col("user_id") % 7).alias("candidate"), F.col("event_type").alias("instance")).agg(F.max("value").alias("score"))
    return L.frontier(s).withColumn("mean", F.round("mean", 6))


@query("""with a as (select doc_id as id, (doc_id % 10) / 10.0::double as f0, 100.0::double as l0 from documents), b as (select doc_id as id, (doc_id % 9) / 9.0::double as f1, 120.0::double as latency from documents where doc_id % 17 <> 0)
select round(100 * (avg(f1) - avg(f0)), 6) as delta, count_if(f0 < 0.5 and f1 >= 0.5) as fixed, count_if(f0 >= 0.5 and f1 < 0.5) as broke, round(avg(latency) / avg(l0), 6) as slower, 100 * (avg(f1) - avg(f0)) >= -0.5 and avg(latency) / avg(l0) <= 1.5 as passes from a full join b using (id)""")
def policy_judge(t: Tables):
    d = t.documents
    a = d.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 10 / 10.0).alias("f1"), F.lit(100.0).alias("latency"))
    b = d.filter("doc_id % 17 <> 0").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 9 / 9.0).alias("f1"), F.lit(120.0).alias("latency"))
    return L.judge(a, b).withColumn("delta", F.round("delta", 6)).withColumn("slower", F.round("slower", 6))


@query()
def outcome_model(t: Tables):
    """A softmax model of polarity from stakes and statement, and its predictions."""
    done = t.commitments.join(t.outcomes, F.col("id") == F.col("commitment_id")).select("id", "stakes", "statement", F.col("polarity").cast("string").alias("polarity"))
    return L.SoftmaxModel().fit(done, ["stakes", "statement"], "polarity").transform(done)


@query("select min(doc_id) as label, count(*) as members, md5(text) as digest from documents group by text having count(*) > 1")
def consolidate_groups(t: Tables):
    """Documents with equal texts as one signal each."""
    same = t.documents.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("a"), F.count("*").alias("c")).filter("c > 1")
    links = t.documents.select(F.md5("text").alias("h"), F.col("doc_id").alias("b")).join(same, "h").filter("a <> b").select("a", "b")
    groups = I.consolidate_groups(t.documents.select(F.col("doc_id").alias("id"), "text"), links)
    return groups.select("label", "members", F.md5("text").alias("digest"))


@query("""with e as (select vec_id as key, case when vec_id % 2 = 0 then 'c' else 'p' end || vec_id as id, case when vec_id % 2 = 0 then c_name else p_name end as name, list_transform(embedding, lambda x: x::double) as v
  from embeddings left join customer on c_custkey = vec_id left join part on p_partkey = vec_id),
u as (select key, id, lower(name) as name, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as v from e where name is not null),
s as (select a.id as id, a.name as name, b.id as id2, b.name as name2, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) as score, b.key from u a join u b on a.key <> b.key),
t as (select * from s qualify row_number() over (partition by id order by score desc, key) <= 5),
l as (select distinct 'c' || o_custkey as a, 'p' || l_partkey as b from orders join lineitem on o_orderkey = l_orderkey),
p as (select least(id, id2) as a, greatest(id, id2) as b, least(name, name2) as n1, greatest(name, name2) as n2, round(score, 12) as score from t where score >= 0.3 and name <> name2)
select a, b, round(score, 6) as score from p anti join l using (a, b) qualify row_number() over (partition by n1, n2 order by score desc, a, b) = 1""")
def relation_suggestions(t: Tables):
    """Customers (even ids) and parts (odd ones) with the embeddings of their numbers; what a customer bought is linked."""
    even = F.col("vec_id") % 2 == 0
    e = t.embeddings.select("vec_id", "embedding").join(t.customer.select(F.col("c_custkey").alias("vec_id"), "c_name"), "vec_id", "left").join(t.part.select(F.col("p_partkey").alias("vec_id"), "p_name"), "vec_id", "left")
    e = e.select(F.col("vec_id").alias("key"), F.concat(F.when(even, "c").otherwise("p"), "vec_id").alias("id"), F.when(even, F.col("c_name")).otherwise(F.col("p_name")).alias("name"), F.col("embedding").alias("vector")).filter("name is not null")
    edges = t.triples.filter("predicate = 'bought'").select(F.col("subject_id").alias("a"), F.col("object_id").alias("b"))
    return I.relation_suggestions(e, edges, least=0.3).select("a", "b", F.round("score", 6).alias("score"))
