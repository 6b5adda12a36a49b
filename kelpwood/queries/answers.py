"""The answer layer: grounding, extractive answers by task, question kinds and short spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import ingest as I
from ..registry import query
from ..sources.tables import Tables, with_views

_TOK = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_ASK = "the tion of thand"
#: Sentences of all passages with their words in common with the question and a share of their chunk's score.
_SENT = f"""with c as (select item_id as id, text, (item_id % 10) / 10.0::double as score from benchmark),
s as (select id, score, i - 1 as pos, trim(x) as sentence from (select id, score, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) as x, generate_subscripts(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) as i from c) where trim(x) <> ''),
v as (select *, len(list_intersect({_TOK.format('sentence')}, {_TOK.format(repr(_ASK))})) as words from s) """


def _chunks(t: Tables):
    return t.benchmark.select(F.col("item_id").alias("id"), "text", (F.col("item_id") % 10 / 10.0).alias("score"))


@query(_SENT + "select id, sentence, words + 0.1 * score as value from v order by value desc, id, pos limit 1")
def short_answer(t: Tables):
    return A.short_answer(_chunks(t), _ASK)


@query(_SENT + "select id, sentence, words::double as value from (select *, row_number() over (partition by id order by words desc, pos) as n from v) where n = 1")
def structured_extract(t: Tables):
    """The best sentence of each chunk."""
    return A.best_sentences(_chunks(t), _ASK).withColumn("value", F.col("value").cast("double"))


@query(_SENT.replace("with c as", "with recursive c as", 1) + f""", o as (select sentence, {_TOK.format('sentence')} as w, row_number() over (order by words + 0.05 * score desc, id, pos) as n from v),
g(n, taken, seen) as (select 0::bigint, []::varchar[], []::varchar[] union all select g.n + 1,
  case when len(taken) < 3 and (len(taken) = 0 or (len(o.w) > 0 and 1 - len(list_filter(list_distinct(o.w), lambda x: list_contains(seen, x))) / len(list_distinct(o.w)) > 0.4)) then list_append(taken, o.sentence) else taken end,
  case when len(taken) < 3 and (len(taken) = 0 or (len(o.w) > 0 and 1 - len(list_filter(list_distinct(o.w), lambda x: list_contains(seen, x))) / len(list_distinct(o.w)) > 0.4)) then list_distinct(list_concat(seen, o.w)) else seen end
  from g join o on o.n = g.n + 1)
select array_to_string(taken, ' ') as answer from g order by n desc limit 1""")
def fused_synthesis(t: Tables):
    """Up to three of the best sentences, each of which says something new."""
    return A.greedy(_chunks(t), _ASK, 0.05, "novelty")


@query(_SENT.replace("with c as", "with recursive c as", 1) + f""", o as (select sentence, list_distinct({_TOK.format('sentence')}) as w, row_number() over (order by words + 0.1 * score desc, id, pos) as n from v),
g(n, taken, seen) as (select 0::bigint, []::varchar[], []::varchar[] union all select g.n + 1,
  case when len(taken) < 3 and len(list_filter(o.w, lambda x: not list_contains(seen, x))) > 2 then list_append(taken, o.sentence) else taken end,
  case when len(taken) < 3 and len(list_filter(o.w, lambda x: not list_contains(seen, x))) > 2 then list_concat(seen, list_filter(o.w, lambda x: not list_contains(seen, x))) else seen end from g join o on o.n = g.n + 1)
select array_to_string(taken, ' ') as answer from g order by n desc limit 1""")
def extractive_summary(t: Tables):
    """Up to three of the best sentences, each of which covers more than two new words."""
    return A.greedy(_chunks(t), _ASK, 0.1, "coverage")


@query(with_views("entities", "triples") + """, g as (select 1 as part, doc_id::varchar as k, text as chunk from (select * from documents order by doc_id desc limit 4)
 union all select 2, t.subject_id || t.predicate || t.object_id, s.name || ' ' || t.predicate || ' ' || o.name || '.' from triples t join entities s on s.id = subject_id join entities o on o.id = object_id where subject_id = 'p7'
 union all select 3, id, name || ' (' || entity_type || ')' from entities where id in ('c1', 'c2', 'c3'))
select row_number() over (order by part, k)::int as n, part, chunk from g order by part, k limit 12""")
def grounding_from(t: Tables):
    """The four newest signals, then edges as sentences with both names, then entities; twelve chunks at most."""
    signals = t.documents.orderBy(F.desc("doc_id")).limit(4).select(F.col("doc_id").cast("string").alias("k"), F.col("text").alias("chunk"))
    return A.grounding_chunks(signals, t.triples.filter("subject_id = 'p7'"), t.entities, t.entities.filter(F.col("id").isin("c1", "c2", "c3")), 12)


@query("select task, count(*) as n from (select case event_type when 'view' then 'short' when 'click' then 'synthesis' when 'error' then 'contradiction' when 'signup' then 'summary' else 'structured' end as task, user_id from events where user_id % 5 > 0 union all select 'abstain', user_id from events where user_id % 5 = 0) group by 1")
def synthesize_dispatch(t: Tables):
    """The strategy by task; without grounding the answer abstains."""
    task = A.strategy(F.col("event_type"), F.col("user_id") % 5, {"view": "short", "click": "synthesis", "error": "contradiction", "signup": "summary"})
    return t.events.groupBy(task.alias("task")).agg(F.count("*").alias("n"))


@query("select tier, count(*) as n from (select case when strlen(text) > 2000 then 'long' when doc_id % 7 = 0 then 'model' else 'extractive' end as tier from documents) group by 1")
def tiered_select(t: Tables):
    tier = F.when(F.octet_length("text") > 2000, "long").when(F.col("doc_id") % 7 == 0, "model").otherwise("extractive")
    return t.documents.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


# ----------------------------------------------------------------- questions and spans
_LEADS = ("did she go", "when was it", "how much is it", "how come", "at what time is it", "why so", "what is it about", "who came", "tell me")
_KIND = """case when regexp_matches(q, '^(did|does|do|is|are|was|were|has|have|had|will|can|could|should|would)( |$)') then 'yes_no' when regexp_matches(q, '^when( |$)') then 'date' when regexp_matches(q, '^how (much|many)( |$)') then 'money' when regexp_matches(q, '^how( |$)') then 'generic'
when regexp_matches(q, '(^| )\\?*time\\?*( |$)') then 'time' when regexp_matches(q, '^why( |$)') then 'reason' when regexp_matches(q, '(^| )\\?*about\\?*( |$)') then 'generic' when regexp_matches(q, '^(who|whom|where|what|which)( |$)') then 'named' else 'generic' end"""


@query(f"select kind, count(*) as n from (select {_KIND} as kind from (select {list(_LEADS)}[(conv_id + turn) % {len(_LEADS)} + 1] || ' ' || lower(regexp_replace(text, '\\s+', ' ', 'g')) as q from conversations)) group by 1")
def classify_question(t: Tables):
    """Every turn behind one of the openings of questions."""
    lead = F.element_at(F.array(*[F.lit(x) for x in _LEADS]), ((F.col("conv_id") + F.col("turn")) % len(_LEADS) + 1).cast("int"))
    q = F.concat(lead, F.lit(" "), F.lower(F.regexp_replace("text", "\\s+", " ")))
    return t.conversations.groupBy(A.question_kind(q).alias("kind")).agg(F.count("*").alias("n"))


_DATED = "text || case turn % 4 when 0 then ' on May 5, 2023 we met' when 1 then ' it was 2023-05-07 then' when 2 then ' in June 2021 or so' else ' no day' end || case conv_id % 3 when 0 then ' for $1,250.50 each' when 1 then ' at 30 dollars' else '' end"


def _dated(t: Tables):
    day = F.when(F.col("turn") % 4 == 0, " on May 5, 2023 we met").when(F.col("turn") % 4 == 1, " it was 2023-05-07 then").when(F.col("turn") % 4 == 2, " in June 2021 or so").otherwise(" no day")
    paid = F.when(F.col("conv_id") % 3 == 0, " for $1,250.50 each").when(F.col("conv_id") % 3 == 1, " at 30 dollars").otherwise("")
    return t.conversations.select("conv_id", "turn", F.concat("text", day, paid).alias("text"))


@query(f"select conv_id, turn, nullif(regexp_extract(t, '{A.DATE}', 0), '') as day from (select conv_id, turn, {_DATED} as t from conversations)")
def extract_date(t: Tables):
    return _dated(t).select("conv_id", "turn", A.date_in(F.col("text")).alias("day"))


@query(f"select conv_id, turn, nullif(regexp_extract(t, '{A.MONEY}', 0), '') as money from (select conv_id, turn, {_DATED} as t from conversations)".replace("{A.MONEY}", A.MONEY))
def extract_money(t: Tables):
    return _dated(t).select("conv_id", "turn", A.money_in(F.col("text")).alias("money"))


@query(f"select conv_id, turn, coalesce(case conv_id % 2 when 0 then nullif(regexp_extract(t, '{A.DATE}', 0), '') else nullif(regexp_extract(t, '{A.MONEY}', 0), '') end, t) as answer from (select conv_id, turn, {_DATED} as t from conversations)")
def compose_short_answer(t: Tables):
    """The span that the question's kind asks for, or the turn itself."""
    kind = F.when(F.col("conv_id") % 2 == 0, "date").otherwise("money")
    return _dated(t).select("conv_id", "turn", A.span(kind, F.col("text")).alias("answer"))


@query("select conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[A-Z][a-z]{3,}'), lambda w: w not in ('What', 'When')))), ',') as names from conversations")
def named_candidates(t: Tables):
    names = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0)), lambda w: ~w.isin("What", "When"))))
    return t.conversations.select("conv_id", "turn", F.array_join(names, ",").alias("names"))


_F1 = "list_filter(regexp_split_to_array(regexp_replace(lower({}), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda t: t <> '' and t not in ('a', 'an', 'the'))"


@query(f"""with p as (select a.item_id as id, b.item_id as ref, {_F1.format('a.text')} as p, {_F1.format('b.text')} as g from benchmark a join benchmark b on b.item_id in (a.item_id + 1, a.item_id + 2)),
w as (select id, p, g, list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda y: y = w)), len(list_filter(g, lambda y: y = w))))) as same from p)
select id, round(max(case when same > 0 then 2 * same / (len(p) + len(g)) else 0 end), 6) as f1 from w group by 1""")
def best_f1(t: Tables):
    """The best score over several references."""
    from ..operators.text import token_f1

    a = t.benchmark.select("item_id", F.col("text").alias("predicted"))
    b = t.benchmark.select(F.col("item_id").alias("ref"), F.col("text").alias("gold"))
    asked = a.withColumn("ref", F.explode(F.array(F.col("item_id") + 1, F.col("item_id") + 2)))
    j = asked.join(b, "ref").select((F.col("item_id") * 1000 + F.col("ref")).alias("id"), "predicted", "gold")
    return token_f1(j, "predicted", "gold").groupBy(F.floor(F.col("id") / 1000).alias("id")).agg(F.round(F.max("f1"), 6).alias("f1"))


@query("select coalesce(event_type, 'all') as category, count(*) as n, round(avg(case when value > 20 then 1.0 else 0.0 end), 6) as rate, round(100 * avg(least(value / 100, 1.0)), 6) as f1 from events group by rollup(event_type)")
def persistence_report(t: Tables):
    """Rates by category and overall."""
    r = t.events.rollup("event_type").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0)), 6).alias("rate"), F.round(100 * F.avg(F.least(F.col("value") / 100, F.lit(1.0))), 6).alias("f1"))
    return r.select(F.coalesce("event_type", F.lit("all")).alias("category"), "n", "rate", "f1")


@query("select doc_id, text is not null as ok, 'Extract triples from: ' || text as prompt from documents")
def triple_prompt(t: Tables):
    """The prompt for a model that a user plugs in; the engine has none."""
    return t.documents.select("doc_id", F.col("text").isNotNull().alias("ok"), I.triple_prompt(F.col("text")).alias("prompt"))


@query("select conv_id * 1000 + turn as id, 'Ada' as subject, 'knows' as predicate, 'B' || turn as object from conversations")
def parse_triples_reply(t: Tables):
    """A model's reply as JSON lines to triples; lines that aren't are left out."""
    reply = F.concat(F.lit('noise\n{"subject": "Ada", "predicate": "knows", "object": "B'), F.col("turn").cast("string"), F.lit('"}\n{broken'))
    return I.parse_triples(t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), reply.alias("reply")), "id", "reply")
