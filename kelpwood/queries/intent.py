"""Intents and their arc: needs, sentiments, actions, candidates, proposals, silences, anticipations, cards, the brief."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import intent as N
from ..operators import store as K
from ..operators import temporal as T
from ..registry import query, text_list
from ..sources.memory import VIEWS
from ..sources.memory import memory_views as V
from ..sources.tables import CTE, Tables, with_views

C, CO = with_views("commitments"), with_views("commitments", "outcomes")
AT = 1704500000
NOW_SQL = "timestamp '2001-08-01'"


def now():
    return F.expr("timestamp_ntz'2001-08-01'")


def both(*names: str) -> str:
    """Views of either kind in one WITH."""
    return "with " + ", ".join(CTE[n] if n in CTE else f"{n} as ({VIEWS[n].replace('{', '').replace('}', '')})" for n in names) + " "


# ----------------------------------------------------------------- commitments
@query(C + "select id, statement, state from commitments where state in ('open', 'acted') order by made_at desc, id limit 40")
def list_open(t: Tables):
    return K.newest(t.commitments.filter(F.col("state").isin("open", "acted")), 40, F.desc("made_at"), "id").select("id", "statement", "state")


@query(CO + "select id, polarity, observed_at from commitments join outcomes on id = commitment_id where observed_at >= timestamp '1996-01-01' order by observed_at desc, id limit 60")
def list_completed_with_polarity(t: Tables):
    j = t.commitments.join(t.outcomes, F.col("id") == F.col("commitment_id")).filter("observed_at >= timestamp_ntz'1996-01-01'")
    return K.newest(j, 60, F.desc("observed_at"), "id").select("id", "polarity", "observed_at")


@query(CO + "select id, stakes, polarity, observed_at from commitments join outcomes on id = commitment_id")
def outcomes_with_time(t: Tables):
    """For splits by time: each outcome with when it was seen."""
    return t.commitments.join(t.outcomes, F.col("id") == F.col("commitment_id")).select("id", "stakes", "polarity", "observed_at")


@query(C + "select state, count(*) as n from (select state from commitments union all select 'open' from customer) group by 1")
def insert_commitment(t: Tables):
    new = t.customer.select(F.lit("open").alias("state"))
    return t.commitments.select("state").unionByName(new).groupBy("state").agg(F.count("*").alias("n"))


@query(C + "select case when id % 5 = 0 and state in ('open', 'acted') then 'completed' else state end as state, count(*) as n from commitments group by 1")
def update_state(t: Tables):
    """A change of state where the automaton allows it."""
    target = F.when(F.col("id") % 5 == 0, "completed")
    ok = T.allowed_transition(F.col("state"), target)
    return t.commitments.groupBy(F.when(target.isNotNull() & ok, target).otherwise(F.col("state")).alias("state")).agg(F.count("*").alias("n"))


@query(C + f"select id, case when state = 'open' and horizon <= {NOW_SQL} and id not in (select l_orderkey from lineitem where l_returnflag = 'R') then 'broken' else state end as state from commitments")
def sweep_broken(t: Tables):
    """Overdue commitments that nothing resolves are broken."""
    resolved = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.lit(True).alias("resolved")).distinct()
    c = t.commitments.join(resolved, "id", "left")
    late = (F.col("state") == "open") & (F.col("horizon") <= now()) & F.col("resolved").isNull()
    return c.select("id", F.when(late, "broken").otherwise(F.col("state")).alias("state"))


@query(CO + "select id, case when polarity >= 0 then 'kept' else 'broken' end as state from commitments join outcomes on id = commitment_id")
def resolve_commitment(t: Tables):
    return t.commitments.join(t.outcomes, F.col("id") == F.col("commitment_id")).select("id", F.when(F.col("polarity") >= 0, "kept").otherwise("broken").alias("state"))


@query(CO + "select polarity, count(*) as n from (select polarity from outcomes union all select 1 from customer) group by 1")
def insert_outcome(t: Tables):
    return t.outcomes.select("polarity").unionByName(t.customer.select(F.lit(1).alias("polarity"))).groupBy("polarity").agg(F.count("*").alias("n"))


@query(C + "select id, state from commitments where id = 3")
def get_commitment(t: Tables):
    return K.point(t.commitments, "id", 3).select("id", "state")


@query(C + "select id, case when id % 6 = 0 then 'superseded' else state end as state from commitments where state = 'open'")
def set_commitment_state(t: Tables):
    c = K.point(t.commitments, "state", "open").select("id", "state")
    return K.change(c, c.filter("id % 6 = 0").select("id", F.lit("superseded").alias("state")), ["id"])


# ----------------------------------------------------------------- needs, sentiments, actions
@query(V("needs") + "select id, text from needs order by created_at desc, id limit 20")
def list_needs(t: Tables):
    return K.newest(t.view("needs"), 20, F.desc("created_at"), "id").select("id", "text")


@query(V("needs") + "select text, count(*) as n from (select text from needs union all select 'rest' from supplier) group by 1")
def insert_need(t: Tables):
    return t.view("needs").select("text").unionByName(t.supplier.select(F.lit("rest").alias("text"))).groupBy("text").agg(F.count("*").alias("n"))


@query(V("need_links") + "select need_id, array_to_string(list_sort(list(distinct commitment_id)), ',') as linked from (select * from need_links union all select need_id, commitment_id from need_links where need_id % 2 = 0) group by 1")
def link_need_to_commitment(t: Tables):
    """Links as sets: one that is there isn't added again."""
    links = t.view("need_links")
    again = links.filter("need_id % 2 = 0")
    sets = links.unionByName(again).groupBy("need_id").agg(F.array_sort(F.collect_set("commitment_id")).alias("s"))
    return sets.select("need_id", F.array_join(F.col("s").cast("array<string>"), ",").alias("linked"))


@query(V("sentiments") + "select id, valence from sentiments order by seen_at desc, id desc limit 15")
def list_recent_sentiments(t: Tables):
    return K.newest(t.view("sentiments"), 15, F.desc("seen_at"), F.desc("id")).select("id", "valence")


@query(V("sentiments") + "select id, valence from sentiments where target_id = 8 order by seen_at desc, id desc limit 5")
def list_sentiments_for(t: Tables):
    return K.newest(K.point(t.view("sentiments"), "target_id", 8), 5, F.desc("seen_at"), F.desc("id")).select("id", "valence")


@query(V("sentiments") + "select count(*) + 1 as n, max(id) + 1 as next from sentiments")
def insert_sentiment(t: Tables):
    log = t.view("sentiments").select(F.col("id").alias("seq"), "target_id")
    return K.append(log, log.limit(1).select("target_id")).agg(F.count("*").alias("n"), F.max("seq").alias("next"))


@query(V("actions") + "select id, what from actions order by seen_at desc, id desc limit 25")
def list_recent_actions(t: Tables):
    return K.newest(t.view("actions"), 25, F.desc("seen_at"), F.desc("id")).select("id", "what")


@query(V("actions") + "select id, what from actions where commitment_id = 5 order by seen_at desc, id desc limit 5")
def list_actions_for_commitment(t: Tables):
    return K.newest(K.point(t.view("actions"), "commitment_id", 5), 5, F.desc("seen_at"), F.desc("id")).select("id", "what")


@query(V("actions") + "select what, count(*) as n from (select what from actions union all select 'planned' from customer) group by 1")
def insert_action(t: Tables):
    return t.view("actions").select("what").unionByName(t.customer.select(F.lit("planned").alias("what"))).groupBy("what").agg(F.count("*").alias("n"))


@query(both("commitments", "outcomes", "actions", "need_links", "needs") + """, a as (select commitment_id, count(*) as actions, max(seen_at) as last_action from actions group by 1), n as (select commitment_id, count(distinct text) as needs from need_links join needs on needs.id = need_id group by 1)
select c.id, c.state, coalesce(n.needs, 0) as needs, coalesce(a.actions, 0) as actions, a.last_action, o.polarity from commitments c left join n on n.commitment_id = c.id left join a on a.commitment_id = c.id left join outcomes o on o.commitment_id = c.id""")
def memory_arc(t: Tables):
    """The arc of every commitment: needs that it is linked with, actions, outcome."""
    return N.arcs(t.commitments, t.view("need_links"), t.view("needs"), t.view("actions"), t.outcomes)


@query(both("commitments", "needs", "sentiments", "actions") + "select kind, count(*) as n, min(text) as first from (select 'commitment' as kind, statement as text from commitments union all select 'need', text from needs union all select 'sentiment', valence::varchar from sentiments union all select 'action', what from actions) where kind <> 'sentiment' group by 1 union all select 'sentiment', count(*), null from sentiments")
def belief_view(t: Tables):
    """One shape over all kinds of an arc."""
    b = N.uniform({"commitment": t.commitments.select("id", F.col("statement").alias("text")), "need": t.view("needs"), "action": t.view("actions").withColumnRenamed("what", "text"), "sentiment": t.view("sentiments").withColumn("text", F.lit(None).cast("string"))})
    return b.groupBy("kind").agg(F.count("*").alias("n"), F.min("text").alias("first"))


# ----------------------------------------------------------------- candidates and mined phrases
@query(V("candidates") + "select id, confidence from candidates where status = 'pending' order by created_at desc, id limit 30")
def list_pending_candidates(t: Tables):
    return K.newest(K.point(t.view("candidates"), "status", "pending"), 30, F.desc("created_at"), "id").select("id", "confidence")


@query(V("candidates") + "select count(*) as n from candidates where status = 'pending'")
def count_pending_candidates(t: Tables):
    return K.point(t.view("candidates"), "status", "pending").agg(F.count("*").alias("n"))


@query(V("candidates") + "select case when status = 'pending' and id % 2 = 0 then 'promoted' else status end as status, count(*) as n from candidates group by 1")
def accept_candidate(t: Tables):
    c = t.view("candidates")
    return K.decide(c, c.filter("id % 2 = 0").select("id", F.lit("promoted").alias("decided")), "id").groupBy("status").agg(F.count("*").alias("n"))


@query(V("candidates") + "select id, case when status = 'pending' and id % 3 = 0 then 'dismissed' else status end as status from candidates")
def dismiss_candidate(t: Tables):
    """Only what is pending can be dismissed."""
    c = t.view("candidates")
    return K.decide(c, c.filter("id % 3 = 0").select("id", F.lit("dismissed").alias("decided")), "id").select("id", "status")


@query(V("candidates") + "select status, count(*) as n from (select status from candidates union all select 'pending' from conversations) group by 1")
def insert_candidates(t: Tables):
    return t.view("candidates").select("status").unionByName(t.conversations.select(F.lit("pending").alias("status"))).groupBy("status").agg(F.count("*").alias("n"))


_SAY = text_list(p for p, _, _ in N.PHRASES)
_TABLE = "(values " + ", ".join(f"({i}, '{p.replace(chr(39), chr(39) * 2)}', '{k}', {w}::double)" for i, (p, k, w) in enumerate(N.PHRASES)) + ") p(i, phrase, kind, worth)"


@query(f"""with said as (select conv_id * 1000 + turn as id, {_SAY}[(conv_id + turn) % {len(N.PHRASES)} + 1] || ' ' || text || ' so ' || {_SAY}[(conv_id + 3 * turn) % {len(N.PHRASES)} + 1] || ' it' as text from conversations),
s as (select id, i - 1 as pos, c[i] as sentence, lower(c[i]) as low from (select id, c, unnest(range(1, len(c) + 1)) as i from (select id, regexp_split_to_array(text, '[.!?\n]') as c from said))),
h as (select *, length(regexp_extract(' ' || low, '(?s)^(.*?[^a-z0-9_''])' || phrase, 1)) - 1 as start from s, {_TABLE} where contains(low, phrase)),
b as (select * from h where start >= 0 qualify row_number() over (partition by id, pos order by length(phrase) desc, worth desc, start, i) = 1),
st as (select *, trim(substr(sentence, start + 1)) as statement from b)
select id, pos as place, phrase, kind, start::int as start, statement, round(case when len(regexp_split_to_array(statement, '\\s+')) < 4 then greatest(worth - 0.05, 0.05) else worth end, 6) as confidence from st""")
def mine(t: Tables):
    """Every turn between two of the phrases, whole: the strongest statement of each sentence."""
    n = lambda k: ((F.col("conv_id") + k * F.col("turn")) % len(N.PHRASES) + 1).cast("int")
    phrase = lambda k: F.element_at(F.array(*[F.lit(p) for p, _, _ in N.PHRASES]), n(k))
    docs = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(phrase(1), F.lit(" "), "text", F.lit(" so "), phrase(3), F.lit(" it")).alias("text"))
    return N.mine(docs, "id", "text").withColumnRenamed("at", "place").withColumn("confidence", F.round("confidence", 6))


@query("""with recursive s as (select user_id, event_id % 40 as a, event_id % 40 + 1 + event_id % 7 as b, 1 + event_id % 7 as len, event_id as id from events),
g as (select *, row_number() over (partition by user_id order by len desc, a, id) as n from s),
w(user_id, n, taken, kept) as (select user_id, 1, [struct_pack(a := a, b := b)], [id] from g where n = 1
  union all select g.user_id, g.n, case when len(list_filter(taken, lambda x: g.a < x.b and x.a < g.b)) = 0 then list_append(taken, struct_pack(a := g.a, b := g.b)) else taken end,
    case when len(list_filter(taken, lambda x: g.a < x.b and x.a < g.b)) = 0 then list_append(kept, g.id) else kept end from w join g on g.user_id = w.user_id and g.n = w.n + 1)
select user_id as doc, unnest(kept) as id from w where (user_id, n) in (select user_id, max(n) from w group by 1)""")
def dedup_overlapping(t: Tables):
    """Of overlapping spans the longest stays, ties to the first."""
    spans = t.events.select(F.col("user_id").alias("doc"), F.col("event_id").alias("id"), (F.col("event_id") % 40).alias("start"), (F.col("event_id") % 7 + 1).alias("length"))
    return N.without_overlaps(spans).select("doc", "id")


# ----------------------------------------------------------------- proposals, silences, anticipations
@query(V("outcome_proposals") + f"select id, cell_key from outcome_proposals where status = 'pending' and expires_at > {AT} order by created_at desc, id limit 30")
def list_active_outcome_proposals(t: Tables):
    p = t.view("outcome_proposals").filter((F.col("status") == "pending") & (F.col("expires_at") > AT))
    return K.newest(p, 30, F.desc("created_at"), "id").select("id", "cell_key")


@query(V("outcome_proposals") + f"select count(*) as n from outcome_proposals where status = 'pending' and expires_at > {AT}")
def count_active_outcome_proposals(t: Tables):
    return t.view("outcome_proposals").filter((F.col("status") == "pending") & (F.col("expires_at") > AT)).agg(F.count("*").alias("n"))


@query(V("outcome_proposals") + f"select cell_key, min(id) as id from (select cell_key, id from outcome_proposals union all select event_type, event_id from events) where cell_key not in (select cell_key from outcome_proposals where status = 'pending' and expires_at > {AT}) group by 1")
def insert_outcome_proposal(t: Tables):
    """Proposals for old cells and for types of events: only cells that have no active one get theirs."""
    p = t.view("outcome_proposals")
    new = p.select("cell_key", "id").unionByName(t.events.select(F.col("event_type").alias("cell_key"), F.col("event_id").alias("id"))).groupBy("cell_key").agg(F.min("id").alias("id"))
    return K.insert_or_ignore(K.point(p, "status", "pending").filter(F.col("expires_at") > AT), new, ["cell_key"])


@query(V("outcome_proposals") + f"select case when status = 'pending' and expires_at <= {AT} + 3000000 then 'expired' else status end as status, count(*) as n from outcome_proposals group by 1")
def expire_outcome_proposals(t: Tables):
    p = t.view("outcome_proposals")
    old = p.filter(F.col("expires_at") <= AT + 3000000).select("id", F.lit("expired").alias("decided"))
    return K.decide(p, old, "id").groupBy("status").agg(F.count("*").alias("n"))


@query(V("outcome_proposals") + "select case when status = 'pending' and id % 5 = 2 then 'accepted' else status end as status, count(*) as n from outcome_proposals group by 1")
def accept_outcome_proposal(t: Tables):
    p = t.view("outcome_proposals")
    return K.decide(p, p.filter("id % 5 = 2").select("id", F.lit("accepted").alias("decided")), "id").groupBy("status").agg(F.count("*").alias("n"))


@query(V("outcome_proposals") + "select case when status = 'pending' and id % 5 = 3 then 'dismissed' else status end as status, count(*) as n from outcome_proposals group by 1")
def dismiss_outcome_proposal(t: Tables):
    p = t.view("outcome_proposals")
    return K.decide(p, p.filter("id % 5 = 3").select("id", F.lit("dismissed").alias("decided")), "id").groupBy("status").agg(F.count("*").alias("n"))


_SIL = "select {0}, max(silenced_at) as silenced_at, max(silenced_until) as silenced_until, arg_max(reason, silenced_at) filter (where reason is not null) as reason from silences group by 1"


@query(V("silences") + _SIL.format("cell"))
def upsert_pattern_silence(t: Tables):
    """A silence is extended, never cut; a reason stays unless a new one is given."""
    return K.extended(t.view("silences"), ["cell"], "silenced_at", "silenced_until", "reason")


@query(V("silences") + f"select cell, silenced_until from ({_SIL.format('cell')}) where silenced_until > {AT}")
def list_active_pattern_silences(t: Tables):
    s = K.extended(t.view("silences"), ["cell"], "silenced_at", "silenced_until", "reason")
    return s.filter(F.col("silenced_until") > AT).select("cell", "silenced_until")


@query(V("silences") + _SIL.format("commitment_id"))
def upsert_insight_silence(t: Tables):
    return K.extended(t.view("silences"), ["commitment_id"], "silenced_at", "silenced_until", "reason")


@query(V("silences") + f"select commitment_id, silenced_until from ({_SIL.format('commitment_id')}) where silenced_until > {AT}")
def list_active_insight_silences(t: Tables):
    s = K.extended(t.view("silences"), ["commitment_id"], "silenced_at", "silenced_until", "reason")
    return s.filter(F.col("silenced_until") > AT).select("commitment_id", "silenced_until")


@query(V("silences") + "select distinct cell from silences where cell <> '1-URGENT'")
def pattern_unsilence(t: Tables):
    s = t.view("silences").select("cell").distinct()
    return K.remove(s, s.filter("cell = '1-URGENT'"), ["cell"])


@query(V("silences") + "select distinct commitment_id from silences where commitment_id % 9 <> 0")
def insight_unsilence(t: Tables):
    s = t.view("silences").select("commitment_id").distinct()
    return K.remove(s, s.filter("commitment_id % 9 = 0"), ["commitment_id"])


@query(V("anticipations") + f"select id, query from anticipations where expires_at > {AT} and not answered order by confidence desc, id limit 20")
def list_active_prefetch_queries(t: Tables):
    a = t.view("anticipations").filter((F.col("expires_at") > AT) & ~F.col("answered"))
    return K.newest(a, 20, F.desc("confidence"), "id").select("id", "query")


@query(V("anticipations") + "select answered, count(*) as n from (select answered from anticipations union all select false from customer) group by 1")
def insert_anticipation(t: Tables):
    return t.view("anticipations").select("answered").unionByName(t.customer.select(F.lit(False).alias("answered"))).groupBy("answered").agg(F.count("*").alias("n"))


@query(V("anticipations") + f"select query, max(expires_at) as expires_at from anticipations where expires_at > {AT} group by 1")
def evict_expired(t: Tables):
    """A cache by question, without what has expired."""
    return K.purge(t.view("anticipations"), F.col("expires_at") > AT).groupBy("query").agg(F.max("expires_at").alias("expires_at"))


@query(V("anticipations") + "select query, expires_at from (select query, max(expires_at) as expires_at from anticipations group by 1 order by max(expires_at) desc, query limit 32)")
def prime(t: Tables):
    """A cache of 32 questions: beyond it the oldest go."""
    return K.newest(t.view("anticipations").groupBy("query").agg(F.max("expires_at").alias("expires_at")), 32, F.desc("expires_at"), "query")


@query(V("anticipations") + f"select id, query from anticipations where trim(lower(query)) = 'query 5' and expires_at > {AT} order by expires_at desc, id limit 1")
def prefetch_lookup(t: Tables):
    a = t.view("anticipations").filter((F.trim(F.lower("query")) == "query 5") & (F.col("expires_at") > AT))
    return K.newest(a, 1, F.desc("expires_at"), "id").select("id", "query")


@query(V("anticipations") + f"select id, query, confidence from anticipations where expires_at > {AT} and not answered order by confidence desc, id limit 8")
def warm_prefetch(t: Tables):
    a = t.view("anticipations").filter((F.col("expires_at") > AT) & ~F.col("answered"))
    return K.newest(a, 8, F.desc("confidence"), "id").select("id", "query", "confidence")


# ----------------------------------------------------------------- cards
@query(V("cards") + "select id, kind, score from cards order by seen_at desc, id desc limit 8")
def recent_cards(t: Tables):
    return K.newest(t.view("cards"), 8, F.desc("seen_at"), F.desc("id")).select("id", "kind", "score")


@query(V("cards") + "select id from (select *, row_number() over (partition by kind, target_id order by seen_at, id) as n from cards) where n = 1")
def proposals_from_sources(t: Tables):
    """Of several proposals for one kind and target the first source's counts."""
    return N.first_proposals(t.view("cards").select("id", "kind", "target_id", F.col("seen_at").alias("ord"))).select("id")


@query(V("cards") + ", n as (select max(seen_at) as now from cards) select id, round(score * greatest(0.2, 1 - 0.2 * (row_number() over (partition by kind, target_id order by seen_at, id) - 1)) * pow(2.0, -(now - seen_at) / 86400.0) * 0.9, 6) as score from cards, n")
def score_proposal(t: Tables):
    """Relevance by surprise, recency (half a day's worth a day) and outcome."""
    c = t.view("cards")
    now = F.broadcast(c.agg(F.max("seen_at").alias("now")))
    repeat = F.row_number().over(Window.partitionBy("kind", "target_id").orderBy("seen_at", "id")) - 1
    surprise = F.greatest(F.lit(0.2), 1 - 0.2 * repeat)
    return c.join(now).select("id", F.round(F.col("score") * surprise * S.half_life((F.col("now") - F.col("seen_at")) / 86400.0, 1.0) * 0.9, 6).alias("score"))


@query(V("cards") + ", o as (select kind, case when score > 0.5 then 1.0 else 0.0 end as v, row_number() over (partition by kind order by seen_at desc, id desc) - 1 as back from cards) select kind, round(0.5 * pow(0.8, count(*)) + sum(0.2 * pow(0.8, back) * v), 6) as v, count(*) as n from o group by 1")
def card_feedback(t: Tables):
    """A moving average of what feedback says, by kind."""
    log = t.view("cards").select("kind", F.when(F.col("score") > 0.5, 1.0).otherwise(0.0).alias("v"), "seen_at", "id")
    return K.moving_average(log, "kind", ["seen_at", "id"], "v").withColumn("v", F.round("v", 6))


@query()
def rank_and_push(t: Tables):
    """Cards that are shown: enough score, half an hour's rest for a target, eight an hour (held against plain Python in the tests)."""
    return N.admit(t.view("cards").withColumn("host", F.col("target_id") % 4), "host")


# ----------------------------------------------------------------- the brief
_BRIEF = both("commitments", "outcomes", "candidates", "outcome_proposals", "pending") + f""", c as (select *, case when state in ('open', 'acted') and horizon <= {NOW_SQL} then case when date_diff('second', horizon, {NOW_SQL}) <= 86400 then 'due' when date_diff('second', horizon, {NOW_SQL}) <= 604800 then 'stale' else 'cold' end end as late from commitments),
s as (select 'overdue_' || late as section, id, 1 as ord, epoch(horizon)::bigint as rank from c where late is not null
 union all select 'open', id, 2, -epoch(made_at)::bigint from c where late is null and state in ('open', 'acted')
 union all select 'resolved', commitment_id, 3, -epoch(observed_at)::bigint from outcomes
 union all select 'candidates', id, 4, -created_at from candidates where status = 'pending'
 union all select 'proposals', id, 5, -created_at from outcome_proposals where status = 'pending'
 union all select 'pending', id, 6, -(confidence * 1000)::bigint from pending where status = 'pending')"""


@query(_BRIEF + ", n as (select *, row_number() over (partition by section order by rank, id)::int as place, count(*) over (partition by section) as total from s) select section, id, place, total from n where place <= 5")
def brief_sections(t: Tables):
    """Sections of the brief, five rows of each; what is overdue isn't listed as open again."""
    return N.brief(t.commitments, t.outcomes, t.view("candidates"), t.view("outcome_proposals"), t.view("pending"), now()).filter("place <= 5").select("section", "id", "place", "total")


@query(_BRIEF + ", n as (select *, row_number() over (partition by ord order by rank, id) as place from s) select row_number() over (order by ord, place, id)::int as n, section, id from n where place <= 4 order by ord, place, id limit 12")
def next_actions(t: Tables):
    """Twelve actions at most: sections in order of weight, four rows of each."""
    b = N.brief(t.commitments, t.outcomes, t.view("candidates"), t.view("outcome_proposals"), t.view("pending"), now())
    w = Window.partitionBy("ord").orderBy("rank", "id")
    top = b.withColumn("place", F.row_number().over(w)).filter("place <= 4").orderBy("ord", "place", "id").limit(12)
    return top.select(F.row_number().over(Window.orderBy("ord", "place", "id")).alias("n"), "section", "id")


@query(CO + """, p as (select polarity, case stakes when 'high' then 1 when 'medium' then 0 else -1 end as said from commitments join outcomes on id = commitment_id),
g as (select count(*) as n, avg(case when said = polarity then 1.0 else 0.0 end) as accuracy, count(case when said = -1 then 1 end) as warnings, count(case when said = -1 and polarity = -1 then 1 end) as hits from p)
select n, round(accuracy, 6) as accuracy, case when n < 8 then 'too_few' when accuracy < 0.35 then 'inaccurate' when warnings > 0 and hits / warnings < 0.5 then 'false_alarms' else 'open' end as gate from g""")
def insight_gate(t: Tables):
    said = F.when(F.col("stakes") == "high", 1).when(F.col("stakes") == "medium", 0).otherwise(-1)
    return N.insight_gate(t.commitments.join(t.outcomes, F.col("id") == F.col("commitment_id")).select("polarity", said.alias("said")))


@query(C + "select source, count(*) as n, min(statement) as first_tag from commitments where state = 'open' group by 1 having count(*) >= 3")
def commitment_sources(t: Tables):
    return t.commitments.filter("state = 'open'").groupBy("source").agg(F.count("*").alias("n"), F.min("statement").alias("first_tag")).filter("n >= 3")


@query(C + "select stakes || '|' || case when hour(made_at) between 5 and 11 then 'morning' when hour(made_at) between 12 and 16 then 'afternoon' when hour(made_at) between 17 and 21 then 'evening' else 'night' end || '|' || statement || '|' || (length(source) % 3) as cell, count(*) as n from commitments group by 1")
def pattern_cell(t: Tables):
    """The key of a commitment's cell: stakes, time band, first tag and source."""
    c = t.commitments
    cell = F.concat_ws("|", "stakes", S.time_band(F.col("made_at")), "statement", (F.length("source") % 3).cast("string"))
    return c.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
