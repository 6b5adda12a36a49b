"""Commitments and their outcomes, patterns, calibration, bitemporal facts and confidence dynamics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import temporal as T
from ..registry import query
from ..sources.tables import Tables, with_views

C, CO, FA, EN = with_views("commitments"), with_views("commitments", "outcomes"), with_views("facts"), with_views("entities")
NOW = "2001-08-01"
NOW_SQL = f"timestamp '{NOW}'"


def now():
    return F.expr(f"timestamp_ntz'{NOW}'")


@query(CO + "select stakes, count(*) as total, sum(case when polarity >= 0 then 1 else 0 end) as kept, sum(case when polarity < 0 then 1 else 0 end) as broken, sum(case when polarity is null then 1 else 0 end) as pending from commitments left join outcomes on id = commitment_id where made_at >= timestamp '1996-01-01' and made_at < timestamp '1999-01-01' group by 1")
def commitment_ledger(t: Tables):
    j = t.commitments.filter("made_at >= timestamp_ntz'1996-01-01' and made_at < timestamp_ntz'1999-01-01'").join(t.outcomes, F.col("id") == F.col("commitment_id"), "left")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return j.groupBy("stakes").agg(F.count("*").alias("total"), one(F.col("polarity") >= 0).alias("kept"), one(F.col("polarity") < 0).alias("broken"), one(F.col("polarity").isNull()).alias("pending"))


@query(C + f"select id, horizon from commitments where state = 'open' order by case when horizon > {NOW_SQL} then null else horizon end nulls last, made_at desc, id limit 50")
def pending_ordering(t: Tables):
    due = F.when(F.col("horizon") <= now(), F.col("horizon"))
    return t.commitments.filter("state = 'open'").orderBy(F.asc_nulls_last(due), F.desc("made_at"), "id").select("id", "horizon").limit(50)


@query(C + f"select id, horizon from commitments where state in ('open', 'acted') and horizon <= {NOW_SQL} and id not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def overdue_without_resolution(t: Tables):
    c = t.commitments.filter(F.col("state").isin("open", "acted") & (F.col("horizon") <= now()))
    return c.join(t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")), "id", "left_anti").select("id", "horizon")


@query(C + f"select id, case when date_diff('second', horizon, {NOW_SQL}) <= 86400 then 'due' when date_diff('second', horizon, {NOW_SQL}) <= 604800 then 'stale' else 'cold' end as lag from commitments where state = 'open' and horizon <= {NOW_SQL}")
def due_prompts(t: Tables):
    return t.commitments.filter((F.col("state") == "open") & (F.col("horizon") <= now())).select("id", S.lag_class(F.col("horizon"), now()).alias("lag"))


@query(CO + "select id, stakes, coalesce(observed_at, made_at) as seen, polarity from commitments left join outcomes on id = commitment_id where state = 'completed' order by seen desc, id limit 100")
def resolved_left_join(t: Tables):
    j = t.commitments.filter("state = 'completed'").join(t.outcomes, F.col("id") == F.col("commitment_id"), "left")
    return j.select("id", "stakes", F.coalesce("observed_at", "made_at").alias("seen"), "polarity").orderBy(F.desc("seen"), "id").limit(100)


@query(CO + """, done as (select stakes, statement, polarity, case when month(made_at) between 1 and 6 then 'first' else 'second' end as half from commitments join outcomes on id = commitment_id),
g as (select count(*) as gn, avg(case when polarity > 0 then 1.0 else 0.0 end) as gp from done),
cell as (select stakes, half, statement, count(*) as n, sum(case when polarity > 0 then 1 else 0 end) as k from done group by 1, 2, 3)
select stakes, half, statement, n, round(k / n, 6) as rate, round(k / n - gp, 6) as lift, round((k / n + 1.96*1.96 / (2*n) - 1.96 * sqrt((k / n * (1 - k / n) + 1.96*1.96 / (4*n)) / n)) / (1 + 1.96*1.96 / n), 6) as low from cell, g where n >= 6 and gn >= 12""")
def pattern_cells_wilson(t: Tables):
    done = t.commitments.join(t.outcomes, F.col("id") == F.col("commitment_id")).withColumn("half", F.when(F.month("made_at").between(1, 6), "first").otherwise("second"))
    hit = F.when(F.col("polarity") > 0, 1)
    g = done.agg(F.count("*").alias("gn"), F.avg(F.coalesce(hit, F.lit(0))).alias("gp"))
    cell = done.groupBy("stakes", "half", "statement").agg(F.count("*").alias("n"), F.sum(F.coalesce(hit, F.lit(0))).alias("k"))
    rate = F.col("k") / F.col("n")
    return cell.join(F.broadcast(g)).filter("n >= 6 and gn >= 12").select("stakes", "half", "statement", "n", F.round(rate, 6).alias("rate"), F.round(rate - F.col("gp"), 6).alias("lift"), F.round(S.wilson_lower(F.col("k"), F.col("n")), 6).alias("low"))


@query(CO + "select round(sum(case when polarity > 0 then 1.0 else 0.0 end) / sum(case when polarity <> 0 then 1.0 else 0.0 end), 6) as positive_rate, count(*) as n from commitments join outcomes on id = commitment_id")
def baseline_rate(t: Tables):
    j = t.commitments.join(t.outcomes, F.col("id") == F.col("commitment_id"))
    one = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    return j.agg(F.round(one(F.col("polarity") > 0) / one(F.col("polarity") != 0), 6).alias("positive_rate"), F.count("*").alias("n"))


@query(CO + """, p as (select stakes, polarity, case stakes when 'high' then 0.5 when 'medium' then 0.4 else 0.3 end as up, case stakes when 'high' then 0.3 when 'medium' then 0.4 else 0.5 end as down from commitments join outcomes on id = commitment_id),
s as (select *, 1 - up - down as mid, case when up >= down and up >= 1 - up - down then 1 when down >= 1 - up - down then -1 else 0 end as said from p)
select count(*) as n, round(avg(case when said = polarity then 1.0 else 0.0 end), 6) as accuracy, round(sum(case when said = 1 and polarity = 1 then 1.0 else 0.0 end) / sum(case when polarity = 1 then 1.0 else 0.0 end), 6) as positive_recall,
 round(sum(case when said = -1 and polarity = -1 then 1.0 else 0.0 end) / sum(case when said = -1 then 1.0 else 0.0 end), 6) as warning_precision,
 round(avg(pow(up - case when polarity = 1 then 1 else 0 end, 2) + pow(down - case when polarity = -1 then 1 else 0 end, 2) + pow(mid - case when polarity = 0 then 1 else 0 end, 2)), 6) as brier from s""")
def calibration(t: Tables):
    """A fixed predictor by stakes, scored: accuracy, recall, precision and the Brier score over three classes."""
    pick = lambda a, b, c: F.when(F.col("stakes") == "high", a).when(F.col("stakes") == "medium", b).otherwise(c)
    p = t.commitments.join(t.outcomes, F.col("id") == F.col("commitment_id")).withColumn("up", pick(0.5, 0.4, 0.3)).withColumn("down", pick(0.3, 0.4, 0.5)).withColumn("mid", 1 - F.col("up") - F.col("down"))
    p = p.withColumn("said", F.when((F.col("up") >= F.col("down")) & (F.col("up") >= F.col("mid")), 1).when(F.col("down") >= F.col("mid"), -1).otherwise(0))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    y, s = F.col("polarity"), F.col("said")
    brier = F.pow(F.col("up") - one(y == 1), 2) + F.pow(F.col("down") - one(y == -1), 2) + F.pow(F.col("mid") - one(y == 0), 2)
    return p.agg(F.count("*").alias("n"), F.round(F.avg(one(s == y)), 6).alias("accuracy"), F.round(F.sum(one((s == 1) & (y == 1))) / F.sum(one(y == 1)), 6).alias("positive_recall"), F.round(F.sum(one((s == -1) & (y == -1))) / F.sum(one(s == -1)), 6).alias("warning_precision"), F.round(F.avg(brier), 6).alias("brier"))


@query(CO + """, done as (select stakes, statement, polarity from commitments join outcomes on id = commitment_id), b as (select avg(case when polarity > 0 then 1.0 else 0.0 end) as base from done)
select stakes, statement, count(*) as n, round(avg(case when polarity > 0 then 1.0 else 0.0 end) - max(base), 6) as gap from done, b group by 1, 2 having count(*) >= 6 order by abs(avg(case when polarity > 0 then 1.0 else 0.0 end) - max(base)) desc, stakes, statement limit 3""")
def insights(t: Tables):
    done = t.commitments.join(t.outcomes, F.col("id") == F.col("commitment_id")).withColumn("hit", F.when(F.col("polarity") > 0, 1.0).otherwise(0.0))
    g = done.groupBy("stakes", "statement").agg(F.count("*").alias("n"), F.avg("hit").alias("p")).filter("n >= 6").join(F.broadcast(done.agg(F.avg("hit").alias("base"))))
    gap = F.col("p") - F.col("base")
    return g.orderBy(F.desc(F.abs(gap)), "stakes", "statement").limit(3).select("stakes", "statement", "n", F.round(gap, 6).alias("gap"))


@query("""with e as (select event_type as kind, case when hour(ts) between 5 and 11 then 'morning' when hour(ts) between 12 and 17 then 'afternoon' when hour(ts) between 18 and 22 then 'evening' else 'night' end as win from events),
m as (select kind, count(*) as n from e group by 1), d as (select count(*) as dom, sum(n) as total from m), c as (select kind, win, count(*) as n from e group by 1, 2), w as (select win, count(*) as wn from e group by 1),
s as (select w.win, m.kind, (m.n + 1) / (total + dom) * (coalesce(c.n, 0) + 1) / (w.wn + dom) as p from w cross join m cross join d left join c on c.kind = m.kind and c.win = w.win)
select win, kind, round(p / sum(p) over (partition by win), 6) as p from s""")
def pgm_posterior(t: Tables):
    """Smoothed marginal times the conditional of the time window, normalised."""
    e = t.events.select(F.col("event_type").alias("kind"), S.time_window(F.col("ts")).alias("win"))
    c = e.groupBy("kind", "win").agg(F.count("*").alias("n"))
    kinds, wins = c.groupBy("kind").agg(F.sum("n").alias("m")), c.groupBy("win").agg(F.sum("n").alias("wn"))
    total = kinds.agg(F.count("*").alias("dom"), F.sum("m").alias("total"))
    grid = wins.join(F.broadcast(kinds)).join(F.broadcast(total)).join(c, ["kind", "win"], "left")
    p = (F.col("m") + 1) / (F.col("total") + F.col("dom")) * (F.coalesce("n", F.lit(0)) + 1) / (F.col("wn") + F.col("dom"))
    return grid.withColumn("p", p).select("win", "kind", F.round(F.col("p") / F.sum("p").over(Window.partitionBy("win")), 6).alias("p"))


# ----------------------------------------------------------------- bitemporal facts
@query(FA + "select entity_id, fact_id, value from facts where recorded_at <= timestamp '1998-06-01' and (superseded_at is null or superseded_at > timestamp '1998-06-01') and valid_from <= timestamp '1998-01-01' and (valid_to is null or valid_to > timestamp '1998-01-01')")
def as_of_valid_tx(t: Tables):
    return T.query_at(t.facts, F.expr("timestamp_ntz'1998-01-01'"), F.expr("timestamp_ntz'1998-06-01'")).select("entity_id", "fact_id", "value")


@query(FA + "select entity_id, fact_id from facts where superseded_at is null and valid_from < timestamp '1997-02-01' and (valid_to is null or valid_to > timestamp '1997-01-01')")
def range_overlap(t: Tables):
    return T.query_range(t.facts, F.expr("timestamp_ntz'1997-01-01'"), F.expr("timestamp_ntz'1997-02-01'")).select("entity_id", "fact_id")


@query(FA + "select entity_id, arg_max(fact_id, struct_pack(r := recorded_at, f := fact_id)) as fact_id from facts where valid_from <= timestamp '1998-01-01' and (valid_to is null or valid_to > timestamp '1998-01-01') group by 1")
def entity_at(t: Tables):
    return T.entity_at(t.facts, F.expr("timestamp_ntz'1998-01-01'"))


@query(FA + "select entity_id, arg_max(fact_id, struct_pack(r := recorded_at, f := fact_id)) as fact_id from facts where superseded_at is null group by 1")
def world_at(t: Tables):
    return T.current(t.facts)


@query(FA + "select entity_id, fact_id, valid_from, recorded_at, superseded_at, row_number() over (partition by entity_id order by recorded_at, fact_id) as version from facts")
def entity_history(t: Tables):
    w = Window.partitionBy("entity_id").orderBy("recorded_at", "fact_id")
    return t.facts.select("entity_id", "fact_id", "valid_from", "recorded_at", "superseded_at", F.row_number().over(w).alias("version"))


@query("select e.event_id, e.user_id, (select v.value from events v where v.user_id = e.user_id and v.event_type = 'purchase' and v.ts <= e.ts order by v.ts desc limit 1) as value from events e where e.event_type = 'click'")
def as_of_join(t: Tables):
    return T.as_of_join(t.events.filter("event_type = 'click'").select("event_id", "user_id", "ts"), t.events.filter("event_type = 'purchase'"), "user_id", "ts", "ts", "value").select("event_id", "user_id", "value")


# ----------------------------------------------------------------- confidence dynamics
@query(EN + "select sum(case when confidence * 0.95 < 0.1 then 1 else 0 end) as below, count(*) as rows from entities")
def decay_all(t: Tables):
    return T.decay(t.entities, 0.95, 0.1)[1]


_R = EN + """, x as (select id, confidence, exp(-0.05 * (k % 48)) as recency, 1 / (1 + ln(1 + k % 9)) as novelty from entities), y as (select *, exp(-(1 - recency) / (1 + 0.5 * round(1 / novelty))) as retention from x),
z as (select id, retention, recency, case when retention > 0.7 and recency > 0.5 then least(confidence + 0.02 * retention, 1.0) when retention < 0.3 then greatest(confidence - 0.1 * (1 - retention), 0.0) else confidence end as confidence from y)
select id, round(retention, 6) as retention, round(confidence, 6) as confidence, case when retention < 0.3 and confidence < 0.05 then 'prune' when retention > 0.7 and recency > 0.5 then 'strengthen' when retention < 0.3 then 'decay' else 'keep' end as action from z"""


@query(_R)
def consolidate(t: Tables):
    x = t.entities.select("id", "confidence", S.recency(F.col("k") % 48).alias("recency"), S.novelty(F.col("k") % 9).alias("novelty"))
    return T.consolidate(x).select("id", F.round("retention", 6).alias("retention"), F.round("confidence", 6).alias("confidence"), "action")


@query(EN + "select case when k % 15 < 1 then 'hot' when k % 15 < 7 then 'warm' else 'cold' end as tier, count(*) as n from entities group by 1")
def tier_promotion(t: Tables):
    return t.entities.groupBy(S.tier(F.col("k") % 15).alias("tier")).agg(F.count("*").alias("n"))


@query(C + "select state, to_state, case when state = 'open' then to_state in ('acted', 'abandoned', 'superseded', 'completed') when state = 'acted' then to_state in ('completed', 'abandoned') else false end as allowed, count(*) as n from (select state, case id % 4 when 0 then 'acted' when 1 then 'completed' when 2 then 'abandoned' else 'open' end as to_state from commitments) group by 1, 2, 3")
def state_transitions(t: Tables):
    to = F.when(F.col("id") % 4 == 0, "acted").when(F.col("id") % 4 == 1, "completed").when(F.col("id") % 4 == 2, "abandoned").otherwise("open")
    c = t.commitments.select("state", to.alias("to_state"))
    return c.groupBy("state", "to_state", T.allowed_transition(F.col("state"), F.col("to_state")).alias("allowed")).agg(F.count("*").alias("n"))


@query(C + f"select stakes, state, count(*) as n, sum(case when horizon <= {NOW_SQL} then 1 else 0 end) as overdue, min(horizon) as next from commitments where state <> 'completed' group by 1, 2")
def daily_brief(t: Tables):
    c = t.commitments.filter("state <> 'completed'")
    return c.groupBy("stakes", "state").agg(F.count("*").alias("n"), F.sum(F.when(F.col("horizon") <= now(), 1).otherwise(0)).alias("overdue"), F.min("horizon").alias("next"))


@query("select event_type, round(avg(case when value > 20 then 1.0 else 0.0 end), 6) as effective, sum(case when value < 1 then 1 else 0 end) as rollbacks, sum(case when value < 1 then 1 else 0 end) >= 3 as suppress from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as n from events) where n <= 50 group by 1")
def curator_stats(t: Tables):
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    e = t.events.withColumn("n", F.row_number().over(w)).filter("n <= 50")
    low = F.sum(F.when(F.col("value") < 1, 1).otherwise(0))
    return e.groupBy("event_type").agg(F.round(F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0)), 6).alias("effective"), low.alias("rollbacks"), (low >= 3).alias("suppress"))


@query("""with w as (select user_id % 6 as arm, count(*) as n, avg(least(value / 100, 1.0)) as mean from events group by 1), t as (select sum(n) as total from w)
select arm, n, round(mean + sqrt(2 * ln(total) / n), 6) as ucb from w, t""")
def bandit_ucb(t: Tables):
    a = t.events.groupBy((F.col("user_id") % 6).alias("arm")).agg(F.count("*").alias("n"), F.avg(F.least(F.col("value") / 100, F.lit(1.0))).alias("mean"))
    return a.join(F.broadcast(a.agg(F.sum("n").alias("total")))).select("arm", "n", F.round(F.col("mean") + F.sqrt(2 * F.log("total") / F.col("n")), 6).alias("ucb"))
