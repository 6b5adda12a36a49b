"""Intents: mined phrases, arcs of commitments, cards and their admission, sections of the brief."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Phrases that state an intent, a decision or a hypothesis, and what they are worth.
PHRASES = (
    ("i'm going to", "intent", 0.85), ("i am going to", "intent", 0.85), ("i'm gonna", "intent", 0.80), ("i intend to", "intent", 0.85), ("i'll try to", "intent", 0.65), ("i'll try", "intent", 0.55),
    ("i'll", "intent", 0.65), ("i need to", "intent", 0.75), ("i have to", "intent", 0.70), ("i want to", "intent", 0.65), ("i should", "intent", 0.60), ("i must", "intent", 0.70),
    ("remind me to", "intent", 0.85), ("note to self", "intent", 0.80), ("todo:", "intent", 0.85), ("the plan is", "intent", 0.80), ("we'll ship", "intent", 0.85), ("we're going to", "intent", 0.80),
    ("we need to", "intent", 0.75), ("let's", "intent", 0.55), ("going with", "intent", 0.70),
    ("he'll", "intent", 0.45), ("she'll", "intent", 0.45), ("they'll", "intent", 0.45), ("he is going to", "intent", 0.50), ("she is going to", "intent", 0.50), ("they are going to", "intent", 0.50),
    ("he plans to", "intent", 0.55), ("she plans to", "intent", 0.55), ("they plan to", "intent", 0.55), ("he needs to", "intent", 0.50), ("she needs to", "intent", 0.50), ("they need to", "intent", 0.50),
    ("plans to", "intent", 0.45), ("agreed to", "intent", 0.65), ("promised to", "intent", 0.75), ("committed to", "intent", 0.70),
    ("decided to", "decision", 0.90), ("i decided", "decision", 0.90), ("i went with", "decision", 0.85), ("we went with", "decision", 0.85), ("ended up", "decision", 0.65), ("settled on", "decision", 0.85),
    ("we're doing", "decision", 0.70), ("chose ", "decision", 0.70),
    ("my guess is", "hypothesis", 0.80), ("i bet ", "hypothesis", 0.65), ("i think ", "hypothesis", 0.55), ("probably ", "hypothesis", 0.50), ("should be ", "hypothesis", 0.45),
)
#: Fixed values of cards: least score, rest of a target in seconds, cards an hour.
LEAST_SCORE, REST, PER_HOUR = 0.18, 1800, 8


def mine(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, at, phrase, kind, start, statement, confidence: of each sentence the longest phrase that starts a word in it (ties: the higher worth, then the earlier).

    Sentences end at ``. ! ?`` or a line's end. ``start`` is the phrase's place in its sentence; the statement goes from there to the sentence's end, and
    one of fewer than four words costs 0.05, down to 0.05. A phrase's first place in a sentence counts, so what a sentence states is known without a fold.
    """
    s = docs.select(F.col(key).alias("id"), F.posexplode(F.split(F.col(text), "[.!?\n]")).alias("at", "sentence"))
    s = s.withColumn("low", F.lower("sentence")).filter(F.col("low").rlike("|".join(p for p, _, _ in PHRASES)))

    def found(order: int, phrase: str, kind: str, worth: float) -> Column:
        place = F.regexp_instr("low", F.lit(f"(?<![a-z0-9_'])(?:{phrase})"))
        best = [F.lit(len(phrase)).alias("length"), F.lit(worth).alias("worth"), (-place).alias("back"), F.lit(-order).alias("order")]
        return F.when(place > 0, F.struct(*best, F.lit(phrase).alias("phrase"), F.lit(kind).alias("kind")))

    top = s.withColumn("x", F.array_max(F.filter(F.array(*[found(i, *p) for i, p in enumerate(PHRASES)]), lambda x: x.isNotNull()))).filter("x is not null")
    start = -F.col("x.back") - 1
    out = top.select("id", "at", "x.phrase", "x.kind", start.alias("start"), F.trim(F.substring("sentence", start + 1, F.length("sentence"))).alias("statement"), F.col("x.worth").alias("worth"))
    short = F.size(F.split("statement", "\\s+")) < 4
    return out.withColumn("confidence", F.when(short, F.greatest(F.col("worth") - 0.05, F.lit(0.05))).otherwise(F.col("worth"))).drop("worth")


def without_overlaps(spans: DataFrame) -> DataFrame:
    """``spans``: doc, start, length, ... Longest first, ties to the first and then to the least id, each that overlaps none taken before.

    A fold over a document's spans in that order; they are those of one sentence or document.
    """
    fields = [c for c in spans.columns if c != "doc"]
    order = F.struct((-F.col("length")).alias("n"), "start", *[c for c in fields if c not in ("start", "length")])
    row = F.struct(order.alias("o"), F.struct(*fields).alias("r"))
    ordered = spans.groupBy("doc").agg(F.array_sort(F.collect_list(row)).alias("s"))
    empty = F.filter(F.col("s"), lambda x: F.lit(False))

    def take(done: Column, x: Column) -> Column:
        clash = F.exists(done, lambda y: (x["r"]["start"] < y["r"]["start"] + y["r"]["length"]) & (y["r"]["start"] < x["r"]["start"] + x["r"]["length"]))
        return F.when(clash, done).otherwise(F.concat(done, F.array(x)))

    return ordered.select("doc", F.explode(F.aggregate("s", empty, take)).alias("k")).select("doc", "k.r.*")


def arcs(commitments: DataFrame, links: DataFrame, needs: DataFrame, actions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Each commitment with how many needs it is linked with, its actions and its outcome."""
    n = links.join(needs.select(F.col("id").alias("need_id"), "text"), "need_id").groupBy(F.col("commitment_id").alias("id")).agg(F.count_distinct("text").alias("needs"))
    a = actions.groupBy(F.col("commitment_id").alias("id")).agg(F.count("*").alias("actions"), F.max("seen_at").alias("last_action"))
    o = outcomes.select(F.col("commitment_id").alias("id"), "polarity")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return commitments.select("id", "state").join(n, "id", "left").join(a, "id", "left").join(o, "id", "left").select("id", "state", zero("needs"), zero("actions"), "last_action", "polarity")


def uniform(kinds: dict[str, DataFrame]) -> DataFrame:
    """kind, id, text over several tables with id and text."""
    parts = [df.select(F.lit(k).alias("kind"), F.col("id").cast("long").alias("id"), "text") for k, df in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_proposals(proposals: DataFrame) -> DataFrame:
    """``proposals``: id, kind, target_id, ord. One of each kind and target: the first source's."""
    return proposals.groupBy("kind", "target_id").agg(F.min_by("id", F.struct("ord", "id")).alias("id"))


def admit(cards: DataFrame, host: str) -> DataFrame:
    """``cards``: id, target_id, score, seen_at and a host. Those that are shown to each host, in order of time.

    A card needs ``LEAST_SCORE``; its target must have rested ``REST`` seconds, and the host have had fewer than ``PER_HOUR`` cards in the hour before. What is shown
    depends on all that was shown before, so a host's cards are a fold; cards under the score are dropped before they are moved.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        last: dict = {}
        shown: list[int] = []
        out = []
        for card, target, at in pdf.sort_values(["seen_at", "id"])[["id", "target_id", "seen_at"]].itertuples(index=False):
            while shown and shown[0] <= at - 3600:
                shown.pop(0)
            if at - last.get(target, -REST) >= REST and len(shown) < PER_HOUR:
                last[target] = at
                shown.append(at)
                out.append(card)
        return pd.DataFrame({"host": pd.Series([pdf["host"].iloc[0]] * len(out), dtype="int64"), "id": pd.Series(out, dtype="int64")})

    some = cards.filter(F.col("score") >= LEAST_SCORE).select(F.col(host).cast("long").alias("host"), "id", "target_id", "seen_at")
    return some.groupBy("host").applyInPandas(fold, "host long, id long")


def brief(commitments: DataFrame, outcomes: DataFrame, candidates: DataFrame, proposals: DataFrame, pending: DataFrame, now: Column) -> DataFrame:
    """section, id, ord (weight of the section), rank (order in it), place, total. Overdue commitments are in classes by how late they are, and not open again."""
    live = commitments.filter(F.col("state").isin("open", "acted")).withColumn("late", F.when(F.col("horizon") <= now, S.lag_class(F.col("horizon"), now)))
    part = lambda df, section, i, ord_, rank: df.select(section.alias("section"), F.col(i).alias("id"), F.lit(ord_).alias("ord"), rank.cast("long").alias("rank"))
    parts = [
        part(live.filter("late is not null"), F.concat(F.lit("overdue_"), "late"), "id", 1, S.seconds(F.col("horizon"))),
        part(live.filter("late is null"), F.lit("open"), "id", 2, -S.seconds(F.col("made_at"))),
        part(outcomes, F.lit("resolved"), "commitment_id", 3, -S.seconds(F.col("observed_at"))),
        part(candidates.filter("status = 'pending'"), F.lit("candidates"), "id", 4, -F.col("created_at")),
        part(proposals.filter("status = 'pending'"), F.lit("proposals"), "id", 5, -F.col("created_at")),
        part(pending.filter("status = 'pending'"), F.lit("pending"), "id", 6, -F.round(F.col("confidence") * 1000)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    totals = out.groupBy("section").agg(F.count("*").alias("total"))
    w = Window.partitionBy("section").orderBy("rank", "id")
    return out.withColumn("place", F.row_number().over(w)).join(F.broadcast(totals), "section")  # a row for each section


def insight_gate(said: DataFrame) -> DataFrame:
    """``said``: polarity, said. Whether predictions may be shown: enough of them, right often enough, and warnings mostly true."""
    g = said.agg(F.count("*").alias("n"), F.avg((F.col("said") == F.col("polarity")).cast("double")).alias("accuracy"), F.count_if(F.col("said") == -1).alias("warnings"), F.count_if((F.col("said") == -1) & (F.col("polarity") == -1)).alias("hits"))
    gate = F.when(F.col("n") < 8, "too_few").when(F.col("accuracy") < 0.35, "inaccurate").when((F.col("warnings") > 0) & (F.col("hits") / F.col("warnings") < 0.5), "false_alarms").otherwise("open")
    return g.select("n", F.round("accuracy", 6).alias("accuracy"), gate.alias("gate"))
