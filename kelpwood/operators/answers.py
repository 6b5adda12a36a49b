"""Answers from grounding: best sentences, coverage summaries, contradictions between texts, grounding classes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import tokens


def sentences(df: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    parts = F.transform(F.split(F.col(text), "(?<=[.!?])\\s+"), lambda s: F.trim(s))
    return df.select(F.col(key).alias("id"), *keep, F.posexplode(parts).alias("at", "sentence")).filter("sentence <> ''")


def short_answer(chunks: DataFrame, question: str) -> DataFrame:
    """``chunks``: id, text, score. The sentence with the most of the question's words, plus a tenth of its chunk's score."""
    q = tokens(F.lit(question))
    s = sentences(chunks, "id", "text", "score").withColumn("value", F.size(F.array_intersect(tokens(F.col("sentence")), q)) + 0.1 * F.col("score"))
    return s.orderBy(F.desc("value"), "id", "at").limit(1).select("id", "sentence", "value")


def best_sentences(chunks: DataFrame, question: str) -> DataFrame:
    """The best sentence of each chunk."""
    q = tokens(F.lit(question))
    s = sentences(chunks, "id", "text").withColumn("value", F.size(F.array_intersect(tokens(F.col("sentence")), q)))
    w = Window.partitionBy("id").orderBy(F.desc("value"), "at")
    return s.withColumn("n", F.row_number().over(w)).filter("n = 1").select("id", "sentence", "value")


def coverage_summary(ranked: DataFrame, least_new: int = 3, most: int = 5) -> DataFrame:
    """``ranked``: query_id, at, sentence (some tens a query). Greedy: a sentence is taken for ``least_new`` new words."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, taken = set(), []
        for i, s in pdf.sort_values("at")[["at", "sentence"]].itertuples(index=False):
            words = set(s.lower().split())
            if len(words - seen) >= least_new and len(taken) < most:
                taken.append((i, s))
                seen |= words
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "at": [i for i, _ in taken], "sentence": [s for _, s in taken]})

    return ranked.groupBy("query_id").applyInPandas(one, "query_id long, at int, sentence string")


def dice(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.when(F.size(x) + F.size(y) > 0, 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))).otherwise(0.0)


def possible_contradiction(a: Column, b: Column) -> Column:
    return dice(a, b).between(0.3, 0.8)


def grounding(best: Column, hits: Column) -> Column:
    return F.when(best >= 0.35, "found").when(hits > 0, "uncertain").otherwise("not_stored")


def space_score(scores: dict[str, Column], weights: dict[str, float], pinned: Column | None = None, bounded: bool = True) -> Column:
    """Weighted mean over the spaces that have a score and a positive weight, cut to 0 to 1 if ``bounded``; pinned rows score 1."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, c in scores.items():
        w = weights.get(name, 0.0)
        if w > 0:
            total, weight = total + F.when(c.isNotNull(), w * c).otherwise(0.0), weight + F.when(c.isNotNull(), w).otherwise(0.0)
    out = F.when(weight > 0, total / weight).otherwise(0.0)
    if bounded:
        out = F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))
    return out if pinned is None else F.when(pinned, 1.0).otherwise(out)


# ----------------------------------------------------------------- greedy answers
def greedy(chunks: DataFrame, question: str, share: float, rule: str, most: int = 3) -> DataFrame:
    """``chunks``: id, text, score (a question's grounding, some tens). answer: up to ``most`` of the best sentences in order of worth.

    ``novelty``: the first, then those of which more than 0.4 of the words are new; ``coverage``: those with more than two new words. A fold over the
    sentences in order, in the plan.
    """
    q = tokens(F.lit(question))
    s = sentences(chunks, "id", "text", "score").withColumn("w", F.array_distinct(tokens(F.col("sentence"))))
    worth = F.size(F.array_intersect("w", q)) + share * F.col("score")
    row = F.struct((-worth).alias("v"), "id", "at", "sentence", "w")
    listed = s.agg(F.array_sort(F.collect_list(row)).alias("rows"))
    empty = F.expr("cast(array() as array<string>)")

    def step(acc: Column, x: Column) -> Column:
        new = F.size(F.array_except(x["w"], acc["seen"]))
        first = F.size(acc["taken"]) == 0
        fresh = (first | ((F.size(x["w"]) > 0) & (new / F.size(x["w"]) > 0.4))) if rule == "novelty" else new > 2
        take = (F.size(acc["taken"]) < most) & fresh
        taken = F.when(take, F.concat(acc["taken"], F.array(x["sentence"]))).otherwise(acc["taken"])
        seen = F.when(take, F.array_union(acc["seen"], x["w"])).otherwise(acc["seen"])
        return F.struct(taken.alias("taken"), seen.alias("seen"))

    done = F.aggregate("rows", F.struct(empty.alias("taken"), empty.alias("seen")), step)
    return listed.select(F.array_join(done.getField("taken"), " ").alias("answer"))


def grounding_chunks(signals: DataFrame, triples: DataFrame, entities: DataFrame, named: DataFrame, most: int) -> DataFrame:
    """``signals``: k, chunk. n, part, chunk: signals, edges of which both names are known, entities; the first ``most``."""
    name = lambda side: entities.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(side))
    edges = triples.join(name("subject"), "subject_id").join(name("object"), "object_id")
    edges = edges.select(F.lit(2).alias("part"), F.concat("subject_id", "predicate", "object_id").alias("k"), F.concat("subject", F.lit(" "), "predicate", F.lit(" "), "object", F.lit(".")).alias("chunk"))
    nodes = named.select(F.lit(3).alias("part"), F.col("id").alias("k"), F.concat("name", F.lit(" ("), "entity_type", F.lit(")")).alias("chunk"))
    cut = signals.select(F.lit(1).alias("part"), "k", "chunk").unionByName(edges).unionByName(nodes).orderBy("part", "k").limit(most)
    return cut.select(F.row_number().over(Window.orderBy("part", "k")).alias("n"), "part", "chunk")


def strategy(task: Column, chunks: Column, names: dict[str, str], default: str = "structured") -> Column:
    out = F.lit(default)
    for key, name in names.items():
        out = F.when(task == key, name).otherwise(out)
    return F.when(chunks == 0, "abstain").otherwise(out)


# ----------------------------------------------------------------- question kinds and spans
#: What a date and an amount look like.
DATE = "([0-9]{4}-[0-9]{2}-[0-9]{2})|((January|February|March|April|May|June|July|August|September|October|November|December) ([0-9]{1,2}, )?[0-9]{4})"
MONEY = "([$][0-9][0-9,]*([.][0-9]+)?)|([0-9][0-9,]* dollars)"


def question_kind(q: Column) -> Column:
    """yes_no, date, money, time, reason, named or generic, by the first words and by nouns."""
    low = F.lower(F.trim(q))
    has = lambda w: low.rlike(f"(^| )\\?*{w}\\?*( |$)")
    first = lambda *ws: low.rlike(f"^({'|'.join(ws)})( |$)")
    yes_no = first("did", "does", "do", "is", "are", "was", "were", "has", "have", "had", "will", "can", "could", "should", "would")
    kind = F.when(yes_no, "yes_no").when(first("when"), "date").when(low.rlike("^how (much|many)( |$)"), "money").when(first("how"), "generic")
    kind = kind.when(has("time"), "time").when(first("why"), "reason").when(has("about"), "generic")
    return kind.when(first("who", "whom", "where", "what", "which"), "named").otherwise("generic")


def date_in(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, DATE, 0), F.lit(""))


def money_in(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, MONEY, 0), F.lit(""))


def span(kind: Column, text: Column) -> Column:
    return F.coalesce(F.when(kind == "date", date_in(text)).when(kind == "money", money_in(text)), text)


def allowed(rows: DataFrame, grants: DataFrame, by: str, most_level: int) -> DataFrame:
    """Rows whose ``by`` is granted and whose level isn't above the reader's."""
    return rows.filter(F.col("level") <= most_level).join(grants.select(by), by, "left_semi")
