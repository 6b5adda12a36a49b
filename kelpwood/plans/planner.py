"""Questions to plans: ordered rules pick a retrieval pipeline, and the pipelines are DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNITS = {"day": 1, "week": 7, "month": 30, "year": 365}
_TEMPORAL = re.compile(r"\b(today|yesterday|recently|last|ago|this (week|month|year))\b")
LADDER = ("direct_lookup", "bandit_retrieval", "decompose")


@dataclass(frozen=True)
class Plan:
    action: str
    parts: tuple[str, ...] = ()
    confidence: float = 0.8
    window: tuple[datetime, datetime] | None = field(default=None)


def time_range(text: str, now: datetime) -> tuple[datetime, datetime] | None:
    """Half-open bounds of the first time phrase."""
    low, day = text.lower(), now.replace(hour=0, minute=0, second=0, microsecond=0)
    if "today" in low:
        return day, day + timedelta(days=1)
    if "yesterday" in low:
        return day - timedelta(days=1), day
    if "recently" in low:
        return now - timedelta(days=3), now
    if m := re.search(r"last (\d+) (day|week|month|year)s?", low):
        return now - timedelta(days=int(m[1]) * UNITS[m[2]]), now
    if m := re.search(r"(\d+) (day|week|month|year)s? ago", low):
        n, unit = int(m[1]), UNITS[m[2]]
        return now - timedelta(days=(n + 1) * unit), now - timedelta(days=(n - 1) * unit)
    if m := re.search(r"(last|this) (week|month|year)", low):
        days = UNITS[m[2]]
        start = {"week": day - timedelta(days=day.weekday()), "month": day.replace(day=1), "year": day.replace(month=1, day=1)}[m[2]]
        return (start, now) if m[1] == "this" else (start - timedelta(days=days), start)
    return None


def plan(question: str, now: datetime | None = None) -> Plan:
    q = question.lower().strip(" ?.!")
    words = q.split()
    if _TEMPORAL.search(q):
        return Plan("temporal", window=time_range(q, now) if now else None)
    if re.search(r"\b(consolidate|clean up)\b", q):
        return Plan("consolidate")
    if re.search(r"\b(analog|similar to|like)", q):
        return Plan("analogy")
    if re.search(r"\b(related to|connect(ed|ion)?|path (from|between))\b", q):
        return Plan("relation_chain")
    parts = tuple(p.strip() for p in re.split(r"\band\b|,|;", q) if p.strip())
    if len(parts) >= 3:
        return Plan("decompose", parts)
    return Plan("direct_lookup") if len(words) < 5 and len(parts) < 2 else Plan("bandit_retrieval", parts if len(parts) > 1 else ())


def replan(p: Plan, quality: float) -> Plan:
    """A poor answer moves one step up the ladder."""
    if quality > 0.4 or p.action not in LADDER[:-1]:
        return p
    return Plan(LADDER[LADDER.index(p.action) + 1], p.parts, p.confidence * 0.7, p.window)


def replan_with_context(p: Plan, error: str) -> Plan:
    """What an error says decides: nothing found, too little likeness, or a cascade that is spent; else like a poor answer."""
    low = error.lower()
    if "0 entities" in low or "no entities" in low:
        step = {"direct_lookup": ("bandit_retrieval", 0.6), "bandit_retrieval": ("relation_chain", 0.4)}.get(p.action)
        return Plan(step[0], p.parts, step[1], p.window) if step else Plan(p.action, p.parts, 0.1, p.window)
    if ("low similarity" in low or "max_sim" in low) and p.parts:
        return Plan("analogy", p.parts, 0.5, p.window)
    if "cascade" in low or "exhausted" in low:
        return Plan(p.action, p.parts, 0.0, p.window)
    again = replan(p, 0.0)
    return again if again != p else Plan(p.action, p.parts, min(p.confidence * 0.7, 0.5), p.window)


@dataclass(frozen=True)
class Variant:
    text: str
    kind: str
    weight: float


#: Words that start questions, words of time, words of change, pronouns.
ASKING = ("what", "who", "when", "where", "why", "how", "which")
TIMES = ("when", "before", "after", "since", "until", "recently", "last", "first")
CHANGES = ("not", "no longer", "changed", "moved", "left", "quit", "ended")
PRONOUNS = ("it", "they", "he", "she", "this", "that")


def named(question: str) -> list[str]:
    """Quoted strings, and capitalised words that don't only ask."""
    quoted = re.findall(r'"([^"]+)"', question)
    words = [w.strip("?.,!") for w in question.split()]
    return list(dict.fromkeys([*quoted, *(w for w in words if w[:1].isupper() and w.lower() not in ASKING)]))


def expand(question: str, most: int = 4) -> list[Variant]:
    """The question and up to three variants of it: who and what, without time words or recent, of change, with pronouns resolved, of owners."""
    out = [Variant(question, "original", 1.0)]
    low, names = question.lower(), named(question)

    def add(text: str, kind: str, weight: float) -> None:
        if len(out) < most and text.lower() not in {v.text.lower() for v in out}:
            out.append(Variant(text, kind, weight))

    for name in names:
        add(f"who is {name}", f"who:{name}", 0.7)
        add(f"what is {name}", f"what:{name}", 0.65)
    if any(w in low for w in TIMES):
        add(" ".join(w for w in low.split() if w.strip("?.,!") not in TIMES), "temporal-stripped", 0.6)
    if names and "recent" not in low and "current" not in low:
        add(f"{question} recent", "temporal-recent", 0.5)
    if names and any(w in low for w in CHANGES):
        add(f"what changed about {names[0]} recently", "change-variant", 0.55)
    for p in PRONOUNS:
        if names and p in low.split():
            add(re.sub(rf"\b{p}\b", names[0], question, flags=re.IGNORECASE), f"deref:{p}", 0.6)
            break
    for owner in [w for w in question.split() if w.endswith(("'s", "s'"))][:2]:
        name = owner.removesuffix("'s").removesuffix("s'")
        add(f"information about {name}", f"multihop:{name}", 0.5)
    return out[:most]


def _entropy(question: str) -> float:
    words = question.split()
    if not words:
        return 0.0
    if len(words) <= 2:
        return 0.6 if "?" in question or question.lower().startswith(ASKING) else 0.1
    return 0.2 + 0.8 * len(set(words)) / len(words)


def should_retrieve(question: str, host: str | None = None, held: bool = False, command: bool = False, miss_rate: float = 0.0) -> bool:
    """No for capturing hosts, what working memory holds, commands, questions that say too little, and where most answers missed."""
    return not (host in ("capture", "clipboard") or held or command or _entropy(question) < 0.15 or miss_rate > 0.8)


def _words(text):
    return F.filter(F.split(F.trim(text), "\\s+"), lambda w: w != "")


def query_entropy(text):
    """The same as an expression over a column of questions."""
    w = _words(text)
    asks = text.contains("?") | F.lower(text).rlike("^(what|who|when|where|why|how|which)")
    return F.when(F.size(w) == 0, 0.0).when(F.size(w) <= 2, F.when(asks, 0.6).otherwise(0.1)).otherwise(0.2 + 0.8 * F.size(F.array_distinct(w)) / F.size(w))


def complexity(text):
    """complex: twelve words or more, or several clauses."""
    return F.when((F.size(_words(text)) >= 12) | text.contains(",") | F.lower(text).rlike("\\b(and|but)\\b"), "complex").otherwise("simple")


def entity_hints(text):
    """Capitalised words that don't only ask, each once."""
    words = F.array_distinct(F.split(text, "[^\\p{L}]+"))
    return F.filter(words, lambda w: w.rlike("^[A-Z][a-z]+$") & ~w.isin("What", "Who", "When", "Where", "Why", "How", "Which", "The"))


def retrieve(question: str, signals: DataFrame, now: datetime, k: int = 10) -> DataFrame:
    """``signals``: id, text, at. Lexical scores; with a time phrase only rows in it, weighed 0.6 to 0.4 with recency; parts of a question by their best score."""
    from ..operators.text import bm25

    p = plan(question, now)
    rows = signals.filter((F.col("at") >= F.lit(p.window[0])) & (F.col("at") < F.lit(p.window[1]))) if p.window else signals
    spark = signals.sparkSession
    parts = spark.createDataFrame(list(enumerate(p.parts or (question,))), "query_id int, query string")
    best = bm25(rows, "id", "text", parts).groupBy("id").agg(F.max("score").alias("score"))
    best = best.join(F.broadcast(best.agg(F.max("score").alias("top")))).withColumn("score", F.col("score") / F.col("top")).drop("top")
    if p.window:
        age = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("at").cast("timestamp"))) / 86400
        best = best.join(rows.select("id", "at"), "id").withColumn("score", 0.6 * F.col("score") + 0.4 * F.pow(F.lit(2.0), -age / 7)).drop("at")
    return best.orderBy(F.desc("score"), "id").limit(k)
