"""The ingest side as columns: gates, commitment detection, due dates, heuristics for entities and triples, memory decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Phrases at the start of an utterance (confidence 0.8) and inside it (0.6), with their labels.
PREFIXES = (
    ("i'll ", "first_person_future_contracted"), ("i will ", "first_person_future"), ("i'm going to ", "first_person_going_to"), ("i am going to ", "first_person_going_to"), ("i'm gonna ", "first_person_gonna"), ("let me ", "let_me"),
    ("remind me to ", "remind_me"), ("todo: ", "todo_colon"), ("todo - ", "todo_dash"), ("todo ", "todo_bare"), ("i promise to ", "promise"), ("i commit to ", "commit"),
)
INFIXES = ((" i'll ", "first_person_future_contracted_mid"), (" i will ", "first_person_future_mid"), (" i'm going to ", "first_person_going_to_mid"))
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Words that say nothing by themselves, for the gate.
STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "to", "of", "in", "for",
    "on", "with", "at", "by", "from", "it", "its", "this", "that", "and", "or", "but", "not", "no", "if", "then", "so", "as", "i", "me", "my", "we", "you", "your", "he", "she", "they",
)


def first_match(rules, default: Column) -> Column:
    """``rules``: (condition, value) in order; the first that holds."""
    out = None
    for cond, value in rules:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default)


def commitment(text: Column, today: Column) -> Column:
    """struct(confidence, pattern, due date), null if no phrase fires. A due date adds 0.1, to 0.95 at most."""
    low = F.lower(F.trim(text))
    pattern = first_match([(low.startswith(p), F.lit(label)) for p, label in PREFIXES] + [(low.contains(p), F.lit(label)) for p, label in INFIXES], F.lit(None).cast("string"))
    base = F.when(pattern.endswith("_mid"), 0.6).otherwise(0.8)
    due = due_date(low, today)
    conf = F.when(due.isNotNull(), F.least(base + 0.1, F.lit(0.95))).otherwise(base)
    return F.when(pattern.isNotNull(), F.struct(F.round(conf, 6).alias("confidence"), pattern.alias("pattern"), due.alias("due")))


def due_date(low: Column, today: Column) -> Column:
    """The date of the first hint, in fixed order: ISO date, today, tomorrow, end of week, in n days or weeks, a weekday."""
    until = lambda day: (F.lit(day) - F.weekday(today) + 7) % 7
    iso = F.regexp_extract(low, "(?:by|on|before) (\\d{4}-\\d{2}-\\d{2})", 1)
    span = lambda unit: F.regexp_extract(low, f"in (\\d+) {unit}", 1)
    rules = [(iso != "", F.try_to_date(F.nullif(iso, F.lit("")))), (low.rlike("tonight|today"), today), (low.contains("tomorrow"), F.date_add(today, 1)), (low.rlike("this week|eow|end of week"), F.date_add(today, until(4)))]
    rules += [(span("day") != "", F.date_add(today, F.nullif(span("day"), F.lit("")).try_cast("int"))), (span("week") != "", F.date_add(today, 7 * F.nullif(span("week"), F.lit("")).try_cast("int")))]
    rules += [(low.contains(f"{word} {name}"), F.date_add(today, F.when((F.lit(word) == "next") & (until(i) < 7), until(i) + 7).otherwise(until(i)))) for word in ("by", "next", "this") for i, name in enumerate(WEEKDAYS)]
    return first_match(rules, F.lit(None).cast("date"))


def gate(text: Column, nearest: Column) -> Column:
    """'pii', 'short', 'duplicate' or 'ok': three words that aren't stopwords, and nothing stored that is nearer than 0.95."""
    words = F.filter(S.tokens(text), lambda t: ~t.isin(*STOPWORDS))
    return F.when(S.has_email(text) | S.has_ssn(text) | S.has_credit_card(text), "pii").when(F.size(words) < 3, "short").when(nearest > 0.95, "duplicate").otherwise("ok")


def signal_tier(text: Column, similarity: Column) -> Column:
    """1: structured; 4: redundant; 2: new or dense; else 3."""
    return F.when(S.has_structured_marker(text), 1).when(similarity >= 0.85, 4).when((similarity < 0.4) | (S.lexical_entropy(text) > 0.7), 2).otherwise(3)


def capitalised(text: Column) -> Column:
    """Runs of capitalised words, each once, in order of first place."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)*)"), F.lit(1)))


def token_type(token: Column) -> Column:
    return F.when(token.rlike("^https?://"), "url").when(token.rlike("^[\\w./-]+\\.(rs|py|md|json|toml|txt|csv|html)$"), "file").when(F.lower(token).isin("rust", "python", "spark", "sql", "parquet", "docker", "linux"), "technology").when(token.rlike("^[A-Z][a-z]+$"), "person").when(token.rlike("^[A-Z][A-Za-z]*[0-9_-]*$"), "concept")


#: Verbs between two mentions and the relation they state.
RELATIONS = (("works at", "works_at"), ("works on", "works_on"), ("depends on", "depends_on"), ("uses", "uses"), ("manages", "manages"), ("owns", "owns"), ("part of", "part_of"), ("located in", "located_in"), ("created", "created"), ("is a", "is_a"))


def triples_in(docs: DataFrame, key: str, text: str, confidence: float = 0.75) -> DataFrame:
    """key, subject, predicate, object: a verb phrase with a capitalised name right before and after it."""
    name = "([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)*)"

    def stated(verb, pred):
        found = F.regexp_extract_all(F.col(text), F.lit(f"{name} (?:is )?{verb} (?:the |a |an )?{name}"), F.lit(0))
        plain = lambda m: F.regexp_replace(m, f" is {verb} ", f" {verb} ")
        part = lambda m, i: F.trim(F.split_part(plain(m), F.lit(f" {verb} "), F.lit(i)))
        return F.transform(found, lambda m: F.struct(part(m, 1).alias("subject"), F.lit(pred).alias("predicate"), F.regexp_replace(part(m, 2), "^(the|a|an) ", "").alias("object")))

    found = [stated(verb, pred) for verb, pred in RELATIONS]
    return docs.select(F.col(key).alias("id"), F.explode(F.array_distinct(F.concat(*found))).alias("t")).select("id", "t.*", F.lit(confidence).alias("confidence"))


def route(triples: DataFrame) -> dict[str, DataFrame]:
    """Accepted at 0.7, pending at 0.3, else dropped."""
    r = triples.withColumn("route", S.route(F.col("confidence")))
    return {x: r.filter(F.col("route") == x).drop("route") for x in ("accept", "pending", "drop")}


def consolidate_groups(signals: DataFrame, links: DataFrame, least: int = 2) -> DataFrame:
    """``signals``: id, text; ``links``: a, b of similar signals. One row per component of ``least`` members: its longest text by words stands for it."""
    from .graph import components

    label = components(links)
    sized = signals.join(label, "id").withColumn("n", F.size(S.tokens(F.col("text"))))
    return sized.groupBy("label").agg(F.count("*").alias("members"), F.max_by("text", F.struct("n", -F.col("id"))).alias("text")).filter(F.col("members") >= least)


def daily_note(entities: DataFrame, edges: DataFrame, day: str) -> DataFrame:
    """Edges from the day's hub to the entities made that day that it doesn't have yet."""
    hub = f"note-{day}"
    new = entities.filter(F.to_date("created_at") == F.lit(day).cast("date")).select(F.lit(hub).alias("subject_id"), F.lit("related_to").alias("predicate"), F.col("id").alias("object_id"))
    return new.join(edges.select("subject_id", "predicate", "object_id"), ["subject_id", "predicate", "object_id"], "left_anti")


def relation_suggestions(entities: DataFrame, edges: DataFrame, least: float = 0.75, k: int = 5) -> DataFrame:
    """``entities``: key (long), id, name, vector; ``edges``: a, b. a < b (ids), score: entities among each other's ``k`` nearest by cosine, of ``least`` at least, that no edge links.

    Once for each pair of names (without regard to case): the most alike, then the least ids. Entities of equal names aren't suggested to each other.
    """
    from .neighbours import k_nearest

    near = k_nearest(entities.select("key", "vector"), "key", "vector", k)
    alike = near.select("id", F.explode(F.arrays_zip("nbr", "d")).alias("z")).select(F.col("id").alias("key"), F.col("z.nbr").alias("other"), (1 - F.col("z.d") * F.col("z.d") / 2).alias("score"))
    low = entities.select("key", "id", F.lower("name").alias("name"))
    one = alike.filter(F.col("score") >= least).join(low, "key").join(low.select(F.col("key").alias("other"), F.col("id").alias("id2"), F.col("name").alias("name2")), "other")
    pairs = one.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), F.least("name", "name2").alias("n1"), F.greatest("name", "name2").alias("n2"), "score").filter("n1 <> n2")
    linked = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    best = F.min(F.struct((-F.round("score", 12)).alias("s"), "a", "b")).alias("m")
    return pairs.join(linked, ["a", "b"], "left_anti").groupBy("n1", "n2").agg(best).select("m.a", "m.b", (-F.col("m.s")).alias("score"))


# ----------------------------------------------------------------- names
#: Shapes of keys and tokens.
SECRET = "^(sk-|ghp_|gho_|AKIA|xox[bp]-|eyJ)[A-Za-z0-9_.-]{8,}$"
TAGS = {"person": "people", "organization": "orgs", "place": "places"}


def type_tag(entity_type: Column) -> Column:
    return first_match([(entity_type == k, F.lit(v)) for k, v in TAGS.items()], F.concat(entity_type, F.lit("s")))


def has_high_entropy(word: Column) -> Column:
    """More than eight bytes, of which over seven tenths are different characters."""
    distinct = F.size(F.array_distinct(F.split(word, "")))
    return (F.octet_length(word) > 8) & (distinct / F.octet_length(word) > 0.7)


def looks_like_secret(word: Column) -> Column:
    return word.rlike(SECRET) | has_high_entropy(word)


def multi_word_type(name: Column, organizations: tuple[str, ...], technology: tuple[str, ...]) -> Column:
    """An organisation by its last word, technology by any word, else a concept."""
    words = F.split(F.lower(name), " ")
    tech = F.arrays_overlap(words, F.array(*[F.lit(w) for w in technology]))
    return F.when(F.element_at(words, -1).isin(*organizations), "organization").when(tech, "technology").otherwise("concept")


def quality_name(name: Column, unwanted: tuple[str, ...] = ()) -> Column:
    return (F.length(name) >= 3) & ~name.rlike("^[0-9#]+$") & ~F.lower(name).isin(*unwanted)


def triple_prompt(text: Column) -> Column:
    return F.concat(F.lit("Extract triples from: "), text)


def parse_triples(df: DataFrame, key: str, reply: str) -> DataFrame:
    """key, subject, predicate, object from replies of one JSON object a line; other lines and incomplete objects are left out."""
    line = df.select(F.col(key).alias("id"), F.explode(F.split(F.col(reply), "\n")).alias("line"))
    t = line.select("id", F.from_json("line", "subject string, predicate string, object string").alias("t"))
    return t.filter("t.subject is not null and t.predicate is not null and t.object is not null").select("id", "t.*")


def greedy_spans(hits: DataFrame, cutoff: float = 0.3) -> DataFrame:
    """``hits``: doc, start, length, label, score of a span model. Above the cutoff, best first, ties to the longer and then the earlier, none overlapping.

    A fold over a document's hits in that order.
    """
    row = F.struct((-F.col("score")).alias("s"), (-F.col("length")).alias("l"), "start", "length", "label", "score")
    ordered = hits.filter(F.col("score") >= cutoff).groupBy("doc").agg(F.array_sort(F.collect_list(row)).alias("h"))
    empty = F.filter(F.col("h"), lambda x: F.lit(False))

    def take(done: Column, x: Column) -> Column:
        clash = F.exists(done, lambda y: (x["start"] < y["start"] + y["length"]) & (y["start"] < x["start"] + x["length"]))
        return F.when(clash, done).otherwise(F.concat(done, F.array(x)))

    return ordered.select("doc", F.explode(F.aggregate("h", empty, take)).alias("k")).select("doc", "k.start", "k.length", "k.label", "k.score")


# ----------------------------------------------------------------- whole paths
#: Captures a minute and at once, by source.
LIMITS = {"clipboard": (60, 30), "shell": (120, 60), "notes": (30, 15), "screenshot": (12, 6), "browser": (60, 30), "audio": (30, 15), "calendar": (6, 3), "other": (30, 15)}


def fast_path(docs: DataFrame, nearest: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, text, gate, tier: equal texts once (the least id), the gate, and the tier of what passes. ``nearest``: likeness to what is stored, of ``key``."""
    once = docs.groupBy(F.col(text).alias("text")).agg(F.min(key).alias(key))
    g = once.select(F.col(key).alias("id"), "text", nearest.alias("sim")).withColumn("gate", gate(F.col("text"), F.col("sim")))
    return g.withColumn("tier", F.when(F.col("gate") == "ok", signal_tier(F.col("text"), F.col("sim")))).drop("sim")


def slow_path(docs: DataFrame, key: str, text: str) -> dict[str, DataFrame]:
    """``refused`` (personal data), ``entities`` (id, name), ``triples``, and those ``accepted``, ``pending`` or to ``drop`` by their confidence."""
    t = F.col(text)
    pii = F.coalesce(S.has_email(t) | S.has_ssn(t) | S.has_credit_card(t), F.lit(False))
    clean = docs.filter(~pii)
    names = clean.select(F.col(key).alias("id"), F.explode(capitalised(t)).alias("name"))
    triples = triples_in(clean, key, text)
    routed = route(triples)
    return {"refused": docs.filter(pii), "entities": names, "triples": triples, "accepted": routed["accept"], "pending": routed["pending"], "drop": routed["drop"]}
