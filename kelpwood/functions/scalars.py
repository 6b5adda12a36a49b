"""Column expressions: scores, decay, vectors as arrays, names and text tests. All run inside generated code on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ----------------------------------------------------------------- vectors


def let(value, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` names it for each element of an array."""
    return F.transform(F.array(value), use)[0]


def unit(a) -> Column:
    """``a`` at unit length; without length as it is."""
    sized = let(a, lambda v: F.struct(v.alias("v"), norm(v).alias("n")))
    return let(sized, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(x)))


def dot(a, b) -> Column:
    """Inner product of two arrays, in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """0 for arrays of unequal length or without length."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def slice_and_normalize(a, dim: int) -> Column:
    """The first ``dim`` components at unit length."""
    return unit(F.slice(a, 1, dim))


def softmax(a) -> Column:
    top = let(a, lambda v: F.struct(v.alias("v"), F.array_max(v).alias("m")))
    e = let(top, lambda s: F.transform(s["v"], lambda x: F.exp(x - s["m"])))
    both = let(e, lambda v: F.struct(v.alias("v"), F.aggregate(v, F.lit(0.0), lambda s, x: s + x).alias("total")))
    return let(both, lambda s: F.transform(s["v"], lambda x: x / s["total"]))


def jaccard(a, b) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def hamming(a, b) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


# ----------------------------------------------------------------- scores
def wilson_lower(k, n, z: float = 1.96) -> Column:
    """Lower end of the Wilson interval."""
    p, z2 = k / n, z * z
    return F.when(n > 0, (p + z2 / (2 * n) - z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)).otherwise(0.0)


def recency(hours, rate: float = 0.05) -> Column:
    return F.exp(-rate * hours)


def half_life(age, life: float) -> Column:
    return F.pow(F.lit(2.0), -age / life)


def novelty(count) -> Column:
    return 1 / (1 + F.log1p(count))


def retention(recent, new) -> Column:
    """exp(-(1 - recency) / stability) with stability 1 + round(1 / novelty) / 2."""
    return F.exp(-(1 - recent) / (1 + 0.5 * F.round(1 / new)))


def salience(age_days, degree) -> Column:
    return 0.5 * F.exp(-age_days * F.lit(0.6931471805599453) / 14) + 0.5 * F.tanh(degree / 8)


def seconds(ts) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def minutes_between(late, early) -> Column:
    return F.floor((seconds(late) - seconds(early)) / 60)


def time_window(ts) -> Column:
    h = F.hour(ts)
    return F.when(h.between(5, 11), "morning").when(h.between(12, 17), "afternoon").when(h.between(18, 22), "evening").otherwise("night")


def time_band(ts) -> Column:
    h = F.hour(ts)
    return F.when(h.between(5, 11), "morning").when(h.between(12, 16), "afternoon").when(h.between(17, 21), "evening").otherwise("night")


def verb_band(ts) -> Column:
    h = F.hour(ts)
    return F.when(h.between(6, 11), "morning").when(h.between(12, 17), "afternoon").when(h.between(18, 21), "evening").otherwise("night")


def tier(age_days) -> Column:
    return F.when(age_days < 1, "hot").when(age_days < 7, "warm").otherwise("cold")


def route(conf) -> Column:
    return F.when(conf >= 0.7, "accept").when(conf >= 0.3, "pending").otherwise("drop")


def lag_class(horizon, now) -> Column:
    h = (seconds(now) - seconds(horizon)) / 3600
    return F.when(h <= 24, "due").when(h <= 168, "stale").otherwise("cold")


def effective_confidence(conf, status) -> Column:
    return F.least(F.greatest(F.when(status == "in", conf).when(status == "contradicted", conf * 0.5).otherwise(0.0), F.lit(0.0)), F.lit(1.0))


def memory_op(similarity, same_name, same_type) -> Column:
    return F.when(similarity < 0.4, "add").when((similarity > 0.9) & same_name, F.when(same_type, "noop").otherwise("update")).when((similarity > 0.75) & same_name, "update").otherwise("add")


# ----------------------------------------------------------------- names and text
def normalize_name(name) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[_-]", " "), " +", " "))


def fingerprint(name) -> Column:
    """Lower case, marks to spaces, without a possessive or plural s; empty below three characters."""
    s = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))
    s = F.regexp_replace(s, " s$", "")
    s = F.when(s.rlike("[^s]s$"), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)
    return F.when(F.length(s) < 3, "").otherwise(s)


def slug(name) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def humanize(pred) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(pred, "([a-z])([A-Z])", "$1 $2"), "_", " ")))


def tokens(text) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def lexical_tokens(text) -> Column:
    """Search terms: runs of letters, digits and ``: . $ - '`` with A-Z in lower case, without a possessive and without ``. - '`` at the ends."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.regexp_extract_all(low, F.lit("[\\p{L}\\p{N}:.$'-]+"), F.lit(0))
    clean = F.transform(runs, lambda t: F.regexp_replace(F.regexp_replace(t, "'s$", ""), "^[.'-]+|[.'-]+$", ""))
    return F.filter(clean, lambda t: t != "")


def hashtags(text) -> Column:
    found = F.regexp_extract_all(text, F.lit("(?:^|[^A-Za-z0-9])#([A-Za-z0-9_]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda t: F.lower(t)))


EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
SSN = "(^|[^0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}($|[^0-9])"
CARD = "(^|[^0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}($|[^0-9])"
PHONE = "(^|[^0-9])(\\+1[ .-]?)?\\(?[0-9]{3}\\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}($|[^0-9])"
MARKER = "https?://|(^|\\s)/[a-z]+/|```|[{\\[]\"|[A-Z_]{3,}="


def has_email(text) -> Column:
    return text.rlike(EMAIL)


def has_ssn(text) -> Column:
    return text.rlike(SSN)


def has_credit_card(text) -> Column:
    return text.rlike(CARD)


def has_phone(text) -> Column:
    return text.rlike(PHONE)


def has_structured_marker(text) -> Column:
    return text.rlike(MARKER)


def redact(text) -> Column:
    """Mask e-mail addresses, social security and card numbers."""
    out = F.regexp_replace(text, EMAIL, "[email]")
    out = F.regexp_replace(out, SSN, "$1[ssn]$2")
    return F.regexp_replace(out, CARD, "$1[card]$2")


def lexical_entropy(text) -> Column:
    """Distinct words of all words."""
    t = tokens(text)
    return F.when(F.size(t) > 0, F.size(F.array_distinct(t)) / F.size(t)).otherwise(0.0)


def polarity_of(text) -> Column:
    t = F.lower(text)
    return F.when(t.rlike("\\b(fail|failed|missed|broke|late)\\b"), -1).when(t.rlike("\\b(done|kept|finished|shipped)\\b"), 1).otherwise(0)


def strip_frontmatter(text) -> Column:
    """Drop a leading fenced block (--- or +++); one that doesn't end stays."""
    return F.regexp_replace(text, "(?s)\\A(---|\\+\\+\\+)\\n.*?\\n\\1(\\n|\\z)", "")
