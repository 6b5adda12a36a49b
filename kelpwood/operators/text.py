"""Lexical scoring, labels, keyphrases, mentions and answer scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import lexical_tokens, tokens

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, len."""
    t = docs.select(F.col(key).alias("id"), tokens(F.col(text)).alias("t")).filter(F.size("t") > 0)
    return t.select("id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame) -> DataFrame:
    """``queries``: query_id, query. Sum over the query's terms (repeated terms count again); only documents with a term are scored.

    Only the queries' terms are kept before anything is shuffled; the statistics of all documents are one aggregate.
    """
    t = docs.select(F.col(key).alias("id"), lexical_tokens(F.col(text)).alias("t")).filter(F.size("t") > 0)
    stats = t.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))
    q = queries.select("query_id", F.explode(lexical_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    wanted = q.select("term").distinct()
    p = t.select("id", F.size("t").alias("len"), F.explode("t").alias("term")).join(F.broadcast(wanted), "term").groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    s = p.join(F.broadcast(df), "term").join(F.broadcast(q), "term").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl"))) * F.col("times")
    return s.groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, group: str, k: int, *order) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def ctfidf(docs: DataFrame, group: str, text: str, k: int = 3, least: int = 3) -> DataFrame:
    """Terms of each group by frequency times ln((groups + 1) / (df + 1)) + 1, of at least ``least`` letters and no number."""
    t = docs.select(F.col(group).alias("grp"), F.explode(tokens(F.col(text))).alias("term")).filter((F.length("term") >= least) & ~F.col("term").rlike("^[0-9]+$"))
    tf = t.groupBy("grp", "term").agg(F.count("*").alias("c"))
    size = tf.groupBy("grp").agg(F.sum("c").alias("len"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = size.agg(F.count("*").alias("n"))
    s = tf.join(F.broadcast(size), "grp").join(df, "term").join(F.broadcast(n))
    s = s.withColumn("score", F.col("c") / F.col("len") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1))
    return top_k(s.select("grp", "term", "score"), "grp", k, F.desc("score"), "term")


#: Words that no phrase may hold.
STOPWORDS = (
    "the", "a", "an", "in", "on", "at", "to", "for", "of", "and", "or", "but", "is", "was", "are", "were", "be", "been", "it", "its", "this", "that", "with", "from", "by", "as", "up",
    "out", "if", "so", "no", "i", "my", "we", "our", "he", "she", "they", "you", "your", "uses", "using", "used", "works", "working", "worked", "built", "builds", "building",
    "stores", "storing", "stored", "runs", "running", "creates", "creating", "created",
)


def phrase_words(text):
    """Words between white space in lower case, only their letters, digits and hyphens."""
    return F.filter(F.transform(F.split(text, "\\s+"), lambda w: F.regexp_replace(F.lower(w), "[^\\p{L}\\p{N}-]", "")), lambda w: w != "")


def phrases(words, sizes: tuple[int, ...]):
    """array<struct<phrase, at>> of neighbouring words, none of which is a stop word, a number or shorter than three letters."""
    noise = lambda w: (F.length(w) < 3) | w.rlike("^[0-9]+$") | w.isin(*STOPWORDS)

    def grams(n):
        at = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.expr("cast(array() as array<int>)"))
        ok = F.filter(at, lambda i: ~F.exists(F.slice(words, i + 1, n), noise))
        return F.transform(ok, lambda i: F.struct(F.array_join(F.slice(words, i + 1, n), " ").alias("phrase"), i.alias("at")))

    return F.concat(*[grams(n) for n in sizes])


def keyphrases(docs: DataFrame, key: str, text: str, k: int = 8) -> DataFrame:
    """Phrases of two and three words by count plus a bonus of up to 1 for an early first place; one that holds a shorter one of at least its score is left out."""
    t = docs.select(F.col(key).alias("id"), phrase_words(F.col(text)).alias("t")).filter(F.size("t") > 1)
    each = t.select("id", F.size("t").alias("total"), F.explode(phrases(F.col("t"), (2, 3))).alias("g"))
    g = each.groupBy("id", "total", F.col("g.phrase").alias("phrase")).agg(F.count("*").alias("n"), F.min("g.at").alias("first"))
    g = g.select("id", "phrase", (F.col("n") + 1 - F.col("first") / F.col("total")).alias("score"))
    words = F.split("phrase", " ")
    inner = g.filter(F.size(words) == 3).select("id", "phrase", "score", F.explode(F.array(F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 2, 2), " "))).alias("short"))
    held = inner.join(g.select("id", F.col("phrase").alias("short"), F.col("score").alias("least")), ["id", "short"]).filter("least >= score")
    kept = g.join(held.select("id", "phrase").distinct(), ["id", "phrase"], "left_anti")
    return top_k(kept, "id", k, F.desc("score"), "phrase")


def label_terms(text, least: int = 3):
    """Words of at least ``least`` letters that are neither stop words nor numbers, then pairs of neighbouring words of which both are."""
    t = tokens(text)
    ok = lambda w: (F.length(w) >= least) & ~w.isin(*STOPWORDS) & ~w.rlike("^[0-9]+$")
    at = F.when(F.size(t) > 1, F.sequence(F.lit(0), F.size(t) - 2)).otherwise(F.expr("cast(array() as array<int>)"))
    pairs = F.transform(F.filter(at, lambda i: ok(F.get(t, i)) & ok(F.get(t, i + 1))), lambda i: F.concat_ws(" ", F.get(t, i), F.get(t, i + 1)))
    return F.concat(F.filter(t, ok), pairs)


def answer_tokens(c):
    """Lower case, marks to spaces, without articles."""
    clean = F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " ")
    return F.filter(F.split(clean, " +"), lambda t: (t != "") & ~t.isin("a", "an", "the"))


def token_f1(pairs: DataFrame, predicted: str, gold: str) -> DataFrame:
    """``pairs``: id and two texts -> id, f1, exact: overlap of words as multisets."""
    p = pairs.select("id", answer_tokens(F.col(predicted)).alias("p"), answer_tokens(F.col(gold)).alias("g"))
    distinct = F.array_distinct("p")
    count = lambda xs, w: F.size(F.filter(xs, lambda y: y == w))
    same = F.aggregate(F.transform(distinct, lambda w: F.least(count("p", w), count("g", w))), F.lit(0), lambda s, x: s + x)
    f1 = F.when(same > 0, 2 * same / (F.size("p") + F.size("g"))).otherwise(F.when((F.size("p") == 0) & (F.size("g") == 0), 1.0).otherwise(0.0))
    return p.select("id", f1.alias("f1"), (F.array_join("p", " ") == F.array_join("g", " ")).alias("exact"))
