"""Names of a dictionary in texts, by a hashed trie of their first tokens; names that hold one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed

#: Marks stripped from both ends of a token.
STRIP = ",.!?;:\"'()"
#: Words that are never linked on their own.
STOPWORDS = (
    "the", "a", "an", "in", "on", "at", "to", "for", "of", "and", "or", "but", "is", "was", "are", "were", "be", "been", "it", "its", "this", "that", "with", "from", "by", "as", "up",
    "out", "if", "so", "no", "i", "my", "we", "our", "he", "she", "they", "you", "your", "has", "had", "have", "do", "does", "did", "not", "all", "each", "every", "can", "will",
    "just", "now", "then", "here", "there", "when", "how", "what", "who", "which", "where", "i'm", "we'll", "we're", "we've", "i've", "you're", "you'll", "it's", "don't", "can't",
    "session", "phase", "step", "note", "point", "item", "idea", "plan", "today", "yesterday", "tomorrow",
)


def stripped_tokens(text: Column) -> Column:
    """Tokens between white space, without marks at their ends; what is empty then goes."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: F.btrim(w, F.lit(STRIP))), lambda w: w != "")


def _part(words: Column, at, n) -> Column:
    return F.array_join(F.slice(words, at, n), " ")


def _may_be(rows: DataFrame, held: DataFrame, column: str, lengths: bool = False, bits: int = 22) -> DataFrame:
    """Rows whose hash ``column`` may be in ``held``: none that is goes, and few others stay. The 2**bits bits are broadcast in words of 64, however many names there are; ``lengths``: with those of each word's names."""
    bit = lambda: F.pmod(F.col(column), F.lit(1 << bits))
    sums = [F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("held"), *[F.collect_set("words").alias("lengths")] * lengths]
    words = held.withColumn("p", bit()).groupBy(F.shiftright("p", 6).alias("word")).agg(*sums)
    j = rows.withColumn("p", bit()).withColumn("word", F.shiftright("p", 6)).join(F.broadcast(words), "word")
    return j.filter("shiftright(held, cast(p & 63 as int)) & 1 = 1").drop("p", "word", "held")


def matches(docs: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """doc, at, words, id: whole names in every text, without regard to case; at a place the longest wins, and what another match covers whole goes.

    ``names``: id, name, of any number of tokens; of several ids of one name the least counts. Where a text is read, a hashed trie of two levels tells whether a name may start
    at a place and how long it may be, and a hash of what stands there whether it may be one; only such parts of texts are compared with whole names. So texts aren't
    exchanged, only these parts (none but the matches, if the names are few enough to be broadcast). Texts without tokens, null ones too, have no
    matches; rows of one key are texts of one document, each matched by itself.
    """
    t = names.select("id", stripped_tokens(F.lower("name")).alias("t")).filter(F.size("t") > 0)
    whole = t.select(F.array_join("t", " ").alias("key"), F.size("t").alias("words"), F.xxhash64(_part(F.col("t"), 1, 2)).alias("g"), "id").groupBy("key", "words", "g").agg(F.min("id").alias("id"))
    whole = checkpointed(whole.withColumn("h", F.xxhash64("key")))
    d = docs.select(F.col(f"`{key}`").alias("doc"), stripped_tokens(F.lower(F.col(f"`{text}`"))).alias("t")).filter(F.size("t") > 0)
    d = d.withColumn("f", F.xxhash64(F.array_join("t", " ")))
    place = d.select("doc", "f", "t", F.posexplode("t").alias("at", "w"))
    place = place.select("doc", "f", "t", "at", F.explode(F.array(F.xxhash64("w"), F.xxhash64(_part(F.col("t"), F.col("at") + 1, 2)))).alias("g"))
    each = _may_be(place, whole, "g", lengths=True).select("doc", "f", "t", "at", F.explode("lengths").alias("words")).filter(F.col("at") + F.col("words") <= F.size("t"))
    each = each.select("doc", "f", "at", _part(F.col("t"), F.col("at") + 1, F.col("words")).alias("key"))
    hit = _may_be(each.withColumn("h", F.xxhash64("key")), whole, "h").join(whole.select("key", "words", "id"), "key")
    # one exchange serves both steps
    one = hit.select("doc", "f", "at", F.struct("words", "id").alias("m")).repartition("doc", "f")
    best = one.groupBy("doc", "f", "at").agg(F.max("m").alias("m")).select("doc", "f", "at", "m.words", "m.id")
    before = Window.partitionBy("doc", "f").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.col("at") + F.col("words")).over(before)
    return best.withColumn("reach", reach).filter(F.col("reach").isNull() | (F.col("at") + F.col("words") > F.col("reach"))).select("doc", "at", "words", "id")


def linked_words(docs: DataFrame, key: str, text: str, names: DataFrame, most: int = 20) -> DataFrame:
    """doc, id: the first ``most`` distinct words of a text that are an entity's whole name, without regard to case.

    Words of under three bytes, stop words, numbers, and words that start with one capital (which an extractor finds by itself) aren't linked.
    """
    w = docs.select(F.col(f"`{key}`").alias("doc"), F.posexplode(stripped_tokens(F.col(f"`{text}`"))).alias("at", "raw"))
    low = F.lower("raw")
    fit = (F.octet_length("raw") >= 3) & ~F.col("raw").rlike("^\\p{Lu}[^\\p{Lu}]*$") & ~low.isin(*STOPWORDS) & ~F.col("raw").rlike("^[0-9]+$")
    first = w.filter(fit).groupBy("doc", low.alias("name")).agg(F.min("at").alias("at"))
    one = names.groupBy(F.lower("name").alias("name")).agg(F.min("id").alias("id"))
    hit = first.join(one, "name").withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("at")))
    return hit.filter(F.col("n") <= most).select("doc", "id")


def containing_names(names: DataFrame, least: int = 4) -> DataFrame:
    """a < b: distinct names of which one holds the other whole, without regard to case; the shorter one has ``least`` letters at least (4 or more).

    A shorter name is looked up by the rarest four letters in it, so the rows are as many as all names have letters, and few places are compared.
    """
    n = names.select(F.lower(F.trim("name")).alias("name")).filter(F.length("name") >= least).distinct()
    place = F.sequence(F.lit(1), F.length("name") - 3)
    gram = n.select("name", F.explode(place).alias("at")).withColumn("g", F.substring("name", F.col("at"), F.lit(4)))
    often = gram.groupBy("g").agg(F.count("*").alias("n"))
    rare = gram.join(often, "g").groupBy("name").agg(F.min(F.struct("n", "at", "g")).alias("m")).select(F.col("name").alias("short"), F.col("m.at").alias("off"), F.col("m.g").alias("g"))
    j = gram.join(rare, "g").filter((F.length("name") > F.length("short")) & (F.substring("name", F.col("at") - F.col("off") + 1, F.length("short")) == F.col("short")) & (F.col("at") >= F.col("off")))
    return j.select(F.least("name", "short").alias("a"), F.greatest("name", "short").alias("b")).distinct()
