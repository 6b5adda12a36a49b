"""Queries of text operators over documents, conversations, benchmark passages and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import text as X
from ..operators.dictionary import matches
from ..registry import query
from ..sources.tables import Tables

_TOK = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_LEX = "list_filter(list_transform(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\p{{L}}\\p{{N}}:.$''-]+'), lambda t: regexp_replace(regexp_replace(t, '''s$', ''), '^[.''-]+|[.''-]+$', '', 'g')), lambda t: t <> '')"
_STOP = list(X.STOPWORDS)


@query(f"""with q(query_id, query) as (values (1, 'the tion of'), (2, 'die und der und')), t as (select doc_id as id, {_LEX.format('text')} as t from documents), d as (select * from t where len(t) > 0),
st as (select count(*) as n, avg(len(t)) as avgdl from d), qq as (select query_id, term, count(*) as times from (select query_id, unnest({_LEX.format('query')}) as term from q) group by 1, 2),
p as (select id, len, term, count(*) as tf from (select id, len(t) as len, unnest(t) as term from d) where term in (select term from qq) group by 1, 2, 3), df as (select term, count(*) as df from p group by 1),
s as (select query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avgdl)) * times), 6) as score from p join df using (term) join qq using (term), st group by 1, 2)
select query_id, id, score, n as rank from (select *, row_number() over (partition by query_id order by score desc, id) as n from s) where n <= 10""")
def bm25_topk(t: Tables):
    q = t.spark.createDataFrame([(1, "the tion of"), (2, "die und der und")], "query_id int, query string")
    s = X.bm25(t.documents, "doc_id", "text", q).withColumn("score", F.round("score", 6))
    return X.top_k(s, "query_id", 10, F.desc("score"), "id")


@query(f"""with t as (select lang as grp, unnest({_TOK.format('text')}) as term from documents), tf as (select grp, term, count(*) as c from t where length(term) >= 3 and not regexp_full_match(term, '[0-9]+') group by 1, 2),
sz as (select grp, sum(c) as len from tf group by 1), df as (select term, count(*) as df from tf group by 1), n as (select count(*) as n from sz),
s as (select grp, term, c / len * (ln((n + 1) / (df + 1)) + 1) as score from tf join sz using (grp) join df using (term), n)
select grp, term, round(score, 9) as score, k as rank from (select *, row_number() over (partition by grp order by score desc, term) as k from s) where k <= 3""")
def ctfidf_labels(t: Tables):
    return X.ctfidf(t.documents, "lang", "text").withColumn("score", F.round("score", 9))


@query(f"""with w as (select item_id as id, list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}-]', '', 'g')), lambda w: w <> '') as t from benchmark),
g as (select id, len(t) as total, array_to_string(t[i:i+n-1], ' ') as phrase, t[i:i+n-1] as ws, i - 1 as pos from (select id, t, n, unnest(range(1, len(t) - n + 2)) as i from w, (values (2), (3)) v(n))),
c as (select id, total, phrase, count(*) + 1 - min(pos) / total as score from g where len(list_filter(ws, lambda x: length(x) < 3 or regexp_full_match(x, '[0-9]+') or list_contains({_STOP}, x))) = 0 group by 1, 2, 3),
d as (select c.id, c.phrase from c join c s on s.id = c.id and s.score >= c.score and len(string_split(c.phrase, ' ')) = 3 and s.phrase in (array_to_string(string_split(c.phrase, ' ')[1:2], ' '), array_to_string(string_split(c.phrase, ' ')[2:3], ' ')))
select id, phrase, round(score, 6) as score, n as rank from (select *, row_number() over (partition by id order by score desc, phrase) as n from c where (id, phrase) not in (select id, phrase from d)) where n <= 8""")
def keyphrases(t: Tables):
    k = X.keyphrases(t.benchmark, "item_id", "text")
    return k.select("id", "phrase", F.round("score", 6).alias("score"), "rank")


@query("select doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') as mails from documents where regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')")
def emails(t: Tables):
    return t.documents.filter(S.has_email(F.col("text"))).select("doc_id", F.regexp_extract_all("text", F.lit(S.EMAIL), F.lit(0)).alias("mails"))


def _re(p):
    return p.replace("'", "''")


@query(f"select doc_id, regexp_matches(text, '{_re(S.EMAIL)}') as email, regexp_matches(text, '{_re(S.SSN)}') as ssn, regexp_matches(text, '{_re(S.CARD)}') as card, regexp_matches(text, '{_re(S.PHONE)}') as phone, regexp_matches(text, '{_re(S.MARKER)}') as marker from documents")
def pii_flags(t: Tables):
    x = F.col("text")
    return t.documents.select("doc_id", S.has_email(x).alias("email"), S.has_ssn(x).alias("ssn"), S.has_credit_card(x).alias("card"), S.has_phone(x).alias("phone"), S.has_structured_marker(x).alias("marker"))


@query(f"select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '{_re(S.EMAIL)}', '[email]', 'g'), '{_re(S.SSN)}', '\\1[ssn]\\2', 'g'), '{_re(S.CARD)}', '\\1[card]\\2', 'g')) as digest from documents")
def export_redact(t: Tables):
    return t.documents.select("doc_id", F.md5(S.redact(F.col("text"))).alias("digest"))


@query("select doc_id, list_distinct(list_transform(regexp_extract_all(' ' || text || ' #Kept #kept #two', '(?:^|[^A-Za-z0-9])#([A-Za-z0-9_]+)', 1), lambda x: lower(x))).list_sort() as tags from documents")
def hashtags(t: Tables):
    return t.documents.select("doc_id", F.array_sort(S.hashtags(F.concat(F.lit(" "), "text", F.lit(" #Kept #kept #two")))).alias("tags"))


@query(f"select doc_id, round(case when len(t) > 0 then len(list_distinct(t)) / len(t) else 0 end, 6) as entropy from (select doc_id, {_TOK.format('text')} as t from documents)")
def lexical_entropy(t: Tables):
    return t.documents.select("doc_id", F.round(S.lexical_entropy(F.col("text")), 6).alias("entropy"))


@query("select min(doc_id) as id, count(*) as copies from documents group by md5(text)")
def fingerprint_dedup(t: Tables):
    return t.documents.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")).drop("h")


_ANS = "list_filter(regexp_split_to_array(regexp_replace(lower({}), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda t: t <> '' and t not in ('a', 'an', 'the'))"


@query(f"""with p as (select a.item_id as id, {_ANS.format('a.text')} as p, {_ANS.format('b.text')} as g from benchmark a join benchmark b on b.item_id = a.item_id + 1),
w as (select id, p, g, list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda y: y = w)), len(list_filter(g, lambda y: y = w))))) as same from p)
select id, round(case when same > 0 then 2 * same / (len(p) + len(g)) when len(p) = 0 and len(g) = 0 then 1.0 else 0.0 end, 6) as f1, array_to_string(p, ' ') = array_to_string(g, ' ') as exact from w""")
def token_f1_em(t: Tables):
    pairs = t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("predicted")).join(t.benchmark.select((F.col("item_id") - 1).alias("id"), F.col("text").alias("gold")), "id")
    return X.token_f1(pairs, "predicted", "gold").withColumn("f1", F.round("f1", 6))


_WORDS = "list_filter(list_transform(regexp_split_to_array(lower({}), '\\s+'), lambda w: trim(w, ',.!?;:\"''()')), lambda w: w <> '')"


@query(f"""with n as (select distinct lower(p_name) as name from part), t as (select item_id * 1 as doc, {_WORDS.format("text || ' red widget and a blue bolt'")} as t from benchmark)
select doc, i - 1 as pos, name as id, 2 as words from (select doc, t, unnest(range(1, len(t))) as i from t) x join n on n.name = x.t[i] || ' ' || x.t[i + 1]""")
def resolve_in_text(t: Tables):
    names = t.part.select(F.lower("p_name").alias("id"), F.lower("p_name").alias("name")).distinct()
    return matches(t.benchmark.withColumn("text", F.concat("text", F.lit(" red widget and a blue bolt"))), "item_id", "text", names).withColumnRenamed("at", "pos")


@query(f"select a.item_id as a, b.item_id as b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) as j from (select item_id, list_distinct({_TOK.format('text')}) as x from benchmark) a, (select item_id, list_distinct({_TOK.format('text')}) as y from benchmark where item_id < 5) b where len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) >= 0.1 and a.item_id <> b.item_id")
def jaccard_outcomes(t: Tables):
    """A stated set of five texts against all, by shared words."""
    words = t.benchmark.select("item_id", F.array_distinct(S.tokens(F.col("text"))).alias("x"))
    few = words.filter("item_id < 5").select(F.col("item_id").alias("b"), F.col("x").alias("y"))
    hit = words.select(F.col("item_id").alias("a"), "x", F.explode("x").alias("w")).join(F.broadcast(few.select("b", "y", F.explode("y").alias("w"))), "w").select("a", "b", "x", "y").distinct()
    return hit.select("a", "b", F.round(S.jaccard(F.col("x"), F.col("y")), 6).alias("j"), S.jaccard(F.col("x"), F.col("y")).alias("raw")).filter("raw >= 0.1 and a <> b").drop("raw")


@query("select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) || ' — ' || url as capture from pages")
def browser_capture(t: Tables):
    return t.pages.select("page_id", F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" — "), "url").alias("capture"))


@query("select conv_id, string_agg(role || ': ' || length(text), ' / ' order by turn) as outline, count(*) as turns from conversations group by 1")
def conversation_outline(t: Tables):
    turn = F.struct("turn", F.concat("role", F.lit(": "), F.length("text")).alias("x"))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(turn)), lambda s: s["x"]), " / ").alias("outline"), F.count("*").alias("turns"))


@query("select source, sum(case when toxic = 1 then 1 else 0 end) as tp, count(*) as n, round(avg(quality), 6) as quality from documents join labels using (doc_id) group by 1")
def label_scores(t: Tables):
    return t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("tp"), F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"))
