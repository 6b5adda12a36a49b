"""The queries of this subpackage's operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host: the source; path: source and language directory, as in the urls of ``pages``."""
    from .quality import score_quality, train

    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "lang"))
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, "source", "path", ["doc_id"])


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), k=20)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: capacities of the bounded loads add up to the rows, so counts are at most one apart."""
    from .sharding import assign_shards

    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = assign_shards(docs, "doc_id", shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has pictures, so each vector of ``embeddings`` is drawn as one."""
    from .media import copies, pictures

    return copies(pictures(table(spark, sf_dir, "embeddings")))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .pieces import encode_pieces

    return encode_pieces(table(spark, sf_dir, "documents"), path("piece_bpe_32k.model"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import filter_urls

    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).drop("url")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), window=13, respace=True)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .packing import pack_documents

    out = pack_documents(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, split, train_split

    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), train_split(docs))
    return split(out.drop("text")).select("doc_id", "held_out", "lang_pred", "score")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitens x = floor(64 * c) + 1000000. Entries of 2**46 or more, of which x isn't exact as a double, count as non-finite; a deviation above a long's range is null."""
    from .whitening import fit, usable, whiten

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("c"))
    rows = rows.filter(usable(F.col("c")) & F.forall("c", lambda e: F.abs(e) < 2.0**46))
    x = rows.select("vec_id", F.transform("c", lambda e: F.floor(e * 64) + 1000000).alias("x"))
    model = fit(x, "x", components=16)
    out = whiten(x, model, "x")
    n, sums = (model.n, model.total()) if model else (0, [])
    far = F.zip_with("x", F.lit(sums).cast("array<long>"), lambda e, s: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), e), s))
    deviation = F.aggregate(far, F.lit(0).cast("long"), lambda a, e: F.try_add(a, F.try_multiply(e, e)))
    each = out.select("vec_id", deviation.alias("deviation"), F.posexplode("whitened").alias("i", "whitened"), "explained", "identity_error")
    return each.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get("explained", "i").alias("explained"), "identity_error")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked import build_index, search

    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=50)


OP6_SQL = """
with rules(verdict, host, path) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
cut as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) end as rest from pages),
parts as (
  select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from cut),
fit as (
  select p.page_id, r.host || r.path as rule, r.verdict, row_number() over (partition by p.page_id order by length(r.host || r.path) desc, r.host || r.path) as n
  from parts p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path))
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from parts p left join fit f on f.page_id = p.page_id and f.n = 1
"""


OP7_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, i, md5(array_to_string(ws[i:i+12], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13)),
first as (select h, min(doc_id) as d from win group by h),
gone as (select distinct doc_id, i + k as p from win join first using (h), (select unnest(range(0, 13)) as k) where d < doc_id),
word as (select doc_id, unnest(ws) as x, generate_subscripts(ws, 1) as p from w),
kept as (select doc_id, string_agg(x, ' ' order by p) as t from word anti join gone using (doc_id, p) group by 1),
n as (select doc_id, count(*) as n from gone group by 1)
select w.doc_id, len(ws) as n_words, coalesce(n.n, 0) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from w left join n using (doc_id) left join kept using (doc_id)
"""

_ROUNDS = 12
OP8_SQL = (
    r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, md5(g) as h from (
  select doc_id, array_to_string(ws[i:i+2], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)
  union all select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and 2)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as materialized (select a, b from l union all select b, a from l), r0 as (select doc_id, doc_id as c from documents)"""
    + "".join(f", r{i + 1} as materialized (select r.doc_id, least(r.c, coalesce(min(o.c), r.c)) as c from r{i} r left join e on e.a = r.doc_id left join r{i} o on o.doc_id = e.b group by r.doc_id, r.c)" for i in range(_ROUNDS))
    + f"""
select r.doc_id, coalesce(n.n, 0) as n_shingles, r.c as component_id, r.c = r.doc_id as kept from r{_ROUNDS} r left join n using (doc_id)
"""
)

OP12_SQL = """
with l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as p from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
often as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(o.key) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by p) filter (where o.key is null), '')) as kept_sha256
from k left join often o using (key) group by doc_id
"""

OP13_SQL = r"""
with t as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
p as (select doc_id, term, count(*) as tf from t group by 1, 2),
d as (select doc_id, count(*) as n from t group by 1),
s as (select count(*) as n_docs, sum(n)::bigint as total from d),
m as (select doc_id, 50 + (50 * n * n_docs) // total as m from d, s),
w as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, s group by term, n_docs),
i as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
r as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score from i join w using (term) join p using (term) join m using (doc_id) group by 1, 2)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from r where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op8_minhash_near_dedup": OP8_SQL, "op12_line_dedup": OP12_SQL, "op13_ranked_search": OP13_SQL}
