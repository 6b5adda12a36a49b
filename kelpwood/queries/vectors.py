"""Queries of vector operators over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import vectors as V
from ..registry import query
from ..sources.tables import Tables

_COS = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform({0}, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform({1}, lambda x: x::double * x::double))))"


def _few(t: Tables, n: int = 5):
    return t.embeddings.filter(F.col("vec_id") < n).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


_TOP = f"""s as (select q.vec_id as query_id, e.vec_id as id, round({_COS.format('e.embedding', 'q.embedding')}, 6) as score from embeddings e, embeddings q where q.vec_id < 5 and e.vec_id <> q.vec_id),
k as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s)"""


@query(f"with {_TOP} select query_id, id, score, rank from k where rank <= 10")
def cosine_topk(t: Tables):
    return V.cosine_topk(t.embeddings, _few(t), "vec_id", "embedding", 10).withColumn("score", F.round("score", 6))


_CEN = """p as (select label as grp, i as pos, avg(embedding[i]::double) as m from (select label, embedding, unnest(range(1, 65)) as i from embeddings) group by 1, 2),
c as (select grp, list(m / len order by pos) as centroid from p join (select grp, sqrt(sum(m * m)) as len from p group by 1) using (grp) group by 1)"""


@query(f"with {_CEN} select grp, round(list_sum(centroid), 6) as total, round(centroid[1], 6) as first, len(centroid) as dim from c")
def centroid_build(t: Tables):
    c = V.centroids(t.embeddings, "label", "embedding")
    return c.select("grp", F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.col("centroid")[0], 6).alias("first"), F.size("centroid").alias("dim"))


@query(f"with {_CEN}, s as (select e.vec_id as id, grp, {_COS.format('e.embedding', 'centroid')} as score from embeddings e, c), b as (select id, max(score) as score, arg_max(grp, struct_pack(s := score, g := -grp)) as grp from s group by 1) select id, case when score >= 0.3 then grp else -1 end as grp, round(score, 6) as score from b")
def centroid_assign(t: Tables):
    return V.assign(t.embeddings, V.centroids(t.embeddings, "label", "embedding"), "vec_id", "embedding", 0.3).withColumn("score", F.round("score", 6))


@query(f"""with {_CEN.replace('label as grp', '0 as grp').replace('select label,', 'select 0 as label,')}, s as (select vec_id as id, round(0.7 * (1 - {_COS.format('embedding', 'centroid')}) + 0.3 * pow(2, -(vec_id % 30) / 7), 6) as score from embeddings, c)
select id, score from s order by score desc, id limit 5""")
def surprise_topk(t: Tables):
    all_ = V.centroids(t.embeddings.withColumn("g", F.lit(0)), "g", "embedding")
    s = t.embeddings.join(F.broadcast(all_)).select(F.col("vec_id").alias("id"), F.round(0.7 * (1 - S.cosine(F.col("embedding"), F.col("centroid"))) + 0.3 * S.half_life(F.col("vec_id") % 30, 7.0), 6).alias("score"))
    return s.orderBy(F.desc("score"), "id").limit(5)


@query(f"""with {_TOP}, l as (select query_id, 'near' as list, id, score from k where rank <= 20 union all select query_id, 'low' as list, id, -id::double as score from k where rank between 5 and 30),
r as (select *, row_number() over (partition by query_id, list order by score desc, id) as rn from l) select query_id, id, round(sum(1 / (60.0::double + rn)), 9) as fused from r group by 1, 2""")
def rrf_fusion(t: Tables):
    k = V.cosine_topk(t.embeddings, _few(t), "vec_id", "embedding", 30)
    near = k.filter("rank <= 20").select("query_id", F.lit("near").alias("list"), "id", F.round("score", 6).alias("score"))
    low = k.filter("rank between 5 and 30").select("query_id", F.lit("low").alias("list"), "id", (-F.col("id")).cast("double").alias("score"))
    return V.rrf(near.unionByName(low)).withColumn("fused", F.round("fused", 9))


@query("select vec_id as id, round(sqrt(list_sum(list_transform(embedding[1:16], lambda x: x::double * x::double))), 6) as before, 1.0::double as after from embeddings")
def slice_and_normalize(t: Tables):
    s = F.slice("embedding", 1, 16)
    return t.embeddings.select(F.col("vec_id").alias("id"), F.round(S.norm(s), 6).alias("before"), F.round(S.norm(S.slice_and_normalize(F.col("embedding"), 16)), 6).alias("after"))


@query("""with q as (select embedding[1:32] as a, embedding[33:64] as b from embeddings where vec_id = 0),
s as (select vec_id as id, [embedding[1:32], embedding[33:64]] as d, [a, b] as qs from embeddings, q)
select id, round(list_sum(list_transform(qs, lambda x: list_max(list_transform(d, lambda y: list_sum(list_transform(list_zip(x, y), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform(x, lambda v: v::double * v::double))) * sqrt(list_sum(list_transform(y, lambda v: v::double * v::double)))))))), 6) as score from s""")
def maxsim(t: Tables):
    two = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    q = t.embeddings.filter("vec_id = 0").select(two.alias("q"))
    return t.embeddings.select(F.col("vec_id").alias("id"), two.alias("d")).join(F.broadcast(q)).select("id", F.round(V.maxsim(F.col("q"), F.col("d")), 6).alias("score"))


@query("select vec_id as id, round(exp(embedding[1]) / list_sum(list_transform(embedding[1:4], lambda x: exp(x))), 6) as first from embeddings")
def softmax(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.round(S.softmax(F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")))[0], 6).alias("first"))


_BITS = "list_transform((select v from planes), lambda p: case when list_sum(list_transform(list_zip(p, embedding), lambda z: z[1] * z[2]::double)) >= 0 then 1 else 0 end)"


@query(f"""with planes as (select {[[float(x) for x in p] for p in V.planes(64)]}::double[][] as v), b as (select vec_id as id, embedding, {_BITS} as b from embeddings), q as (select id as query_id, embedding as q, b as qb from b where id < 5),
d as (select query_id, id, list_sum(list_transform(list_zip(qb, b), lambda z: abs(z[1] - z[2]))) as d from q, b), c as (select * from (select *, row_number() over (partition by query_id order by d, id) as n from d) where n <= 256 and id <> query_id),
s as (select query_id, id, {_COS.format('embedding', 'q')} as score from c join b using (id) join q using (query_id))
select query_id, id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, id)::int as rank from s) where rank <= 10""")
def simhash_two_stage(t: Tables):
    return V.two_stage(t.embeddings, _few(t), "vec_id", "embedding", 64, 10).withColumn("score", F.round("score", 6))


@query()
def diversify_mmr(t: Tables):
    k = V.cosine_topk(t.embeddings, _few(t), "vec_id", "embedding", 20)
    return V.mmr(k.join(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id"))
