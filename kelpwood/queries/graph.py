"""Queries of graph operators over the triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import actions as A
from ..operators import graph as G
from ..operators.relational import in_scope
from ..registry import query
from ..sources.tables import CTE, Tables, with_views

T, ET = with_views("triples"), with_views("entities", "triples")
T_REC = T.replace("with ", "with recursive ", 1)


@query(T_REC + """, e as (select subject_id as a, object_id as b from triples union select object_id, subject_id from triples),
w(id, hop) as (select 's1', 0 union select b, hop + 1 from w join e on e.a = w.id where hop < 3) select id, min(hop)::int as hop from w where id <> 's1' group by 1""")
def khop(t: Tables):
    return G.k_hop(t.triples, "s1", 3)


@query(T_REC + """, e as (select subject_id as a, object_id as b, confidence as c from triples where confidence >= 0.1),
w(path, node, score, hops) as (select ['c7', b], b, c, 1 from e where a = 'c7' union all select list_append(path, b), b, score * c * 0.85, hops + 1 from w join e on e.a = w.node where hops < 4 and w.node <> 'n3' and not list_contains(path, b))
select array_to_string(path, '>') as path, round(score, 9) as score, hops from w where node = 'n3' order by score desc, array_to_string(path, '>') limit 10""")
def path_chains(t: Tables):
    return G.chains(t.triples, "c7", "n3").select("path", F.round("score", 9).alias("score"), "hops")


@query(T_REC + """, e as (select subject_id as a, object_id as b, confidence as c from triples where confidence >= 0.1),
w(path, node, score, hops) as (select [a, b], b, c, 1 from e where a in ('c7', 'c11') union all select list_append(path, b), b, score * c * 0.85, hops + 1 from w join e on e.a = w.node where hops < 3 and not list_contains(path, b))
select array_to_string(path, '>') as path, round(score, 9) as score, hops from w where hops >= 2 order by score desc, array_to_string(path, '>') limit 10""")
def explore_chains(t: Tables):
    return G.explore(t.triples, ["c7", "c11"]).select("path", F.round("score", 9).alias("score"), "hops")


def _pagerank_sql(rounds: int = 4) -> str:
    s = T + """, e as (select distinct subject_id as a, object_id as b from triples), d as (select a, count(*) as d from e group by 1),
v as (select a as id from e union select b from e), n as (select count(*) as n from v), r0 as (select id, 1.0 / n as r from v, n)"""
    for i in range(rounds):
        s += f", r{i + 1} as (select v.id, 0.15 / max(n) + 0.85 * coalesce(sum(r / d), 0) as r from v cross join n left join e on e.b = v.id left join r{i} p on p.id = e.a left join d on d.a = e.a group by 1)"
    return s


@query(_pagerank_sql() + " select id, round(r, 9) as r from r4")
def pagerank(t: Tables):
    return G.pagerank(t.triples, rounds=4).select("id", F.round("r", 9).alias("r"))


@query(_pagerank_sql().replace(CTE["triples"], CTE["entities"] + ", " + CTE["triples"]) + " select id, name from r4 join entities using (id) where context_id is null or context_id = 2 order by r desc, id limit 1")
def reason_seed(t: Tables):
    """The entity in scope with the highest rank."""
    rank = G.pagerank(t.triples, rounds=4)
    return in_scope(t.entities, 2).join(rank, "id").orderBy(F.desc("r"), "id").limit(1).select("id", "name")


@query(ET + """, d as (select id, count(*) as degree from (select subject_id as id from triples union all select object_id from triples) group by 1)
select id, round(0.5 * exp(-date_diff('day', created_at, timestamp '2025-01-01') * 0.6931471805599453 / 14) + 0.5 * tanh(coalesce(degree, 0) / 8), 6) as salience from entities left join d using (id)""")
def salience(t: Tables):
    ends = t.triples.select(F.explode(F.array("subject_id", "object_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    age = F.datediff(F.lit("2025-01-01").cast("date"), F.col("created_at").cast("date"))
    return t.entities.join(ends, "id", "left").select("id", F.round(S.salience(age, F.coalesce("degree", F.lit(0))), 6).alias("salience"))


# ----------------------------------------------------------------- structural likeness
_FP = ET + """, p as (select x.id, x.other, x.p || coalesce(e.entity_type, 'unknown') as pattern from (select subject_id as id, object_id as other, predicate || '->' as p from triples union all select object_id, subject_id, predicate || '<-' from triples) x left join entities e on e.id = x.other),
h1 as (select id, list_sort(list(distinct pattern)) as hop1 from p group by 1),
c as (select id, pattern, count(distinct other) as n, min(other) as first from p group by 1, 2),
h2 as (select p.id, list_sort(list(distinct c.pattern)) as hop2 from (select distinct id, other from p) p join c on c.id = p.other and (c.n > 1 or c.first <> p.id) group by 1),
fp as (select e.id, e.entity_type, hop1, coalesce(hop2, []) as hop2 from entities e join h1 using (id) left join h2 using (id))"""
_J = "case when len(list_distinct(list_concat(q.{0}, x.{0}))) > 0 then len(list_intersect(q.{0}, x.{0})) / len(list_distinct(list_concat(q.{0}, x.{0}))) else 0 end"


@query(_FP + f""", s as (select q.id as query_id, x.id, round(least(1.0, 0.6 * {_J.format('hop1')} + 0.3 * {_J.format('hop2')} + case when q.entity_type = x.entity_type then 0.1 else 0 end), 9) as score from fp q, fp x where q.id in ('s1', 'c7', 'n3') and x.id <> q.id),
r as (select *, row_number() over (partition by query_id order by score desc, id)::int as rank from s where score >= 0.1) select * from r where rank <= 10""")
def analogies(t: Tables):
    """A stated set of entities against all: typed patterns one and two edges away."""
    return G.analogies(t.triples, t.entities, ["s1", "c7", "n3"])


@query(_FP + " select entity_type, array_to_string(hop1, ',') as hop1, array_to_string(hop2, ',') as hop2, count(*) as members, min(id) as first from fp group by entity_type, 2, 3")
def analogy_classes(t: Tables):
    """All entities by class of equal fingerprints, in place of all pairs."""
    c = G.shapes(G.fingerprints(t.triples, t.entities))
    return c.select("entity_type", F.array_join("hop1", ",").alias("hop1"), F.array_join("hop2", ",").alias("hop2"), "members", "first")


@query(_FP + """, cl as (select entity_type, hop1, hop2, count(*) as members, min(id) as first from fp group by 1, 2, 3)
select q.first as a, x.first as b, round(least(1.0, 0.6 * """ + _J.format("hop1") + " + 0.3 * " + _J.format("hop2") + """ + case when q.entity_type = x.entity_type then 0.1 else 0 end), 9) as score, q.members as a_members, x.members as b_members from cl q, cl x where q.first < x.first""")
def fingerprint_similarity(t: Tables):
    """Likeness of classes of entities: typed patterns are few, so classes are."""
    c = G.checkpointed(G.shapes(G.fingerprints(t.triples, t.entities)))
    pack = F.struct("entity_type", "hop1", "hop2")
    a = c.select(F.col("first").alias("a"), pack.alias("q"), F.col("members").alias("a_members"))
    b = c.select(F.col("first").alias("b"), pack.alias("x"), F.col("members").alias("b_members"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(G.likeness("q", "x"), 9).alias("score"), "a_members", "b_members")


# ----------------------------------------------------------------- typed steps
@query(T + "select predicate, object_id from triples where subject_id = 'p7'")
def outgoing_predicates(t: Tables):
    return t.triples.filter("subject_id = 'p7'").select("predicate", "object_id")


@query(T + "select predicate, subject_id from triples where object_id = 'p7'")
def incoming_predicates(t: Tables):
    return t.triples.filter("object_id = 'p7'").select("predicate", "subject_id")


@query(ET + "select e.id, e.name from triples t join entities e on e.id = t.object_id where t.subject_id = 'p7' and t.predicate = 'supplied_by'")
def follow(t: Tables):
    return A.execute("follow", t.triples, t.entities, "p7", "supplied_by").select("id", "name")


@query(ET + "select e.id, e.name from triples t join entities e on e.id = t.subject_id where t.object_id = 'n3' and t.predicate = 'located_in'")
def reverse_follow(t: Tables):
    return A.execute("reverse_follow", t.triples, t.entities, "n3", "located_in").select("id", "name")


@query(ET + """select 'neighbors' as action, count(distinct case when subject_id = 'p7' then object_id else subject_id end) as n from triples where subject_id = 'p7' or object_id = 'p7'
union all select 'inspect', count(*) from entities where id = 'p7' union all select 'follow', count(*) from triples where subject_id = 'p7' and predicate = 'supplied_by' union all select 'reverse_follow', count(*) from triples where object_id = 'p7' and predicate = 'bought'""")
def graph_actions(t: Tables):
    """The four verbs of typed traversal."""
    verbs = (("neighbors", None), ("inspect", None), ("follow", "supplied_by"), ("reverse_follow", "bought"))
    parts = [A.execute(v, t.triples, t.entities, "p7", p).agg(F.count("*").alias("n")).select(F.lit(v).alias("action"), "n") for v, p in verbs]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(T + "select a.subject_id, b.object_id, count(*) as ways from triples a join triples b on a.object_id = b.subject_id where a.predicate = 'supplied_by' and b.predicate = 'located_in' group by 1, 2")
def follow_two_hops(t: Tables):
    a = t.triples.filter("predicate = 'supplied_by'").select("subject_id", F.col("object_id").alias("mid"))
    b = t.triples.filter("predicate = 'located_in'").select(F.col("subject_id").alias("mid"), "object_id")
    return a.join(b, "mid").groupBy("subject_id", "object_id").agg(F.count("*").alias("ways"))


# ----------------------------------------------------------------- hubs
@query(T + "select predicate, object_id, count(distinct subject_id) as members from triples group by 1, 2 having count(distinct subject_id) >= 3")
def heuristic_moc_groups(t: Tables):
    return t.triples.groupBy("predicate", "object_id").agg(F.count_distinct("subject_id").alias("members")).filter("members >= 3")


_HUBS = ET + ", g as (select object_id, count(distinct subject_id) as n from triples where predicate = 'located_in' group by 1 having count(distinct subject_id) >= 3), h as (select g.object_id, e.name || ' (MOC)' as hub, n from g join entities e on e.id = g.object_id)"


@query(_HUBS + " select h.hub as subject_id, 'indexes' as predicate, t.subject_id as object_id, 0.85::double as confidence from h join triples t on t.object_id = h.object_id and t.predicate = 'located_in'")
def upsert_moc(t: Tables):
    """A hub for each group, named like the entity it is about (so the name clashes and gets a mark), with an edge to each member."""
    return A.hubs(t.triples.filter("predicate = 'located_in'").select(F.col("object_id").alias("grp"), F.col("subject_id").alias("member")), t.entities)


@query("with c as (select label, count(*) as n from embeddings group by 1 having count(*) >= 3) select 'Cluster ' || label as subject_id, 'indexes' as predicate, vec_id::varchar as object_id, 0.85::double as confidence from embeddings join c using (label)")
def generate_moc_for_cluster(t: Tables):
    members = t.embeddings.select(F.concat(F.lit("Cluster "), F.col("label").cast("string")).alias("grp"), F.col("vec_id").cast("string").alias("member"))
    return A.hubs(members, None)


# ----------------------------------------------------------------- components and communities
def _edges(t: Tables):
    return t.triples.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b"), F.col("confidence").alias("weight"))


def _components_sql(rounds: int) -> str:
    s = T + ", e as materialized (select subject_id as a, object_id as b from triples union select object_id, subject_id from triples), l0 as materialized (select a as id, least(a, min(b)) as label from e group by a)"
    for i in range(rounds):
        s += f", l{i + 1} as materialized (select l.id, least(l.label, m.m) as label from l{i} l join (select e.a as id, min(x.label) as m from e join l{i} x on x.id = e.b group by 1) m using (id))"
    return s + f" select label, count(*) as members from l{rounds} group by 1"


@query(_components_sql(8))
def components(t: Tables):
    return G.components(_edges(t).select("a", "b")).groupBy("label").agg(F.count("*").alias("members"))


@query()
def community(t: Tables):
    """Communities in levels over all edges, until no level adds modularity; without SQL, as it is iterative (held against brute force in the tests)."""
    return G.community_levels(_edges(t), least=0.01)


@query(ET + """, l as (select 'c' || c_custkey as id, 'n' || c_nationkey as label from customer union all select 's' || s_suppkey, 'n' || s_nationkey from supplier union all select id, 'n' || (k % 25) from entities where entity_type = 'concept' union all select id, id from entities where entity_type = 'place'),
x as (select a.label as la, b.label as lb from triples join l a on a.id = subject_id join l b on b.id = object_id),
m as (select count(*)::double as m, sum(case when la = lb then 1 else 0 end) as inside from x), d as (select l, count(*) as d from (select la as l from x union all select lb from x) group by 1)
select round(max(inside / m) - sum(pow(d / (2 * m), 2)), 9) as q from d, m""")
def modularity(t: Tables):
    """Of a given labelling of all entities: by nation, parts dealt over the nations."""
    nation = lambda df, letter, key, at: df.select(F.concat(F.lit(letter), key).alias("id"), F.concat(F.lit("n"), at).alias("label"))
    label = nation(t.customer, "c", "c_custkey", "c_nationkey").unionByName(nation(t.supplier, "s", "s_suppkey", "s_nationkey"))
    label = label.unionByName(t.entities.filter("entity_type = 'concept'").select("id", F.concat(F.lit("n"), F.col("k") % 25).alias("label")))
    label = label.unionByName(t.entities.filter("entity_type = 'place'").select("id", F.col("id").alias("label")))
    return G.modularity(_edges(t).withColumn("weight", F.lit(1.0)), label).select(F.round("q", 9).alias("q"))


@query(T + """, l as (select 'c' || c_custkey as id, c_nationkey as community from customer union all select 's' || s_suppkey, s_nationkey from supplier union all select 'n' || n_nationkey, n_nationkey from nation),
r as (select a.community, replace(predicate, '_', ' ') as word, count(*) as n from triples join l a on a.id = subject_id join l b on b.id = object_id and b.community = a.community where predicate not in ('indexes', 'related_to') group by 1, 2)
select community, string_agg(word, ', ' order by n desc, word) as label, sum(n)::bigint as edges from (select *, row_number() over (partition by community order by n desc, word) as k from r) where k <= 3 group by 1""")
def recompute_community_labels(t: Tables):
    """Labels of communities from the relations whose both ends are in them."""
    at = lambda df, letter, key, c: df.select(F.concat(F.lit(letter), key).alias("id"), F.col(c).alias("community"))
    label = at(t.customer, "c", "c_custkey", "c_nationkey").unionByName(at(t.supplier, "s", "s_suppkey", "s_nationkey")).unionByName(at(t.nation, "n", "n_nationkey", "n_nationkey"))
    return A.community_labels(t.triples, label)
