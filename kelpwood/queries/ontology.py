"""Types, bindings, proposals, names and classes of entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import dictionary as D
from ..operators import ingest as I
from ..operators import ontology as O
from ..operators import store as K
from ..operators.text import ctfidf
from ..registry import query
from ..sources.memory import memory_views as V
from ..sources.tables import Tables, with_views

E, T, ET = with_views("entities"), with_views("triples"), with_views("entities", "triples")


# ----------------------------------------------------------------- types and bindings
@query(V("object_types") + "select name, members from object_types order by name")
def list_object_types(t: Tables):
    return t.view("object_types").select("name", "members").orderBy("name")


@query(V("link_types") + "select from_type, name, to_type from link_types")
def list_link_types(t: Tables):
    return t.view("link_types")


@query("select p_type as name, max(p_size)::bigint + 1 as version from part group by 1 union select 'fresh', 1")
def create_object_type(t: Tables):
    """A new version behind the last of its name."""
    old = t.part.select(F.col("p_type").alias("name"), F.col("p_size").cast("long").alias("version"))
    new = old.select("name").distinct().unionByName(t.spark.createDataFrame([("fresh",)], "name string"))
    return K.versioned(old, new, ["name"]).select("name", F.col("version").cast("long").alias("version"))


@query(V("link_types") + "select from_type, 'replaces' as name, to_type from link_types where from_type <> 'ECONOMY'")
def create_link_type(t: Tables):
    """Links between types that both exist."""
    types = t.view("object_types").filter("name <> 'ECONOMY'").select(F.col("name").alias("from_type"))
    return t.view("link_types").join(types, "from_type", "left_semi").select("from_type", F.lit("replaces").alias("name"), "to_type")


@query("select 'p' || p_partkey as entity_id, p_type as object_type from part where p_partkey % 4 = 0")
def assign_object_type(t: Tables):
    """Entities without a binding take one by name; names that aren't types are refused."""
    asked = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("entity_id"), F.col("p_type").alias("object_type"))
    asked = asked.unionByName(t.part.limit(5).select(F.concat(F.lit("p"), "p_partkey").alias("entity_id"), F.lit("no such type").alias("object_type")))
    known = asked.join(t.view("object_types").select(F.col("name").alias("object_type")), "object_type", "left_semi")
    return K.insert_or_ignore(t.view("type_bindings"), known.select("entity_id", "object_type"), ["entity_id"])


@query(V("type_bindings") + "select entity_id, object_type from type_bindings where entity_id = 'p7'")
def object_type_for_entity(t: Tables):
    return K.point(t.view("type_bindings"), "entity_id", "p7")


@query("select name, 1 as version from (values " + ", ".join(f"('{n}')" for n in O.OBJECT_TYPES) + ") v(name)")
def seed_builtin_ontology(t: Tables):
    return O.seed(t.view("object_types").limit(0).select("name", "version"))


_DOMAIN = "case when regexp_matches(lower({1}), '" + O.FICTION.replace("\\b", "\\b") + "') then 'fictional' else case {0} " + " ".join(f"when '{k}' then '{v}'" for k, v in O.DOMAINS.items()) + " else 'unknown' end end"
_COMP = "case when {0} = 'fictional' or {1} = 'fictional' then {0} = {1} else {0} = {1} or {0} = 'unknown' or {1} = 'unknown' or " + " or ".join(f"({{0}} = '{a}' and {{1}} = '{b}') or ({{0}} = '{b}' and {{1}} = '{a}')" for a, b in O.COMPATIBLE) + " end"


@query(E + f"select domain, count(*) as n from (select {_DOMAIN.format('entity_type', 'name')} as domain from entities) group by 1")
def classify_domain(t: Tables):
    return t.entities.groupBy(O.domain(F.col("entity_type"), F.col("name")).alias("domain")).agg(F.count("*").alias("n"))


@query(ET + f", d as (select id, {_DOMAIN.format('entity_type', 'name')} as d from entities) select a.d as from_domain, b.d as to_domain, {_COMP.format('a.d', 'b.d')} as compatible, count(*) as n from triples join d a on a.id = subject_id join d b on b.id = object_id group by 1, 2, 3")
def is_compatible_with(t: Tables):
    """Every edge by the domains of its ends."""
    d = t.entities.select("id", O.domain(F.col("entity_type"), F.col("name")).alias("d"))
    j = t.triples.join(d.select(F.col("id").alias("subject_id"), F.col("d").alias("from_domain")), "subject_id").join(d.select(F.col("id").alias("object_id"), F.col("d").alias("to_domain")), "object_id")
    return j.groupBy("from_domain", "to_domain", O.compatible(F.col("from_domain"), F.col("to_domain")).alias("compatible")).agg(F.count("*").alias("n"))


@query(ET + f", d as (select id, {_DOMAIN.format('entity_type', 'name')} as d from entities) select predicate, count(*) as blocked from triples join d a on a.id = subject_id join d b on b.id = object_id where not ({_COMP.format('a.d', 'b.d')}) group by 1")
def bridge_blocked_by_ontology(t: Tables):
    d = t.entities.select("id", O.domain(F.col("entity_type"), F.col("name")).alias("d"))
    j = t.triples.join(d.select(F.col("id").alias("subject_id"), F.col("d").alias("a")), "subject_id").join(d.select(F.col("id").alias("object_id"), F.col("d").alias("b")), "object_id")
    return j.filter(~O.compatible(F.col("a"), F.col("b"))).groupBy("predicate").agg(F.count("*").alias("blocked"))


# ----------------------------------------------------------------- proposals
_MERGED = "select kind, name, sum(greatest(support, 1))::bigint as support, arg_max(id, struct_pack(c := created_at, i := id)) as evidence from type_proposals where status = 'pending' group by 1, 2"


@query(V("type_proposals") + _MERGED)
def upsert_ontology_proposal(t: Tables):
    return O.merged_proposals(t.view("type_proposals"))


@query(V("type_proposals") + "select id, name, support from type_proposals where status = 'pending' order by support desc, created_at, id limit 25")
def list_pending_proposals(t: Tables):
    return K.newest(K.point(t.view("type_proposals"), "status", "pending"), 25, F.desc("support"), "created_at", "id").select("id", "name", "support")


@query(V("type_proposals") + "select distinct name from type_proposals where status = 'pending' and kind = 'object' and id % 2 = 0")
def accept_ontology_proposal(t: Tables):
    """An accepted proposal of an object becomes a type."""
    p = t.view("type_proposals")
    done = K.decide(p, p.filter("id % 2 = 0").select("id", F.lit("accepted").alias("decided")), "id")
    return done.filter("status = 'accepted' and kind = 'object'").select("name").distinct()


@query(V("type_proposals") + "select case when status = 'pending' and id % 3 = 0 then 'rejected' else status end as status, count(*) as n from type_proposals group by 1")
def reject_ontology_proposal(t: Tables):
    p = t.view("type_proposals")
    return K.decide(p, p.filter("id % 3 = 0").select("id", F.lit("rejected").alias("decided")), "id").groupBy("status").agg(F.count("*").alias("n"))


@query(V("type_proposals", "object_types") + f", m as ({_MERGED}) select kind, name, support from m where name not in (select name from object_types) and name not in (select name from type_proposals where status = 'rejected' and kind = 'link')")
def persist_proposals(t: Tables):
    """Merged proposals that neither are types nor were turned down as links."""
    p = t.view("type_proposals")
    return O.unknown_proposals(O.merged_proposals(p), t.view("object_types"), K.point(p, "kind", "link")).select("kind", "name", "support")


_TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


@query(f"""with t as (select source as grp, unnest({_TOK}) as term from documents), tf as (select grp, term, count(*) as c from t where length(term) >= 3 and not regexp_full_match(term, '[0-9]+') group by 1, 2),
sz as (select grp, sum(c) as len from tf group by 1), df as (select term, count(*) as df from tf group by 1), n as (select count(*) as n from sz),
s as (select grp, term, c / len * (ln((n + 1) / (df + 1)) + 1) as score from tf join sz using (grp) join df using (term), n),
b as (select grp, term, round(score, 9) as score from (select *, row_number() over (partition by grp order by score desc, term) as k from s) where k = 1), m as (select source as grp, count(*) as members from documents group by 1)
select grp, upper(term[1]) || term[2:] as name, members as support from b join m using (grp) where members >= 5 and score >= 0.002""")
def propose_object_types(t: Tables):
    """Types from the clusters' most telling terms (here: sources as clusters, with a bar that their common words pass)."""
    terms = ctfidf(t.documents, "source", "text", k=1).withColumn("score", F.round("score", 9))
    sizes = t.documents.groupBy(F.col("source").alias("grp")).agg(F.count("*").alias("members"))
    return O.proposed_types(terms, sizes, least_score=0.002)


# ----------------------------------------------------------------- mutations
@query(V("mutations") + "select id, kind from mutations order by seen_at desc, id desc limit 20")
def recent_mutations(t: Tables):
    return K.newest(t.view("mutations"), 20, F.desc("seen_at"), F.desc("id")).select("id", "kind")


@query(V("mutations") + "select kind, count(*) as n from (select kind from mutations union all select 'weight' from supplier) group by 1")
def record_mutation(t: Tables):
    return t.view("mutations").select("kind").unionByName(t.supplier.select(F.lit("weight").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query(V("rollbacks") + "select kind, count(*) as n from rollbacks group by 1 order by n desc, kind")
def rollback_count_by_kind(t: Tables):
    return t.view("rollbacks").groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


@query(V("mutations", "rollbacks") + "select m.kind, count(r.id) as rolled_back from mutations m left join rollbacks r on r.mutation_id = m.id group by 1")
def record_rollback(t: Tables):
    r = t.view("rollbacks").select(F.col("mutation_id").alias("id"), F.col("id").alias("rollback"))
    return t.view("mutations").join(r, "id", "left").groupBy("kind").agg(F.count("rollback").alias("rolled_back"))


@query(V("feedback") + "select class, count(*) as n, min(id) as first from feedback group by 1")
def record_signal(t: Tables):
    return t.view("feedback").groupBy("class").agg(F.count("*").alias("n"), F.min("id").alias("first"))


# ----------------------------------------------------------------- names, tags, tests of names
@query(E + "select entity_type, case entity_type when 'person' then 'people' when 'organization' then 'orgs' when 'place' then 'places' else entity_type || 's' end as tag, count(*) as n from entities group by 1, 2")
def entity_type_tag(t: Tables):
    return t.entities.groupBy("entity_type", I.type_tag(F.col("entity_type")).alias("tag")).agg(F.count("*").alias("n"))


@query("select doc_id, array_to_string(list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(' ' || text || ' #Kept', '(?:^|[^A-Za-z0-9])#([A-Za-z0-9_]+)', 1), lambda x: lower(x)), [case when doc_id % 2 = 0 then 'people' else 'concepts' end]))), ',') as tags from documents")
def tags_for_memory(t: Tables):
    """Hashtags of the text and tags of the types of what it names."""
    kind = F.when(F.col("doc_id") % 2 == 0, "person").otherwise("concept")
    tags = F.array_union(S.hashtags(F.concat(F.lit(" "), "text", F.lit(" #Kept"))), F.array(I.type_tag(kind)))
    return t.documents.select("doc_id", F.array_join(F.array_sort(tags), ",").alias("tags"))


@query("select doc_id, case when regexp_matches(text, '{0}') or regexp_matches(text, '{1}') or regexp_matches(text, '{2}') then 'pii' when (doc_id % 100) / 100.0 < 0.4 then 'low_confidence' else 'ok' end as verdict from documents".format(*[p.replace("'", "''") for p in (S.EMAIL, S.SSN, S.CARD)]))
def governance_check(t: Tables):
    """Personal data, then too little confidence."""
    x = F.col("text")
    pii = S.has_email(x) | S.has_ssn(x) | S.has_credit_card(x)
    return t.documents.select("doc_id", F.when(pii, "pii").when(F.col("doc_id") % 100 / 100 < 0.4, "low_confidence").otherwise("ok").alias("verdict"))


@query(f"select doc_id, w as word, regexp_matches(w, '{I.SECRET}') or (strlen(w) > 8 and len(list_distinct(string_split(w, ''))) / strlen(w) > 0.7) as secret from (select doc_id, unnest(list_distinct(regexp_split_to_array(text, '\\s+'))) as w from documents) where strlen(w) >= 16")
def looks_like_secret(t: Tables):
    """Long words of all documents: known shapes of keys, or many different characters."""
    w = t.documents.select("doc_id", F.explode(F.array_distinct(F.split("text", "\\s+"))).alias("word")).filter(F.octet_length("word") >= 16)
    return w.select("doc_id", "word", I.looks_like_secret(F.col("word")).alias("secret"))


@query("select case when regexp_matches(p_name, '(widget|bolt)$') then 'technology' when regexp_matches(p_name, '(ring|gear)$') then 'organization' else 'concept' end as entity_type, count(*) as n from part group by 1")
def classify_multi_word(t: Tables):
    """Names of several words by their last one; the dictionaries are arguments."""
    kind = I.multi_word_type(F.col("p_name"), organizations=("ring", "gear"), technology=("widget", "bolt"))
    return t.part.groupBy(kind.alias("entity_type")).agg(F.count("*").alias("n"))


_NAMES = "(select distinct lower(trim(n)) as n from (select p_name as n from part union all select distinct substr(p_name, 2, 6) from part union all select n_name from nation union all select c_name from customer where c_custkey <= 300 union all select substr(c_name, 12) from customer where c_custkey % 10 = 0))"


@query(f"select a.n as a, b.n as b from {_NAMES} a join {_NAMES} b on a.n < b.n and length(least(a.n, b.n)) > 0 where length(a.n) >= 4 and length(b.n) >= 4 and (contains(b.n, a.n) or contains(a.n, b.n))")
def names_look_like_same(t: Tables):
    """Distinct names, and parts of names, of which one holds the other."""
    few = [t.part.select("p_name"), t.part.select(F.substring("p_name", 2, 6)), t.nation.select("n_name"), t.customer.filter("c_custkey <= 300").select("c_name"), t.customer.filter("c_custkey % 10 = 0").select(F.substring("c_name", 12, 30))]
    names = few[0]
    for other in few[1:]:
        names = names.union(other)
    return D.containing_names(names.toDF("name"))


@query(E + "select entity_type, count(*) as n from entities where length(name) >= 3 and not regexp_matches(name, '^[0-9#]+$') and lower(name) not in ('small ring') group by 1")
def proactive_quality(t: Tables):
    """Names that are worth showing: long enough, not only digits, not on the list."""
    return t.entities.filter(I.quality_name(F.col("name"), ("small ring",))).groupBy("entity_type").agg(F.count("*").alias("n"))


_STRIPPED = "list_filter(list_transform(regexp_split_to_array({}, '\\s+'), lambda w: trim(w, ',.!?;:\"''()')), lambda w: w <> '')"
_CLAUSES = "(select item_id * 1000 + i as id, trim(c[i]) as name from (select item_id, c, unnest(range(1, len(c) + 1)) as i from (select item_id, regexp_split_to_array(text, '[,.]') as c from benchmark)) where trim(c[i]) <> '')"
_LEAD = "(select id, array_to_string(list_slice(t, 1, k), ' ') as name from (select id, regexp_split_to_array(name, '\\s+') as t from " + _CLAUSES + "), (values (1), (2), (3), (1000)) v(k))"


def _phrases(t: Tables):
    """Phrases of one word to many: the clauses of ``benchmark``, and the first one, two and three words of each."""
    c = t.benchmark.select("item_id", F.posexplode(F.split("text", "[,.]")).alias("i", "c"))
    c = c.filter("trim(c) <> ''").select((F.col("item_id") * 1000 + F.col("i") + 1).alias("id"), F.split(F.trim("c"), "\\s+").alias("t"))
    return c.select("id", F.explode(F.array(*[F.array_join(F.slice("t", 1, k), " ") for k in (1, 2, 3, 1000)])).alias("name"))


@query(f"""with n as (select name, len(string_split(name, ' ')) as k, min(id) as id from (select id, array_to_string({_STRIPPED.format('lower(name)')}, ' ') as name from {_LEAD}) where name <> '' group by 1, 2),
t as (select doc_id, {_STRIPPED.format('lower(text)')} as t from documents), p as (select doc_id, t, unnest(range(1, len(t) + 1)) as pos from t),
first as (select distinct string_split(name, ' ')[1] as w from n), ks as (select distinct k from n),
c as (select doc_id as doc, pos, k, array_to_string(list_slice(t, pos, pos + k - 1), ' ') as s from p join first on w = t[pos], ks where pos + k - 1 <= len(t)),
m as (select doc, pos - 1 as pos, n.k as words, n.id from c join n on n.name = c.s and n.k = c.k qualify row_number() over (partition by doc, pos order by n.k desc) = 1),
r as (select *, max(pos + words) over (partition by doc order by pos rows between unbounded preceding and 1 preceding) as reach from m)
select words, id, count(*) as n, min(doc) as first_doc, sum(pos)::bigint as places from r where reach is null or pos + words > reach group by 1, 2""")
def dictionary_matches(t: Tables):
    """Phrases of any length in every text of ``documents``: how often each is found as the longest match, and where."""
    m = D.matches(t.documents, "doc_id", "text", _phrases(t))
    return m.groupBy("words", "id").agg(F.count("*").alias("n"), F.min("doc").alias("first_doc"), F.sum("at").alias("places"))


@query(f"""with n as (select lower(name) as name, min(id) as id from (select item_id as id, unnest({_STRIPPED.format('text')}) as name from benchmark) group by 1),
w as (select doc_id, ws[i] as raw, i from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from (select doc_id, {_STRIPPED.format("coalesce(text, '')")} as ws from documents))),
f as (select doc_id, lower(raw) as name, min(i) as pos from w where strlen(raw) >= 3 and not regexp_full_match(raw, '\\p{{Lu}}[^\\p{{Lu}}]*') and not regexp_full_match(raw, '[0-9]+') and lower(raw) not in ({", ".join("'" + x.replace("'", "''") + "'" for x in D.STOPWORDS)}) group by 1, 2)
select doc_id as doc, id from f join n using (name) qualify row_number() over (partition by doc_id order by pos) <= 20""")
def link_lowercase_to_graph(t: Tables):
    """The first twenty words of each text that are a whole name; the names are the words of ``benchmark``."""
    names = t.benchmark.select(F.col("item_id").alias("id"), F.explode(D.stripped_tokens(F.col("text"))).alias("name"))
    return D.linked_words(t.documents, "doc_id", "text", names)


@query(V("signals") + "select count(*) as pairs, round(avg(s), 6) as mean from (select list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::double * x::double)))) as s from signals a join signals b on b.id = a.id + 1)")
def embedding_quality(t: Tables):
    """Likeness of neighbouring rows' vectors, a probe of an embedder."""
    s = t.view("signals").select("id", "embedding")
    j = s.join(s.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("b")), "id")
    return j.agg(F.count("*").alias("pairs"), F.round(F.avg(S.cosine(F.col("embedding"), F.col("b"))), 6).alias("mean"))
