"""What a memory system stores, as views over the star-schema tables: signals, logs, threads, views, proposals and so on.

Each view is one statement that Spark and DuckDB both run. Times are whole seconds since 1970.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

VIEWS: dict[str, str] = {
    "signals": """select e.vec_id as id, d.source, d.text as raw_text, e.embedding, e.vec_id % 7 as session_id, 1 + e.vec_id % 4 as tier, nullif(e.vec_id % 3, 0) as context_id,
  case when e.vec_id % 5 < 2 then cast(null as bigint) when e.vec_id % 5 = 2 then cast(-1 as bigint) when e.vec_id % 5 = 3 then cast(-2 as bigint) else cast(e.label as bigint) end as cluster_id,
  1704067200 + e.vec_id * 3600 as created_at from {embeddings} e join {documents} d on d.doc_id = e.vec_id""",
    "access_log": "select event_id as id, concat('c', user_id) as entity_id, event_type, value, 1704067200 + event_id * 60 as seen_at from {events}",
    "traces": "select event_id as id, event_type, user_id as session_id, value as latency, 1704067200 + event_id * 60 as seen_at, concat('c', user_id) as entity_id from {events}",
    "trajectories": """select event_id as id, user_id % 6 as arm, case when value > 100 then 1e0 else value / 100 end as reward, event_type as query_class,
  case when value > 50 then 'success' when value < 5 then 'failure' else 'unknown' end as outcome, case when event_id % 3 = 0 then value end as actual, 1704067200 + event_id * 60 as seen_at from {events}""",
    "procedures": """select l_partkey as id, l_orderkey * 10 + l_linenumber as seq, l_linenumber as version, concat('make ', p_name) as name, lower(p_type) as steps,
  case l_returnflag when 'R' then 'deprecated' when 'A' then 'active' else 'draft' end as status, cast(l_quantity as bigint) as total, cast(floor(l_quantity * (1 - l_discount * 8)) as bigint) as succeeded
  from {lineitem} join {part} on p_partkey = l_partkey""",
    "threads": """select c_custkey as id, c_name as title, 1704067200 + c_custkey * 60 as started_at, case when c_custkey % 3 = 0 then 1704067800 + c_custkey * 60 end as ended_at,
  case when c_custkey % 2 = 0 then c_nationkey end as view_id from {customer}""",
    "contexts": "select n_nationkey as id, lower(n_name) as name, 1704067200 + n_nationkey * 100 as created_at from {nation}",
    "views": "select s_suppkey as id, s_name as name, (s_suppkey % 10) / 1e1 as confidence_floor, s_suppkey % 2 = 0 as include_pending, 1704067200 + s_suppkey * 10 as created_at from {supplier}",
    "view_members": """select distinct l_suppkey as view_id, case l_returnflag when 'R' then 'exclude' else 'include' end as kind, 'entity' as member_type, concat('p', l_partkey) as member_id
  from {lineitem}""",
    "pending": """select o_orderkey as id, concat('c', o_custkey) as subject_id, 'bought' as predicate, concat('p', o_orderkey % 200) as object_id, 3e-1 + (o_orderkey % 41) / 1e2 as confidence,
  case o_orderkey % 3 when 0 then 'pending' when 1 then 'accepted' else 'rejected' end as status, case when o_orderkey % 3 > 0 then 1704067200 + o_orderkey * 600 end as decided_at from {orders}""",
    "needs": "select c_custkey as id, lower(c_mktsegment) as text, 1704067200 + c_custkey * 77 as created_at from {customer}",
    "need_links": "select o_custkey as need_id, o_orderkey as commitment_id from {orders}",
    "sentiments": "select event_id as id, user_id as target_id, round(value / 100 - 1, 4) as valence, 1704067200 + event_id * 60 as seen_at from {events}",
    "actions": "select l_orderkey * 10 + l_linenumber as id, l_orderkey as commitment_id, case l_linestatus when 'O' then 'started' else 'done' end as what, 1704067200 + l_orderkey * 60 + l_linenumber as seen_at from {lineitem}",
    "silences": """select o_orderpriority as cell, o_custkey as commitment_id, 1704067200 + o_orderkey * 60 as silenced_at, 1704067200 + o_orderkey * 60 + 86400 * (o_orderkey % 14) as silenced_until,
  case when o_orderkey % 5 > 0 then o_orderstatus end as reason from {orders}""",
    "outcome_proposals": """select o_orderkey as id, concat(o_custkey % 50, ':', o_orderpriority) as cell_key, case o_orderkey % 4 when 0 then 'accepted' when 1 then 'dismissed' else 'pending' end as status,
  1704067200 + o_orderkey * 60 as created_at, 1706659200 + o_orderkey * 60 as expires_at from {orders}""",
    "candidates": """select o_orderkey as id, lower(o_orderpriority) as statement, case o_orderkey % 3 when 0 then 'pending' when 1 then 'accepted' else 'dismissed' end as status, 5e-1 + (o_orderkey % 50) / 1e2 as confidence,
  1704067200 + o_orderkey * 60 as created_at from {orders}""",
    "anticipations": """select o_orderkey as id, concat('query ', o_orderkey % 97) as query, (o_orderkey % 100) / 1e2 as confidence, 1704067200 + o_orderkey * 60 as expires_at, o_orderkey % 5 = 0 as answered from {orders}""",
    "object_types": "select row_number() over (order by p_type) as id, p_type as name, count(*) as members, 1 as version from {part} group by p_type",
    "type_bindings": "select concat('p', p_partkey) as entity_id, p_type as object_type from {part} where p_partkey % 4 > 0",
    "link_types": "select s.p_type as from_type, 'pairs_with' as name, t.p_type as to_type from (select distinct p_type from {part}) s join (select distinct p_type from {part}) t on s.p_type < t.p_type",
    "type_proposals": """select l_orderkey * 10 + l_linenumber as id, case l_returnflag when 'R' then 'link' else 'object' end as kind, concat(p_brand, ' ', p_type) as name, cast(l_quantity as bigint) % 3 as support,
  case when l_orderkey % 4 = 0 then 'rejected' else 'pending' end as status, 1704067200 + l_orderkey as created_at from {lineitem} join {part} on p_partkey = l_partkey""",
    "mutations": "select event_id as id, event_type as kind, value as delta, 1704067200 + event_id * 60 as seen_at from {events}",
    "rollbacks": "select event_id as id, event_id - event_id % 3 as mutation_id, event_type as kind, 1704067200 + event_id * 60 as seen_at from {events} where value < 2",
    "feedback": "select event_id as id, user_id % 40 as hook_id, event_type as class, case when value > 20 then 3e-1 else -5e-1 end as weight, user_id as query_id, event_id % 50 as result_id, 1704067200 + event_id * 60 as seen_at from {events}",
    "cards": """select event_id as id, event_type as kind, user_id as target_id, case when value > 100 then 1e0 else value / 100 end as score, 1704067200 + event_id * 60 as seen_at from {events}""",
    "tags": "select concat('p', p_partkey) as entity_id, lower(p_type) as tag, 'type' as origin from {part} union all select concat('p', p_partkey), lower(p_brand), 'brand' from {part}",
    "tiers": "select user_id as memory_id, max(1704067200 + event_id * 60) as last_accessed, count(*) as access_count, user_id % 10 = 0 as pinned, case user_id % 3 when 0 then 'hot' when 1 then 'warm' else 'cold' end as tier from {events} group by user_id",
    "recent": "select event_id as id, case user_id % 3 when 0 then 'clipboard' when 1 then 'shell' else 'browser' end as source, substr(event_type, 1, 120) as preview, 1704067200 + event_id * 60 as seen_at from {events}",
    "beliefs": "select l_orderkey * 10 + l_linenumber as id, concat('p', l_partkey, '|s', l_suppkey) as statement, l_discount * 10 as confidence, case l_returnflag when 'R' then 'out' else 'in' end as status, l_orderkey as seq from {lineitem}",
}


class Memory:
    """Mixin of ``Tables``: ``view(name)`` runs one of VIEWS over the folder's tables."""

    def view(self, name: str) -> DataFrame:
        names = {w.split("}")[0] for w in VIEWS[name].split("{")[1:]}
        return self.spark.sql(VIEWS[name], **{n: getattr(self, n) for n in names})


def memory_views(*names: str) -> str:
    """The views as SQL, to be put before a query's own SELECT."""
    return "with " + ", ".join(f"{n} as ({VIEWS[n].replace('{', '').replace('}', '')})" for n in names) + " "
