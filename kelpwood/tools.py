"""The tool surface: each tool's name and the query that does its data operation, and a command line over all queries.

``python -m kelpwood NAME FOLDER [ROWS]`` prints rows of a tool or query over the tables of a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tools by what they do; a write's query returns the state after it.
TOOLS: dict[str, str] = {
    "memory_store": "ingest_fast", "memory_store_structured": "store_structured", "memory_commit": "insert_commitment", "memory_resolve": "resolve_commitment", "memory_query": "search_end_to_end",
    "memory_views_list": "list_views", "memory_views_create": "create_view", "memory_views_show": "list_members", "memory_views_add": "add_member", "memory_views_remove": "remove_member",
    "memory_views_delete": "delete_view", "get_trace": "recent_traces", "list_procedures": "load_procedures", "memory_reason": "path_chains", "memory_analogies": "analogies",
    "memory_consolidate": "consolidate", "memory_brief": "brief_sections", "memory_cards": "recent_cards", "memory_card_feedback": "card_feedback", "memory_insight_silence": "upsert_insight_silence",
    "memory_insight_unsilence": "insight_unsilence", "memory_insight_silences": "list_active_insight_silences", "memory_pattern_silence": "upsert_pattern_silence",
    "memory_pattern_unsilence": "pattern_unsilence", "memory_pattern_silences": "list_active_pattern_silences", "memory_world_calibration": "calibration",
    "memory_outcome_proposals": "list_active_outcome_proposals", "memory_outcome_accept": "accept_outcome_proposal", "memory_outcome_dismiss": "dismiss_outcome_proposal", "memory_need": "insert_need",
    "memory_sentiment": "insert_sentiment", "memory_action": "insert_action", "memory_arc": "memory_arc", "memory_feedback": "memory_feedback", "memory_pending_list": "pending_list",
    "memory_pending_accept": "accept_pending", "memory_pending_reject": "reject_pending", "memory_thread_start": "start_thread", "memory_threads_list": "list_threads",
    "memory_thread_attach_view": "attach_view", "memory_compose": "compose_expression", "memory_portable_export": "export_portable", "memory_pin": "pin", "memory_forget": "forget",
    "memory_promote": "reinforce_entity", "memory_contradict": "record_contradiction", "memory_reflect": "session_reflection", "memory_compose_union": "compose_union",
    "memory_compose_intersect": "compose_intersect", "memory_compose_filter": "compose_expression",
}


def call(name: str, spark: SparkSession, folder: str) -> DataFrame:
    """The result of a tool, or of a query of that name."""
    from .catalogue import queries

    known = queries()
    target = TOOLS.get(name, name)
    if target not in known:
        raise KeyError(f"no such tool or query: {name}")
    return known[target](spark, folder)


def main(argv: list[str]) -> None:
    name, folder, rows = argv[0], argv[1], int(argv[2]) if len(argv) > 2 else 20
    spark = SparkSession.builder.appName("kelpwood").getOrCreate()
    call(name, spark, folder).show(rows, truncate=80)
