"""Declared tables: types, keys and value rules (used by readers, sinks and the audit)."""

from __future__ import annotations

from pyspark.sql import types as T


def field_names(ddl: str) -> list[str]:
    """Top-level column names of a DDL text (needs a session)."""
    return T.StructType.fromDDL(ddl).fieldNames()


# DDL texts; readers and from_json take them as they are.
TABLES = {
    "incidents": (
        "id string, external_id string, source string, severity string, flow string, title string, "
        "description string, host string, service string, raw_payload string, "
        "created_at timestamp, updated_at timestamp"),
    "pipeline_runs": (
        "id string, incident_id string, status string, flow string, started_at timestamp, "
        "completed_at timestamp, duration_ms int, meta string"),
    "pipeline_steps": (
        "id string, run_id string, agent_num smallint, agent_name string, status string, "
        "started_at timestamp, completed_at timestamp, duration_ms int, summary string, "
        "error string, retry_count smallint"),
    "enrichments": (
        "id string, run_id string, agent_num smallint, source string, data string, written_at timestamp"),
    "resolutions": (
        "id string, run_id string, incident_id string, root_cause string, root_cause_cat string, "
        "resolution_steps string, confidence int, generated_at timestamp"),
    "ratings": (
        "id string, resolution_id string, rated_by string, rating smallint, comment string, "
        "rated_at timestamp"),
    "sessions": (
        "id string, user_id string, title string, created_at timestamp, last_active timestamp"),
    "messages": (
        "id string, session_id string, role string, content string, sources string, "
        "token_count int, created_at timestamp"),
    "documents": (
        "id string, source_type string, source_id string, source_url string, title string, "
        "content string, content_hash string, metadata string, indexed_at timestamp"),
    "chunks": (
        "id string, document_id string, chunk_index int, content string, "
        "embedding array<float>, token_count int, created_at timestamp"),
    "synthesized_kb": (
        "id string, cluster_signature string, version int, is_active boolean, title string, "
        "problem_summary string, root_cause string, "
        "resolution_steps array<struct<step:int,action:string,command:string>>, "
        "keywords array<string>, assignment_group string, category string, subcategory string, "
        "source_incident_count int, "
        "confidence_score decimal(4,3), llm_self_rating decimal(4,3), cluster_cohesion decimal(4,3), "
        "embedding_title array<double>, embedding_full array<double>, page_id string, "
        "embedding_model_version string, created_at timestamp, retired_at timestamp"),
    "synthesized_kb_sources": ("article_id string, incident_id string"),
    "kb_synthesis_runs": (
        "run_id string, seq int, started_at timestamp, finished_at timestamp, status string, "
        "window_start date, window_end date, counts map<string,bigint>, "
        "stage_durations map<string,double>, error_message string"),
    "kb_synthesis_decisions": (
        "decision_id string, run_id string, cluster_signature string, decision string, "
        "article_id string, similarity_score decimal(4,3), notes string, created_at timestamp"),
    "kb_recommendations": (
        "kb_article_id string, feedback_score double, created_at timestamp"),
}

# ---- Fixed values: allowed values and ranges --------------------------------
ALLOWED = {
    ("incidents", "source"): ["dynatrace", "servicenow"],
    ("incidents", "severity"): ["P1", "P2", "P3", "P4", "P5"],
    ("incidents", "flow"): ["primary", "secondary"],
    ("pipeline_runs", "status"): ["running", "completed", "failed", "cancelled"],
    ("pipeline_runs", "flow"): ["primary", "secondary"],
    ("pipeline_steps", "status"): ["pending", "running", "completed", "failed", "skipped"],
    ("messages", "role"): ["user", "assistant", "system"],
    ("kb_synthesis_runs", "status"): ["running", "succeeded", "partial", "failed"],
    ("kb_synthesis_decisions", "decision"): ["create", "update", "review", "skip"],
}
RANGES = {
    ("pipeline_steps", "agent_num"): (1, 7),
    ("resolutions", "confidence"): (0, 100),
    ("ratings", "rating"): (1, 5),
}
# -----------------------------------------------------------------------------
UNIQUE = {
    "incidents": [["external_id"]],
    "pipeline_steps": [["run_id", "agent_num"]],
    "documents": [["source_type", "source_id"], ["content_hash"]],
    "chunks": [["document_id", "chunk_index"]],
    "synthesized_kb": [["cluster_signature", "version"]],
}
FOREIGN = {
    ("pipeline_runs", "incident_id"): ("incidents", "external_id"),
    ("pipeline_steps", "run_id"): ("pipeline_runs", "id"),
}

# Inbound payloads. Unknown fields stay in the raw text.
PROBLEM_EVENT = (
    "problemId string, displayName string, severity string, status string, eventType string, "
    "tags array<string>, impactedEntities array<struct<name:string,type:string>>, "
    "deploymentEvent boolean, startTime string, endTime string")
TICKET_EVENT = (
    "number string, priority string, short_description string, caller_id string, cmdb_ci string, "
    "state string, category string, subcategory string, assignment_group string, "
    "u_service_tier string, u_hipaa_flag boolean")
REQUIRED_PROBLEM = ["problemId", "displayName", "severity", "status", "eventType"]
REQUIRED_TICKET = ["number", "priority", "short_description"]

ARTICLE = (
    "title string, problem_summary string, root_cause string, "
    "resolution_steps array<struct<step:int,action:string,command:string>>, "
    "keywords array<string>, assignment_group string, category string, subcategory string, "
    "confidence_self_rating double")
ROOT_CAUSE = (
    "root_cause string, root_cause_category string, confidence string, rollback_required boolean, "
    "rollback_target string, resolution_steps array<string>")
STEP = (
    "step_num int, action string, owner string, tool string, command string, rationale string")

# Columns of a closed-incident extract.
CLOSED_FIELDS = ["number", "short_description", "description", "close_notes", "close_code",
                 "assignment_group", "category", "subcategory", "closed_at", "u_source_tool"]
