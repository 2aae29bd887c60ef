"""Schemas of the engine's tables and the values that their enumerated columns may take."""

from __future__ import annotations

#: Fixed values.
CHANGE_TYPES = ("value_change", "rate_change", "date_change", "condition_change", "structural_change", "table_change", "new_field", "no_code_impact", "unknown")
DECISIONS = ("verified", "rejected", "stale", "revoked")
SOURCES = ("verified_mapping", "constant_match", "term_dictionary", "rag", "code_graph", "historical_commit")
REASONS = {
    "verified": ("confirmed_by_owner", "matched_historical_change", "golden_test_confirmed", "exact_constant_confirmed", "domain_mapping_confirmed", "other"),
    "rejected": ("wrong_module", "legacy_code", "false_positive_term", "same_value_unrelated", "generated_code", "test_only", "duplicate_candidate", "insufficient_context", "other"),
    "stale": ("file_missing", "symbol_missing", "content_changed", "module_moved", "repository_replaced"),
    "revoked": ("other",),
}
EXCLUDED_DIRS = (".git", ".svn", "target", "build", "out", "dist", "node_modules", ".venv", "venv", "__pycache__", "classes")
ARTIFACTS = {
    "full": ("metric", "hash", "count", "diff_structure", "file_path", "diff_body", "code_snippet", "golden_output"),
    "redacted": ("metric", "hash", "count", "diff_structure", "file_path"),
    "metadata_only": ("metric", "hash", "count"),
}

CANDIDATES = "query_id long, provider_idx int, cand_idx long, source string, path string, symbol string, line_start int, content_hash string, normalized_score double, stale boolean, verified_state string"
DECISION_EVENTS = "mapping_id long, decision string, reason_code string, reason_text string, actor string, created_at timestamp, seq long"
CONTEXTS = "query_id long, dedup_key string, article_id string, change_type string, state string, rejection_count long, golden_confirmed boolean, historical_match boolean, legacy boolean"
NODES = "id string, kind string, name string, path string, container string"
EDGES = "src string, dst string, kind string"
