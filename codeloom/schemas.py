"""Explicit schemas of the library's tables (the reader never infers any)."""

ELEMENTS = (
    "id string, file string, type string, name string, code string, language string, line_start int, line_end int, docstring string, "
    "signature string, parameters array<string>, created_at timestamp_ntz, updated_at timestamp_ntz"
)
NODES = "id string, name string, node_type string, file string, line_start int, line_end int, language string, indexed_at timestamp_ntz, deleted_at timestamp_ntz"
EDGES = "src string, dst string, rel_type string, call_line int, import_type string, usage_type string, created_at timestamp_ntz"
FINDINGS = "severity string, category string, file string, line int, rule_id string, message string, suggestion string, source string, suppressed boolean"
CHANGES = "path string, status string, additions int, deletions int, old_path string"
PATTERNS = (
    "id string, name string, category string, description string, pattern_text string, examples array<string>, occurrence_count int, "
    "confidence_score double, first_seen timestamp_ntz, last_seen timestamp_ntz, deleted_at timestamp_ntz, embedding array<float>"
)
REL_TYPES = ["CALLS", "IMPORTS", "INHERITS", "CONTAINS", "USES"]
SEVERITIES = ["critical", "high", "warning", "suggestion", "praise"]
SECURITY_SEVERITIES = ["critical", "high", "medium", "low", "info"]
