"""Views that the SQL of the queries shares: the same clean tables, written independently in SQL."""

LANGUAGE = """CASE lower(trim(language)) WHEN 'py' THEN 'python' WHEN 'ja' THEN 'javascript' WHEN 'js' THEN 'javascript' WHEN 'ty' THEN 'typescript'
 WHEN 'ts' THEN 'typescript' WHEN 'ru' THEN 'rust' WHEN 'rs' THEN 'rust' ELSE lower(trim(language)) END"""

VIEWS = {
    "el": f"SELECT * REPLACE ({LANGUAGE} AS language) FROM (SELECT * FROM code_elements WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1)",
    "nd": "SELECT * FROM (SELECT * FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) = 1) WHERE deleted_at IS NULL",
    "raw": "SELECT lower(trim(source_id)) AS src, lower(trim(target_id)) AS dst, rel_type, call_line, import_type, usage_type, created_at FROM code_relationships WHERE trim(source_id) <> '' AND trim(target_id) <> ''",
    "ed": """SELECT src, dst, rel_type, CASE WHEN rel_type = 'CALLS' THEN coalesce(call_line, 0) END AS call_line,
 CASE WHEN rel_type = 'IMPORTS' THEN coalesce(import_type, 'module') END AS import_type, CASE WHEN rel_type = 'USES' THEN coalesce(usage_type, 'reference') END AS usage_type
 FROM (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY src, dst, rel_type ORDER BY created_at DESC NULLS LAST, call_line DESC NULLS LAST, import_type DESC NULLS LAST, usage_type DESC NULLS LAST) = 1)
 WHERE src IN (SELECT id FROM nd) AND dst IN (SELECT id FROM nd)""",
    "pt": "SELECT * FROM (SELECT * FROM patterns WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_seen DESC NULLS LAST) = 1) WHERE deleted_at IS NULL",
    "pl": "SELECT lower(trim(pattern_id)) AS pattern_id, trim(project_name) AS project_name, min(first_seen) AS first_seen, max(occurrences) AS occurrences FROM pattern_projects WHERE trim(pattern_id) <> '' AND project_name IS NOT NULL GROUP BY 1, 2",
    "it": "SELECT event_id AS id, event_type AS interaction_type, 'user-' || user_id AS project_name, CASE event_type WHEN 'purchase' THEN TRUE WHEN 'error' THEN FALSE END AS accepted, ts, value, props FROM events",
}


def over(*names: str, then: str, recursive: bool = False) -> str:
    """A statement over some of the shared views."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " " + then
