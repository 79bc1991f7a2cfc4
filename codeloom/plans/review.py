"""Queries of review, security, style and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import cut_code, short_id, split_lines
from codeloom.operators import review as r
from codeloom.operators import style as st
from codeloom.operators.graph import first_per, numbered
from codeloom.operators.memory import set_similarity
from codeloom.operators.upsert import changed, delete_where, latest
from codeloom.plans.sql import over
from codeloom.session import materialize, table
from codeloom.sources.tables import elements, language_name, over_texts


def _measured(spark: SparkSession, d: str) -> DataFrame:
    return elements(spark, d, "type", "name", "language", "line_start", "line_end", **st.habits())


def _styles(spark: SparkSession, d: str) -> DataFrame:
    return over_texts(spark, d, st.style_matches, "type", "name", "language", "code", "docstring")


def _on_code(spark: SparkSession, d: str, work) -> DataFrame:
    return over_texts(spark, d, work, "code")


def _by_line(spark: SparkSession, d: str, work) -> DataFrame:
    return over_texts(spark, d, lambda t: work(r.lines(t)), "code")


def latest_elements(spark: SparkSession, d: str) -> DataFrame:
    return elements(spark, d, "file", "type", "name", "language", "line_start", "line_end", "updated_at")


def elements_by_name(spark: SparkSession, d: str) -> DataFrame:
    """The first ten elements of every name (a top-k report)."""
    return first_per(elements(spark, d, "name", "file", "line_start").where("name is not null"), ["name"], ["line_start", "id"], 10)


def elements_in_file(spark: SparkSession, d: str) -> DataFrame:
    """Elements of every file, in order."""
    return numbered(elements(spark, d, "file", "name", "line_start"), ["file"], ["line_start", "id"])


def language_stats(spark: SparkSession, d: str) -> DataFrame:
    return elements(spark, d, "language", "file").groupBy("language").agg(F.count("*").alias("elements"), F.countDistinct("file").alias("files"))


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return elements(spark, d, "file", "updated_at").agg(F.count("*").alias("elements"), F.countDistinct("file").alias("files"), F.max("updated_at").alias("last_indexed"))


def type_counts(spark: SparkSession, d: str) -> DataFrame:
    return elements(spark, d, "type", "language").groupBy("type", "language").agg(F.count("*").alias("n"))


def detect_languages(spark: SparkSession, d: str) -> DataFrame:
    """Files per extension, with the language of the extension."""
    ext = F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1))
    files = table(spark, d, "code_elements").select("file").where("file is not null").distinct()
    return files.groupBy(ext.alias("extension")).agg(F.count("*").alias("files")).withColumn("language", language_name("extension"))


def directory_stats(spark: SparkSession, d: str) -> DataFrame:
    """Elements and files per top directory."""
    top = F.element_at(F.split("file", "/"), 1)
    return elements(spark, d, "file").where("file is not null").groupBy(top.alias("directory")).agg(F.count("*").alias("elements"), F.countDistinct("file").alias("files"))


def _digests(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "h"))), lambda x: x["h"]), ""), 256).alias("digest"))


def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that differ between the deliveries before 2025 and all of them, by content hash."""
    rows = table(spark, d, "code_elements").select("id", "file", F.sha2(F.coalesce("code", F.lit("")), 256).alias("h"), "updated_at")
    old = latest(rows.where("updated_at < timestamp_ntz'2025-01-01'"), ["id"], "updated_at")
    return changed(_digests(latest(rows, ["id"], "updated_at")), _digests(old), "file", "digest")


def content_ids(spark: SparkSession, d: str) -> DataFrame:
    """A stable id from place and content."""
    h = F.sha2(F.coalesce("code", F.lit("")), 256)
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return elements(spark, d, stable_id=short_id(F.coalesce("file", F.lit("")), number("line_start"), number("line_end"), h))


def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    """The text an element is embedded by, without control characters; its length, its hash, and the hash of what is left when its code is cut to 8000 in all."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    text = F.concat_ws("\n", F.concat(F.col("type"), F.lit(": "), F.coalesce(blank("name"), F.lit("anonymous"))), F.concat(F.lit("Description: "), blank("docstring")), F.concat(F.lit("Signature: "), blank("signature")), F.concat(F.lit("Code:\n"), F.col("code")))
    text = F.regexp_replace(F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", ""), "\n{4,}", "\n\n\n")
    return elements(spark, d, length=F.length(text), digest=F.sha2(text, 256), cut_digest=F.sha2(cut_code(text), 256))


def kept_elements(spark: SparkSession, d: str) -> DataFrame:
    """Elements left after the files of deleted nodes are removed."""
    gone = latest(table(spark, d, "nodes").select("id", "file", "indexed_at", "deleted_at"), ["id"], "indexed_at").where("deleted_at is not null").select("file")
    return delete_where(elements(spark, d, "file", "type"), gone, ["file"])


def long_lines(spark: SparkSession, d: str) -> DataFrame:
    return _by_line(spark, d, r.long_lines)


def todo_markers(spark: SparkSession, d: str) -> DataFrame:
    return _by_line(spark, d, r.todo_markers)


def high_nesting(spark: SparkSession, d: str) -> DataFrame:
    """Lines indented deeper than two levels, as these elements are short; ``deep_nesting`` has the limit that reviews use."""
    return _by_line(spark, d, lambda t: r.nesting(t, 2))


def deep_nesting(spark: SparkSession, d: str) -> DataFrame:
    return _by_line(spark, d, r.nesting)


def long_functions(spark: SparkSession, d: str) -> DataFrame:
    return r.long_routines(elements(spark, d, "file", "type", "line_start", "line_end").where("type in ('function', 'method')"), 25)


def very_long_functions(spark: SparkSession, d: str) -> DataFrame:
    """At the limit that reviews use, 60 lines; ``long_functions`` takes 25, as these elements are short."""
    return r.long_routines(elements(spark, d, "file", "type", "line_start", "line_end").where("type in ('function', 'method')"))


def line_counts(spark: SparkSession, d: str) -> DataFrame:
    return elements(spark, d, lines=F.size(split_lines("code"))).where("lines is not null")


def security_counts(spark: SparkSession, d: str) -> DataFrame:
    return _on_code(spark, d, r.security_counts)


def security_findings(spark: SparkSession, d: str) -> DataFrame:
    return _on_code(spark, d, r.security_findings)


def security_report(spark: SparkSession, d: str) -> DataFrame:
    found = security_counts(spark, d)
    return found.groupBy("rule_id", "severity", "category").agg(F.count("*").alias("texts"), F.sum("n").alias("matches"))


def risk_scores(spark: SparkSession, d: str) -> DataFrame:
    """Per file, the weighted security matches, 1 at most."""
    weight = F.when(F.col("severity").isin("critical", "high"), 0.3).when(F.col("severity") == "medium", 0.15).otherwise(0.05)
    found = security_counts(spark, d).join(elements(spark, d, "file"), "id")
    return found.groupBy("file").agg(F.round(F.least(F.lit(1.0), F.sum(weight * F.col("n"))), 6).alias("risk"))


def recency_bands(spark: SparkSession, d: str) -> DataFrame:
    """Elements per language and recency, measured from the latest delivery."""
    rows = elements(spark, d, "language", "updated_at")
    latest_at = rows.agg(F.max("updated_at")).first()[0]
    days = F.timestamp_diff("DAY", F.col("updated_at"), F.lit(latest_at).cast("timestamp_ntz"))
    band = F.when(days.isNull(), 0.5).when(days < 7, 1.0).when(days < 30, 0.8).when(days < 90, 0.6).when(days < 365, 0.4).otherwise(0.1)
    return rows.groupBy("language", band.alias("recency")).agg(F.count("*").alias("n"))


def inline_suppressions(spark: SparkSession, d: str) -> DataFrame:
    """Comments that silence tools: here the linters' own marks serve as suppressions."""
    return _by_line(spark, d, r.tool_marks)


def ignore_comments(spark: SparkSession, d: str) -> DataFrame:
    """The library's own ignore comments, with the rules they name."""
    return _by_line(spark, d, r.inline_suppressions)


def reviewed(spark: SparkSession, d: str) -> DataFrame:
    """All findings with those on silenced lines marked."""


    def found(texts: DataFrame) -> DataFrame:
        rows = r.lines(texts)
        marks = F.array(
            F.when(r.is_long("body"), F.struct(F.lit("GEN-LONG-LINE").alias("rule_id"), F.lit("low").alias("severity"))),
            F.when(r.todo_mark("body") != "", F.struct(F.lit("GEN-TODO").alias("rule_id"), F.lit("info").alias("severity"))),
            F.when(r.tool_mark("body") != "", F.struct(F.lit("*").alias("rule_id"), r.tool_mark("body").alias("severity"))),
        )
        by_line = rows.select("id", "line", F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("m")).select("id", "line", "m.*")
        return by_line.unionByName(r.security_findings(texts).select("id", "line", "rule_id", "severity"))

    rows = materialize(_on_code(spark, d, found), "found")
    quiet = rows.where("rule_id = '*'").select("id", r.next_line(F.col("line"), F.col("severity")).alias("line"), "rule_id")
    return r.apply_suppressions(rows.where("rule_id <> '*'"), quiet)


def review_findings(spark: SparkSession, d: str) -> DataFrame:
    return reviewed(spark, d)


def review_summary(spark: SparkSession, d: str) -> DataFrame:
    """Active findings per file by severity, and whether the file is blocked."""
    found = materialize(reviewed(spark, d), "findings")
    return r.summary(found.join(elements(spark, d, "file"), "id"), "file")


def review_sarif(spark: SparkSession, d: str) -> DataFrame:
    return r.sarif(materialize(reviewed(spark, d), "findings"))


def review_sarif_rules(spark: SparkSession, d: str) -> DataFrame:
    return r.sarif_rules(materialize(reviewed(spark, d), "findings"))


def style_matches(spark: SparkSession, d: str) -> DataFrame:
    return _styles(spark, d)


def style_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return st.aggregate_styles(_styles(spark, d))


def learned_styles(spark: SparkSession, d: str) -> DataFrame:
    return st.learned_styles(_styles(spark, d))


def style_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard of the element sets of styles; the styles are a fixed list, so the pairs are few."""
    return set_similarity(_styles(spark, d), "style", "id", 0.3)


def baseline_stats(spark: SparkSession, d: str) -> DataFrame:
    return st.baseline(_measured(spark, d))


def style_deviations(spark: SparkSession, d: str) -> DataFrame:
    code = materialize(_measured(spark, d), "measured")
    return st.deviations(code, st.baseline(code))


#: RE2 has no lookarounds: for these rules the SQL matches more and then drops what the lookaround excludes.
WIDER = {
    "SEC022": (r"(?:literal_)?eval\s*\(\s*(?:[a-zA-Z_][a-zA-Z0-9_]*|[f]?['\"].*?\{)", "NOT starts_with(lower(x), 'literal_')"),
    "SEC030": (r"\{\{\s*[a-zA-Z_][a-zA-Z0-9_.]*\s*\}\}(?:\s*\|.*?escape)?", "NOT ends_with(lower(x), 'escape')"),
    "SEC061": (r"yaml\.load\s*\([^)]*", "NOT contains(lower(x), 'safeloader')"),
}


def _quote(rx: str) -> str:
    return rx.replace("'", "''")


def _count_sql(rule: str, rx: str) -> str:
    wide, keep = WIDER.get(rule, (rx, "TRUE"))
    return f"len(list_filter(regexp_extract_all(code, '(?im){_quote(wide)}'), lambda x: {keep}))"


_COUNTS = "@, sc AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT id, '{i}' AS rule_id, '{s}' AS severity, '{c}' AS category, CAST({_count_sql(i, p)} AS INTEGER) AS n FROM el WHERE code IS NOT NULL" for i, s, c, p in r.SECURITY_RULES) + ") WHERE n > 0)"


def _on_counts(then: str) -> str:
    return over("el", then=_COUNTS + " " + then).replace(" @,", ",")


#: Matches one by one: the text is cut behind each match in turn, so that its place follows from what was cut off.
_RULES = ", ".join(f"('{i}', '{s}', '{c}', '(?im){_quote(WIDER.get(i, (p,))[0])}')" for i, s, c, p in r.SECURITY_RULES)
_KEPT = "CASE rule_id " + " ".join(f"WHEN '{k}' THEN {v[1].replace('x)', 'match)')}" for k, v in WIDER.items()) + " ELSE TRUE END"
_FOUND = f"""@, ru AS (SELECT * FROM (VALUES {_RULES}) v(rule_id, severity, category, rx)),
 hs AS (SELECT id, code, rule_id, severity, category, unnest(regexp_extract_all(code, rx)) AS match, generate_subscripts(regexp_extract_all(code, rx), 1) AS i FROM el, ru WHERE code IS NOT NULL AND regexp_matches(code, rx)),
 wk AS (SELECT id, code, rule_id, severity, category, match, i, strpos(code, match) - 1 AS before FROM hs WHERE i = 1
  UNION ALL SELECT h.id, h.code, h.rule_id, h.severity, h.category, h.match, h.i, w.before + length(w.match) + strpos(h.code[w.before + length(w.match) + 1:], h.match) - 1 FROM wk w JOIN hs h ON h.id = w.id AND h.rule_id = w.rule_id AND h.i = w.i + 1),
 sf AS (SELECT id, rule_id, severity, category, length(code[:before]) - length(replace(code[:before], chr(10), '')) + 1 AS line, length(list_last(string_split(code[:before], chr(10)))) + 1 AS col, match FROM wk WHERE {_KEPT})"""
_REVIEWED = """, mk AS (SELECT id, line, body, lower(regexp_extract(body, '(?i)\\b(noqa|nolint|eslint-disable-next-line|eslint-disable|pylint: disable)\\b', 1)) AS mark FROM ln),
 q AS (SELECT DISTINCT id, line + CASE WHEN mark = 'eslint-disable-next-line' THEN 1 ELSE 0 END AS line FROM mk WHERE mark <> ''),
 f AS (SELECT id, line, 'GEN-LONG-LINE' AS rule_id, 'low' AS severity FROM ln WHERE length(body) > 120 AND NOT regexp_matches(ltrim(body, ' '), '^(//|/\\*|\\*)')
  UNION ALL SELECT id, line, 'GEN-TODO', 'info' FROM ln WHERE regexp_matches(body, '(?i)(?://|#|/\\*|\\*)\\s*(TODO|FIXME|HACK|XXX)\\b') UNION ALL SELECT id, line, rule_id, severity FROM sf),
 rf AS (SELECT f.id, CAST(f.line AS INTEGER) AS line, rule_id, severity, q.id IS NOT NULL AS suppressed FROM f LEFT JOIN q ON q.id = f.id AND q.line = f.line)"""
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_TEXT = """regexp_replace(regexp_replace(concat_ws(chr(10), type || ': ' || coalesce(nullif(name, ''), 'anonymous'), 'Description: ' || nullif(docstring, ''), 'Signature: ' || nullif(signature, ''), 'Code:' || chr(10) || code),
 '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), chr(10) || '{4,}', chr(10) || chr(10) || chr(10), 'g')"""
_LINES = "@, ln AS (SELECT id, unnest(l) AS body, generate_subscripts(l, 1) AS line FROM (SELECT id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT id, regexp_split_to_array(code, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]') AS l FROM el WHERE code IS NOT NULL)))"


def _on_lines(then: str) -> str:
    return over("el", then=_LINES + " " + then).replace(" @,", ",")


def _on_found(then: str) -> str:
    return over("el", then=_LINES + _FOUND.replace("@,", ",") + " " + then, recursive=True).replace(" @,", ",")


def _style_sql() -> str:
    parts = []
    for c, n, rx, col, types, langs in st.RULES:
        where = f"regexp_matches({col}, '{'(?m)' if col == 'code' else ''}{_quote(rx)}')"
        if types:
            where += " AND type IN (" + ", ".join(f"'{t}'" for t in types) + ")"
        if langs:
            where += " AND language IN (" + ", ".join(f"'{x}'" for x in langs) + ")"
        parts.append(f"SELECT id, '{c}' AS category, '{n}' AS style, {st.CONFIDENCE.get(c, 0.7)}::DOUBLE AS confidence FROM el WHERE {where}")
    return "@, sm AS (" + " UNION ALL ".join(parts) + ")"


def _on_styles(then: str) -> str:
    return over("el", then=_style_sql() + " " + then).replace(" @,", ",")


_NAMING = """CASE WHEN regexp_matches(nm, '^[A-Z][A-Z0-9_]*$') THEN 'screaming' WHEN regexp_matches(nm, '^[A-Z][a-zA-Z0-9]*$') THEN 'pascal'
 WHEN regexp_matches(nm, '^[a-z][a-z0-9_]*$') THEN 'snake' WHEN regexp_matches(nm, '^[a-z][a-zA-Z0-9]*$') THEN 'camel' ELSE 'other' END"""
_BASE = f"""@, x AS (SELECT *, split_part(name, '.', -1) AS nm, line_end - line_start + 1 AS size, regexp_matches(coalesce(code, ''), '\\b(try|except|catch|Err)\\b') AS tried FROM el),
 y AS (SELECT *, {_NAMING} AS p FROM x), k AS (SELECT language, type, p, count(*) AS n FROM y WHERE name IS NOT NULL GROUP BY 1, 2, 3),
 t AS (SELECT language, type, arg_max(p, (n, p)) AS dominant, max(n) / sum(n) AS r FROM k GROUP BY 1, 2),
 b AS (SELECT y.language, y.type, count(*) AS n, any_value(dominant) AS dominant, round(any_value(r), 9) AS dominant_rate, round(avg(CASE WHEN tried THEN 1.0 ELSE 0 END), 9) AS error_handling_rate,
 round(sum(size) / count(size), 9) AS mean_length, round(sqrt(greatest(0, sum(size * size) / count(size) - (sum(size) / count(size)) * (sum(size) / count(size)))), 6) AS std_length
 FROM y LEFT JOIN t ON t.language IS NOT DISTINCT FROM y.language AND t.type IS NOT DISTINCT FROM y.type GROUP BY 1, 2)"""

QUERIES = {
    f.__name__: f
    for f in (
        latest_elements, elements_by_name, elements_in_file, language_stats, index_stats, type_counts, detect_languages, directory_stats, changed_files, content_ids, embedding_text,
        kept_elements, long_lines, todo_markers, high_nesting, long_functions, line_counts, deep_nesting, very_long_functions, ignore_comments, security_counts, security_findings, security_report, risk_scores, recency_bands, inline_suppressions, review_findings,
        review_summary, review_sarif, review_sarif_rules, style_matches, style_aggregate, learned_styles, style_cooccurrence, baseline_stats, style_deviations,
    )
}
ORACLES = {
    "latest_elements": over("el", then="SELECT id, file, type, name, language, line_start, line_end, updated_at FROM el"),
    "elements_by_name": over("el", then="SELECT id, name, file, line_start, CAST(row_number() OVER (PARTITION BY name ORDER BY line_start NULLS FIRST, id) AS INTEGER) AS position FROM el WHERE name IS NOT NULL QUALIFY position <= 10"),
    "elements_in_file": over("el", then="SELECT id, file, name, line_start, CAST(row_number() OVER (PARTITION BY file ORDER BY line_start NULLS FIRST, id) AS INTEGER) AS position FROM el"),
    "language_stats": over("el", then="SELECT language, count(*) AS elements, count(DISTINCT file) AS files FROM el GROUP BY 1"),
    "index_stats": over("el", then="SELECT count(*) AS elements, count(DISTINCT file) AS files, max(updated_at) AS last_indexed FROM el"),
    "type_counts": over("el", then="SELECT type, language, count(*) AS n FROM el GROUP BY 1, 2"),
    "detect_languages": """SELECT extension, files, CASE extension WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'rs' THEN 'rust' ELSE extension END AS language
 FROM (SELECT lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) AS extension, count(DISTINCT file) AS files FROM code_elements WHERE file IS NOT NULL GROUP BY 1)""",
    "directory_stats": over("el", then="SELECT split_part(file, '/', 1) AS directory, count(*) AS elements, count(DISTINCT file) AS files FROM el WHERE file IS NOT NULL GROUP BY 1"),
    "changed_files": """WITH a AS (SELECT * FROM code_elements QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1),
 b AS (SELECT * FROM code_elements WHERE updated_at < TIMESTAMP '2025-01-01' QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1),
 x AS (SELECT file, string_agg(id || sha256(coalesce(code, '')), '' ORDER BY id) AS h FROM a WHERE file IS NOT NULL GROUP BY 1), y AS (SELECT file, string_agg(id || sha256(coalesce(code, '')), '' ORDER BY id) AS h FROM b WHERE file IS NOT NULL GROUP BY 1)
 SELECT file, status FROM (SELECT coalesce(x.file, y.file) AS file, CASE WHEN y.file IS NULL THEN 'added' WHEN x.file IS NULL THEN 'deleted' WHEN x.h <> y.h THEN 'changed' END AS status FROM x FULL JOIN y ON x.file = y.file) WHERE status IS NOT NULL""",
    "content_ids": over("el", then="SELECT id, sha256(coalesce(file, '') || ':' || coalesce(CAST(line_start AS VARCHAR), '') || ':' || coalesce(CAST(line_end AS VARCHAR), '') || ':' || sha256(coalesce(code, '')))[:16] AS stable_id FROM el"),
    "kept_elements": over("el", then="SELECT id, file, type FROM el WHERE file IS NULL OR file NOT IN (SELECT file FROM (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC) = 1) WHERE deleted_at IS NOT NULL AND file IS NOT NULL)"),
    "long_lines": _on_lines("SELECT id, CAST(line AS INTEGER) AS line, CAST(length(body) AS INTEGER) AS length FROM ln WHERE length(body) > 120 AND NOT regexp_matches(ltrim(body, ' '), '^(//|/\\*|\\*)')"),
    "todo_markers": _on_lines("SELECT id, CAST(line AS INTEGER) AS line, marker, CASE WHEN marker = 'FIXME' THEN 'warning' ELSE 'suggestion' END AS severity FROM (SELECT *, upper(regexp_extract(body, '(?i)(?://|#|/\\*|\\*)\\s*(TODO|FIXME|HACK|XXX)\\b', 1)) AS marker FROM ln) WHERE marker <> ''"),
    "high_nesting": _on_lines("""SELECT id, CAST(depth AS INTEGER) AS depth, CAST(line // 5 AS INTEGER) AS block, CAST(min(line) AS INTEGER) AS line FROM (SELECT *, length(w) - length(replace(w, chr(9), '')) + length(replace(w, chr(9), '')) // 4 AS depth,
 ltrim(replace(body, chr(9), ' '), ' ') AS c FROM (SELECT *, regexp_extract(body, '^([ \\t]*)', 1) AS w FROM ln)) WHERE depth > 2 AND c <> '' AND NOT starts_with(c, '//') AND NOT starts_with(c, '#') GROUP BY id, depth, line // 5"""),
    "long_functions": over("el", then="SELECT id, file, line_start, line_end - line_start + 1 AS length FROM el WHERE type IN ('function', 'method') AND line_end - line_start + 1 > 25"),
    "line_counts": _on_lines("SELECT id, CAST(count(*) AS INTEGER) AS lines FROM ln GROUP BY 1"),
    "security_counts": _on_counts("SELECT * FROM sc"),
    "security_findings": _on_found("SELECT id, rule_id, severity, category, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS \"column\", match FROM sf"),
    "review_findings": _on_found(_REVIEWED + " SELECT * FROM rf"),
    "review_summary": _on_found(_REVIEWED + " SELECT file, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}' AND NOT suppressed) AS {s}" for s in ("critical", "high", "medium", "low", "info")) + ", count(*) FILTER (WHERE severity = 'critical' AND NOT suppressed) > 0 AS blocking FROM rf JOIN el USING (id) GROUP BY file"),
    "review_sarif": _on_found(_REVIEWED + """ SELECT id, line, rule_id, '{"ruleId":"' || rule_id || '","level":"' || CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity IN ('low', 'info') THEN 'note' ELSE 'warning' END
 || '","message":{"text":"' || rule_id || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || id || '"},"region":{"startLine":' || line || '}}}]}' AS result FROM rf WHERE NOT suppressed"""),
    "review_sarif_rules": _on_found(_REVIEWED + """, lv AS (SELECT rule_id, CASE WHEN severity IN ('critical', 'high') THEN 3 WHEN severity IN ('low', 'info') THEN 1 ELSE 2 END AS l FROM rf WHERE NOT suppressed)
 SELECT rule_id, count(*) AS results, '{"id":"' || rule_id || '","defaultConfiguration":{"level":"' || ['note', 'warning', 'error'][max(l)] || '"}}' AS rule FROM lv GROUP BY rule_id"""),
    "embedding_text": over("el", then=f"""@, tx AS (SELECT id, {_TEXT} AS t FROM el), st AS (SELECT id, t, CASE WHEN trim(t, {_BLANK}) = '' THEN 'empty' ELSE trim(t, {_BLANK}) END AS s FROM tx),
 pt AS (SELECT *, string_split(s, chr(10) || 'Code:' || chr(10)) AS p FROM st), rm AS (SELECT *, 8000 - 7 - 30 - length(p[1]) AS room FROM pt)
 SELECT id, CAST(length(t) AS INTEGER) AS length, sha256(t) AS digest, sha256(CASE WHEN length(s) <= 8000 THEN s WHEN len(p) < 2 THEN s[:7980] || chr(10) || '... [truncated]'
 WHEN room > 100 THEN p[1] || chr(10) || 'Code:' || chr(10) || p[2][:room] || chr(10) || '... [truncated]' ELSE p[1][:7980] || chr(10) || '... [truncated]' END) AS cut_digest FROM rm""").replace(" @,", ","),
    "deep_nesting": _on_lines("""SELECT id, CAST(depth AS INTEGER) AS depth, CAST(line // 5 AS INTEGER) AS block, CAST(min(line) AS INTEGER) AS line FROM (SELECT *, length(w) - length(replace(w, chr(9), '')) + length(replace(w, chr(9), '')) // 4 AS depth,
 ltrim(replace(body, chr(9), ' '), ' ') AS c FROM (SELECT *, regexp_extract(body, '^([ \\t]*)', 1) AS w FROM ln)) WHERE depth > 5 AND c <> '' AND NOT starts_with(c, '//') AND NOT starts_with(c, '#') GROUP BY id, depth, line // 5"""),
    "very_long_functions": over("el", then="SELECT id, file, line_start, line_end - line_start + 1 AS length FROM el WHERE type IN ('function', 'method') AND line_end - line_start + 1 > 60"),
    "ignore_comments": _on_lines("""SELECT DISTINCT id, CAST(line + CASE WHEN k = 'ignore-next-line' THEN 1 ELSE 0 END AS INTEGER) AS line, unnest(CASE WHEN len(p) > 0 THEN p ELSE ['*'] END) AS rule_id FROM (SELECT id, line, lower(regexp_extract(body, '(?i)codeloom:\\s*(ignore-next-line|ignore)\\b', 1)) AS k,
 list_filter(regexp_split_to_array(regexp_extract(body, '(?i)codeloom:\\s*(?:ignore-next-line|ignore)\\b[ \\t]*([A-Za-z0-9_, \\t-]*)', 1), '[,\\s]+'), lambda x: x <> '') AS p FROM ln) WHERE k <> ''"""),
    "security_report": _on_counts("SELECT rule_id, severity, category, count(*) AS texts, CAST(sum(n) AS BIGINT) AS matches FROM sc GROUP BY 1, 2, 3"),
    "risk_scores": _on_counts("SELECT file, round(least(1.0, sum(n * CASE WHEN severity IN ('critical', 'high') THEN 0.3 WHEN severity = 'medium' THEN 0.15 ELSE 0.05 END)), 6)::DOUBLE AS risk FROM sc JOIN el USING (id) GROUP BY 1"),
    "recency_bands": over("el", then="""@, m AS (SELECT max(updated_at) AS m FROM el), a AS (SELECT *, epoch_us(m) - epoch_us(updated_at) AS us FROM el, m)
 SELECT language, CASE WHEN us IS NULL THEN 0.5 WHEN us < 7 * 86400000000 THEN 1.0 WHEN us < 30 * 86400000000 THEN 0.8 WHEN us < 90 * 86400000000 THEN 0.6 WHEN us < 365 * 86400000000 THEN 0.4 ELSE 0.1 END::DOUBLE AS recency, count(*) AS n FROM a GROUP BY 1, 2""").replace(" @,", ","),
    "inline_suppressions": _on_lines("SELECT id, CAST(line + CASE WHEN mark = 'eslint-disable-next-line' THEN 1 ELSE 0 END AS INTEGER) AS line, mark FROM (SELECT *, lower(regexp_extract(body, '(?i)\\b(noqa|nolint|eslint-disable-next-line|eslint-disable|pylint: disable)\\b', 1)) AS mark FROM ln) WHERE mark <> ''"),
    "style_matches": _on_styles("SELECT * FROM sm"),
    "style_aggregate": _on_styles("SELECT category, style, count(*) AS n, round(avg(confidence), 6) AS confidence FROM sm GROUP BY 1, 2"),
    "learned_styles": _on_styles("SELECT category, style, count(*) AS n, round(avg(confidence), 6) AS confidence, min(id) AS example FROM sm GROUP BY 1, 2 HAVING count(*) >= 2 AND avg(confidence) >= 0.5"),
    "style_cooccurrence": _on_styles(""", z AS (SELECT style, count(*) AS n FROM sm GROUP BY 1), c AS (SELECT a.style AS a, b.style AS b, count(*) AS shared FROM sm a JOIN sm b ON a.id = b.id AND a.style < b.style GROUP BY 1, 2)
 SELECT a, b, shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM c JOIN z x ON x.style = a JOIN z y ON y.style = b WHERE shared / (x.n + y.n - shared) >= 0.3"""),
    "baseline_stats": over("el", then=_BASE + " SELECT * FROM b").replace(" @,", ","),
    "style_deviations": over("el", then=_BASE + """, q AS (SELECT y.*, b.* EXCLUDE (language, type, n) FROM y LEFT JOIN b ON b.language = y.language AND b.type = y.type)
 SELECT id, 'PAT-NAMING-CONVENTION' AS rule_id FROM q WHERE dominant_rate >= 0.7 AND p <> dominant AND p = 'other' AND nm IS NOT NULL
 UNION ALL SELECT id, 'PAT-MISSING-ERROR-HANDLING' FROM q WHERE error_handling_rate >= 0.7 AND NOT tried
 UNION ALL SELECT id, 'PAT-COMPLEXITY-SPIKE' FROM q WHERE std_length > 0 AND size > 40 AND size > mean_length + 2 * std_length
 UNION ALL SELECT id, 'PAT-PASSWORD-HANDLING' FROM q WHERE contains(code, 'password') AND NOT regexp_matches(code, 'hash|bcrypt|scrypt')""").replace(" @,", ","),
}
