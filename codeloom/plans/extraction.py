"""Queries of relations read from text, and of deduplicated context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import extract as x
from codeloom.operators.graph import DEPENDENCY_TYPES, degrees, neighbours
from codeloom.plans.graph import _DEG, graph
from codeloom.plans.review import _on_counts, security_counts
from codeloom.plans.sql import over
from codeloom.session import materialize, table
from codeloom.sources.tables import elements, language_name, patterns


def calls_by_text(spark: SparkSession, d: str) -> DataFrame:
    return x.calls_by_text(materialize(elements(spark, d, "file", "type", "name", "line_start", called=x.called_names(F.col("code"))), "calls"))


def inheritance_by_text(spark: SparkSession, d: str) -> DataFrame:
    return x.inheritance_by_text(elements(spark, d, "type", "language", "code"))


def function_ranges(spark: SparkSession, d: str) -> DataFrame:
    return x.ranges(elements(spark, d, "file", "type", "line_start", "line_end").where("type in ('function', 'method')"))


def element_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Documents that name a code element."""
    return x.mentions(table(spark, d, "documents"), "doc_id", "text", elements(spark, d, "name", "file", "line_start"))


def named_hits(spark: SparkSession, d: str) -> DataFrame:
    """Elements whose exact name stands in a text, scored by all terms of confidence.

    confidence = 0.30 similarity (1 for an exact name) + 0.20 centrality + 0.20 overlap of names (1) + 0.15 pattern
    (the confidence of a pattern of that name + 0.3, at most 1; else 0.3) + 0.15 recency of the element.
    """
    e, n = graph(spark, d)
    rows = materialize(elements(spark, d, "name", "file", "line_start", "updated_at"), "elements")
    hits = x.mentions(table(spark, d, "documents"), "doc_id", "text", rows)
    newest = rows.agg(F.max("updated_at")).first()[0]
    days = F.timestamp_diff("DAY", F.col("updated_at"), F.lit(newest).cast("timestamp_ntz"))
    recency = F.when(days.isNull(), 0.5).when(days < 7, 1.0).when(days < 30, 0.8).when(days < 90, 0.6).when(days < 365, 0.4).otherwise(0.1)
    known = patterns(spark, d, "name", "confidence_score").groupBy(F.lower("name").alias("_name")).agg(F.max(F.coalesce("confidence_score", F.lit(0.5))).alias("_p"))
    facts = rows.select("id", "file", F.lower("name").alias("_name"), recency.alias("_r")).join(degrees(e, n).select("id", "centrality"), "id", "left").join(known, "_name", "left")
    score = 0.30 + 0.20 * F.coalesce("centrality", F.lit(0.0)) + 0.20 + 0.15 * F.when(F.col("_p").isNull(), 0.3).otherwise(F.least(F.lit(1.0), F.col("_p") + 0.3)) + 0.15 * F.col("_r")
    tier = F.when(F.col("_s") > 0.7, "high").when(F.col("_s") > 0.4, "medium").otherwise("low")
    return hits.join(facts, "id").withColumn("_s", score).select("doc_id", "word", "id", "file", F.round("_s", 3).alias("confidence"), tier.alias("tier"))


def structure_stats(spark: SparkSession, d: str) -> DataFrame:
    return x.structures(elements(spark, d, "language", **x.structure_marks()))


def context_once(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of every node, each in the first of its lists only: callers, callees, dependencies, dependents."""
    e, n = graph(spark, d)
    e = materialize(e, "edges")
    lists = [("CALLS", True), ("CALLS", False), (None, False), (None, True)]
    rows = None
    for i, (rel, incoming) in enumerate(lists):
        part = neighbours(e, n, [rel] if rel else DEPENDENCY_TYPES, incoming).select("node_id", "other_id", F.lit(i).alias("list"))
        rows = part if rows is None else rows.unionByName(part)
    return x.once(rows, ["node_id"], "other_id", ["list"])


def import_edges(spark: SparkSession, d: str) -> DataFrame:
    """Files and the modules they import, in all languages."""
    return x.import_edges(elements(spark, d, "file", "language", modules=x.imported_modules(language_name("language"), F.col("code"))))


def contains_edges(spark: SparkSession, d: str) -> DataFrame:
    """Elements in their class, or else in their file."""
    return x.contains_edges(elements(spark, d, "file", "type", "name", "line_start"))


def trait_edges(spark: SparkSession, d: str) -> DataFrame:
    return x.trait_edges(elements(spark, d, "type", "name", impls=x.trait_impls(language_name("language"), F.col("code"))))


def text_checks(spark: SparkSession, d: str) -> DataFrame:
    """Complexity, length, nesting, parameters and naming in languages without a parser here."""
    lang, code = language_name("language"), F.col("code")
    return x.text_checks(elements(spark, d, "type", "name", "language", "line_start", "line_end", "parameters", complexity=x.complexity(lang, code), depth=x.block_depth(lang, code)))


def text_complexity(spark: SparkSession, d: str) -> DataFrame:
    """Complexity and depth of blocks of every routine, whatever the limits."""
    lang, code = language_name("language"), F.col("code")
    rows = elements(spark, d, "type", complexity=x.complexity(lang, code), depth=x.block_depth(lang, code))
    return rows.where("type in ('function', 'method') and complexity is not null").select("id", "complexity")


def findings_silenced(spark: SparkSession, d: str) -> DataFrame:
    """Security findings under rules made of the projects: a project with a language silences all in its folder, one without only weak digests."""
    found = security_counts(spark, d).join(elements(spark, d, "file"), "id").select("id", "rule_id", "file")
    rules = table(spark, d, "projects").select(F.when(F.col("language").isNull(), "SEC052").alias("rule_id"), F.concat("path", F.lit("/*")).alias("glob")).distinct()
    return x.suppress_by_glob(found, rules)


_FIRST = "(SELECT {name} AS called, arg_min(id, (file, line_start, id)) AS dst FROM el WHERE name IS NOT NULL GROUP BY 1)"
_WORDS = ", ".join(f"'{k}'" for k in x.KEYWORDS)
QUERIES = {f.__name__: f for f in (calls_by_text, inheritance_by_text, function_ranges, element_mentions, structure_stats, context_once, named_hits, import_edges, contains_edges, trait_edges, text_checks, text_complexity, findings_silenced)}
_BARE = """regexp_replace(code, '"(?:\\\\.|[^"\\\\\n])*"|''(?:\\\\.|[^''\\\\\n]){many}''|`[^`]*`|//[^\n]*|/\\*[\\s\\S]*?\\*/', ' ', 'g')"""
_SPENT = f"""@, cx AS (SELECT id, 1 + len(CASE language WHEN 'rust' THEN regexp_extract_all({_BARE.format(many="")}, '\\b(?:if|while|for|loop)\\b|=>') WHEN 'go' THEN regexp_extract_all({_BARE.format(many="")}, '\\b(?:if|for|case|select)\\b')
 WHEN 'javascript' THEN regexp_extract_all({_BARE.format(many="*")}, '\\b(?:if|for|while|case)\\b|\\s\\?\\s') WHEN 'typescript' THEN regexp_extract_all({_BARE.format(many="*")}, '\\b(?:if|for|while|case)\\b|\\s\\?\\s') END) AS complexity, el.* EXCLUDE (id) FROM el)"""
ORACLES = {
    "text_complexity": over("el", then=_SPENT + " SELECT id, CAST(complexity AS INTEGER) AS complexity FROM cx WHERE type IN ('function', 'method') AND complexity IS NOT NULL").replace(" @,", ","),
    "text_checks": over("el", then=_SPENT + """, c AS (SELECT *, split_part(name, '.', -1) AS nm, line_end - line_start + 1 AS size, len(list_filter(parameters, lambda p: NOT regexp_matches(p, '^&?(?:mut )?self\\b'))) AS n FROM cx WHERE language IN ('rust', 'go', 'javascript', 'typescript'))
 SELECT id, 'TS-COMPLEXITY' AS rule_id, 'warning' AS severity, CAST(complexity AS VARCHAR) AS detail FROM c WHERE type IN ('function', 'method') AND complexity > 10
 UNION ALL SELECT id, 'TS-LONG-FN', 'warning', CAST(size AS VARCHAR) FROM c WHERE type IN ('function', 'method') AND size > 60
 UNION ALL SELECT id, 'TS-TOO-MANY-PARAMS', 'suggestion', CAST(n AS VARCHAR) FROM c WHERE type IN ('function', 'method') AND n > 5
 UNION ALL SELECT id, CASE language WHEN 'rust' THEN 'TS-RUST-NAMING' WHEN 'go' THEN 'TS-GO-NAMING' WHEN 'javascript' THEN 'TS-JS-NAMING' ELSE 'TS-TS-NAMING' END, 'suggestion', nm FROM c WHERE length(nm) > 1 AND CASE
 WHEN language = 'rust' AND type IN ('function', 'method') THEN NOT regexp_matches(nm, '^[a-z][a-z0-9_]*$') WHEN language = 'rust' AND type IN ('struct', 'enum') THEN NOT regexp_matches(nm, '^[A-Z][a-zA-Z0-9]*$')
 WHEN language = 'go' AND type IN ('function', 'method') THEN NOT regexp_matches(nm, '^[a-zA-Z][a-zA-Z0-9]*$')
 WHEN language IN ('javascript', 'typescript') AND type IN ('function', 'method') THEN NOT regexp_matches(nm, '^[a-z_$][a-zA-Z0-9_$]*$|^[A-Z][a-zA-Z0-9]*$')
 WHEN language IN ('javascript', 'typescript') AND type IN ('class', 'interface') THEN NOT regexp_matches(nm, '^[A-Z][a-zA-Z0-9]*$') END""").replace(" @,", ","),
    "import_edges": over("el", then="""@, m AS (SELECT file, language, unnest(CASE language
 WHEN 'python' THEN list_concat(regexp_extract_all(code, '(?m)^[ \\t]*import[ \\t]+([A-Za-z_][A-Za-z0-9_.]*)', 1), regexp_extract_all(code, '(?m)^[ \\t]*from[ \\t]+([A-Za-z_.][A-Za-z0-9_.]*)[ \\t]+import\\b', 1))
 WHEN 'rust' THEN regexp_extract_all(code, '(?m)^[ \\t]*(?:pub[ \\t]+)?use[ \\t]+(?:::)?([A-Za-z_][A-Za-z0-9_]*)', 1)
 WHEN 'go' THEN CASE WHEN regexp_matches(code, '(?m)^[ \\t]*import\\b') THEN list_transform(list_filter(list_concat(regexp_extract_all(code, '(?m)^[ \\t]*import[ \\t]+(?:[A-Za-z0-9_.]+[ \\t]+)?"([^"\\n]+)"', 1), regexp_extract_all(code, '(?m)^[ \\t]*(?:[A-Za-z0-9_.]+[ \\t]+)?"([^"\\n]+)"[ \\t]*\\r?$', 1)), lambda x: NOT starts_with(x, '.')), lambda x: split_part(x, '/', -1)) END
 WHEN 'javascript' THEN list_transform(regexp_extract_all(code, '(?m)^[ \\t]*import\\b[^''"\\n]*[''"]([^''"\\n]+)[''"]', 1), lambda x: split_part(regexp_replace(x, '^[./]+', ''), '/', 1))
 WHEN 'typescript' THEN list_transform(regexp_extract_all(code, '(?m)^[ \\t]*import\\b[^''"\\n]*[''"]([^''"\\n]+)[''"]', 1), lambda x: split_part(regexp_replace(x, '^[./]+', ''), '/', 1)) END) AS module FROM el WHERE file IS NOT NULL)
 SELECT DISTINCT file, language, module, sha256('file:' || file)[:16] AS source_id, sha256('module:' || module)[:16] AS target_id FROM m WHERE module <> ''""").replace(" @,", ","),
    "contains_edges": over("el", then="""@, r AS (SELECT * FROM el WHERE file IS NOT NULL AND type <> 'file'), c AS (SELECT file, split_part(name, '.', -1) AS owner, arg_min(id, (line_start, id)) AS class_id FROM r WHERE type IN ('class', 'struct') AND name IS NOT NULL GROUP BY 1, 2),
 m AS (SELECT r.id, r.file, CASE WHEN c.class_id <> r.id THEN c.class_id END AS own FROM r LEFT JOIN c ON c.file = r.file AND c.owner = CASE WHEN contains(r.name, '.') THEN split_part(r.name, '.', -2) END)
 SELECT coalesce(own, sha256('file:' || file)[:16]) AS source_id, id AS target_id, CASE WHEN own IS NULL THEN 'file' ELSE 'class' END AS container FROM m""").replace(" @,", ","),
    "named_hits": over("nd", "raw", "ed", "el", "pt", then=_DEG + f""", n AS {_FIRST.format(name="name")}, w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.]{{2,}}')) AS word FROM documents WHERE text IS NOT NULL),
 h AS (SELECT DISTINCT doc_id, word, dst AS id FROM w JOIN n ON n.called = w.word), m AS (SELECT max(updated_at) AS m FROM el), kp AS (SELECT lower(name) AS name, max(coalesce(confidence_score, 0.5)) AS p FROM pt GROUP BY 1),
 x AS (SELECT doc_id, word, id, file, 0.5::DOUBLE + 0.2::DOUBLE * least(1.0::DOUBLE, coalesce(callers + callees + dependencies + dependents, 0) / 10.0) + 0.15::DOUBLE * CASE WHEN p IS NULL THEN 0.3 ELSE least(1.0::DOUBLE, p + 0.3) END
 + 0.15::DOUBLE * CASE WHEN updated_at IS NULL THEN 0.5 WHEN m - updated_at < INTERVAL 7 DAY THEN 1.0 WHEN m - updated_at < INTERVAL 30 DAY THEN 0.8 WHEN m - updated_at < INTERVAL 90 DAY THEN 0.6 WHEN m - updated_at < INTERVAL 365 DAY THEN 0.4 ELSE 0.1 END::DOUBLE AS s
 FROM h JOIN el USING (id) LEFT JOIN deg USING (id) LEFT JOIN kp ON kp.name = lower(el.name), m)
 SELECT doc_id, word, id, file, round(s, 3) AS confidence, CASE WHEN s > 0.7 THEN 'high' WHEN s > 0.4 THEN 'medium' ELSE 'low' END AS tier FROM x""").replace(") , inc AS", "), inc AS"),
    "trait_edges": over("el", then="""@, i AS (SELECT DISTINCT split_part(unnest(regexp_extract_all(code, '\\bimpl(?:\\s*<[^>]*>)?\\s+([A-Za-z0-9_:]+)(?:<[^>]*>)?\\s+for\\s+([A-Za-z0-9_]+)', 1)), '::', -1) AS base,
 unnest(regexp_extract_all(code, '\\bimpl(?:\\s*<[^>]*>)?\\s+([A-Za-z0-9_:]+)(?:<[^>]*>)?\\s+for\\s+([A-Za-z0-9_]+)', 2)) AS of FROM el WHERE language = 'rust'), n AS (SELECT name, min(id) AS child FROM el WHERE type IN ('struct', 'enum', 'class') GROUP BY 1)
 SELECT DISTINCT child, base FROM i JOIN n ON n.name = i.of""").replace(" @,", ","),
    "findings_silenced": _on_counts("""SELECT sc.id, sc.rule_id, el.file, EXISTS (SELECT 1 FROM projects p WHERE (p.language IS NOT NULL OR sc.rule_id = 'SEC052') AND starts_with(coalesce(el.file, ''), p.path || '/')) AS suppressed FROM sc JOIN el USING (id)"""),
    "calls_by_text": over("el", then=f"""@, d AS {_FIRST.format(name="split_part(name, '.', -1)")}, c AS (SELECT DISTINCT id AS src, unnest(regexp_extract_all(code, '([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1)) AS called FROM el
 WHERE code IS NOT NULL AND type IN ('function', 'method')) SELECT DISTINCT src, dst FROM c JOIN d USING (called) WHERE src <> dst AND length(called) > 1 AND called NOT IN ({_WORDS})""").replace(" @,", ","),
    "inheritance_by_text": over("el", then="""@, b AS (SELECT id AS child, unnest(CASE WHEN language = 'python' THEN regexp_split_to_array(regexp_extract(coalesce(code, ''), '^\\s*class\\s+[A-Za-z_]\\w*\\s*\\(([^)]*)\\)', 1), '\\s*,\\s*')
 ELSE [regexp_extract(coalesce(code, ''), 'class\\s+[A-Za-z_]\\w*(?:<[^>{]*>)?\\s+extends\\s+([A-Za-z_][\\w.]*)', 1)] END) AS b FROM el WHERE type IN ('class', 'struct'))
 SELECT DISTINCT child, split_part(trim(b), '.', -1) AS base FROM b WHERE split_part(trim(b), '.', -1) <> '' AND NOT contains(b, '=')""").replace(" @,", ","),
    "function_ranges": over("el", then="""SELECT id, file, line_start, greatest(line_start, coalesce(lead(line_start) OVER (PARTITION BY file ORDER BY line_start, id) - 1, line_end)) AS end_guess
 FROM el WHERE file IS NOT NULL AND line_start IS NOT NULL AND type IN ('function', 'method')"""),
    "element_mentions": over("el", then=f"""@, n AS {_FIRST.format(name="name")}, w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.]{{2,}}')) AS word FROM documents WHERE text IS NOT NULL)
 SELECT DISTINCT doc_id, word, dst AS id FROM w JOIN n ON n.called = w.word""").replace(" @,", ","),
    "structure_stats": over("el", then="""SELECT language, count(*) AS n, count(*) FILTER (WHERE regexp_matches(code, '(?m)^\\s*@\\w')) AS decorators, count(*) FILTER (WHERE regexp_matches(code, '(?m)^\\s*(?:async\\s+)?with\\s')) AS context_managers,
 count(*) FILTER (WHERE regexp_matches(code, '@dataclass|\\bNamedTuple\\b')) AS dataclasses, count(*) FILTER (WHERE regexp_matches(code, '\\byield\\b')) AS generators, count(*) FILTER (WHERE regexp_matches(code, '\\basync\\b|\\bawait\\b')) AS asynchronous,
 count(*) FILTER (WHERE regexp_matches(code, '=>|\\blambda\\b')) AS closures FROM el GROUP BY 1"""),
    "context_once": over("nd", "raw", "ed", then="""SELECT node_id, other_id, CAST(min(l) AS INTEGER) AS list FROM (SELECT dst AS node_id, src AS other_id, 0 AS l FROM ed WHERE rel_type = 'CALLS' UNION ALL SELECT src, dst, 1 FROM ed WHERE rel_type = 'CALLS'
 UNION ALL SELECT src, dst, 2 FROM ed WHERE rel_type <> 'CONTAINS' UNION ALL SELECT dst, src, 3 FROM ed WHERE rel_type <> 'CONTAINS') GROUP BY 1, 2"""),
}
