"""Checks over source text, suppressions and verdicts; all line work happens on arrays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import split_lines

# The rules, their severities and categories, and their patterns (case-insensitive, over the whole text).
SECURITY_RULES = [
    ("SEC010", "high", "injection", r"(?:execute|executemany|raw)\s*\(\s*[f]?['\"].*?(?:SELECT|INSERT|UPDATE|DELETE|DROP).*?%[sd]"),
    ("SEC011", "high", "injection", r"(?:execute|executemany|raw)\s*\(\s*f['\"].*?(?:SELECT|INSERT|UPDATE|DELETE|DROP).*?\{"),
    ("SEC012", "high", "injection", r"(?:execute|executemany)\s*\([^)]*\+\s*(?:str\()?[a-zA-Z_][a-zA-Z0-9_]*"),
    ("SEC020", "high", "injection", r"os\.system\s*\(\s*[f]?['\"].*?\{|os\.system\s*\([^)]*\+"),
    ("SEC021", "medium", "injection", r"subprocess\.(?:run|call|Popen)\s*\([^)]*shell\s*=\s*True"),
    ("SEC022", "high", "injection", r"(?<!literal_)eval\s*\(\s*(?:[a-zA-Z_][a-zA-Z0-9_]*|[f]?['\"].*?\{)"),
    ("SEC023", "high", "injection", r"exec\s*\(\s*(?:[a-zA-Z_][a-zA-Z0-9_]*|[f]?['\"].*?\{)"),
    ("SEC030", "medium", "xss", r"\{\{\s*[a-zA-Z_][a-zA-Z0-9_.]*\s*\}\}(?!\s*\|.*?escape)"),
    ("SEC031", "medium", "xss", r"\.innerHTML\s*=\s*[^'\"]+"),
    ("SEC032", "medium", "xss", r"document\.write\s*\("),
    ("SEC040", "medium", "path_traversal", r"(?:open|read|write)\s*\([^)]*\+\s*[a-zA-Z_][a-zA-Z0-9_]*"),
    ("SEC050", "medium", "configuration", r"DEBUG\s*=\s*True|debug\s*=\s*True|\.run\s*\([^)]*debug\s*=\s*True"),
    ("SEC051", "high", "configuration", r"verify\s*=\s*False|ssl[_.]verify\s*=\s*False"),
    ("SEC052", "medium", "cryptography", r"(?:hashlib\.)?md5\s*\("),
    ("SEC053", "low", "cryptography", r"(?:hashlib\.)?sha1\s*\("),
    ("SEC054", "high", "cryptography", r"(?:iv|nonce)\s*=\s*[b]?['\"][^'\"]+['\"]"),
    ("SEC060", "high", "deserialization", r"pickle\.loads?\s*\("),
    ("SEC061", "high", "deserialization", r"yaml\.load\s*\((?![^)]*SafeLoader)"),
    ("SEC070", "low", "information_disclosure", r"traceback\.print_exc|print\s*\(\s*(?:e|err|error|exception)\s*\)"),
    ("SEC071", "medium", "information_disclosure", r"(?:raise|return)\s+[A-Za-z]*(?:Error|Exception)\s*\([^)]*\{(?:password|secret|api_key|token|credential)[^}]*\}"),
]
# Rules of our own, for secrets in plain assignments; the full search is a separate operator.
SECURITY_RULES += [
    ("SEC001", "critical", "secrets", r"(?:password|passwd|pwd)\s*[:=]\s*['\"][^'\"\s]{8,}['\"]"),
    ("SEC002", "critical", "secrets", r"(?:api_?key|secret|token)\s*[:=]\s*['\"][A-Za-z0-9+/_=-]{16,}['\"]"),
    ("SEC005", "critical", "secrets", r"AKIA[0-9A-Z]{16}"),
    ("SEC007", "critical", "secrets", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
]
SECURITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}


def rank(severity: Column, order: list[str]) -> Column:
    """Position of a severity, most severe first; unknown ones come last."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, order)), severity), F.lit(0)).cast("int")


def security_counts(files: DataFrame, text: str = "code") -> DataFrame:
    """``id, rule_id, severity, category, n``: matches of each rule in each text. One pass over the text; no shuffle."""
    each = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), F.lit(c).alias("category"), F.regexp_count(F.col(text), F.lit("(?im)" + p)).alias("n")) for r, s, c, p in SECURITY_RULES])
    return files.where(F.col(text).isNotNull()).select("id", F.explode(F.filter(each, lambda x: x["n"] > 0)).alias("f")).select("id", "f.*")


def _feeds(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def security_findings(files: DataFrame, text: str = "code") -> DataFrame:
    """Every match with ``rule_id, severity, category``, its line, columns (from 1; the end is exclusive) and text. Rules see the whole text, as classes cross lines.

    A text is matched once per rule and split only by the rules that match. Where a match begins follows from a
    running sum over the line feeds of what lies before it.
    """
    each = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), F.lit(c).alias("category"), F.lit("(?im)(?:" + p + ")").alias("rx"), F.regexp_extract_all(F.col(text), F.lit("(?im)(" + p + ")"), F.lit(1)).alias("m")) for r, s, c, p in SECURITY_RULES])
    hit = files.where(F.col(text).isNotNull()).select("id", F.col(text).alias("_t"), F.explode(F.filter(each, lambda x: F.size(x["m"]) > 0)).alias("f"))
    parts = hit.select("id", "f.*", F.split("_t", F.col("f.rx"), -1).alias("_s"))

    def tail(c: Column) -> Column:
        return F.length(F.substring_index(c, "\n", -1))

    pieces = F.arrays_zip(F.transform("_s", _feeds).alias("sf"), F.transform("_s", tail).alias("st"), F.transform("m", _feeds).alias("mf"), F.transform("m", tail).alias("mt"))
    zero = F.struct(F.lit(1).alias("line"), F.lit(1).alias("col"), F.array().cast("array<struct<line:int,col:int>>").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        line, col = (acc["line"] + x["sf"]).cast("int"), F.when(x["sf"] > 0, x["st"] + 1).otherwise(acc["col"] + x["st"]).cast("int")
        after, then = (line + F.coalesce(x["mf"], F.lit(0))).cast("int"), F.when(x["mf"] > 0, x["mt"] + 1).otherwise(col + F.coalesce(x["mt"], F.lit(0))).cast("int")
        return F.struct(after.alias("line"), then.alias("col"), F.array_append(acc["at"], F.struct(line.alias("line"), col.alias("col"))).alias("at"))

    places = F.aggregate(pieces, zero, step, lambda acc: acc["at"])
    rows = parts.select("id", "rule_id", "severity", "category", F.explode(F.arrays_zip(F.slice(places, F.lit(1), F.size("m")).alias("at"), F.col("m").alias("match"))).alias("f"))
    return rows.select("id", "rule_id", "severity", "category", F.col("f.at.line").alias("line"), F.col("f.at.col").alias("column"), "f.match")


def lines(files: DataFrame, text: str = "code", *keep: str) -> DataFrame:
    """``id, line, body``: the lines of every text, counted from 1."""
    return files.where(F.col(text).isNotNull()).select("id", *keep, F.posexplode(split_lines(text)).alias("_i", "body")).select("id", *keep, (F.col("_i") + 1).alias("line"), "body")


def is_long(body: str, limit: int = 120) -> Column:
    head = F.ltrim(body)
    return (F.length(body) > limit) & ~head.startswith("//") & ~head.startswith("/*") & ~head.startswith("*")


def long_lines(rows: DataFrame, limit: int = 120) -> DataFrame:
    return rows.where(is_long("body", limit)).select("id", "line", F.length("body").alias("length"))


def todo_mark(body: str) -> Column:
    return F.upper(F.regexp_extract(body, r"(?i)(?://|#|/\*|\*)\s*(TODO|FIXME|HACK|XXX)\b", 1))


def tool_mark(body: str) -> Column:
    """The first linter mark of a line, in lower case."""
    return F.lower(F.regexp_extract(body, r"(?i)\b(noqa|nolint|eslint-disable-next-line|eslint-disable|pylint: disable)\b", 1))


def next_line(line: Column, mark: Column) -> Column:
    """The line a mark speaks of."""
    return (line + F.when(mark == "eslint-disable-next-line", 1).otherwise(0)).cast("int")


def tool_marks(rows: DataFrame) -> DataFrame:
    mark = tool_mark("body")
    return rows.select("id", next_line(F.col("line"), mark).alias("line"), mark.alias("mark")).where("mark <> ''")


def todo_markers(rows: DataFrame) -> DataFrame:
    """First TODO, FIXME, HACK or XXX comment of a line; FIXME is a warning."""
    return rows.select("id", "line", todo_mark("body").alias("marker")).where("marker <> ''").withColumn("severity", F.when(F.col("marker") == "FIXME", "warning").otherwise("suggestion"))


def nesting(rows: DataFrame, limit: int = 5) -> DataFrame:
    """First line of each (depth, block of five lines) that is indented deeper than ``limit`` levels (a tab or four spaces)."""
    white = F.regexp_extract("body", r"^([ \t]*)", 1)
    tabs = F.length(white) - F.length(F.replace(white, F.lit("\t"), F.lit("")))
    depth = tabs + F.floor((F.length(white) - tabs) / 4)
    code = F.ltrim(F.regexp_replace("body", "\t", " "))
    deep = rows.select("id", "line", depth.cast("int").alias("depth"), code.alias("_c")).where((F.col("depth") > limit) & (F.col("_c") != "") & ~F.col("_c").startswith("//") & ~F.col("_c").startswith("#"))
    return deep.groupBy("id", "depth", F.floor(F.col("line") / 5).cast("int").alias("block")).agg(F.min("line").alias("line"))


def long_routines(elements: DataFrame, limit: int = 60) -> DataFrame:
    """Routines longer than ``limit`` lines: one that has no end of its own ends where the next of its file begins."""
    return elements.select("id", "file", "line_start", (F.col("line_end") - F.col("line_start") + 1).alias("length")).where(F.col("length") > limit)


def inline_suppressions(rows: DataFrame, tag: str = "codeloom") -> DataFrame:
    """``id, line, rule_id``: suppressed rules per line ('*' for all), from ``tag: ignore [ids]`` and ``ignore-next-line [ids]`` comments."""
    found = F.regexp_extract("body", rf"(?i){tag}:\s*(ignore-next-line|ignore)\b", 1)
    ids = F.regexp_extract("body", rf"(?i){tag}:\s*(?:ignore-next-line|ignore)\b[ \t]*([A-Za-z0-9_, \t-]*)", 1)
    parts = F.filter(F.split(F.trim(ids), r"[,\s]+"), lambda x: x != "")
    marked = rows.select("id", "line", F.lower(found).alias("_k"), F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("*"))).alias("_ids")).where("_k <> ''")
    return marked.select("id", (F.col("line") + F.when(F.col("_k") == "ignore-next-line", 1).otherwise(0)).alias("line"), F.explode("_ids").alias("rule_id")).distinct()


def apply_suppressions(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Findings with ``suppressed``: marked where the line is suppressed for all rules or for theirs; none is removed."""
    per_line = suppressions.groupBy("id", "line").agg(F.collect_set("rule_id").alias("_ids"))
    joined = findings.join(per_line, ["id", "line"], "left")
    return joined.withColumn("suppressed", F.coalesce(F.array_contains("_ids", "*") | F.array_contains("_ids", F.col("rule_id")), F.lit(False))).drop("_ids")


def summary(findings: DataFrame, *by: str) -> DataFrame:
    """Active findings per severity, and whether a critical one blocks."""
    live = ~F.col("suppressed") if "suppressed" in findings.columns else F.lit(True)
    counts = [F.count_if(live & (F.col("severity") == s)).alias(s) for s in SECURITY_RANK]
    return findings.groupBy(*by).agg(*counts).withColumn("blocking", F.col("critical") > 0)


def _level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity.isin("suggestion", "praise", "low", "info"), "note").otherwise("warning")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One SARIF 2.1.0 rule per rule that has an active finding, as JSON text, at its gravest level, with the number of its results."""
    order = F.array(*map(F.lit, ["note", "warning", "error"]))
    live = findings.where("not suppressed").groupBy("rule_id").agg(F.max(F.array_position(order, _level(F.col("severity")))).alias("_l"), F.count("*").alias("results"))
    rule = F.struct(F.col("rule_id").alias("id"), F.struct(F.element_at(order, F.col("_l").cast("int")).alias("level")).alias("defaultConfiguration"))
    return live.select("rule_id", "results", F.to_json(rule).alias("rule"))


def sarif(findings: DataFrame) -> DataFrame:
    """One SARIF 2.1.0 result per active finding, as JSON text."""
    level = _level(F.col("severity"))
    where = F.struct(F.struct(F.struct(F.col("id").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("rule_id").alias("text")).alias("message"), F.array(where).alias("locations"))
    return findings.where("not suppressed").select("id", "line", "rule_id", F.to_json(result).alias("result"))
