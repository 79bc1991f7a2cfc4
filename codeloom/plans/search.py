"""Queries of vector search and query understanding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import query as q
from codeloom.operators.vectors import nearest
from codeloom.plans.sql import over
from codeloom.session import materialize, table
from codeloom.sources.tables import elements, patterns


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("grp"))
    return v, v.where("id % 20 = 0")  # the stated query set, against all rows


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return nearest(*_vectors(spark, d), 64, 10)


def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of the query's own label."""
    return nearest(*_vectors(spark, d), 64, 5, within_group=True)


def vector_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return nearest(*_vectors(spark, d), 64, 10, metric="cosine").drop("similarity")


def duplicate_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Of the three patterns nearest to each asked for, those similar enough to report: high from 0.85, similar from 0.70."""
    v = materialize(patterns(spark, d, "embedding").where(F.exists("embedding", lambda x: x != 0)).select("id", F.col("embedding").alias("v"), F.lit("").alias("grp")), "vectors")
    top = nearest(v, v.where("cast(conv(right(id, 8), 16, 10) as bigint) % 20 = 0"), 96, 3, unit=True)
    level = F.when(F.col("similarity") >= 0.85, "DUP-HIGH").when(F.col("similarity") >= 0.70, "DUP-SIMILAR")
    return top.select("query_id", "id", "similarity", level.alias("rule_id")).where("rule_id is not null")


def search_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per query: hits and mean similarity, with the confidence tier of the mean."""
    mean = F.avg("similarity")
    per = vector_topk(spark, d).groupBy("query_id").agg(F.count("*").alias("hits"), F.round(mean, 5).alias("mean_similarity"))
    return per.withColumn("tier", F.when(F.col("mean_similarity") > 0.6, "high").when(F.col("mean_similarity") > 0.3, "medium").otherwise("low"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", "text").distinct()


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Queries with a column per intent: each pattern is tried once, whatever is built on the scores."""
    return _queries(spark, d).select("doc_id", "text", *[c.alias(k) for k, c in q.intent_scores(F.col("text")).items()])


def intent_classify(spark: SparkSession, d: str) -> DataFrame:
    name, conf = q.intent({k: F.col(k) for k in q.INTENTS})
    return _scored(spark, d).select("doc_id", name.alias("intent"), F.round(conf, 6).alias("confidence"))


def expand_terms(spark: SparkSession, d: str) -> DataFrame:
    own = _queries(spark, d).select("doc_id", q.words(F.col("text")).alias("own"))
    return own.select("doc_id", F.explode(q.expanded(F.col("own"))).alias("term"))


def ambiguity(spark: SparkSession, d: str) -> DataFrame:
    """Queries to ask back about: their ambiguous terms and vague words, and the readings to choose from."""
    t, r = q.ambiguous_terms(F.col("text")), q.clarifications(F.col("text"))
    return _queries(spark, d).select("doc_id", F.array_join(t, ",").alias("terms"), F.array_join(r, "|").alias("readings")).where("terms <> ''")


def dynamic_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select("doc_id", q.dynamic_threshold(F.col("text")).alias("threshold"))


def query_confidence(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    _, conf = q.intent({k: F.col(k) for k in q.INTENTS})
    rows = _scored(spark, d).select("doc_id", "text", conf.alias("_c"), F.size(q.terms(text)).alias("n_terms"), (F.size(q.ambiguous_terms(text)) > 0).alias("is_ambiguous"))
    return rows.select("doc_id", "n_terms", "is_ambiguous", q.query_confidence(text, F.col("_c"), F.col("n_terms"), F.col("is_ambiguous")).alias("confidence"))


def name_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How far an element's name is found in its own documentation: 1 if contained, else the share of common words."""
    rows = elements(spark, d, "name", "docstring").where("name is not null and trim(docstring) <> ''")
    name, doc = F.lower("name"), F.lower("docstring")
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("([a-z0-9_]+)"), 1))
    share = F.size(F.array_intersect(words(name), words(doc))) / F.greatest(F.size(words(name)), F.size(words(doc)), F.lit(1))
    return rows.select("id", F.round(F.when(doc.contains(name) | name.contains(doc), 1.0).otherwise(share), 9).alias("overlap"))


def search_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Elements whose name holds a term, whatever the case."""
    return elements(spark, d, "name", "type", "file").where(F.contains(F.lower("name"), F.lit("queue"))).select("id", "name", "type", "file", F.lit(1.0).alias("similarity"))


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """Per file, the elements from the top whose text fits into 4000 characters together; the first that does not ends the list."""
    from pyspark.sql import Window

    rows = elements(spark, d, "file", "line_start", size=F.least(F.length("code"), F.lit(500)) + 20).where("size is not null and file is not null")
    used = F.sum("size").over(Window.partitionBy("file").orderBy("line_start", "id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("id", "file", "line_start", used.alias("used")).where("used <= 4000")


_Q = "d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)"


def _near(metric: str, k: int, extra: str = "") -> str:
    f = {"l2": "list_distance", "cosine": "list_cosine_distance"}[metric]
    return f"""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label AS grp FROM embeddings),
 s AS (SELECT q.id AS query_id, v.id, round({f}(q.v, v.v), 6) AS distance FROM v q JOIN v ON q.id <> v.id {extra} WHERE q.id % 20 = 0),
 r AS (SELECT *, round(1 / (1 + distance), 6) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS position FROM s QUALIFY position <= {k}) """


def _score(rx: list[str]) -> str:
    return " + ".join(f"CAST(regexp_matches(lower(text), '{r}') AS INTEGER)" for r in rx)


_INTENT = (
    f"WITH {_Q}, s AS (SELECT *, " + ", ".join(f"{_score(v)} AS {k}" for k, v in q.INTENTS.items()) + " FROM d), b AS (SELECT *, greatest(" + ", ".join(q.INTENTS)
    + ") AS best FROM s), t AS (SELECT *, " + " + ".join(f"CAST({k} = best AS INTEGER)" for k in q.INTENTS) + " AS ties FROM b), i AS (SELECT doc_id, text, CASE WHEN best = 0 OR ties > 1 THEN 'unknown' "
    + " ".join(f"WHEN {k} = best THEN '{k}'" for k in q.INTENTS) + " END AS intent, round(CASE WHEN best = 0 THEN 0.3 WHEN ties > 1 THEN 0.4 ELSE least(0.9, 0.5 + 0.1 * best) END, 6)::DOUBLE AS confidence FROM t)"
)
_NW = "CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) END"
_TERMS = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z_]+'), lambda x: length(x) > 2))"
_MANY = ["auth", "handler", "model", "service", "controller", "client", "worker", "queue", "config", "manager"]
_MEANT = {
    "auth": "Authentication (login/signup)|Authorization (permissions/RBAC)|API authentication (keys/tokens)", "handler": "HTTP request handler|Exception handler|Event handler", "model": "Data model/ORM|MVC Model|AI/ML model",
    "service": "Business logic service|Microservice|External API service", "controller": "MVC Controller|Game controller|Hardware controller", "client": "API client|Frontend/client-side|Customer/client entity",
    "worker": "Background job worker|Web worker|Service worker", "queue": "Message queue|Task queue|Job queue", "config": "Configuration files|App settings|Environment config", "manager": "Resource manager|State manager|Connection manager",
}
_W, _E = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"
_AMB = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{_W}{t}{_E}') THEN '{t}' END" for t in _MANY) + """, CASE WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(it|this|that|these|those)([^\\p{L}\\p{N}_]|$)') THEN 'vague language (unclear reference)' END,
 CASE WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(all|every|each)([^\\p{L}\\p{N}_]|$)') THEN 'vague language (overly broad scope)' END, CASE WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(some|few|many)([^\\p{L}\\p{N}_]|$)') THEN 'vague language (imprecise quantity)' END], lambda x: x IS NOT NULL)"""
_ASK = "flatten([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{_W}{t}{_E}') THEN string_split('{r}', '|') ELSE [] END" for t, r in _MEANT.items()) + "])[1:6]"
_EXPANDED = """, k AS (SELECT term, string_split(l, '|') AS l FROM (VALUES ('auth', 'authentication|authorization|login|logout|session|credential|password|oauth|jwt|identity'), ('login', 'authentication|signin|auth|session|credential'),
 ('logout', 'signout|session|invalidate|clear'), ('dto', 'data transfer object|model|schema|payload|request|response'), ('orm', 'object relational mapping|database|sql|model|entity'), ('db', 'database|storage|persistence|sql|query'),
 ('cache', 'memoization|redis|memcached|storage|buffer|ttl'), ('api', 'endpoint|route|controller|handler|rest|graphql'), ('endpoint', 'api|route|url|path|handler'), ('middleware', 'interceptor|filter|pipeline|handler'),
 ('test', 'unittest|pytest|mock|fixture|coverage|assert'), ('mock', 'stub|fake|test double|unittest.mock|monkeypatch'), ('perf', 'performance|optimization|speed|latency|throughput|efficiency|fast|slow|bottleneck'),
 ('optimize', 'performance|improve|efficient|fast|speed up'), ('memory', 'ram|heap|leak|usage|consumption'), ('error', 'exception|raise|catch|handle|error handling|fail'), ('exception', 'error|raise|catch|try|except|finally'),
 ('debug', 'debugger|breakpoint|trace|logging|print|inspect'), ('service', 'business logic|use case|interactor|domain'), ('repo', 'repository|data access|dao|persistence|store'), ('controller', 'handler|endpoint|view|api|route'),
 ('model', 'entity|domain|data class|schema|orm'), ('singleton', 'single instance|global|shared|one instance'), ('factory', 'creator|builder|constructor|instantiate'), ('observer', 'pub sub|event|listener|callback|subscribe'),
 ('decorator', 'wrapper|aspect|annotation|attribute')) v(term, l)), kn AS (SELECT *, row_number() OVER () AS n FROM k),
 syn AS (SELECT x, arg_min(term, n) AS term FROM (SELECT unnest(l) AS x, term, n FROM kn) WHERE x NOT IN (SELECT term FROM k) GROUP BY 1),
 w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM d),
 hit AS (SELECT DISTINCT w.doc_id, k.term, k.l FROM w JOIN k ON contains(w.w, k.term) OR contains(k.term, w.w) UNION SELECT w.doc_id, k.term, k.l FROM w JOIN syn ON syn.x = w.w JOIN k ON k.term = syn.term),
 t AS (SELECT doc_id, w AS term FROM w UNION SELECT doc_id, term FROM hit UNION SELECT doc_id, unnest(l) FROM hit)
 SELECT doc_id, term FROM t WHERE length(term) > 2 AND term NOT IN ('the','a','an','is','are','was','were','be','been','being','have','has','had','do','does','did','will','would','could','should','may','might','must','shall','can','need','dare','ought','used','to','of','in','for','on','with','at','by','from',
 'as','into','through','during','before','after','above','below','between','under','and','but','or','yet','so','if','because','although','though','while','where','when','that','which','who','whom','whose','what','this','these','those','i','you','he','she','it','we','they')"""

QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, vector_topk_filtered, vector_topk_cosine, duplicate_candidates, search_summary, intent_classify, expand_terms, ambiguity, dynamic_threshold,
        query_confidence, name_overlap, search_by_name, context_budget,
    )
}
ORACLES = {
    "vector_topk": _near("l2", 10) + "SELECT * FROM r",
    "vector_topk_filtered": _near("l2", 5, "AND q.grp = v.grp") + "SELECT * FROM r",
    "vector_topk_cosine": _near("cosine", 10) + "SELECT query_id, id, distance, position FROM r",
    "duplicate_candidates": over("pt", then="""@, v AS (SELECT id, CAST(embedding AS DOUBLE[]) AS e FROM pt WHERE len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS v FROM v),
 s AS (SELECT q.id AS query_id, u.id, round(list_distance(q.v, u.v), 6) AS distance FROM u q JOIN u ON q.id <> u.id WHERE CAST('0x' || right(q.id, 8) AS BIGINT) % 20 = 0),
 r AS (SELECT *, round(1 / (1 + distance), 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 3)
 SELECT query_id, id, similarity, CASE WHEN similarity >= 0.85 THEN 'DUP-HIGH' ELSE 'DUP-SIMILAR' END AS rule_id FROM r WHERE similarity >= 0.70""").replace(" @,", ","),
    "search_summary": _near("l2", 10) + """, m AS (SELECT query_id, count(*) AS hits, round(avg(similarity), 5) AS mean_similarity FROM r GROUP BY 1)
 SELECT *, CASE WHEN mean_similarity > 0.6 THEN 'high' WHEN mean_similarity > 0.3 THEN 'medium' ELSE 'low' END AS tier FROM m""",
    "intent_classify": _INTENT + " SELECT doc_id, intent, confidence FROM i",
    "expand_terms": f"WITH {_Q}" + _EXPANDED,
    "ambiguity": f"WITH {_Q} SELECT doc_id, array_to_string({_AMB}, ',') AS terms, coalesce(array_to_string({_ASK}, '|'), '') AS readings FROM d WHERE len({_AMB}) > 0",
    "dynamic_threshold": f"""WITH {_Q} SELECT doc_id, round(greatest(0.1, least(0.5, 0.2 + CASE WHEN {_NW} <= 2 THEN 0.15 WHEN {_NW} >= 6 THEN -0.05 ELSE 0 END
 + CASE WHEN regexp_matches(lower(text), '\\b({"|".join(q.TECHNICAL)})\\b') THEN 0.05 ELSE 0 END + CASE WHEN contains(text, '_') OR regexp_matches(text, '[a-z][A-Z]') THEN 0.1 ELSE 0 END)), 6)::DOUBLE AS threshold FROM d""",
    "query_confidence": _INTENT + f""", n AS (SELECT *, len({_TERMS}) AS n_terms, len({_AMB}) > 0 AS is_ambiguous, {_NW} AS w FROM i)
 SELECT doc_id, CAST(n_terms AS INTEGER) AS n_terms, is_ambiguous, round(greatest(0, least(1, confidence + CASE WHEN w >= 5 THEN 0.1 WHEN w <= 2 THEN -0.15 ELSE 0 END
 + CASE WHEN n_terms >= 5 THEN 0.1 WHEN n_terms <= 2 THEN -0.1 ELSE 0 END + CASE WHEN is_ambiguous THEN -0.25 ELSE 0 END)), 6)::DOUBLE AS confidence FROM n""",
    "name_overlap": over("el", then="""SELECT id, round(CASE WHEN contains(lower(docstring), lower(name)) OR contains(lower(name), lower(docstring)) THEN 1.0 ELSE
 len(list_intersect(regexp_extract_all(lower(name), '[a-z0-9_]+'), regexp_extract_all(lower(docstring), '[a-z0-9_]+')))
 / greatest(len(list_distinct(regexp_extract_all(lower(name), '[a-z0-9_]+'))), len(list_distinct(regexp_extract_all(lower(docstring), '[a-z0-9_]+'))), 1) END, 9) AS overlap
 FROM el WHERE name IS NOT NULL AND trim(docstring) <> ''"""),
    "search_by_name": over("el", then="SELECT id, name, type, file, CAST(1 AS DOUBLE) AS similarity FROM el WHERE contains(lower(name), 'queue')"),
    "context_budget": over("el", then="SELECT id, file, line_start, CAST(sum(least(length(code), 500) + 20) OVER (PARTITION BY file ORDER BY line_start NULLS FIRST, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM el WHERE code IS NOT NULL AND file IS NOT NULL QUALIFY used <= 4000"),
}
