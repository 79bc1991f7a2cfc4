"""Queries of parsing, indexing and streams, and the composed search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import parsing
from codeloom.operators.vectors import nearest
from codeloom.plans.sql import over
from codeloom.session import materialize
from codeloom.sources.tables import elements, over_texts, pattern_links, patterns
from codeloom.streaming.interactions import interaction_stream


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return materialize(over_texts(spark, d, lambda t: parsing.facts(t.where("language = 'python'")), "language", "code"), "facts")


def python_elements(spark: SparkSession, d: str) -> DataFrame:
    return parsing.elements_of(_facts(spark, d))


def python_checks(spark: SparkSession, d: str) -> DataFrame:
    return parsing.findings_of(_facts(spark, d))


def python_check_counts(spark: SparkSession, d: str) -> DataFrame:
    return parsing.findings_of(_facts(spark, d)).groupBy("rule_id").agg(F.count("*").alias("n"), F.countDistinct("id").alias("elements"))


def extracted_calls(spark: SparkSession, d: str) -> DataFrame:
    return parsing.resolve_calls(_facts(spark, d), elements(spark, d, "name", "file", "line_start"))


def events_per_day(spark: SparkSession, d: str) -> DataFrame:
    return interaction_stream(spark, d)


def pattern_search(spark: SparkSession, d: str) -> DataFrame:
    """The five patterns most similar to each asked for, with how widely they are used, how recent they are, and a confidence.

    confidence = 0.30 similarity + 0.20 spread + 0.20 same category + 0.15 own confidence + 0.15 recency.
    """
    rows = materialize(patterns(spark, d, "name", "category", "confidence_score", "last_seen", "embedding"), "patterns")
    vectors = rows.where((F.size("embedding") == 96) & F.exists("embedding", lambda x: x != 0)).select("id", F.col("embedding").alias("v"), F.lit("").alias("grp"))
    hits = nearest(vectors, vectors.where("cast(conv(right(id, 8), 16, 10) as bigint) % 20 = 0"), 96, 5, unit=True)
    spread = pattern_links(spark, d).groupBy(F.col("pattern_id").alias("id")).agg(F.count("*").alias("projects"))
    latest_at = rows.agg(F.max("last_seen")).first()[0]
    days = F.timestamp_diff("DAY", F.col("last_seen"), F.lit(latest_at).cast("timestamp_ntz"))
    recency = F.when(days.isNull(), 0.5).when(days < 7, 1.0).when(days < 30, 0.8).when(days < 90, 0.6).when(days < 365, 0.4).otherwise(0.1)
    facts = rows.select("id", "name", "category", F.coalesce("confidence_score", F.lit(0.0)).alias("_c"), recency.alias("_r")).join(spread, "id", "left").fillna(0, ["projects"])
    asked = rows.select(F.col("id").alias("query_id"), F.col("category").alias("_qc"))
    score = 0.30 * F.col("similarity") + 0.20 * F.least(F.lit(1.0), F.col("projects") / 10.0) + 0.20 * F.when(F.col("_qc").eqNullSafe(F.col("category")), 1.0).otherwise(0.0) + 0.15 * F.col("_c") + 0.15 * F.col("_r")
    out = hits.join(facts, "id").join(asked, "query_id")
    tier = F.when(F.col("_s") > 0.7, "high").when(F.col("_s") > 0.4, "medium").otherwise("low")
    return out.withColumn("_s", score).select("query_id", "position", "id", "name", "similarity", "projects", F.round("_s", 6).alias("confidence"), tier.alias("tier"))


_SEARCH = """@, v AS (SELECT id, CAST(embedding AS DOUBLE[]) AS e FROM pt WHERE len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS v FROM v),
 s AS (SELECT q.id AS query_id, u.id, round(list_distance(q.v, u.v), 6) AS distance FROM u q JOIN u ON q.id <> u.id WHERE CAST('0x' || right(q.id, 8) AS BIGINT) % 20 = 0),
 r AS (SELECT *, round(1 / (1 + distance), 6) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS position FROM s QUALIFY position <= 5),
 m AS (SELECT max(last_seen) AS m FROM pt), n AS (SELECT pattern_id AS id, count(*) AS projects FROM pl GROUP BY 1),
 x AS (SELECT r.query_id, r.position, r.id, p.name, r.similarity, coalesce(n.projects, 0) AS projects, 0.30::DOUBLE * similarity + 0.20::DOUBLE * least(1.0::DOUBLE, coalesce(n.projects, 0) / 10.0) + 0.20::DOUBLE * CASE WHEN p.category IS NOT DISTINCT FROM k.category THEN 1 ELSE 0 END
 + 0.15::DOUBLE * coalesce(p.confidence_score, 0) + 0.15::DOUBLE * (CASE WHEN p.last_seen IS NULL THEN 0.5 WHEN m - p.last_seen < INTERVAL 7 DAY THEN 1.0 WHEN m - p.last_seen < INTERVAL 30 DAY THEN 0.8 WHEN m - p.last_seen < INTERVAL 90 DAY THEN 0.6 WHEN m - p.last_seen < INTERVAL 365 DAY THEN 0.4 ELSE 0.1 END)::DOUBLE AS s
 FROM r JOIN pt p ON p.id = r.id JOIN pt k ON k.id = r.query_id LEFT JOIN n ON n.id = r.id, m)
 SELECT query_id, position, id, name, similarity, projects, round(s, 6) AS confidence, CASE WHEN s > 0.7 THEN 'high' WHEN s > 0.4 THEN 'medium' ELSE 'low' END AS tier FROM x"""

QUERIES = {f.__name__: f for f in (python_elements, python_checks, python_check_counts, extracted_calls, events_per_day, pattern_search)}
ORACLES = {
    "events_per_day": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "pattern_search": over("pt", "pl", then=_SEARCH).replace(" @,", ","),
}
