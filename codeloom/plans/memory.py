"""Queries over patterns, projects and interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import memory as m
from codeloom.operators.graph import first_per, numbered
from codeloom.plans.sql import over
from codeloom.session import materialize, table
from codeloom.sources.tables import interactions, pattern_links, patterns


def cross_project_patterns(spark: SparkSession, d: str) -> DataFrame:
    return m.cross_project(patterns(spark, d), pattern_links(spark, d))


def category_summary(spark: SparkSession, d: str) -> DataFrame:
    return m.category_summary(patterns(spark, d))


def unique_patterns(spark: SparkSession, d: str) -> DataFrame:
    return m.unique_patterns(patterns(spark, d), pattern_links(spark, d))


def pattern_evolution(spark: SparkSession, d: str) -> DataFrame:
    return m.evolution(patterns(spark, d))


def project_similarity(spark: SparkSession, d: str) -> DataFrame:
    return m.project_similarity(pattern_links(spark, d), 0.0)


def recommend_patterns(spark: SparkSession, d: str) -> DataFrame:
    links = materialize(pattern_links(spark, d), "links")
    return m.recommend(patterns(spark, d), links, m.project_similarity(links, 0.0))


def style_consistency(spark: SparkSession, d: str) -> DataFrame:
    return m.style_consistency(patterns(spark, d), pattern_links(spark, d))


def project_consistency(spark: SparkSession, d: str) -> DataFrame:
    return m.overall_consistency(style_consistency(spark, d))


def patterns_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of each category by confidence, then occurrences."""
    order = [F.col("confidence_score").desc_nulls_last(), F.col("occurrence_count").desc_nulls_last(), "id"]
    return first_per(patterns(spark, d).select("id", "category", "confidence_score", "occurrence_count"), ["category"], order, 100)


def pattern_projects_listed(spark: SparkSession, d: str) -> DataFrame:
    """Each pattern with its projects, most occurrences first."""
    rows = pattern_links(spark, d).select("pattern_id", "project_name", "occurrences", (-F.col("occurrences").cast("long")).alias("_fewer"), F.col("occurrences").isNull().alias("_none"))
    return numbered(rows, ["pattern_id"], ["_none", "_fewer", "project_name"]).drop("_fewer", "_none")


def pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    return patterns(spark, d).groupBy("category").agg(F.count("*").alias("n"))


def interaction_stats(spark: SparkSession, d: str) -> DataFrame:
    return m.interaction_stats(interactions(spark, d))


def interactions_recent(spark: SparkSession, d: str) -> DataFrame:
    """The ten latest interactions of each type (a top-k report)."""
    return first_per(interactions(spark, d).select("id", "interaction_type", "project_name", "ts"), ["interaction_type"], [F.desc("ts"), "id"], 10)


def project_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Every project with its patterns, occurrences and shared patterns."""
    links = pattern_links(spark, d)
    spread = links.groupBy("pattern_id").agg(F.count("*").alias("_n"))
    per = links.join(spread, "pattern_id").groupBy(F.col("project_name").alias("name")).agg(
        F.count("*").alias("patterns"), F.sum("occurrences").alias("occurrences"), F.count_if(F.col("_n") >= 2).alias("shared_patterns")
    )
    return table(spark, d, "projects").select("id", "name", F.lower(F.trim("language")).alias("language")).join(per, "name", "left").fillna(0, ["patterns", "occurrences", "shared_patterns"])


def pattern_confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("confidence_score")
    band = F.when(c.isNull(), "unknown").when(c > 0.7, "high").when(c > 0.4, "medium").otherwise("low")
    return patterns(spark, d).groupBy("category", band.alias("tier")).agg(F.count("*").alias("n"))


_SIM = """, sets AS (SELECT DISTINCT pattern_id, project_name FROM pl), sz AS (SELECT project_name, count(*) AS n FROM sets GROUP BY 1),
sim AS (SELECT a.project_name AS a, b.project_name AS b, count(*) AS shared, round(count(*) / (max(x.n) + max(y.n) - count(*)), 6) AS jaccard
 FROM sets a JOIN sets b ON a.pattern_id = b.pattern_id AND a.project_name < b.project_name JOIN sz x ON x.project_name = a.project_name JOIN sz y ON y.project_name = b.project_name GROUP BY 1, 2)"""
_CONS = """, c AS (SELECT project_name, category, count(*) AS n, coalesce(avg(confidence_score), 0) AS c, sum(occurrences) / (10.0 * count(*)) AS o FROM pl JOIN pt ON pt.id = pattern_id GROUP BY 1, 2),
s AS (SELECT project_name, category, n, round(c, 10) AS confidence, round(o, 10) AS coverage, round(least(1.0, (c + o) / 2), 10) AS score FROM c)"""


def _then(*names: str, then: str) -> str:
    return over(*names, then="@" + then).replace(" @,", ",").replace(" @", " ")


def pattern_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of pattern classes (equal projects, named by the smallest id) that share at least half of their projects."""
    return m.cooccurring(pattern_links(spark, d))[1]


def pattern_classes(spark: SparkSession, d: str) -> DataFrame:
    return m.pattern_classes(pattern_links(spark, d))


def pattern_clusters(spark: SparkSession, d: str) -> DataFrame:
    return m.pattern_clusters(pattern_links(spark, d))


def pattern_partners(spark: SparkSession, d: str) -> DataFrame:
    """The five other classes that occur most together with each class of patterns (a top-k report)."""
    pairs = materialize(m.cooccurring(pattern_links(spark, d))[1], "pairs")
    both = pairs.select(F.col("a").alias("class_id"), F.col("b").alias("other"), "shared", "jaccard").unionByName(pairs.select(F.col("b").alias("class_id"), F.col("a").alias("other"), "shared", "jaccard"))
    return first_per(both, ["class_id"], [F.desc("jaccard"), "other"], 5)


_CO = """@, ps AS (SELECT pattern_id AS id, list_sort(list(DISTINCT project_name)) AS p FROM pl GROUP BY 1), cl AS (SELECT id, p, min(id) OVER (PARTITION BY p) AS class_id FROM ps), rp AS (SELECT id, p FROM cl WHERE id = class_id),
 co AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.p, b.p)) AS shared, round(len(list_intersect(a.p, b.p)) / (len(a.p) + len(b.p) - len(list_intersect(a.p, b.p))), 6) AS jaccard FROM rp a JOIN rp b ON a.id < b.id
  WHERE len(list_intersect(a.p, b.p)) * 2 >= len(a.p) + len(b.p) - len(list_intersect(a.p, b.p)))"""


def _on_co(then: str, recursive: bool = False) -> str:
    return over("pl", then=_CO + then, recursive=recursive).replace(" @,", ",")


QUERIES = {
    f.__name__: f
    for f in (
        cross_project_patterns, category_summary, unique_patterns, pattern_evolution, project_similarity, recommend_patterns, style_consistency, project_consistency,
        patterns_ranked, pattern_projects_listed, pattern_counts, interaction_stats, interactions_recent, project_profiles, pattern_confidence_bands, pattern_cooccurrence, pattern_classes, pattern_clusters, pattern_partners,
    )
}
ORACLES = {
    "pattern_cooccurrence": _on_co(" SELECT a, b, shared, jaccard FROM co"),
    "pattern_classes": _on_co(" SELECT id, class_id FROM cl"),
    "pattern_partners": _on_co(", u AS (SELECT a AS class_id, b AS other, shared, jaccard FROM co UNION ALL SELECT b, a, shared, jaccard FROM co) SELECT *, CAST(row_number() OVER (PARTITION BY class_id ORDER BY jaccard DESC, other) AS INTEGER) AS position FROM u QUALIFY position <= 5"),
    "pattern_clusters": _on_co(""", e AS (SELECT a, b FROM co UNION SELECT b, a FROM co), w AS (SELECT id, id AS far FROM rp UNION SELECT w.id, e.b FROM w JOIN e ON e.a = w.far),
 k AS (SELECT id, min(far) AS cluster FROM w GROUP BY 1), x AS (SELECT cl.id, k.cluster, count(*) OVER (PARTITION BY k.cluster) AS n FROM cl JOIN k ON k.id = cl.class_id) SELECT id, cluster FROM x WHERE n > 1""", recursive=True),
    "cross_project_patterns": over("pt", "pl", then="SELECT id, name, category, projects, CAST(occurrences AS BIGINT) AS occurrences FROM pt JOIN (SELECT pattern_id AS id, count(*) AS projects, sum(occurrences) AS occurrences FROM pl GROUP BY 1) USING (id) WHERE projects >= 2"),
    "category_summary": over("pt", then="""SELECT category, count(*) AS patterns, CAST(sum(occurrence_count) AS BIGINT) AS occurrences, round(avg(confidence_score), 10) AS confidence,
 (SELECT string_agg(id, ',' ORDER BY n) FROM (SELECT id, row_number() OVER (ORDER BY occurrence_count DESC NULLS LAST, id) AS n FROM pt x WHERE x.category IS NOT DISTINCT FROM pt.category) WHERE n <= 3) AS top FROM pt GROUP BY category"""),
    "unique_patterns": over("pt", "pl", then="SELECT id, name, confidence_score, project_name FROM pt JOIN (SELECT pattern_id AS id, max(project_name) AS project_name FROM pl GROUP BY 1 HAVING count(*) = 1) USING (id) WHERE confidence_score >= 0.5"),
    "pattern_evolution": over("pt", then="""SELECT name, id, first_seen, CAST(row_number() OVER (PARTITION BY name ORDER BY first_seen NULLS FIRST, id) AS INTEGER) AS version,
 row_number() OVER (PARTITION BY name ORDER BY first_seen DESC NULLS LAST, id DESC) = 1 AS is_current FROM pt WHERE name IS NOT NULL"""),
    "project_similarity": _then("pl", then=_SIM + " SELECT * FROM sim WHERE jaccard > 0"),
    "recommend_patterns": _then("pt", "pl", then=_SIM + """, b AS (SELECT a, b, jaccard FROM sim UNION ALL SELECT b, a, jaccard FROM sim),
 o AS (SELECT a, pattern_id AS id, count(*) AS similar_projects, sum(jaccard) AS s FROM b JOIN pl ON pl.project_name = b.b WHERE (a, pattern_id) NOT IN (SELECT (project_name, pattern_id) FROM pl) GROUP BY 1, 2)
 SELECT a AS project_name, id, similar_projects, round(0.3 * coalesce(confidence_score, 0) + 0.3 * similar_projects + 0.4 * s, 4) AS score,
 CAST(row_number() OVER (PARTITION BY a ORDER BY round(0.3 * coalesce(confidence_score, 0) + 0.3 * similar_projects + 0.4 * s, 4) DESC, id) AS INTEGER) AS position FROM o JOIN pt USING (id) QUALIFY position <= 5"""),
    "style_consistency": _then("pt", "pl", then=_CONS + " SELECT * FROM s"),
    "project_consistency": _then("pt", "pl", then=_CONS + " SELECT project_name, round(sum(score * n) / sum(n), 9) AS score FROM s GROUP BY 1"),
    "patterns_ranked": over("pt", then="SELECT id, category, confidence_score, occurrence_count, CAST(row_number() OVER (PARTITION BY category ORDER BY confidence_score DESC NULLS LAST, occurrence_count DESC NULLS LAST, id) AS INTEGER) AS position FROM pt QUALIFY position <= 100"),
    "pattern_projects_listed": over("pl", then="SELECT pattern_id, project_name, occurrences, CAST(row_number() OVER (PARTITION BY pattern_id ORDER BY occurrences DESC NULLS LAST, project_name) AS INTEGER) AS position FROM pl"),
    "pattern_counts": over("pt", then="SELECT category, count(*) AS n FROM pt GROUP BY 1"),
    "interaction_stats": over("it", then="SELECT interaction_type, count(*) AS total, count(accepted) AS rated, round(coalesce(avg(CASE WHEN accepted THEN 1.0 WHEN NOT accepted THEN 0.0 END), 0), 6) AS acceptance_rate FROM it GROUP BY 1"),
    "interactions_recent": over("it", then="SELECT id, interaction_type, project_name, ts, CAST(row_number() OVER (PARTITION BY interaction_type ORDER BY ts DESC, id) AS INTEGER) AS position FROM it QUALIFY position <= 10"),
    "project_profiles": over("pl", then="""SELECT p.id, p.name, lower(trim(p.language)) AS language, count(pl.pattern_id) AS patterns, CAST(coalesce(sum(occurrences), 0) AS BIGINT) AS occurrences, count(*) FILTER (WHERE n >= 2) AS shared_patterns
 FROM projects p LEFT JOIN pl ON pl.project_name = p.name LEFT JOIN (SELECT pattern_id, count(*) AS n FROM pl GROUP BY 1) s ON s.pattern_id = pl.pattern_id GROUP BY ALL"""),
    "pattern_confidence_bands": over("pt", then="SELECT category, CASE WHEN confidence_score IS NULL THEN 'unknown' WHEN confidence_score > 0.7 THEN 'high' WHEN confidence_score > 0.4 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n FROM pt GROUP BY 1, 2"),
}
