"""Queries of the general problems (orphan references, hierarchies), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.hierarchy import descendants, hierarchies, paths
from codeloom.operators.integrity import MATCHES, orphan_references, orphan_report
from codeloom.session import materialize, table


def all_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Orphans of the three referring fields, labelled by table and field; each table is read once."""
    edges = table(spark, d, "code_relationships").select(
        "created_at", F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("ref_id")) for c in ("source_id", "target_id")])).alias("r")
    )
    edges = edges.select(F.lit("code_relationships").alias("table_name"), "r.field_name", "r.ref_id", "created_at")
    links = table(spark, d, "pattern_projects").select(
        F.lit("pattern_projects").alias("table_name"), F.lit("pattern_id").alias("field_name"), F.col("pattern_id").alias("ref_id"), "first_seen"
    )
    labels = ["table_name", "field_name"]
    a = orphan_references(
        edges, table(spark, d, "nodes"), [("ref_id", "id")], labels=labels, at="created_at", version="indexed_at", deleted="deleted_at", born="indexed_at"
    )
    b = orphan_references(
        links, table(spark, d, "patterns"), [("ref_id", "id")], labels=labels, at="first_seen", version="last_seen", deleted="deleted_at", born="first_seen"
    )
    return a.unionByName(b)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return all_orphans(spark, d).select("table_name", "field_name", "ref_id", "period", "reason")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(all_orphans(spark, d), ["table_name", "field_name"])


def _placed(match: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        refs = table(spark, d, "code_elements").select("file", "name", F.col("language").alias("lang"), "updated_at")
        keys = [("file", "file"), ("name", "name"), ("lang", "language")]
        found = orphan_references(refs, table(spark, d, "nodes"), keys, at="updated_at", match=match, version="indexed_at", deleted="deleted_at", born="indexed_at")
        return found.select(F.col("file").alias("ref_file"), F.col("name").alias("ref_name"), F.col("lang").alias("ref_language"), "period", "reason", "n_refs")

    run.__doc__ = f"""Elements named by file, name and language (a key of three columns, null in part) that no node bears, under {match} match."""
    return run


def tree_edges(spark: SparkSession, d: str) -> DataFrame:
    """CONTAINS (source is the parent) and INHERITS (target is the parent) as child and parent."""
    down = F.col("rel_type") == "CONTAINS"
    return (
        table(spark, d, "code_relationships")
        .where(F.col("rel_type").isin("CONTAINS", "INHERITS"))
        .select(
            "rel_type",
            F.when(down, F.col("target_id")).otherwise(F.col("source_id")).alias("child"),
            F.when(down, F.col("source_id")).otherwise(F.col("target_id")).alias("parent"),
            "created_at",
        )
    )


def trees(spark: SparkSession, d: str) -> DataFrame:
    return hierarchies(tree_edges(spark, d), "rel_type", "child", "parent", "created_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return trees(spark, d).select(F.col("tree").alias("rel_type"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    return paths(materialize(trees(spark, d), "trees")).select(
        F.col("tree").alias("rel_type"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth", F.array_join("path", "/").alias("path")
    )


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(paths(materialize(trees(spark, d), "trees"))).select(
        F.col("tree").alias("rel_type"), F.col("ancestor").alias("ancestor_id"), F.col("descendant").alias("node_id"), "distance"
    )


_ORPHANS = """
WITH refs AS (
  SELECT 'code_relationships' AS table_name, 'source_id' AS field_name, lower(trim(source_id)) AS ref_id, created_at AS at FROM code_relationships
  UNION ALL SELECT 'code_relationships', 'target_id', lower(trim(target_id)), created_at FROM code_relationships
  UNION ALL SELECT 'pattern_projects', 'pattern_id', lower(trim(pattern_id)), first_seen FROM pattern_projects
), states AS (
  SELECT 'code_relationships' AS table_name, lower(trim(id)) AS id, arg_max(deleted_at IS NOT NULL, indexed_at) AS gone, min(indexed_at) AS born FROM nodes GROUP BY 2
  UNION ALL
  SELECT 'pattern_projects', lower(trim(id)), arg_max(deleted_at IS NOT NULL, last_seen), min(first_seen) FROM patterns GROUP BY 2
), reasons AS (
  SELECT r.table_name, r.field_name, r.ref_id, strftime(r.at, '%Y-%m') AS period,
         CASE WHEN s.id IS NULL THEN 'missing' WHEN s.gone THEN 'deleted' WHEN min(r.at) < min(s.born) THEN 'late' END AS reason, count(*) AS n_refs
  FROM refs r LEFT JOIN states s ON r.table_name = s.table_name AND r.ref_id = s.id
  WHERE r.ref_id <> '' GROUP BY r.table_name, r.field_name, r.ref_id, strftime(r.at, '%Y-%m'), s.id, s.gone
), orphans AS (SELECT * FROM reasons WHERE reason IS NOT NULL)
"""

_TREES = """
WITH RECURSIVE edges AS (
  SELECT rel_type, lower(trim(CASE WHEN rel_type = 'CONTAINS' THEN target_id ELSE source_id END)) AS child,
         lower(trim(CASE WHEN rel_type = 'CONTAINS' THEN source_id ELSE target_id END)) AS parent, created_at
  FROM code_relationships WHERE rel_type IN ('CONTAINS', 'INHERITS')
), sound AS (SELECT * FROM edges WHERE child <> '' AND parent <> ''),
links AS (SELECT rel_type, child, arg_max(parent, created_at) AS parent FROM sound GROUP BY 1, 2),
ids AS (SELECT rel_type, child AS id FROM sound UNION SELECT rel_type, parent FROM sound),
walk AS (
  SELECT rel_type, id AS node_id, id AS root_id, 0 AS depth, id AS path FROM ids ANTI JOIN links ON ids.rel_type = links.rel_type AND ids.id = links.child
  UNION ALL
  SELECT l.rel_type, l.child, w.root_id, w.depth + 1, w.path || '/' || l.child FROM walk w JOIN links l ON l.rel_type = w.rel_type AND l.parent = w.node_id
)
"""

_PLACED = """WITH r AS (SELECT nullif(lower(trim(file)), '') AS f, nullif(lower(trim(name)), '') AS n, nullif(lower(trim(language)), '') AS l, strftime(updated_at, '%Y-%m') AS period, updated_at AS seen FROM code_elements),
 g AS (SELECT f, n, l, period, min(seen) AS seen, count(*) AS n_refs FROM r WHERE f IS NOT NULL OR n IS NOT NULL OR l IS NOT NULL GROUP BY 1, 2, 3, 4),
 t AS (SELECT lower(trim(file)) AS f, lower(trim(name)) AS n, lower(trim(language)) AS l, arg_max(deleted_at IS NOT NULL, (indexed_at, deleted_at IS NOT NULL)) AS gone, min(indexed_at) AS born
  FROM nodes WHERE trim(file) <> '' AND trim(name) <> '' AND trim(language) <> '' GROUP BY 1, 2, 3),
 m AS (SELECT g.f, g.n, g.l, g.period, g.n_refs, g.seen, count(t.f) AS hits, min(CAST(t.gone AS INTEGER)) AS gone, min(t.born) AS born FROM g LEFT JOIN t ON {on} GROUP BY 1, 2, 3, 4, 5, 6),
 o AS (SELECT *, CASE {full} WHEN hits = 0 THEN 'missing' WHEN gone = 1 THEN 'deleted' WHEN seen < born THEN 'late' END AS reason FROM m)
 SELECT f AS ref_file, n AS ref_name, l AS ref_language, period, reason, n_refs FROM o WHERE reason IS NOT NULL {simple}"""
_WHOLE, _ANY = "g.f = t.f AND g.n = t.n AND g.l = t.l", "(g.f IS NULL OR g.f = t.f) AND (g.n IS NULL OR g.n = t.n) AND (g.l IS NULL OR g.l = t.l)"
_PARTLY = "f IS NULL OR n IS NULL OR l IS NULL"

QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found, "p5_paths": p5_paths, "p5_descendants": p5_descendants} | {f"p4_placed_{m}": _placed(m) for m in MATCHES}
ORACLES = {
    "p4_placed_simple": _PLACED.format(on=_WHOLE, full="", simple=f"AND NOT ({_PARTLY})"),
    "p4_placed_partial": _PLACED.format(on=_ANY, full="", simple=""),
    "p4_placed_full": _PLACED.format(on=_WHOLE, full=f"WHEN {_PARTLY} THEN 'partial_null'", simple=""),
    "p4_found": _ORPHANS + "SELECT table_name, field_name, ref_id, period, reason FROM orphans",
    "p4_report": _ORPHANS
    + "SELECT table_name, field_name, period, reason, count(*) AS n_keys, CAST(sum(n_refs) AS BIGINT) AS n_refs FROM orphans GROUP BY ALL",
    "p5_found": _TREES
    + """SELECT i.rel_type, i.id AS node_id, coalesce(w.root_id, '') AS root_id, CAST(coalesce(w.depth, -1) AS INTEGER) AS depth
FROM ids i LEFT JOIN walk w ON i.rel_type = w.rel_type AND i.id = w.node_id""",
    "p5_paths": _TREES + "SELECT rel_type, node_id, root_id, CAST(depth AS INTEGER) AS depth, path FROM walk",
    "p5_descendants": _TREES
    + """, up AS (
  SELECT rel_type, child AS node_id, parent AS ancestor_id, 1 AS distance FROM links
  WHERE (rel_type, child) IN (SELECT (rel_type, node_id) FROM walk)
  UNION ALL SELECT u.rel_type, u.node_id, l.parent, u.distance + 1 FROM up u JOIN links l ON l.rel_type = u.rel_type AND l.child = u.ancestor_id
) SELECT rel_type, ancestor_id, node_id, CAST(distance AS INTEGER) AS distance FROM up""",
}
