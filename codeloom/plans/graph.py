"""Queries over the code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import graph as g
from codeloom.plans.sql import over
from codeloom.schemas import REL_TYPES
from codeloom.session import materialize
from codeloom.sources.tables import edges, elements, nodes


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = nodes(spark, d)
    return g.merge_edges(edges(spark, d), n), n


def _hop(rel: str, incoming: bool, extra: tuple[str, ...] = ()):
    def run(spark: SparkSession, d: str) -> DataFrame:
        e, n = graph(spark, d)
        return g.neighbours(e, n, [rel], incoming).select("node_id", "other_id", "name", "file", "line_start", *extra)

    return run


def _hop_sql(rel: str, incoming: bool, extra: tuple[str, ...] = ()) -> str:
    near, far = ("dst", "src") if incoming else ("src", "dst")
    more = "".join(f", ed.{x}" for x in extra)
    return over("nd", "raw", "ed", then=f"SELECT ed.{near} AS node_id, ed.{far} AS other_id, nd.name, nd.file, nd.line_start{more} FROM ed JOIN nd ON nd.id = ed.{far} WHERE ed.rel_type = '{rel}'")


HOPS = {
    "callers": ("CALLS", True, ("call_line",)),
    "callees": ("CALLS", False, ("call_line",)),
    "imports": ("IMPORTS", False, ("import_type",)),
    "importers": ("IMPORTS", True, ("import_type",)),
    "superclasses": ("INHERITS", False, ()),
    "subclasses": ("INHERITS", True, ()),
}


def merged_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d)[0]


def dependencies(spark: SparkSession, d: str) -> DataFrame:
    e, n = graph(spark, d)
    return g.neighbours(e, n, g.DEPENDENCY_TYPES, False).select("node_id", "rel_type", "other_id", "name", "file")


def dependents(spark: SparkSession, d: str) -> DataFrame:
    e, n = graph(spark, d)
    return g.neighbours(e, n, g.DEPENDENCY_TYPES, True).select("node_id", "rel_type", "other_id", "name", "file")


def file_contents(spark: SparkSession, d: str) -> DataFrame:
    """Members of every container, numbered by line."""
    e, n = graph(spark, d)
    inside = g.neighbours(e, n, ["CONTAINS"], False).select("node_id", "other_id", "name", "node_type", "line_start")
    return g.numbered(inside, ["node_id"], ["line_start", "other_id"])


def transitive_callers(spark: SparkSession, d: str) -> DataFrame:
    """Distinct callers of every node within two hops, with their distance."""
    e, _ = graph(spark, d)
    calls = materialize(e.where("rel_type = 'CALLS'").select("src", "dst"), "calls")
    one = calls.distinct().select(F.col("dst").alias("node_id"), F.col("src").alias("caller_id"), F.lit(1).alias("depth"))
    two = g.two_steps(calls).select(F.col("start").alias("node_id"), F.col("end").alias("caller_id"), F.lit(2).alias("depth"))
    return one.unionByName(two).groupBy("node_id", "caller_id").agg(F.min("depth").alias("depth"))


def impact_score(spark: SparkSession, d: str) -> DataFrame:
    e, n = graph(spark, d)
    return g.impact(e, n)


def node_degrees(spark: SparkSession, d: str) -> DataFrame:
    e, n = graph(spark, d)
    return g.degrees(e, n)


def connection_tiers(spark: SparkSession, d: str) -> DataFrame:
    e, n = graph(spark, d)
    return g.tiers(g.degrees(e, n))


def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    """Callers plus dependents of every node; callers count twice, as dependents hold them too."""
    e, n = graph(spark, d)
    return g.degrees(e, n).select("id", "callers", "dependents", (F.col("callers") + F.col("dependents")).alias("score"))


def trace_flow(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty callers and callees of every node (a top-k report)."""
    e, n = graph(spark, d)
    both = None
    for side, incoming in (("caller", True), ("callee", False)):
        hop = g.neighbours(e, n, ["CALLS"], incoming).select("node_id", F.lit(side).alias("side"), "other_id", "name", "file", "line_start")
        both = hop if both is None else both.unionByName(hop)
    return g.first_per(both, ["node_id", "side"], ["name", "other_id"], 20).drop("line_start")


def call_chains(spark: SparkSession, d: str) -> DataFrame:
    """All ways of up to three calls from each caller to each of its callees, the first ten for each pair; ``call_chains_from`` has other ends and longer chains."""
    e, _ = graph(spark, d)
    calls = materialize(e.where("rel_type = 'CALLS' and src <> dst").select("src", "dst"), "calls")
    return g.call_chains(calls, calls, 3, 10)


def call_chains_from(spark: SparkSession, d: str) -> DataFrame:
    """All ways of up to five calls from a twentieth of the callers (by a hash of the id) to every node they reach, the first ten for each pair."""
    e, _ = graph(spark, d)
    calls = materialize(e.where("rel_type = 'CALLS' and src <> dst").select("src", "dst"), "calls")
    return g.chains_from(calls, calls.select("src").where(F.conv(F.substring(F.md5("src"), 1, 8), 16, 10).cast("long") % 20 == 0), 5, 10)


def file_impact(spark: SparkSession, d: str) -> DataFrame:
    """For every file, its nodes and what depends on them from other files: edges, distinct nodes and distinct files."""
    e, n = graph(spark, d)
    place = n.where("file is not null").select("id", "file")
    used = e.where(F.col("rel_type").isin(g.DEPENDENCY_TYPES)).join(place.select(F.col("id").alias("dst"), "file"), "dst").join(place.select(F.col("id").alias("src"), F.col("file").alias("from_file")), "src").where("from_file <> file")
    # counted per dependent node and file first, so that a hub's edges are combined before they meet
    nodes_in = used.groupBy("file", "src").agg(F.count("*").alias("edges"), F.first("from_file").alias("from_file"))
    files_in = nodes_in.groupBy("file", "from_file").agg(F.sum("edges").alias("edges"), F.count("*").alias("nodes"))
    per = files_in.groupBy("file").agg(F.sum("edges").alias("edges"), F.sum("nodes").alias("dependents"), F.count("*").alias("files"))
    own = place.groupBy("file").agg(F.count("*").alias("nodes"))
    return own.join(per, "file", "left").fillna(0)


def count_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).groupBy("node_type").agg(F.count("*").alias("n"))


def count_relationships(spark: SparkSession, d: str) -> DataFrame:
    """Edges per type, with a zero for types that have none."""
    e, _ = graph(spark, d)
    kinds = spark.createDataFrame([(x,) for x in REL_TYPES], "rel_type string")
    return kinds.join(e.groupBy("rel_type").agg(F.count("*").alias("n")), "rel_type", "left").fillna(0, ["n"])


def names_shared(spark: SparkSession, d: str) -> DataFrame:
    """Node names that several nodes bear."""
    return nodes(spark, d).where("name is not null").groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def cross_file_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls between different files, counted per pair of files."""
    e, n = graph(spark, d)
    calls = e.where("rel_type = 'CALLS'").join(n.select(F.col("id").alias("src"), F.col("file").alias("from_file")), "src").join(n.select(F.col("id").alias("dst"), F.col("file").alias("to_file")), "dst")
    return calls.where("from_file <> to_file").groupBy("from_file", "to_file").agg(F.count("*").alias("calls"))


def elements_with_context(spark: SparkSession, d: str) -> DataFrame:
    """Every element with its callers, callees and base classes as counts and its five first callers by name."""
    e, n = graph(spark, d)
    deg = g.degrees(e, n).select("id", "callers", "callees", "centrality")
    top = g.first_per(g.neighbours(e, n, ["CALLS"], True), ["node_id"], ["name", "other_id"], 5)
    named = top.groupBy(F.col("node_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("position", "name"))).alias("x"))
    rows = elements(spark, d, "type", "name", "file")
    return rows.join(deg, "id", "left").join(named, "id", "left").select(
        "id", "type", "name", "file", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"),
        F.coalesce("centrality", F.lit(0.0)).alias("centrality"), F.coalesce(F.array_join("x.name", ","), F.lit("")).alias("caller_names"),
    )


_DEG = """, inc AS (SELECT dst AS id, count(*) FILTER (WHERE rel_type = 'CALLS') AS callers, count(*) AS dependents FROM ed WHERE rel_type <> 'CONTAINS' GROUP BY 1),
outg AS (SELECT src AS id, count(*) FILTER (WHERE rel_type = 'CALLS') AS callees, count(*) AS dependencies FROM ed WHERE rel_type <> 'CONTAINS' GROUP BY 1),
deg AS (SELECT nd.id, coalesce(callers, 0) AS callers, coalesce(dependents, 0) AS dependents, coalesce(callees, 0) AS callees, coalesce(dependencies, 0) AS dependencies FROM nd LEFT JOIN inc USING (id) LEFT JOIN outg USING (id)) """


def _deg(then: str) -> str:
    return over("nd", "raw", "ed", then=_DEG + then).replace(") , inc AS", "), inc AS")


_FLOW = "SELECT ed.{near} AS node_id, '{side}' AS side, ed.{far} AS other_id, nd.name, nd.file FROM ed JOIN nd ON nd.id = ed.{far} WHERE ed.rel_type = 'CALLS'"
_BOTH = _FLOW.format(near="dst", far="src", side="caller") + " UNION ALL " + _FLOW.format(near="src", far="dst", side="callee")

_GROWN = "".join(f", w{n} AS (SELECT w.src, c.dst, {n} AS hops, list_append(w.path, c.dst) AS path FROM w{n - 1} w JOIN c ON c.src = w.dst WHERE NOT list_contains(w.path, c.dst))" for n in range(1, 6))
_CHAINS = (
    ", c AS (SELECT DISTINCT src, dst FROM ed WHERE rel_type = 'CALLS' AND src <> dst), w0 AS (SELECT DISTINCT src, src AS dst, 0 AS hops, [src] AS path FROM c WHERE CAST('0x' || substr(md5(src), 1, 8) AS BIGINT) % 20 = 0)"
    + _GROWN
    + " SELECT src, dst, CAST(hops AS INTEGER) AS hops, array_to_string(path, '>') AS path FROM (" + " UNION ALL ".join(f"SELECT * FROM w{n}" for n in range(1, 6)) + ")"
    " QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY hops, path) <= 10"
)

QUERIES = {name: _hop(*args) for name, args in HOPS.items()} | {
    f.__name__: f
    for f in (
        merged_edges, dependencies, dependents, file_contents, transitive_callers, impact_score, node_degrees, connection_tiers, blast_radius, trace_flow, call_chains, call_chains_from,
        file_impact, count_nodes, count_relationships, names_shared, cross_file_calls, elements_with_context,
    )
}
ORACLES = {name: _hop_sql(*args) for name, args in HOPS.items()} | {
    "merged_edges": over("nd", "raw", "ed", then="SELECT * FROM ed"),
    "dependencies": over("nd", "raw", "ed", then="SELECT src AS node_id, rel_type, dst AS other_id, name, file FROM ed JOIN nd ON nd.id = dst WHERE rel_type <> 'CONTAINS'"),
    "dependents": over("nd", "raw", "ed", then="SELECT dst AS node_id, rel_type, src AS other_id, name, file FROM ed JOIN nd ON nd.id = src WHERE rel_type <> 'CONTAINS'"),
    "file_contents": over("nd", "raw", "ed", then="""SELECT src AS node_id, dst AS other_id, name, node_type, line_start,
 CAST(row_number() OVER (PARTITION BY src ORDER BY line_start NULLS FIRST, dst) AS INTEGER) AS position FROM ed JOIN nd ON nd.id = dst WHERE rel_type = 'CONTAINS'"""),
    "transitive_callers": over("nd", "raw", "ed", then="""SELECT node_id, caller_id, CAST(min(depth) AS INTEGER) AS depth FROM (
 SELECT dst AS node_id, src AS caller_id, 1 AS depth FROM ed WHERE rel_type = 'CALLS' UNION ALL
 SELECT a.dst, b.src, 2 FROM ed a JOIN ed b ON b.dst = a.src WHERE a.rel_type = 'CALLS' AND b.rel_type = 'CALLS') GROUP BY 1, 2"""),
    "impact_score": over("nd", "raw", "ed", then=""", c AS (SELECT src, dst FROM ed WHERE rel_type = 'CALLS'), w AS (SELECT dst AS id, src AS far FROM c UNION SELECT a.dst, b.src FROM c a JOIN c b ON b.dst = a.src)
 SELECT id, coalesce(direct, 0) AS direct, coalesce(transitive, 0) AS transitive, round(least(1.0, (coalesce(direct, 0) + coalesce(transitive, 0)) / 50.0), 6) AS impact
 FROM nd LEFT JOIN (SELECT dst AS id, count(*) AS direct FROM c GROUP BY 1) USING (id) LEFT JOIN (SELECT id, count(*) AS transitive FROM w GROUP BY 1) USING (id)""").replace(") , c AS", "), c AS"),
    "node_degrees": _deg("SELECT *, round(least(1.0, (callers + callees + dependencies + dependents) / 10.0), 6) AS centrality FROM deg"),
    "connection_tiers": _deg("SELECT id, callers + callees AS connections, CASE WHEN callers + callees > 5 THEN 'high' WHEN callers + callees > 0 THEN 'medium' ELSE 'low' END AS tier FROM deg"),
    "blast_radius": _deg("SELECT id, callers, dependents, callers + dependents AS score FROM deg"),
    "trace_flow": over("nd", "raw", "ed", then=f"""SELECT *, CAST(row_number() OVER (PARTITION BY node_id, side ORDER BY name NULLS FIRST, other_id) AS INTEGER) AS position
 FROM ({_BOTH}) QUALIFY position <= 20"""),
    "call_chains": over("nd", "raw", "ed", then=""", c AS (SELECT DISTINCT src, dst FROM ed WHERE rel_type = 'CALLS' AND src <> dst), p AS (SELECT * FROM c),
 w AS (SELECT p.src, p.dst, 1 AS hops, p.src || '>' || p.dst AS path FROM p JOIN c ON c.src = p.src AND c.dst = p.dst
 UNION ALL SELECT p.src, p.dst, 2, concat_ws('>', p.src, a.dst, p.dst) FROM p JOIN c a ON a.src = p.src JOIN c b ON b.src = a.dst AND b.dst = p.dst WHERE a.dst <> p.dst
 UNION ALL SELECT p.src, p.dst, 3, concat_ws('>', p.src, a.dst, b.dst, p.dst) FROM p JOIN c a ON a.src = p.src JOIN c b ON b.src = a.dst JOIN c z ON z.src = b.dst AND z.dst = p.dst
  WHERE a.dst <> p.dst AND b.dst <> p.dst AND b.dst <> p.src AND a.dst <> p.src)
 SELECT src, dst, CAST(hops AS INTEGER) AS hops, path FROM w QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY hops, path) <= 10""").replace(") , c AS", "), c AS"),
    "call_chains_from": over("nd", "raw", "ed", then=_CHAINS).replace(") , c AS", "), c AS"),
    "file_impact": over("nd", "raw", "ed", then="""@, u AS (SELECT b.file, a.file AS from_file, e.src FROM ed e JOIN nd a ON a.id = e.src JOIN nd b ON b.id = e.dst WHERE e.rel_type <> 'CONTAINS' AND a.file <> b.file),
 p AS (SELECT file, count(*) AS edges, count(DISTINCT src) AS dependents, count(DISTINCT from_file) AS files FROM u GROUP BY 1)
 SELECT o.file, o.nodes, coalesce(edges, 0) AS edges, coalesce(dependents, 0) AS dependents, coalesce(files, 0) AS files FROM (SELECT file, count(*) AS nodes FROM nd WHERE file IS NOT NULL GROUP BY 1) o LEFT JOIN p USING (file)""").replace(" @,", ","),
    "count_nodes": over("nd", then="SELECT node_type, count(*) AS n FROM nd GROUP BY 1"),
    "count_relationships": over("nd", "raw", "ed", then="SELECT k.rel_type, count(ed.src) AS n FROM (VALUES ('CALLS'), ('IMPORTS'), ('INHERITS'), ('CONTAINS'), ('USES')) k(rel_type) LEFT JOIN ed USING (rel_type) GROUP BY 1"),
    "names_shared": over("nd", then="SELECT name, count(*) AS n, min(id) AS first_id FROM nd WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) > 1"),
    "cross_file_calls": over("nd", "raw", "ed", then="SELECT a.file AS from_file, b.file AS to_file, count(*) AS calls FROM ed JOIN nd a ON a.id = src JOIN nd b ON b.id = dst WHERE rel_type = 'CALLS' AND a.file <> b.file GROUP BY 1, 2"),
    "elements_with_context": over("nd", "raw", "ed", "el", then=_DEG + """, t AS (SELECT dst AS id, nd.name, row_number() OVER (PARTITION BY dst ORDER BY nd.name NULLS FIRST, src) AS n FROM ed JOIN nd ON nd.id = src WHERE rel_type = 'CALLS' QUALIFY n <= 5),
 s AS (SELECT id, string_agg(name, ',' ORDER BY n) AS names FROM t GROUP BY 1)
 SELECT el.id, el.type, el.name, el.file, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees, round(least(1.0, coalesce(callers + callees + dependencies + dependents, 0) / 10.0), 6) AS centrality,
 coalesce(names, '') AS caller_names FROM el LEFT JOIN deg USING (id) LEFT JOIN s USING (id)""").replace(") , inc AS", "), inc AS").replace(") , t AS", "), t AS"),
}
