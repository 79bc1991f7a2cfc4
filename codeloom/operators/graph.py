"""Property-graph operators: every pattern match is an equi-join of nodes and one edge table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import materialize

DEPENDENCY_TYPES = ["CALLS", "IMPORTS", "INHERITS", "USES"]


def merge_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge per (src, dst, rel_type), the last written, without edges whose end is missing.

    Attributes that do not belong to the type are dropped; absent ones get the type's default.
    """
    last = edges.groupBy("src", "dst", "rel_type").agg(
        F.max_by(F.struct("call_line", "import_type", "usage_type"), F.struct("created_at", "call_line", "import_type", "usage_type")).alias("e")
    )
    ids = nodes.select("id")
    sound = last.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return sound.select(
        "src",
        "dst",
        "rel_type",
        F.when(F.col("rel_type") == "CALLS", F.coalesce("e.call_line", F.lit(0))).alias("call_line"),
        F.when(F.col("rel_type") == "IMPORTS", F.coalesce("e.import_type", F.lit("module"))).alias("import_type"),
        F.when(F.col("rel_type") == "USES", F.coalesce("e.usage_type", F.lit("reference"))).alias("usage_type"),
    )


def neighbours(edges: DataFrame, nodes: DataFrame, rel_types: Sequence[str], incoming: bool) -> DataFrame:
    """``node_id, rel_type, other_id, name, node_type, file, line_start, call_line, import_type`` over one hop, for all nodes.

    The node table is joined on its unique id, so that a hub with a tenth of all edges
    only makes one side of a streamed join long.
    """
    near, far = ("dst", "src") if incoming else ("src", "dst")
    hops = edges.where(F.col("rel_type").isin(list(rel_types))).select(F.col(near).alias("node_id"), F.col(far).alias("id"), "rel_type", "call_line", "import_type")
    return hops.join(nodes.select("id", "name", "node_type", "file", "line_start"), "id").select(
        "node_id", "rel_type", F.col("id").alias("other_id"), "name", "node_type", "file", "line_start", "call_line", "import_type"
    )


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int, incoming: bool = True) -> DataFrame:
    """``seed, node, depth``: distinct nodes within ``max_depth`` hops of each seed, at their smallest depth.

    Frontier by frontier: join, distinct, and drop what was seen; lineage is cut each hop.
    Over a cycle a seed can reach itself.
    """
    near, far = ("dst", "src") if incoming else ("src", "dst")
    step = edges.select(F.col(near).alias("node"), F.col(far).alias("_next")).distinct()
    seen = None
    frontier = seeds.select(F.col(seeds.columns[0]).alias("seed"), F.col(seeds.columns[0]).alias("node")).distinct()
    for depth in range(1, max_depth + 1):
        found = frontier.join(step, "node").select("seed", F.col("_next").alias("node")).distinct()
        if seen is not None:
            found = found.join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        found = found.withColumn("depth", F.lit(depth))
        frontier = materialize(found, "frontier") if depth < max_depth else found
        seen = frontier if seen is None else seen.unionByName(frontier)
    return seen


def call_chains(edges: DataFrame, pairs: DataFrame, max_depth: int = 3, most: int = 10) -> DataFrame:
    """``src, dst, hops, path``: the first ``most`` simple chains from src to dst, shortest first, then by path.

    Chains grow from the start and are kept only while their end can still reach the goal:
    both halves of the search meet, so no walk is carried that leads nowhere.
    """
    step = materialize(edges.select("src", "dst").distinct().where("src <> dst"), "steps")
    pairs = materialize(pairs.select("src", "dst").distinct(), "pairs")
    back = [pairs.select(F.col("dst").alias("goal"), F.col("dst").alias("node")).distinct()]
    for _ in range(max_depth - 1):  # nodes from which the goal can be reached in so many hops
        prev = back[-1].join(step.select(F.col("dst").alias("node"), F.col("src").alias("_p")), "node")
        back.append(materialize(prev.select("goal", F.col("_p").alias("node")).distinct(), "back"))
    out, walks = None, pairs.select("src", F.col("dst").alias("goal"), F.array("src").alias("path"), F.col("src").alias("node"))
    for hops in range(1, max_depth + 1):
        walks = walks.join(step.select(F.col("src").alias("node"), F.col("dst").alias("_n")), "node").where(~F.array_contains("path", F.col("_n")))
        walks = walks.select("src", "goal", F.concat("path", F.array("_n")).alias("path"), F.col("_n").alias("node"))
        done = walks.where("node = goal").select("src", F.col("goal").alias("dst"), F.lit(hops).alias("hops"), "path")
        out = done if out is None else out.unionByName(done)
        if hops < max_depth:
            ahead = None
            for b in back[1 : max_depth - hops + 1]:
                ahead = b if ahead is None else ahead.unionByName(b)
            walks = materialize(walks.where("node <> goal").join(ahead.distinct(), ["goal", "node"], "left_semi"), "walks")
    order = Window.partitionBy("src", "dst").orderBy("hops", "path")
    return out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("src", "dst", "hops", F.array_join("path", ">").alias("path"))


def chains_from(edges: DataFrame, starts: DataFrame, max_depth: int = 5, most: int = 10) -> DataFrame:
    """``src, dst, hops, path``: from each start to every node it reaches, the first ``most`` simple chains, shortest first, then by path.

    Every beginning of a simple chain is a simple chain to its own end, so that all chains
    carried are results or are passed over for shorter ones; no goal is carried along.
    """
    step = materialize(edges.select(F.col("src").alias("node"), F.col("dst").alias("_n")).distinct().where("node <> _n"), "steps")
    out, walks = None, starts.select(F.col(starts.columns[0]).alias("src")).distinct().select("src", F.array("src").alias("path"), F.col("src").alias("node"))
    for hops in range(1, max_depth + 1):
        walks = walks.join(step, "node").where(~F.array_contains("path", F.col("_n"))).select("src", F.concat("path", F.array("_n")).alias("path"), F.col("_n").alias("node"))
        if hops < max_depth:
            walks = materialize(walks, "walks")
        part = walks.select("src", F.col("node").alias("dst"), F.lit(hops).alias("hops"), "path")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("src", "dst").orderBy("hops", "path")
    return out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("src", "dst", "hops", F.array_join("path", ">").alias("path"))


def impact(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, direct, transitive, impact``: min(1, (direct callers + distinct callers within two hops) / 50) for all nodes.

    Direct callers count in both terms, as in the definition followed.
    """
    calls = materialize(edges.where("rel_type = 'CALLS'").select("src", "dst").distinct(), "calls")
    two = two_steps(calls).select(F.col("start").alias("id"), F.col("end").alias("far"))
    within = calls.select(F.col("dst").alias("id"), F.col("src").alias("far")).unionByName(two).distinct().groupBy("id").agg(F.count("*").alias("transitive"))
    direct = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("direct"))
    out = nodes.select("id").join(direct, "id", "left").join(within, "id", "left").fillna(0, ["direct", "transitive"])
    return out.withColumn("impact", F.round(F.least(F.lit(1.0), (F.col("direct") + F.col("transitive")) / F.lit(50.0)), 6))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, callers, callees, dependencies, dependents, centrality``: degree per node; centrality is min(1, sum / 10)."""
    calls = F.col("rel_type") == "CALLS"
    inc = edges.where(F.col("rel_type").isin(DEPENDENCY_TYPES)).groupBy(F.col("dst").alias("id")).agg(F.count_if(calls).alias("callers"), F.count("*").alias("dependents"))
    out = edges.where(F.col("rel_type").isin(DEPENDENCY_TYPES)).groupBy(F.col("src").alias("id")).agg(F.count_if(calls).alias("callees"), F.count("*").alias("dependencies"))
    both = nodes.select("id").join(inc, "id", "left").join(out, "id", "left").fillna(0)
    total = F.col("callers") + F.col("callees") + F.col("dependencies") + F.col("dependents")
    return both.withColumn("centrality", F.round(F.least(F.lit(1.0), total / F.lit(10.0)), 6))


def tiers(deg: DataFrame) -> DataFrame:
    """Connection tier of every node: more than five links high, some medium, none low."""
    n = F.col("callers") + F.col("callees")
    return deg.select("id", n.alias("connections"), F.when(n > 5, "high").when(n > 0, "medium").otherwise("low").alias("tier"))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """Rows numbered from 1 per key in a total order, without ever sorting one key in one task.

    Rows are split by ranges of (key, order) and numbered within their range; what earlier
    ranges hold of the key is added. Nulls come first, as in an ascending sort; null keys are one key.
    """
    at = [*keys, *order]
    parts = materialize(rows.repartitionByRange(*at).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    within = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    out = parts.withColumn("_w", within).join(starts, [F.col("_part") == F.col("_p"), *same])
    return out.withColumn(name, (F.col("_w") + F.col("_before")).cast("int")).select(*rows.columns, name)


def two_steps(step: DataFrame, hub: int = 10_000) -> DataFrame:
    """Distinct ``start, end`` over two edges of ``src, dst``: for each node (start) what reaches it in two hops (end).

    A node in the middle that many edges enter is split by a hash of where they come from, so
    that its pairs are formed, and combined, in several tasks.
    """
    entering = step.groupBy(F.col("dst").alias("mid")).agg(F.ceil(F.count("*") / hub).cast("int").alias("_cells"))
    inner = step.select(F.col("dst").alias("mid"), F.col("src").alias("end")).join(entering, "mid")
    inner = inner.select("mid", "end", F.pmod(F.xxhash64("end"), F.col("_cells")).cast("int").alias("_cell"))
    outer = step.select(F.col("dst").alias("start"), F.col("src").alias("mid")).join(entering, "mid")
    outer = outer.select("mid", "start", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1)).alias("_cell"))
    return outer.join(inner, ["mid", "_cell"]).select("start", "end").distinct()


def first_per(rows: DataFrame, keys: Sequence[str], order: Sequence, most: int) -> DataFrame:
    """The first ``most`` rows per key under a total order (a top-k report)."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("position") <= most)
