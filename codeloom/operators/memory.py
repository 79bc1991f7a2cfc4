"""Analytics over learned patterns, projects and interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.components import connected_components
from codeloom.operators.graph import numbered
from codeloom.session import materialize


def cross_project(patterns: DataFrame, links: DataFrame, min_projects: int = 2) -> DataFrame:
    """Patterns found in at least so many projects, with the number and total occurrences."""
    spread = links.groupBy(F.col("pattern_id").alias("id")).agg(F.count("*").alias("projects"), F.sum("occurrences").alias("occurrences")).where(F.col("projects") >= min_projects)
    return patterns.select("id", "name", "category").join(spread, "id")


def category_summary(patterns: DataFrame, most: int = 3) -> DataFrame:
    """Per category: patterns, occurrences, mean confidence, and the names of the most frequent ones (a top-k report)."""
    totals = patterns.groupBy("category").agg(F.count("*").alias("patterns"), F.sum("occurrence_count").alias("occurrences"), F.round(F.avg("confidence_score"), 10).alias("confidence"))
    order = Window.partitionBy("category").orderBy(F.col("occurrence_count").desc_nulls_last(), "id")
    top = patterns.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    names = top.groupBy("category").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "id"))), lambda x: x["id"]), ",").alias("top"))
    return totals.join(names, totals["category"].eqNullSafe(names["category"]), "left").drop(names["category"])


def unique_patterns(patterns: DataFrame, links: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Patterns that exactly one project has."""
    one = links.groupBy(F.col("pattern_id").alias("id")).agg(F.count("*").alias("_n"), F.max("project_name").alias("project_name")).where(F.col("_n") == 1).drop("_n")
    return patterns.where(F.col("confidence_score") >= min_confidence).select("id", "name", "confidence_score").join(one, "id")


def evolution(patterns: DataFrame) -> DataFrame:
    """Patterns of one name in the order they appeared; the last is the current one."""
    rows = numbered(patterns.where("name is not null").select("name", "id", "first_seen"), ["name"], ["first_seen", "id"], "version")
    newest = rows.groupBy("name").agg(F.max("version").alias("_v"))
    return rows.join(newest, "name").select("name", "id", "first_seen", "version", (F.col("version") == F.col("_v")).alias("is_current"))


def similar_sets(membership: DataFrame, item: str, holder: str, least: float, strict: bool = True) -> DataFrame:
    """``a, b, shared, jaccard`` for pairs of holders whose item sets overlap by more than ``least`` (or as much, if not ``strict``).

    Candidates meet on rare items only: of a holder's items, ordered from the rarest, the first
    n - ceil(least * n) + 1 must hold one that a similar holder has among its own first ones. An
    item that most holders have is among them for none but the smallest, and the sizes of
    two sets must be near enough. What they share is then counted for the candidates alone.
    """
    sets = materialize(membership.select(F.col(item).alias("_item"), F.col(holder).alias("_holder")).distinct(), "sets")
    sizes = sets.groupBy("_holder").agg(F.count("*").alias("n"))
    common = sets.groupBy("_item").agg(F.count("*").alias("_f"))
    ranked = F.row_number().over(Window.partitionBy("_holder").orderBy("_f", "_item"))
    rare = sets.join(common, "_item").join(sizes, "_holder").withColumn("_i", ranked).where(F.col("_i") <= F.col("n") - F.ceil(F.col("n") * F.lit(least)) + 1)
    rare = materialize(rare.select("_item", "_holder", "n"), "rare")
    a, b = rare.select("_item", F.col("_holder").alias("a"), F.col("n").alias("_na")), rare.select("_item", F.col("_holder").alias("b"), F.col("n").alias("_nb"))
    near = F.least("_na", "_nb") >= F.greatest("_na", "_nb") * F.lit(least)
    candidates = a.join(b, "_item").where((F.col("a") < F.col("b")) & near).select("a", "b", "_na", "_nb").distinct()
    held = sets.select("_item", F.col("_holder").alias("a")), sets.select("_item", F.col("_holder").alias("b"))
    shared = candidates.join(held[0], "a").join(held[1], ["b", "_item"]).groupBy("a", "b", "_na", "_nb").agg(F.count("*").alias("shared"))
    jac = F.col("shared") / (F.col("_na") + F.col("_nb") - F.col("shared"))
    return shared.select("a", "b", "shared", F.round(jac, 6).alias("jaccard")).where(jac > least if strict else jac >= least)


def project_similarity(links: DataFrame, least: float = 0.3) -> DataFrame:
    """``a, b, shared, jaccard`` for pairs of projects whose pattern sets overlap."""
    return similar_sets(links, "pattern_id", "project_name", least)


def pattern_classes(links: DataFrame) -> DataFrame:
    """``id, class_id``: patterns found in exactly the same projects form a class, named by its smallest id.

    A set of projects is known by the number and the sum of the hashes of its members, so that no list is gathered.
    """
    sets = links.select("pattern_id", "project_name").distinct().groupBy(F.col("pattern_id").alias("id")).agg(
        F.count("*").alias("_n"), F.sum(F.xxhash64("project_name").cast("decimal(38,0)")).alias("_h"), F.sum(F.xxhash64(F.lit(7), "project_name").cast("decimal(38,0)")).alias("_g")
    )
    sets = materialize(sets, "sets")
    names = sets.groupBy("_n", "_h", "_g").agg(F.min("id").alias("class_id"))
    return sets.join(names, ["_n", "_h", "_g"]).select("id", "class_id")


def cooccurring(links: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Patterns that occur together: classes of patterns with equal projects (``id, class_id``), and ``a, b, shared, jaccard``
    for classes (by their names) whose projects overlap by at least ``least``. Patterns of one class overlap wholly; they are not paired."""
    classes = materialize(pattern_classes(links), "classes")
    named = classes.where("id = class_id").select("class_id")
    rows = links.select("pattern_id", "project_name").join(named, F.col("pattern_id") == F.col("class_id"), "left_semi")
    return classes, similar_sets(rows, "project_name", "pattern_id", least, strict=False)


def pattern_clusters(links: DataFrame, least: float = 0.5) -> DataFrame:
    """``id, cluster``: patterns linked over any chain of patterns that occur together, named by the smallest id; patterns alone in theirs are left out."""
    classes, pairs = cooccurring(links, least)
    found = connected_components(pairs, "a", "b").select(F.col("id").alias("class_id"), "component")
    rows = materialize(classes.join(found, "class_id", "left").select("id", F.coalesce("component", "class_id").alias("cluster")), "clusters")
    several = rows.groupBy("cluster").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select("cluster")
    return rows.join(several, "cluster", "left_semi").select("id", "cluster")


def recommend(patterns: DataFrame, links: DataFrame, similarity: DataFrame, most: int = 5) -> DataFrame:
    """For every project the ``most`` patterns that similar projects have and it has not.

    score = 0.3 * confidence + 0.3 * similar projects that have it + 0.4 * sum of their similarity.
    """
    both = similarity.select("a", "b", "jaccard").unionByName(similarity.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard"))
    offers = both.join(links.select(F.col("project_name").alias("b"), F.col("pattern_id").alias("id")), "b").groupBy("a", "id").agg(F.count("*").alias("similar_projects"), F.sum("jaccard").alias("_s"))
    new = offers.join(links.select(F.col("project_name").alias("a"), F.col("pattern_id").alias("id")), ["a", "id"], "left_anti")
    scored = new.join(patterns.select("id", F.coalesce("confidence_score", F.lit(0.0)).alias("_c")), "id")
    score = F.round(0.3 * F.col("_c") + 0.3 * F.col("similar_projects") + 0.4 * F.col("_s"), 4)
    scored = scored.select(F.col("a").alias("project_name"), "id", "similar_projects", score.alias("score"))
    order = Window.partitionBy("project_name").orderBy(F.desc("score"), "id")
    return scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)


def style_consistency(patterns: DataFrame, links: DataFrame) -> DataFrame:
    """Per project and category: mean confidence, coverage = occurrences / (10 n), and min(1, (mean + coverage) / 2)."""
    rows = links.join(patterns.select(F.col("id").alias("pattern_id"), "category", "confidence_score"), "pattern_id")
    per = rows.groupBy("project_name", "category").agg(F.count("*").alias("n"), F.coalesce(F.avg("confidence_score"), F.lit(0.0)).alias("c"), F.sum("occurrences").alias("o"))
    cover = F.col("o") / (10.0 * F.col("n"))
    return per.select("project_name", "category", "n", F.round("c", 10).alias("confidence"), F.round(cover, 10).alias("coverage"), F.round(F.least(F.lit(1.0), (F.col("c") + cover) / 2), 10).alias("score"))


def overall_consistency(per_category: DataFrame) -> DataFrame:
    """Per project, the categories' scores weighted by their number of patterns."""
    return per_category.groupBy("project_name").agg(F.round(F.sum(F.col("score") * F.col("n")) / F.sum("n"), 9).alias("score"))


def interaction_stats(log: DataFrame) -> DataFrame:
    """Per type: interactions, those rated, and the share accepted among these (0 if none)."""
    rate = F.avg(F.when(F.col("accepted"), 1.0).when(~F.col("accepted"), 0.0))
    return log.groupBy("interaction_type").agg(F.count("*").alias("total"), F.count("accepted").alias("rated"), F.round(F.coalesce(rate, F.lit(0.0)), 6).alias("acceptance_rate"))


def set_similarity(membership: DataFrame, item: str, holder: str, least: float) -> DataFrame:
    """Jaccard of the holder sets of few items (such as style rules): pairs are formed inside a holder's own short list."""
    held = membership.select(holder, item).distinct()
    sizes = held.groupBy(item).agg(F.count("*").alias("n"))
    lists = held.groupBy(holder).agg(F.sort_array(F.collect_set(item)).alias("p"))
    pairs = lists.select(F.explode(F.transform("p", lambda x: F.struct(x.alias("a"), F.filter("p", lambda y: y > x).alias("bs")))).alias("x"))
    shared = pairs.select("x.a", F.explode("x.bs").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))
    both = shared.join(sizes.select(F.col(item).alias("a"), F.col("n").alias("_a")), "a").join(sizes.select(F.col(item).alias("b"), F.col("n").alias("_b")), "b")
    jac = F.col("shared") / (F.col("_a") + F.col("_b") - F.col("shared"))
    return both.where(jac >= least).select("a", "b", "shared", F.round(jac, 6).alias("jaccard"))
