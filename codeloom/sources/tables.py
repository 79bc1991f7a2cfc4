"""The code-intelligence tables as clean views: one row per key, ids and spellings normalized."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import clean_id
from codeloom.operators.upsert import latest
from codeloom.session import spread, table


def language_name(c: Column | str) -> Column:
    """Language under one spelling: case, spaces and short forms are unified; unknown names stay."""
    c = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return (
        F.when(c.isin("py", "python"), "python")
        .when(c.isin("ja", "js", "javascript"), "javascript")
        .when(c.isin("ty", "ts", "typescript"), "typescript")
        .when(c.isin("ru", "rs", "rust"), "rust")
        .otherwise(c)
    )


def elements(spark: SparkSession, d: str, *columns: str, **derived: Column) -> DataFrame:
    """Code elements, each id in its latest delivery; only the columns asked for are read and moved.

    ``derived`` columns are computed from the row before deliveries are compared, so that what is
    learned from a long text travels in its place.
    """
    cols = columns or (() if derived else ("file", "type", "name", "language", "line_start", "line_end"))
    raw = table(spark, d, "code_elements")
    if "language" in raw.columns and ("language" in cols or derived):
        raw = raw.withColumn("language", language_name("language"))
    rows = raw.select("id", *[c for c in cols if c != "id"], *[v.alias(k) for k, v in derived.items()], *([] if "updated_at" in cols else ["updated_at"]))
    out = latest(rows, ["id"], "updated_at")
    return out.select("id", *[c for c in cols if c != "id"], *derived)


def _deliveries(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    return table(spark, d, "code_elements").select(F.struct("id", place.alias("place")).alias("id"), *columns)


def over_texts(spark: SparkSession, d: str, work: Callable[[DataFrame], DataFrame], *columns: str) -> DataFrame:
    """What ``work`` makes of every delivered row (keyed by ``id``), kept for the latest delivery of each id.

    Texts are read where they lie: only what was found in them, and ids, meet the choice of
    the latest row. Of deliveries of one time the place in the files decides.
    """
    rows = _deliveries(spark, d, *columns)
    if "language" in columns:
        rows = rows.withColumn("language", language_name("language"))
    last = _deliveries(spark, d, "updated_at").where("id.id is not null").groupBy(F.col("id.id").alias("_id")).agg(F.max_by("id.place", F.struct("updated_at", "id.place")).alias("_place"))
    found = work(spread(rows))
    kept = found.join(last, (F.col("id.id") == F.col("_id")) & (F.col("id.place") == F.col("_place")), "left_semi")
    return kept.withColumn("id", F.col("id.id"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Graph nodes as they stand: the latest row of each id, without those deleted since."""
    cols = ["name", "node_type", "file", "line_start", "line_end", "language"]
    rows = table(spark, d, "nodes").select("id", *cols, "indexed_at", "deleted_at")
    return latest(rows, ["id"], "indexed_at").where("deleted_at is null").select("id", *cols)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Relationship rows with clean, non-blank ids; repeated rows are still there."""
    return (
        table(spark, d, "code_relationships")
        .select(clean_id("source_id").alias("src"), clean_id("target_id").alias("dst"), "rel_type", "call_line", "import_type", "usage_type", "created_at")
        .where("src is not null and dst is not null")
    )


def patterns(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Learned patterns, each id as last seen, without deleted ones."""
    cols = columns or ("name", "category", "occurrence_count", "confidence_score", "first_seen", "last_seen")
    rows = table(spark, d, "patterns").select("id", *cols, *[c for c in ("last_seen", "deleted_at") if c not in cols])
    return latest(rows, ["id"], "last_seen").where("deleted_at is null").select("id", *cols)


def pattern_links(spark: SparkSession, d: str) -> DataFrame:
    """One row per pattern and project: first seen, and the largest count delivered (repeated rows do not add up)."""
    return (
        table(spark, d, "pattern_projects")
        .select(clean_id("pattern_id").alias("pattern_id"), F.trim("project_name").alias("project_name"), "first_seen", "occurrences")
        .where("pattern_id is not null and project_name is not null")
        .groupBy("pattern_id", "project_name")
        .agg(F.min("first_seen").alias("first_seen"), F.max("occurrences").alias("occurrences"))
    )


def interactions(spark: SparkSession, d: str) -> DataFrame:
    """The event log as interactions: accepted is true for a purchase, false for an error, else unknown."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("interaction_type"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("project_name"),
        F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False).alias("accepted"),
        "ts",
        "value",
        "props",
    )
