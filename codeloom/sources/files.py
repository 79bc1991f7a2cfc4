"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# File endings and the languages they stand for, and directories that hold no sources.
LANGUAGES = {
    "py": "python", "pyw": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "go": "go", "rs": "rust",
}
EXCLUDED = ["venv", ".venv", "env", "__pycache__", ".git", "node_modules", "dist", "build", "target", "vendor", ".tox", ".mypy_cache", ".pytest_cache"]


def scan_files(spark: SparkSession, root: str, extensions: Sequence[str] = tuple(LANGUAGES), exclude: Sequence[str] = tuple(EXCLUDED)) -> DataFrame:
    """``path, language, sha256, length, content``: source files under a folder, without excluded folders.

    Content is UTF-8 text, or Latin-1 where it is not valid UTF-8. The hash is of the bytes.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    language = F.coalesce(*[F.when(ext == k, v) for k, v in LANGUAGES.items()])
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = F.split(F.regexp_replace("path", "^file:/*", "/"), "/")
    return raw.where(ext.isin(list(extensions)) & ~F.arrays_overlap(inside, F.array(*map(F.lit, exclude)))).select(
        "path", language.alias("language"), F.sha2("content", 256).alias("sha256"), "length", F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1")).alias("content")
    )


def reindex(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose hash differs from the stored one; unknown files count as changed."""
    known = stored.select("path", F.col("sha256").alias("_h"))
    return files.join(known, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("_h"))).drop("_h")


def parse_diff(lines: DataFrame) -> DataFrame:
    """``path, status, additions, deletions, old_path`` from the lines (``diff_id, n, body``) of unified diffs.

    Works on rows: every line takes the file header last seen before it in its diff.
    """
    order = Window.partitionBy("diff_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("body").startswith("diff --git "), F.col("n"))
    rows = lines.withColumn("_f", F.last(head, ignorenulls=True).over(order)).where("_f is not null")
    old, new = F.regexp_extract("body", r"^diff --git a/(.*) b/.*$", 1), F.regexp_extract("body", r"^diff --git a/.* b/(.*)$", 1)
    first = F.col("body").startswith("diff --git ")
    status = F.when(F.max(F.col("body").startswith("new file mode")), "A").when(F.max(F.col("body").startswith("deleted file mode")), "D").when(F.max(F.col("body").startswith("rename from ")), "R").otherwise("M")
    plus = F.col("body").startswith("+") & ~F.col("body").startswith("+++")
    minus = F.col("body").startswith("-") & ~F.col("body").startswith("---")
    out = rows.groupBy("diff_id", "_f").agg(
        F.max(F.when(first, new)).alias("path"), status.alias("status"), F.count_if(plus).cast("int").alias("additions"), F.count_if(minus).cast("int").alias("deletions"), F.max(F.when(first, old)).alias("_o")
    )
    return out.select("diff_id", "path", "status", "additions", "deletions", F.when(F.col("_o") != F.col("path"), F.col("_o")).alias("old_path"))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Writes a table as parquet, orc, json or csv; with partitions only those present are replaced."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    w.save(path)
