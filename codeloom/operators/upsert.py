"""Keyed tables: upsert, replace, delete and change detection (plain files have no MERGE)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """One row per key: the one with the largest version; among equal versions a hash of the row decides.

    A map-side combined aggregate, so that a key delivered many times never gathers its
    rows in one task. Rows with a null key are dropped; a null version is the oldest.
    """
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(F.col(version), F.xxhash64(*rest))
    some = rows.dropna(subset=list(keys))
    return some.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def upsert(stored: DataFrame, batch: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The stored table after a batch: new keys added, known ones replaced if the batch is not older."""
    return latest(stored.unionByName(batch, allowMissingColumns=True), keys, version)


def delete_where(stored: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored rows whose key is not in ``gone`` (a null key is never deleted)."""
    return stored.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def changed(current: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, status`` of what differs between two snapshots: added, changed or deleted."""
    a = current.select(key, F.col(digest).alias("_now")).dropna(subset=[key])
    b = stored.select(key, F.col(digest).alias("_then")).dropna(subset=[key])
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), key, "full")
    status = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "deleted").when(~F.col("_now").eqNullSafe(F.col("_then")), "changed")
    return both.select(key, status.alias("status")).where("status is not null")
