"""Exact nearest neighbours of a stated query set, in blocks over all rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 5_000  # query vectors held by a task at a time


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _near(q: np.ndarray, qk: np.ndarray, x: np.ndarray, key: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and distance of the k nearest rows of each query, with all that tie at the k-th place."""
    cols = ([], [], [])
    for c in range(0, len(q), 256):
        dots = q[c : c + 256] @ x.T
        if metric == "cosine":
            norm = np.linalg.norm(q[c : c + 256], axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
            far = 1 - dots / np.where(norm > 0, norm, 1)
        else:
            far = np.sqrt(np.maximum(0, (q[c : c + 256] ** 2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * dots))
        far[qk[c : c + 256, None] == key[None, :]] = np.inf
        far = np.round(far, 6)
        cut = np.partition(far, k - 1, axis=1)[:, k - 1 : k] if far.shape[1] > k else np.full((len(far), 1), np.inf)
        i, j = np.nonzero((far <= cut) & np.isfinite(far))
        for col, v in zip(cols, (qk[i + c], key[j], far[i, j])):
            col.append(v)
    return tuple(np.concatenate(c) for c in cols)


def _scan(batches: Iterator[pa.RecordBatch], queries: pa.Table, dim: int, k: int, metric: str, within: bool, unit: bool) -> Iterator[pa.RecordBatch]:
    kind = queries.schema.field("id").type
    qk = queries.column("id").to_pandas().to_numpy()
    q = queries.column("v").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dim)
    q = _unit(q) if unit else q
    groups: dict = {}
    for i, g in enumerate(queries.column("grp").to_pylist() if within else [None] * len(qk)):
        groups.setdefault(g, []).append(i)
    for b in batches:
        key = b.column("id").to_pandas().to_numpy()
        x = b.column("v").flatten().to_numpy().astype(np.float64).reshape(-1, dim)
        x = _unit(x) if unit else x
        grp = np.array(b.column("grp").to_pylist() if within else [None] * len(key), dtype=object)
        found = []
        for g in dict.fromkeys(grp.tolist()):  # queries meet the rows of their own group only
            if g in groups and (g is not None or not within):
                at, mine = np.flatnonzero(grp == g) if within else np.arange(len(key)), np.array(groups[g])
                found.append(_near(q[mine], qk[mine], x[at], key[at], k, metric))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, kind, pa.float64()))], ["query_id", "id", "distance"])


def nearest(vectors: DataFrame, queries: DataFrame, dim: int, k: int, metric: str = "l2", within_group: bool = False, unit: bool = False) -> DataFrame:
    """``query_id, id, distance, similarity, position``: the k nearest other rows of each query row.

    Both tables have ``id, v, grp`` (``within_group``: hits are of the query's own group; a null group has none).
    With ``unit`` vectors are brought to length 1 first, inside the batches. Distances are rounded to
    six digits; ties go to the smaller id; similarity is 1 / (1 + distance). Vectors that are null or of another
    size are left out. The query set travels to the tasks in blocks of a fixed size, each a pass over
    the rows; the rows searched are never shuffled, only k candidates per query and batch are.
    """
    sound = vectors.where((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))).select("id", "v", F.col("grp").cast("string").alias("grp"))
    asked = queries.where((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))).select("id", "v", F.col("grp").cast("string").alias("grp"))
    kind = dict(sound.dtypes)["id"]
    blocks = max(1, -(-asked.count() // BLOCK))
    out = None
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toArrow()
        got = sound.mapInArrow(partial(_scan, queries=part, dim=dim, k=k, metric=metric, within=within_group, unit=unit), f"query_id {kind}, id {kind}, distance double")
        out = got if out is None else out.unionByName(got)
    ranked = out.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("position") <= k)
    return ranked.select("query_id", "id", "distance", F.round(1 / (1 + F.col("distance")), 6).alias("similarity"), "position")
