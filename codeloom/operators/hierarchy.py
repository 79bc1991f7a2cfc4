"""Parent-child links to full hierarchies.

Every child has one parent, so the links of a tree form a forest with weights: each
node points at an ancestor, and the weight is the distance to it. Links are contracted
partition by partition (a weighted disjoint-set forest with path compression), then
only the nodes that other partitions point at are merged further up, in ever fewer
partitions, until every pointer ends in a root or in a loop. Leaves, the bulk of the
rows, take no part in this; they read the answer of their parent in one join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import clean_id
from codeloom.session import materialize

FOREST = "tree string, node string, top string, off long, looped boolean"
LINKS_PER_TASK = 20_000
MERGE = 4


def parent_links(edges: DataFrame, tree: str, child: str, parent: str, at: str) -> DataFrame:
    """One parent per (tree, child): that of the row with the latest ``at``; the larger parent id breaks ties."""
    return edges.groupBy(F.col(tree).alias("tree"), F.col(child).alias("node")).agg(
        F.max_by(parent, F.struct(at, parent)).alias("parent")
    )


def compress(nodes: np.ndarray, tops: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted find with path compression for all nodes at once.

    ``nodes`` are distinct keys, ``tops`` the keys they point at, ``offs`` the distances.
    Returns for each node the last key reachable here, the distance to it, and whether
    the way never ends (the node lies in or below a loop).
    """
    index = pd.Index(nodes)
    at = index.get_indexer(tops)
    live = at >= 0
    # The set forest over the nodes here: nxt is a node's representative so far, w the offset to it.
    nxt = np.where(live, at, np.arange(len(nodes)))
    w = np.where(live, offs, 0).astype(np.int64)
    for _ in range(max(1, int(np.ceil(np.log2(len(nodes) + 1))) + 1)):
        step = nxt[nxt]
        if (step == nxt).all():
            break
        w, nxt = w + w[nxt], step
    looped = live[nxt]  # a representative that itself still points at a node here
    return tops[nxt], w + np.where(looped, 0, offs[nxt]), looped


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    key = (rows["tree"] + "\x1f" + rows["node"]).to_numpy()
    top = (rows["tree"] + "\x1f" + rows["top"]).to_numpy()
    last, off, looped = compress(key, top, rows["off"].to_numpy(dtype=np.int64))
    # A looped node points at itself, so that it stays a loop in every later merge.
    rows["top"] = rows["node"].where(pd.Series(looped, index=rows.index), pd.Series(last, index=rows.index).str.split("\x1f", n=1).str[1])
    rows["off"] = np.where(looped, -1, off)
    rows["looped"] = looped
    yield rows


def _jump(forest: DataFrame) -> DataFrame:
    """Pointer doubling over joins, for links too many to meet in few partitions.

    Each round doubles the distance covered. While any tree is unfinished, a round
    finishes at least one node, so a round that finishes none leaves only loops.
    """
    names = forest.select("tree", "node")
    state = forest.join(names.select("tree", F.col("node").alias("top"), F.lit(True).alias("_on")), ["tree", "top"], "left").select(
        "tree", "node", "top", "off", "looped", F.coalesce(F.col("_on") & ~F.col("looped"), F.lit(False)).alias("_open")
    )
    state, before = materialize(state, "jump"), None
    while True:
        left = state.where("_open").count()
        if not left or left == before:
            break
        before = left
        up = state.select(
            "tree", F.col("node").alias("top"), F.col("top").alias("_top"), F.col("off").alias("_off"), F.col("looped").alias("_loop"), F.col("_open").alias("_more")
        )
        moved = state.where("_open").join(up, ["tree", "top"]).select(
            "tree", "node", F.col("_top").alias("top"), (F.col("off") + F.col("_off")).alias("off"), F.col("_loop").alias("looped"), F.col("_more").alias("_open")
        )
        state = materialize(state.where("not _open").unionByName(moved), "jump")
    return state.select("tree", "node", "top", "off", (F.col("looped") | F.col("_open")).alias("looped"))


def _solve(links: DataFrame, parts: int, links_per_task: int) -> DataFrame:
    """Root and distance of every node that has a link: contract, merge what is pointed at, then read the answers back."""
    forest = materialize(links.repartition(parts, "tree", "node").mapInPandas(_contract, FOREST), "forest")
    pointed = forest.where("not looped").select("tree", F.col("top").alias("node")).distinct()
    portals = forest.join(pointed, ["tree", "node"], "left_semi")
    if parts == 1:
        return forest
    portals = materialize(portals, "portals")
    m = portals.count()
    if not m:
        return forest
    fewer = max(parts // MERGE, -(-m // links_per_task), 1)
    solved = _solve(portals, fewer, links_per_task) if fewer < parts else _jump(portals)
    above = solved.select("tree", F.col("node").alias("top"), F.col("top").alias("_top"), F.col("off").alias("_off"), F.col("looped").alias("_loop"))
    return forest.join(above, ["tree", "top"], "left").select(
        "tree",
        "node",
        F.coalesce("_top", "top").alias("top"),
        (F.col("off") + F.coalesce("_off", F.lit(0))).alias("off"),
        (F.col("looped") | F.coalesce("_loop", F.lit(False))).alias("looped"),
    )


def inner_links(links: DataFrame) -> DataFrame:
    """The links of nodes that are themselves a parent; all chains run through these."""
    parents = links.select("tree", F.col("parent").alias("node")).distinct()
    return links.join(parents, ["tree", "node"], "left_semi")


def hierarchies(edges: DataFrame, tree: str, child: str, parent: str, at: str, links_per_task: int = LINKS_PER_TASK) -> DataFrame:
    """Root, depth and parent of every id at either end of a link.

    Ids are compared without outer spaces and in lower case; a row with a null or blank
    id does not count. Result: ``tree, node, parent, root, depth``. A root has a null
    parent, itself as root and depth 0. A node in or below a loop (a self-reference is
    one) has root '' and depth -1. Repeated rows change nothing; of several parents the
    one with the latest ``at`` counts (a null time is the oldest, then the larger
    parent id). An empty input gives an empty result.
    """
    clean = edges.select(F.col(tree).alias("tree"), clean_id(child).alias("node"), clean_id(parent).alias("parent"), F.col(at).alias("at")).where(
        "tree is not null and node is not null and parent is not null"
    )
    links = materialize(parent_links(clean, "tree", "node", "parent", "at"), "links")
    everyone = clean.select("tree", F.explode(F.array("node", "parent")).alias("node")).distinct()
    inner = materialize(inner_links(links).select("tree", "node", F.col("parent").alias("top"), F.lit(1).cast("long").alias("off"), F.lit(False).alias("looped")), "inner")
    n = inner.count()
    solved = _solve(inner, max(8, -(-n // links_per_task)), links_per_task) if n else inner
    known = solved.select("tree", F.col("node").alias("parent"), "top", "off", "looped")
    return (
        everyone.join(links, ["tree", "node"], "left")
        .join(known, ["tree", "parent"], "left")
        .select(
            "tree",
            "node",
            "parent",
            F.when(F.col("looped"), "").otherwise(F.coalesce("top", "parent", "node")).alias("root"),
            F.when(F.col("looped"), -1).when(F.col("parent").isNull(), 0).otherwise(F.coalesce("off", F.lit(0)) + 1).cast("int").alias("depth"),
        )
    )


def paths(nodes: DataFrame) -> DataFrame:
    """Path from the root to every node outside loops, over the result of :func:`hierarchies`.

    Parents are looked up by key; each round doubles the stretch of path a node holds, so
    depth d takes log2(d) joins. Result: ``tree, node, root, depth, path`` (array, root first).
    """
    sound = nodes.where("depth >= 0").select("tree", "node", "parent", "root", "depth")
    upper = sound.select("tree", F.col("parent").alias("node")).where("node is not null").distinct()
    seg = materialize(
        sound.join(upper, ["tree", "node"], "left_semi").select("tree", "node", F.col("parent").alias("next"), F.array("node").alias("seg")), "seg"
    )
    while seg.where("next is not null").limit(1).count():
        up = seg.select("tree", F.col("node").alias("next"), F.col("next").alias("_next"), F.col("seg").alias("_seg"))
        moved = seg.where("next is not null").join(up, ["tree", "next"]).select("tree", "node", F.col("_next").alias("next"), F.concat("_seg", "seg").alias("seg"))
        seg = materialize(seg.where("next is null").unionByName(moved), "seg")
    above = seg.select("tree", F.col("node").alias("parent"), F.col("seg").alias("_seg"))
    return sound.join(above, ["tree", "parent"], "left").select(
        "tree", "node", "root", "depth", F.concat(F.coalesce("_seg", F.array().cast("array<string>")), F.array("node")).alias("path")
    )


def descendants(path_rows: DataFrame) -> DataFrame:
    """Every (ancestor, descendant) pair with its distance: a row per step of a path, never a list per ancestor."""
    return path_rows.select("tree", F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("_i", "ancestor")).where("_i < depth").select(
        "tree", "ancestor", "descendant", (F.col("depth") - F.col("_i")).cast("int").alias("distance")
    )
