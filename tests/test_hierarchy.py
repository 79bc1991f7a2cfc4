import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from codeloom.operators.hierarchy import compress, descendants, hierarchies, paths
from tests.conftest import rows

SCHEMA = "t string, child string, parent string, at timestamp_ntz, node string, root int"
T0 = datetime(2024, 1, 1)


def run(spark, links, **kw):
    return hierarchies(spark.createDataFrame([(*x, "clash", 1) for x in links], SCHEMA), "t", "child", "parent", "at", **kw)


def brute(links):
    best, ids = {}, set()
    for t, c, p, at in links:
        c, p = (c or "").strip().lower(), (p or "").strip().lower()
        if c and p and t:
            ids |= {(t, c), (t, p)}
            key = (at or datetime.min, p)
            if (t, c) not in best or key > best[t, c]:
                best[t, c] = key
    out = set()
    for t, n in ids:
        seen, x = [], n
        while (t, x) in best and x not in seen:
            seen.append(x)
            x = best[t, x][1]
        out.add((t, n, "", -1) if (t, x) in best else (t, n, x, len(seen)))
    return out


def test_small_trees_loops_and_dirty_rows(spark):
    links = [("C", "b", "a", T0), ("C", " B ", "z", T0 - timedelta(1)), ("C", "c", "b", T0), ("C", "c", "b", T0), ("C", "l1", "l2", T0), ("C", "l2", "l1", T0), ("C", "below", "l1", T0), ("C", "self", "self", T0), ("C", None, "a", T0), ("C", "x", "  ", T0), ("I", "a", "b", None), (None, "q", "r", T0)]
    assert {tuple(r) for r in run(spark, links).select("tree", "node", "root", "depth").collect()} == brute(links)


def test_empty(spark):
    assert rows(run(spark, [])) == []
    assert rows(paths(run(spark, []))) == []


@pytest.mark.parametrize("per_task", [20_000, 7])
def test_random_forests_against_brute_force(spark, per_task):
    rnd = random.Random(5)
    links = []
    for k in range(400):
        links.append(("C", f"n{k}", f"n{rnd.randrange(max(0, k - 3), k + 1) if rnd.random() < 0.8 else rnd.randrange(400)}", T0 + timedelta(seconds=rnd.randrange(5))))
    links += [("C", f"d{k}", f"d{k + 1}", T0) for k in range(150)]
    got = run(spark, links, links_per_task=per_task)
    assert {tuple(r) for r in got.select("tree", "node", "root", "depth").collect()} == brute(links)


def test_paths_and_descendants(spark):
    links = [("C", "b", "a", T0), ("C", "c", "b", T0), ("C", "d", "b", T0), ("C", "l", "l", T0)]
    p = paths(run(spark, links))
    assert {(r.node, "/".join(r.path)) for r in p.collect()} == {("a", "a"), ("b", "a/b"), ("c", "a/b/c"), ("d", "a/b/d")}
    assert {(r.ancestor, r.descendant, r.distance) for r in descendants(p).collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)}


def test_one_parent_holds_a_third(spark):
    links = [("C", f"k{i}", "hub" if i % 3 == 0 else f"p{i}", T0) for i in range(900)] + [("C", "hub", "top", T0)]
    got = run(spark, links, links_per_task=50)
    assert {tuple(r) for r in got.select("tree", "node", "root", "depth").collect()} == brute(links)


def test_compress_follows_chains_within_a_partition():
    top, off, looped = compress(np.array(["a", "b", "c", "x", "y"], dtype=object), np.array(["b", "c", "far", "y", "x"], dtype=object), np.array([1, 1, 2, 1, 1]))
    assert top[:3].tolist() == ["far"] * 3 and off[:3].tolist() == [4, 3, 2] and looped.tolist() == [False] * 3 + [True] * 2
