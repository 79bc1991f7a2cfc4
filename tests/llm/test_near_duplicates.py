import random
import re
from datetime import datetime as D

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm.near_duplicates import _lists, _merged, near_duplicates, shingle_sets
from tests.conftest import rows

SCHEMA = "id string, t string, at timestamp_ntz, key long, token string"


def table(spark, data):
    return spark.createDataFrame([(*(x if len(x) == 3 else (*x, None)), 1, "clash") for x in data], SCHEMA)


def sets(text, n):
    w = [x.lower() for x in re.findall(r"[A-Za-z0-9_]+", text)]
    return w, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(data, n, least, t):
    kept = {}
    for i, text in data:
        w, s = sets(text or "", n)
        if i and len(w) >= least and s:
            kept[i] = s
    ids = sorted(kept)
    return sorted((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(kept[a] & kept[b]) >= t * len(kept[a] | kept[b]) - 1e-12)


@pytest.mark.parametrize("t,n,split", [(0.6, 3, {}), (0.8, 5, {}), (0.6, 3, {"long_list": 4, "partner_block": 30})])
def test_against_brute_force(spark, t, n, split):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(60)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randrange(10, 60))] for _ in range(60)]
    data = []
    for i in range(240):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        data.append((f"d{i:03d}", " ".join(w)))
    found = near_duplicates(table(spark, data), "id", F.col("t"), threshold=t, shingle=n, min_tokens=8, **split)
    want = brute(data, n, 8, t)
    assert rows(found.pairs()) == want and len(want) > 20
    parent = {i: i for i, _ in data}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {r.id: r.group_id for r in found.groups().collect()} == {i: find(i) for i in parent}


def test_edge_cases(spark):
    text = " ".join(f"tok{i}" for i in range(30))
    data = [("a", text), ("b", text.upper()), ("b", text.upper()), ("c", text + "  !"), ("n", None), ("e", ""), ("s", "too short"), (None, text), ("x", "old " * 30, D(2024, 1, 1)), ("x", text + " tail", D(2025, 1, 1)), ("u", "é" * 50), ("long", "word " * 300_000)]
    found = near_duplicates(table(spark, data), "id", F.col("t"), at="at", threshold=0.6, shingle=3, min_tokens=20)
    assert rows(found.pairs()) == [("a", "b"), ("a", "c"), ("a", "x"), ("b", "c"), ("b", "x"), ("c", "x")]
    groups = {r.id: (r.class_id, r.group_id, r.n_links) for r in found.groups().collect()}
    assert groups == {"a": ("a", "a", 1), "b": ("a", "a", 1), "c": ("a", "a", 1), "x": ("x", "a", 1), "long": ("long", "long", 0)}


def test_empty(spark):
    found = near_duplicates(table(spark, []), "id", F.col("t"))
    assert rows(found.pairs()) == [] and rows(found.groups()) == []


def test_copies_of_a_third_stay_one_class(spark):
    data = [(f"d{i:04d}", "same text again and again here" if i % 3 == 0 else f"other {i} text number {i * 7} of many {i * 3}") for i in range(900)]
    found = near_duplicates(table(spark, data), "id", F.col("t"), threshold=0.8, shingle=3)
    assert found.links.count() == 0 and found.groups().where("class_id = 'd0000'").count() == 300


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_lists_in_any_batching(size):
    t = np.sort(np.random.default_rng(1).integers(0, 40, 500))
    k = np.arange(500) % 97
    order = np.lexsort((k, t))
    t, k = t[order], k[order]
    batches = [pa.RecordBatch.from_arrays([pa.array(t[i : i + size]), pa.array(k[i : i + size])], ["token", "key"]) for i in range(0, 500, size)]
    got = [r for b in _lists(iter(batches), 12) for r in zip(*(c.to_pylist() for c in b.columns))]
    have = {}
    for a, b in set(zip(t.tolist(), k.tolist())):
        have.setdefault(a, set()).add(b)
    assert sorted(got) == sorted((a, b, min(len(v), 12)) for a, v in have.items() if len(v) > 1 for b in v)


def test_shingles_of_sliced_columns():
    col = pa.array(["x y z", None, "A-b_c d", "", "a b_c d q"])
    row, gram, keys, sizes = shingle_sets(col.slice(1), 3, 1)
    assert sizes.tolist() == [0, 1, 0, 2] and gram[0] in gram[1:]


def test_heap_merge_counts_partners():
    lists = [np.array(x) for x in ([1, 4, 9], [4, 9], [2, 4], [9])]
    assert _merged(lists, 2) == ([4, 9], [3, 3]) and _merged(lists, 1) == ([1, 2, 4, 9], [1, 1, 3, 3]) and _merged([], 1) == ([], [])
