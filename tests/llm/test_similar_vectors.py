from datetime import datetime as D
from functools import partial

import numpy as np
import pyarrow as pa

from codeloom.llm.similar_vectors import _grove_search, _normalize, _pack, _unpack, fit_forest, similar_vectors
from tests.conftest import rows

SCHEMA = "id string, v array<float>, at timestamp_ntz, key string, leaf int"


def table(spark, data):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], a, "clash", 0) for i, v, a in data], SCHEMA)


def brute(vectors, k, least):
    ids = sorted(vectors)
    x = np.array([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    s = x @ x.T
    out = set()
    for a, i in enumerate(ids):
        near = sorted(((-round(float(s[a, b]), 9), j) for b, j in enumerate(ids) if b != a))[:k]
        out |= {(i, j) for f, j in near if -f >= least}
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    data = {f"v{i:04d}": centres[i % 60] + rng.normal(size=16) * 0.4 for i in range(3000)}
    got = {(r.id, r.other) for r in similar_vectors(table(spark, [(i, v, None) for i, v in data.items()]), "id", "v", 16, k=5, leaf_rows=100, sample_rows=1000).collect()}
    want = brute(data, 5, -1)
    assert len(got & want) / len(want) >= 0.9 and len(got) == 15000


def test_recall_holds_where_the_sample_shows_no_groups(spark):
    """Groups of ten are unknown to a sample of 1 in 60: with many rows for each sampled one no pair may be lost for it."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(1800, 48))
    data = {f"v{i:05d}": centres[i % 1800] + rng.normal(size=48) * 0.35 for i in range(18000)}
    got = {(r.id, r.other) for r in similar_vectors(table(spark, [(i, v, None) for i, v in data.items()]), "id", "v", 48, k=5, least=0.8, leaf_rows=50, grove_rows=2000, sample_rows=300).collect()}
    ids = sorted(data)
    x = np.array([data[i] / np.linalg.norm(data[i]) for i in ids], dtype=np.float32)
    want = set()
    for c in range(0, len(x), 2000):
        s = x[c : c + 2000] @ x.T
        s[np.arange(len(s)), np.arange(c, c + len(s))] = -2
        top = np.argpartition(-s, 4, axis=1)[:, :5]
        want |= {(ids[c + i], ids[j]) for i, j in zip(np.repeat(np.arange(len(s)), 5), top.ravel()) if s[i, j] >= 0.8}
    assert len(want) > 50000 and len(got & want) / len(want) >= 0.99 and len(got & want) / len(got) >= 0.99


def test_a_pair_found_from_one_side_counts_for_both():
    """A guest that is among a resident's first ones is reported to it, though the resident never looks where the guest lives."""
    x = np.array([[1, 0, 0], [0.8, 0.6, 0], [0, 0, 1]], dtype=np.float32)
    grove = pa.RecordBatch.from_arrays([pa.array([7, 7, 7]), pa.array([False, False, True]), pa.array([10, 11, 12]), _pack(np.array([x[0], x[2], x[1]]))], ["grove", "guest", "key", "v"])
    got = {(r["key"], r["other"]): round(r["similarity"], 6) for b in _grove_search(iter([grove]), 3, 1, 4, 10, 1, 0.5) for r in b.to_pylist()}
    assert got == {(12, 10): 0.8, (10, 12): 0.8}


def test_packed_vectors_come_back():
    x = np.random.default_rng(2).normal(size=(50, 7))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[0], x[1] = np.eye(7)[0], -np.eye(7)[6]
    assert np.abs(_unpack(_pack(x), 7) - x).max() < 2e-7


def test_bad_vectors_copies_and_ties(spark):
    copies = [(f"c{i:02d}", [1, 0, 0], None) for i in range(9)]
    data = copies + [("near", [1, 0.1, 0], None), ("zero", [0, 0, 0], None), ("null", None, None), ("short", [1, 0], None), ("nan", [1, float("nan"), 0], None), ("inf", [1, float("inf"), 0], None), ("hole", [1, None, 0], None), ("moved", [0, 0, 1], D(2024, 1, 1)), ("moved", [1, 0.2, 0], D(2025, 1, 1)), ("near", [1, 0.1, 0], None), (None, [1, 0, 0], None)]
    got = rows(similar_vectors(table(spark, data), "id", "v", 3, k=3, least=0.5, at="at"), "id", "other")
    assert [o for i, o in got if i == "c00"] == ["c01", "c02", "c03"]
    assert [o for i, o in got if i == "c05"] == ["c00", "c01", "c02"]
    assert sorted(o for i, o in got if i == "moved") == ["c00", "c01", "near"]
    assert {i for i, _ in got} == {f"c{i:02d}" for i in range(9)} | {"near", "moved"}


def test_empty_and_single(spark):
    assert rows(similar_vectors(table(spark, []), "id", "v", 3)) == []
    assert rows(similar_vectors(table(spark, [("a", [1, 2, 3], None)]), "id", "v", 3)) == []


def test_hot_leaf_is_split(spark):
    rng = np.random.default_rng(5)
    data = {f"v{i:04d}": np.array([10.0, 0, 0, 0]) + rng.normal(size=4) * (0.01 if i % 3 == 0 else 5) for i in range(1500)}
    got = {(r.id, r.other) for r in similar_vectors(table(spark, [(i, v, None) for i, v in data.items()]), "id", "v", 4, k=5, leaf_rows=50, sample_rows=300).collect()}
    assert len(got & brute(data, 5, -1)) / 7500 >= 0.9


def test_multiples_of_a_vector_are_one_direction(spark):
    rng = np.random.default_rng(8)
    one = rng.normal(size=8)
    data = [(f"m{i:05d}", (one * (0.1 + i / 7)).astype(np.float32), None) for i in range(4000)] + [(f"o{i:05d}", rng.normal(size=8), None) for i in range(8000)]
    t = table(spark, data)
    unit = t.mapInArrow(partial(_normalize, dim=8), "id string, at timestamp_ntz, key long, v binary").cache()
    assert unit.where("id < 'n'").select("key").distinct().count() < 40
    forest = fit_forest(unit.select("key", "v").dropDuplicates(["key"]), 8, 3, 200, 4000, 2000, 42)
    keys = forest.own_keys(np.stack([np.frombuffer(r.v, dtype=np.float32) for r in unit.dropDuplicates(["key"]).collect()]))
    assert max(np.unique(keys[:, k], return_counts=True)[1].max() for k in range(3)) <= 400
    got = similar_vectors(t, "id", "v", 8, k=5, least=0.999999).where("id < 'n'")
    assert got.select("id").distinct().count() == 4000 and got.count() == 20000
