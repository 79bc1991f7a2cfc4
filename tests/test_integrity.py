from datetime import datetime as D

import pytest

from codeloom.operators.integrity import orphan_references, orphan_report
from tests.conftest import rows

REF, TGT = "ref string, at timestamp_ntz, id string, reason int", "id string, v timestamp_ntz, gone timestamp_ntz, ref string"


def run(spark, refs, targets):
    r = spark.createDataFrame(refs, REF)
    t = spark.createDataFrame(targets, TGT)
    return orphan_references(r, t, [("ref", "id")], at="at", version="v", deleted="gone", born="v")


def test_reasons_and_clashing_columns(spark):
    targets = [("a", D(2024, 1, 5), None, "x"), ("a", D(2024, 1, 5), None, "x"), ("b", D(2024, 1, 1), None, None), ("b", D(2024, 3, 1), D(2024, 3, 2), None), ("c", D(2024, 1, 1), D(2024, 1, 2), None), ("c", D(2024, 5, 1), None, None), (None, D(2024, 1, 1), None, None)]
    refs = [(" A ", D(2024, 2, 1), "q", 1), ("a", D(2024, 1, 2), "q", 1), ("a", D(2024, 1, 9), None, None), ("b", D(2024, 4, 1), None, None), ("b", None, None, None), ("c", D(2024, 6, 1), None, None), ("zz", D(2024, 1, 1), None, None), ("zz", D(2024, 1, 7), None, None), (None, D(2024, 1, 1), None, None), ("  ", D(2024, 1, 1), None, None)]
    got = rows(run(spark, refs, targets))
    assert got == sorted([("a", "2024-01", "late", 2), ("b", "2024-04", "deleted", 1), ("b", None, "deleted", 1), ("zz", "2024-01", "missing", 2)], key=repr)
    report = orphan_report(run(spark, refs, targets), [])
    assert ("2024-01", "missing", 1, 2) in rows(report)


def test_empty_tables(spark):
    assert rows(run(spark, [], [])) == []
    assert rows(run(spark, [("a", D(2024, 1, 1), None, None)], [])) == [("a", "2024-01", "missing", 1)]
    assert rows(run(spark, [], [("a", D(2024, 1, 1), None, None)])) == []


@pytest.mark.parametrize("match,expected", [("simple", {("1", "9")}), ("partial", {("1", "9"), (None, "9")}), ("full", {("1", "9"), (None, "9"), ("1", None), (None, "2")})])
def test_composite_keys_with_partial_nulls(spark, match, expected):
    refs = spark.createDataFrame([("1", "2"), ("1", "9"), (None, "9"), ("1", None), (None, "2"), (None, None)], "x string, y string")
    targets = spark.createDataFrame([("1", "2"), ("3", "4"), (None, "9")], "x string, y string")
    got = orphan_references(refs, targets, [("x", "x"), ("y", "y")], match=match)
    assert {(r.x, r.y) for r in got.collect()} == expected
    assert {r.reason for r in got.collect()} <= {"missing", "partial_null"}


def test_hot_key_shrinks_before_the_join(spark):
    refs = spark.range(5000).selectExpr("case when id % 3 = 0 then 'hot' else concat('k', id) end as ref", "timestamp_ntz'2024-01-01' as at", "'' as id", "1 as reason")
    targets = spark.range(5000).selectExpr("concat('k', id) as id", "timestamp_ntz'2023-01-01' as v", "cast(null as timestamp_ntz) as gone", "'' as ref")
    got = orphan_references(refs, targets, [("ref", "id")], at="at", version="v", deleted="gone", born="v")
    assert rows(got) == [("hot", "2024-01", "missing", 1667)]
