from datetime import datetime as D

from pyspark.sql import functions as F

from codeloom.sources.files import parse_diff, reindex, scan_files, write_table
from codeloom.streaming.interactions import incremental_index
from tests.conftest import rows


def test_scan_and_reindex(spark, tmp_path):
    for p in ("src/main.py", "node_modules/x.js", "web/app.tsx", "notes.txt"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x = 1\n" if p != "web/app.tsx" else b"caf\xe9")
    files = scan_files(spark, str(tmp_path))
    assert sorted((x.path.rsplit("/", 1)[1], x.language, x.content) for x in files.collect()) == [("app.tsx", "typescript", "café"), ("main.py", "python", "x = 1\n")]
    assert reindex(files, files.where(F.col("path").endswith(".py"))).count() == 1


def test_diff(spark):
    text = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n+one\n-two\n+three\ndiff --git a/old.py b/new.py\nrename from old.py\nrename to new.py\ndiff --git a/n.py b/n.py\nnew file mode 100644\n+a"
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(text.split("\n"))], "diff_id string, n int, body string")
    assert rows(parse_diff(lines), "path", "status", "additions", "deletions", "old_path") == [("n.py", "A", 1, 0, None), ("new.py", "R", 0, 0, "old.py"), ("x.py", "M", 2, 1, None)]


def test_incremental_index(spark, tmp_path):
    schema = "id string, v int, at timestamp_ntz"
    spark.createDataFrame([("a", 1, D(2024, 1, 1)), ("b", 1, D(2024, 1, 1))], schema).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("a", 2, D(2024, 2, 1)), ("a", 0, D(2023, 1, 1))], schema).write.mode("append").parquet(str(tmp_path / "in"))
    assert rows(incremental_index(spark, str(tmp_path / "in"), schema, ["id"], "at"), "id", "v") == [("a", 2), ("b", 1)]
    base = str(tmp_path / "index")
    first = incremental_index(spark, str(tmp_path / "in"), schema, ["id"], "at", base, 4)
    assert rows(first, "id", "v") == [("a", 2), ("b", 1)]
    spark.createDataFrame([("c", 5, D(2024, 1, 1)), ("b", 3, D(2024, 3, 1)), ("a", 9, D(2020, 1, 1)), (None, 1, D(2024, 1, 1))], schema).write.mode("append").parquet(str(tmp_path / "in"))
    assert rows(incremental_index(spark, str(tmp_path / "in"), schema, ["id"], "at", base, 4), "id", "v") == [("a", 2), ("b", 3), ("c", 5)]
    write_table(spark.createDataFrame([("a", 1)], "k string, v int"), str(tmp_path / "out"), ["k"])
    write_table(spark.createDataFrame([("b", 2)], "k string, v int"), str(tmp_path / "out"), ["k"])
    assert rows(spark.read.parquet(str(tmp_path / "out")), "k", "v") == [("a", 1), ("b", 2)]


def test_glob_suppressions(spark):
    from codeloom.operators.extract import suppress_by_glob

    found = spark.createDataFrame([("src/a.py", "R1"), ("tests/a+b.py", "R2"), (None, "R1")], "file string, rule_id string")
    rules = spark.createDataFrame([(None, "tests/*+b.py"), ("R9", None)], "rule_id string, glob string")
    assert rows(suppress_by_glob(found, rules), "file", "suppressed") == [("src/a.py", False), ("tests/a+b.py", True), (None, False)]
    assert rows(suppress_by_glob(found, rules.where("glob = 'x'")), "suppressed") == [(False,)] * 3
