import re
from hashlib import sha256

from pyspark.sql import functions as F

from codeloom.functions.text import split_lines
from codeloom.operators import parsing
from codeloom.operators import review as r
from codeloom.operators import upsert
from codeloom.operators.vectors import nearest
from codeloom.plans import review
from tests.conftest import rows

CODE = "import hashlib\nx = hashlib.md5(b'a')\n\neval(user)\nliteral_eval(y)\nyaml.load(a,\n  Loader=SafeLoader)\nyaml.load(f)\npassword = 'hunter22xyz'\nrun(\n  a, debug=True)\n{{ name }}\n{{ name | escape }}\n"


def test_security_matches_equal_a_plain_scan(spark):
    df = spark.createDataFrame([("a", CODE), ("b", ""), ("c", None), ("d", "md5(1)\n" * 1000)], "id string, code string")
    want = {}
    for rule, _, _, p in r.SECURITY_RULES:
        for i, code in (("a", CODE), ("d", "md5(1)\n" * 1000)):
            for m in re.finditer(p, code, re.I | re.M):
                want[(i, rule, code.count("\n", 0, m.start()) + 1)] = m.group()
    got = {(x.id, x.rule_id, x.line): x.match for x in r.security_findings(df).collect()}
    assert got == want and ("a", "SEC022", 4) in got and ("a", "SEC061", 8) in got and ("a", "SEC061", 6) not in got
    assert {(x.id, x.rule_id): x.n for x in r.security_counts(df).collect()}[("d", "SEC052")] == 1000


def test_lines_suppressions_and_verdict(spark):
    df = spark.createDataFrame([("a", "x = 1  # codeloom: ignore R1\n# codeloom: ignore-next-line\ny\r\nz # TODO later")], "id string, code string")
    lines = r.lines(df)
    assert rows(lines, "line", "body")[-1] == (4, "z # TODO later")
    quiet = r.inline_suppressions(lines)
    assert rows(quiet) == [("a", 1, "R1"), ("a", 3, "*")]
    found = spark.createDataFrame([("a", 1, "R1", "critical"), ("a", 1, "R2", "high"), ("a", 3, "R9", "critical"), ("b", 1, "R1", "low")], "id string, line int, rule_id string, severity string")
    marked = r.apply_suppressions(found, quiet)
    assert {(x.line, x.rule_id): x.suppressed for x in marked.where("id = 'a'").collect()} == {(1, "R1"): True, (1, "R2"): False, (3, "R9"): True}
    assert rows(r.summary(marked, "id"), "id", "critical", "high", "blocking") == [("a", 0, 1, False), ("b", 0, 0, False)]
    assert r.sarif(marked).count() == 2
    assert rows(r.todo_markers(lines), "line", "marker") == [(4, "TODO")]


def test_split_lines(spark):
    df = spark.createDataFrame([("a\r\nb\n",), ("",), ("a b\rc",)], "t string").select(split_lines("t").alias("l"))
    assert [x.l for x in df.collect()] == ["a\r\nb\n".splitlines(), [], "a b\rc".splitlines()]


def test_upsert_and_changes(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1), (None, "n", 1)], "k int, v string, ver int")
    b = spark.createDataFrame([(2, "z", 2), (3, "w", 1), (1, "old", 0)], "k int, v string, ver int")
    assert rows(upsert.upsert(a, b, ["k"], "ver")) == [(1, "x", 1), (2, "z", 2), (3, "w", 1)]
    assert rows(upsert.changed(b, a, "k", "v")) == [(1, "changed"), (2, "changed"), (3, "added")]
    assert rows(upsert.delete_where(a, b, ["k"]), "v") == [("n",)]


def test_python_facts(spark):
    code = "import os\nfrom a.b import c\nclass Dog(Animal):\n    def add(self, a, b=[]):\n        try:\n            return helper(42)\n        except:\n            pass\n\nasync def fetch(url) -> int:\n    return 1 if url else 0\n"
    df = spark.createDataFrame([("f", code), ("bad", "def ("), ("none", None), ("empty", "")], "id string, code string")
    got = parsing.facts(df)
    assert rows(parsing.elements_of(got), "type", "name") == [("class", "Dog"), ("function", "fetch"), ("method", "add")]
    assert {x.rule_id for x in parsing.findings_of(got).collect()} == {"PY-MUTABLE-DEFAULT", "PY-BARE-EXCEPT", "PY-MAGIC-NUM", "PY-MISSING-RETURN-TYPE", "PY-UNUSED-IMPORT"}
    assert rows(got.where("kind in ('import', 'inherits')"), "kind", "name") == [("import", "a.b"), ("import", "os"), ("inherits", "Animal")]
    defs = spark.createDataFrame([("h2", "helper", "b.py", 1), ("h1", "helper", "a.py", 9)], "id string, name string, file string, line_start int")
    assert rows(parsing.resolve_calls(got, defs)) == [("f", "h1", 6)]


def test_nearest_with_ties_and_bad_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [5.0, 5.0]), (5, None), (6, [1.0])], "id long, v array<float>").withColumn("grp", F.lit("g"))
    got = nearest(v, v.where("id = 1"), 2, 2)
    assert rows(got, "id", "distance", "similarity", "position") == [(2, 1.0, 0.5, 1), (3, 1.0, 0.5, 2)]
    assert rows(nearest(v.where("id < 0"), v.where("id = 1"), 2, 2)) == []


def test_embedding_text_keeps_what_stands_before_the_code(spark, tmp_path):
    schema = "id string, type string, name string, docstring string, signature string, code string, updated_at timestamp_ntz"
    data = [("a", "function", "f", "does f", "f()", "x" * 9000 + "1"), ("b", "function", "f", "does f", "f()", "x" * 9000 + "2"), ("c", "function", "f", "d" * 9000, "f()", "x"), ("d", "function", "f", None, None, "x = 1")]
    spark.createDataFrame([(*x, None) for x in data], schema).write.parquet(str(tmp_path / "code_elements.parquet"))
    got = {r.id: r for r in review.embedding_text(spark, str(tmp_path)).collect()}
    assert got["a"].digest != got["b"].digest and got["a"].cut_digest == got["b"].cut_digest
    head = "function: f\nDescription: does f\nSignature: f()"
    assert got["a"].cut_digest == sha256(f"{head}\nCode:\n{'x' * (8000 - len(head) - 7 - 30)}\n... [truncated]".encode()).hexdigest()
    assert got["c"].cut_digest == sha256(f"function: f\nDescription: {'d' * 9000}"[:7980].encode() + b"\n... [truncated]").hexdigest()
    assert got["d"].digest == got["d"].cut_digest == sha256(b"function: f\nCode:\nx = 1").hexdigest()
