"""Relations and checks read from text, on written cases."""

from pyspark.sql import functions as F

from codeloom.operators import extract as x
from codeloom.operators import parsing
from tests.conftest import rows

CASES = [
    ("python", "import os, sys\nfrom a.b import c\n  import late.x as y\n# import no\n", ["a.b", "late.x", "os"]),
    ("rust", "use std::io;\npub use crate::x::{A, B};\n  use serde::Deserialize;\n", ["crate", "serde", "std"]),
    ("go", 'import "fmt"\nimport (\n\t"net/http"\n\tyaml "gopkg.in/yaml.v3"\n\t"./local"\n)\n', ["fmt", "http", "yaml.v3"]),
    ("go", 'x := []string{\n"not/import"\n}', []),
    ("javascript", "import React from 'react';\nimport { a } from \"../lib/util\";\nimport './style.css';\nconst b = require('no');", ["lib", "react", "style.css"]),
    ("typescript", "import type { T } from '@scope/pkg';\n", ["@scope"]),
    ("cobol", "import x", []),
    (None, "import x", []),
    ("python", None, []),
]


def test_imports_of_each_language(spark):
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(CASES)], "i int, language string, code string")
    got = {r.i: sorted(r.m) for r in df.select("i", x.imported_modules(F.col("language"), F.col("code")).alias("m")).collect()}
    assert got == {i: c[2] for i, c in enumerate(CASES)}


def test_import_and_contains_edges(spark):
    df = spark.createDataFrame([("f.py", "python", ["a", "b"], "clash"), ("f.py", "python", ["a"], ""), (None, "go", ["z"], "")], "file string, language string, modules array<string>, source_id string")
    assert rows(x.import_edges(df), "file", "module") == [("f.py", "a"), ("f.py", "b")]
    els = spark.createDataFrame([("c", "f", "class", "C", 1), ("c2", "f", "class", "C", 9), ("m", "f", "method", "C.run", 2), ("g", "f", "function", "go", 30), ("o", "g", "method", "C.run", 1), ("n", "f", "function", None, None), ("q", None, "function", "q", 1), ("i", "f", "class", "C.Inner", 3)], "id string, file string, type string, name string, line_start int")
    got = {r.target_id: (r.source_id if r.container == "class" else r.container) for r in x.contains_edges(els).collect()}
    assert got == {"c": "file", "c2": "file", "m": "c", "g": "file", "o": "file", "n": "file", "i": "c"}
    assert rows(x.contains_edges(els.where("id = 'zz'"))) == []


def test_traits(spark):
    df = spark.createDataFrame([("s", "struct", "Shape", "rust", "impl<T: Clone> fmt::Display for Shape {}\nimpl Iterator<Item> for Shape {}"), ("p", "class", "Other", "python", "impl A for Other"), ("t", "function", "f", "rust", "impl Drop for Unknown {}"), ("u", "struct", None, "rust", None)], "id string, type string, name string, language string, code string")
    assert rows(x.trait_edges(df.withColumn("impls", x.trait_impls(F.col("language"), F.col("code"))))) == [("s", "Display"), ("s", "Iterator")]


def test_text_checks(spark):
    deep = "fn f() { if a { for x in y { while z { if q { if r { g(S { a: 1 }); } } } } } }"
    data = [
        ("deep", "function", "f2", "rust", deep, 1, 5, ["&self", "a"]),
        ("long", "function", "main", "go", "func main() { s := \"if for case\" // if if\n}", 1, 80, []),
        ("many", "method", "C.run", "typescript", "run() { return a ? b : c }", 1, 2, ["a", "b", "c", "d", "e", "f"]),
        ("named", "function", "snake_case", "go", "x", 1, 1, None),
        ("class", "class", "lowerName", "javascript", "class lowerName {}", 1, 1, None),
        ("py", "function", "CamelCase", "python", "x", 1, 99, None),
        ("null", "function", None, "go", None, None, None, None),
    ]
    df = spark.createDataFrame(data, "id string, type string, name string, language string, code string, line_start int, line_end int, parameters array<string>")
    df = df.withColumn("complexity", x.complexity(F.col("language"), F.col("code"))).withColumn("depth", x.block_depth(F.col("language"), F.col("code")))
    facts = {r.id: (r.complexity, r.depth) for r in df.collect()}
    assert facts["deep"] == (6, 5) and facts["long"] == (1, 0) and facts["many"] == (2, 0) and facts["py"] == (None, None) and facts["null"] == (None, None)
    assert rows(x.text_checks(df), "id", "rule_id") == [("class", "TS-JS-NAMING"), ("deep", "TS-DEEP-NEST"), ("long", "TS-LONG-FN"), ("many", "TS-TOO-MANY-PARAMS"), ("named", "TS-GO-NAMING")]


def test_project_rules_silence_findings(spark):
    found = spark.createDataFrame([("src/a.py", "R1"), ("src/a.py", "R2"), ("gen/b.py", "R2"), (None, "R1"), ("x.py", None)], "file string, rule_id string")
    rules = spark.createDataFrame([("R1", "src/*"), (None, "gen/*"), ("R9", None)], "rule_id string, glob string")
    got = {(r.file, r.rule_id): r.suppressed for r in x.suppress_by_glob(found, rules).collect()}
    assert got == {("src/a.py", "R1"): True, ("src/a.py", "R2"): False, ("gen/b.py", "R2"): True, (None, "R1"): False, ("x.py", None): False}
    assert {r.suppressed for r in x.suppress_by_glob(found, rules.where("glob = 'zz'")).collect()} == {False}


def test_python_checks(spark):
    code = "import os, json as j\nfrom typing import TYPE_CHECKING, List\nif TYPE_CHECKING:\n    from a import Typed\nfrom b import exported, other\n__all__ = ['exported']\nBad_Name = 1\nGOOD_NAME = 1\n" \
        "def CamelCase(a, b, c, *, d, e, f):\n    os.path\n    for x in y:\n        if x:\n            while x:\n                with x:\n                    if x:\n                        pass\n" \
        "class lower_class:\n" + "".join(f"    def m{i}(self): pass\n" for i in range(21))
    facts = parsing.facts(spark.createDataFrame([("a", code), ("b", "def broken(:"), ("c", None), ("d", "")], "id string, code string"))
    got = {(r.rule_id, r.detail) for r in parsing.findings_of(facts).where("rule_id not in ('PY-MISSING-RETURN-TYPE')").collect()}
    assert got == {
        ("PY-UNUSED-IMPORT", "json"), ("PY-UNUSED-IMPORT", "List"), ("PY-UNUSED-IMPORT", "other"), ("PY-CONST-NAMING", "Bad_Name"), ("PY-FUNC-NAMING", "CamelCase"),
        ("PY-TOO-MANY-PARAMS", "6"), ("PY-DEEP-NESTING", "5"), ("PY-CLASS-NAMING", "lower_class"), ("PY-GOD-CLASS", "21"),
    }
    assert {r.severity for r in parsing.findings_of(facts).where("rule_id = 'PY-GOD-CLASS'").collect()} == {"warning"}
