from codeloom.operators import graph as g
from codeloom.operators.components import connected_components
from tests.conftest import rows

NODES = [("main", "main", "function", "app.py", 1), ("helper1", "helper1", "function", "utils.py", 5), ("helper2", "helper2", "function", "utils.py", 15), ("process", "process", "function", "core.py", 1), ("Base", "Base", "class", "base.py", 0), ("Child", "Child", "class", "child.py", 0), ("app_file", "app.py", "file", "app.py", 0), ("utils_mod", "utils", "module", "utils.py", 0)]
EDGES = [("main", "helper1", "CALLS", 10), ("main", "helper2", "CALLS", 15), ("helper1", "process", "CALLS", 8), ("Child", "Base", "INHERITS", None), ("app_file", "utils_mod", "IMPORTS", None), ("app_file", "main", "CONTAINS", None), ("main", "ghost", "CALLS", 3), ("main", "helper1", "CALLS", 12)]


def graph(spark):
    n = spark.createDataFrame([(*x, x[4], "python") for x in NODES], "id string, name string, node_type string, file string, line_start int, line_end int, language string")
    e = spark.createDataFrame([(s, d, t, c, None, None) for s, d, t, c in EDGES], "src string, dst string, rel_type string, call_line int, import_type string, usage_type string")
    e = e.selectExpr("*", "cast(null as timestamp_ntz) as created_at")
    return g.merge_edges(e, n), n


def names(df, node):
    return {r.name for r in df.where(f"node_id = '{node}'").collect()}


def test_one_hop(spark):
    e, n = graph(spark)
    assert e.count() == 6  # the dangling edge is dropped, the repeated one merged
    assert names(g.neighbours(e, n, ["CALLS"], True), "helper1") == {"main"}
    assert names(g.neighbours(e, n, ["CALLS"], False), "main") == {"helper1", "helper2"}
    assert names(g.neighbours(e, n, ["INHERITS"], False), "Child") == {"Base"}
    assert names(g.neighbours(e, n, ["INHERITS"], True), "Base") == {"Child"}
    assert names(g.neighbours(e, n, ["IMPORTS"], False), "app_file") == {"utils"}
    assert names(g.neighbours(e, n, ["IMPORTS"], True), "utils_mod") == {"app.py"}
    assert names(g.neighbours(e, n, ["CONTAINS"], False), "app_file") == {"main"}
    assert names(g.neighbours(e, n, g.DEPENDENCY_TYPES, True), "process") == {"helper1"}
    assert {r.call_line for r in e.where("src = 'main' and dst = 'helper1'").collect()} == {12}
    assert {r.import_type for r in e.where("rel_type = 'IMPORTS'").collect()} == {"module"}


def test_reach_and_chains(spark):
    e, n = graph(spark)
    seeds = spark.createDataFrame([("process",)], "id string")
    assert {(r.node, r.depth) for r in g.reach(e.where("rel_type='CALLS'"), seeds, 3).collect()} == {("helper1", 1), ("main", 2)}
    pairs = spark.createDataFrame([("main", "process")], "src string, dst string")
    assert rows(g.call_chains(e.where("rel_type='CALLS'"), pairs, 3), "hops", "path") == [(2, "main>helper1>process")]
    assert {r.id: r.impact for r in g.impact(e, n).collect()}["process"] == 0.06


def test_components(spark):
    links = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(40)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "q")], "a string, b string")
    got = {r.id: r.component for r in connected_components(links, "a", "b").collect()}
    assert len(got) == 43 and got["x"] == got["y"] == "x" and {got[f"c{i}"] for i in range(41)} == {"c0"}
    assert rows(connected_components(links.where("a = 'none'"), "a", "b")) == []


def test_chains_to_all_ends(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g"), ("c", "a"), ("a", "d"), ("x", "a"), ("a", "a")], "src string, dst string")
    got = rows(g.chains_from(e, spark.createDataFrame([("a",)], "src string")), "dst", "hops", "path")
    assert got == sorted([("b", 1, "a>b"), ("c", 2, "a>b>c"), ("d", 1, "a>d"), ("d", 3, "a>b>c>d"), ("e", 2, "a>d>e"), ("e", 4, "a>b>c>d>e"), ("f", 3, "a>d>e>f"), ("f", 5, "a>b>c>d>e>f"), ("g", 4, "a>d>e>f>g")])
    two = [("s", f"m{i:02}") for i in range(12)] + [(f"m{i:02}", "t") for i in range(12)]
    first = g.chains_from(spark.createDataFrame(two, "src string, dst string"), spark.createDataFrame([("s",)], "src string")).where("dst = 't'")
    assert rows(first, "path") == [(f"s>m{i:02}>t",) for i in range(10)]
