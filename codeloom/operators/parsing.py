"""Source text to rows: one parse per text gives facts; joins in Spark turn these into elements, edges and findings."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACTS = "kind string, name string, owner string, line int, line_end int, detail string"
_BRANCH = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.With, ast.Assert, ast.AsyncFor, ast.AsyncWith, ast.IfExp)
_KINDS = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
_PLAIN_NUMBERS = {0, 1, -1, 2, 100, 1000}


def _called(f: ast.expr) -> str | None:
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None


def _complexity(node: ast.AST) -> int:
    return 1 + sum(isinstance(x, _BRANCH) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0) + (len(x.ifs) if isinstance(x, ast.comprehension) else 0) for x in ast.walk(node))


_BLOCKS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.ExceptHandler)
# Method names that other libraries ask for.
_ASKED_FOR = ["setUp", "tearDown", "setUpClass", "tearDownClass", "maxDiff"]


def _depth(node: ast.AST) -> int:
    """How deep blocks nest in a routine."""
    deepest, stack = 0, [(x, 0) for x in ast.iter_child_nodes(node)]
    while stack:
        x, d = stack.pop()
        d += isinstance(x, _BLOCKS)
        deepest = max(deepest, d)
        stack.extend((y, d) for y in ast.iter_child_nodes(x))
    return deepest


def _name_facts(tree: ast.Module) -> list[tuple]:
    """Imported names (kind 'imported', outside type checking), names used ('use') and names assigned at the top ('assign')."""
    out, typed, used = [], set(), set()
    for x in ast.walk(tree):
        if isinstance(x, ast.If) and getattr(x.test, "id", getattr(x.test, "attr", None)) == "TYPE_CHECKING":
            typed.update(y for y in ast.walk(x) if isinstance(y, (ast.Import, ast.ImportFrom)))
        elif isinstance(x, ast.Name):
            used.add(x.id)
        elif isinstance(x, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in x.targets) and isinstance(x.value, (ast.List, ast.Tuple)):
            used.update(e.value for e in x.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str))
    for x in ast.walk(tree):
        if x in typed or (isinstance(x, ast.ImportFrom) and (x.module or "").split(".")[0] == "__future__"):
            continue
        if isinstance(x, ast.Import):
            out.extend(("imported", a.asname or a.name.split(".")[0], None, x.lineno, x.lineno, a.name) for a in x.names)
        elif isinstance(x, ast.ImportFrom):
            out.extend(("imported", a.asname or a.name, None, x.lineno, x.lineno, a.name) for a in x.names if a.name != "*")
    out.extend(("use", n, None, None, None, None) for n in sorted(used))
    out.extend(("assign", t.id, None, x.lineno, x.lineno, None) for x in tree.body if isinstance(x, ast.Assign) for t in x.targets if isinstance(t, ast.Name))
    return out


def python_facts(code: str) -> list[tuple]:
    """(kind, name, owner, line, line_end, detail) of a Python text; nothing where it does not parse."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple] = _name_facts(tree)

    def visit(node: ast.AST, owner: str | None, in_class: bool) -> None:
        for x in ast.iter_child_nodes(node):
            line = getattr(x, "lineno", None)
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                args = [a.arg for a in x.args.posonlyargs + x.args.args]
                method = bool(args) and args[0] in ("self", "cls")
                out.append(("method" if method else "function", x.name, owner, line, x.end_lineno, f"{'async def' if isinstance(x, ast.AsyncFunctionDef) else 'def'} {x.name}({ast.unparse(x.args)})"))
                out.append(("nesting", x.name, owner, line, x.end_lineno, str(_depth(x))))
                out.append(("complexity", x.name, owner, line, x.end_lineno, str(_complexity(x))))
                if x.returns is None and not x.name.startswith(("_", "test")):
                    out.append(("PY-MISSING-RETURN-TYPE", x.name, owner, line, x.end_lineno, None))
                n = sum(a not in ("self", "cls") for a in [*args, *(a.arg for a in x.args.kwonlyargs)])
                if n > 5:
                    out.append(("PY-TOO-MANY-PARAMS", x.name, owner, line, x.end_lineno, str(n)))
                out.extend(("PY-MUTABLE-DEFAULT", x.name, owner, dflt.lineno, dflt.lineno, None) for dflt in x.args.defaults + x.args.kw_defaults if isinstance(dflt, (ast.List, ast.Dict, ast.Set)))
                visit(x, x.name, False)
            elif isinstance(x, ast.ClassDef):
                out.append(("class", x.name, owner, line, x.end_lineno, f"class {x.name}({', '.join(ast.unparse(b) for b in x.bases)})"))
                out.append(("members", x.name, owner, line, x.end_lineno, str(sum(isinstance(y, (ast.FunctionDef, ast.AsyncFunctionDef)) for y in x.body))))
                out.extend(("inherits", _called(b) or ast.unparse(b), x.name, line, line, None) for b in x.bases)
                visit(x, x.name, True)
            else:
                if isinstance(x, ast.Import):
                    out.extend(("import", a.name, owner, line, line, "module") for a in x.names)
                elif isinstance(x, ast.ImportFrom) and x.module:
                    out.append(("import", x.module, owner, line, line, "from"))
                elif isinstance(x, ast.Call) and _called(x.func):
                    out.append(("call", _called(x.func), owner, line, line, None))
                elif isinstance(x, ast.ExceptHandler) and x.type is None:
                    out.append(("PY-BARE-EXCEPT", None, owner, line, line, None))
                elif isinstance(x, ast.Constant) and isinstance(x.value, (int, float)) and not isinstance(x.value, bool) and x.value not in _PLAIN_NUMBERS:
                    out.append(("PY-MAGIC-NUM", None, owner, line, line, str(x.value)))
                visit(x, owner, in_class)

    visit(tree, None, False)
    return out


def _fact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [python_facts(c) for c in b.column("code").to_pylist()]
        at = pa.array([i for i, g in enumerate(got) for _ in g], pa.int64())
        cols = zip(*(f for g in got for f in g)) if len(at) else [[]] * len(_KINDS)
        yield pa.RecordBatch.from_arrays([b.column("id").take(at), *(pa.array(c, t) for c, t in zip(cols, _KINDS))], ["id", "kind", "name", "owner", "line", "line_end", "detail"])


def facts(texts: DataFrame) -> DataFrame:
    """``id, kind, name, owner, line, line_end, detail`` of Python texts (``id, code``). Each text is parsed once, in its own task."""
    rows = texts.where("code is not null").select("id", "code")
    return rows.mapInArrow(_fact_batches, f"id {dict(rows.dtypes)['id']}, {FACTS}")


def elements_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind").isin("function", "method", "class")).select("id", F.col("kind").alias("type"), "name", "owner", "line", "line_end", F.col("detail").alias("signature"))


# Severities of the checks.
SEVERITY = {
    "PY-MAGIC-NUM": "suggestion", "PY-BARE-EXCEPT": "warning", "PY-MUTABLE-DEFAULT": "warning", "PY-MISSING-RETURN-TYPE": "suggestion", "PY-TOO-MANY-PARAMS": "suggestion", "PY-UNUSED-IMPORT": "suggestion",
    "PY-LONG-FUNCTION": "warning", "PY-DEEP-NESTING": "warning", "PY-GOD-CLASS": "warning", "PY-LARGE-CLASS": "suggestion", "PY-FUNC-NAMING": "suggestion", "PY-CLASS-NAMING": "suggestion", "PY-CONST-NAMING": "suggestion",
}


def findings_of(rows: DataFrame, max_complexity: int = 10, max_lines: int = 50, max_depth: int = 4, max_methods: int = 20, max_class_lines: int = 500) -> DataFrame:
    """``id, rule_id, severity, line, detail`` of the checks that one parse allows: rules over the facts, and a join of imported with used names."""
    size, number, bare = F.col("line_end") - F.col("line") + 1, F.col("detail").cast("int"), F.ltrim("name", F.lit("_"))
    routine, kind = F.col("kind").isin("function", "method"), F.col("kind")
    odd_name = routine & ~F.col("name").startswith("__") & ~F.col("name").isin(_ASKED_FOR) & ~F.col("name").startswith("visit_") & (F.col("name") != "generic_visit") & (bare != "") & ~bare.rlike("^[a-z_][a-z0-9_]*$")
    odd_class = (kind == "class") & (bare != "") & ~bare.rlike("^[A-Z][a-zA-Z0-9]*$")
    odd_const = (kind == "assign") & F.col("name").rlike("^[A-Z]") & F.col("name").contains("_") & (F.col("name") != F.upper("name"))
    hit = lambda rule, when, detail: F.when(when, F.struct(F.lit(rule).alias("rule_id"), detail.cast("string").alias("detail")))
    rules = F.array(
        F.when(kind.startswith("PY-"), F.struct(kind.alias("rule_id"), F.col("detail"))),
        hit("PY-HIGH-COMPLEXITY", (kind == "complexity") & (number > max_complexity), number),
        hit("PY-LONG-FUNCTION", routine & (size > max_lines), size),
        hit("PY-DEEP-NESTING", (kind == "nesting") & (number > max_depth), number),
        hit("PY-GOD-CLASS", (kind == "members") & (number > max_methods), number),
        hit("PY-LARGE-CLASS", (kind == "members") & (number <= max_methods) & (size > max_class_lines), size),
        hit("PY-FUNC-NAMING", odd_name, F.col("name")),
        hit("PY-CLASS-NAMING", odd_class, F.col("name")),
        hit("PY-CONST-NAMING", odd_const, F.col("name")),
    )
    found = rows.select("id", "line", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("r")).select("id", "r.rule_id", "line", "r.detail")
    used = rows.where("kind = 'use'").select("id", "name")
    unused = rows.where("kind = 'imported'").join(used, ["id", "name"], "left_anti").select("id", F.lit("PY-UNUSED-IMPORT").alias("rule_id"), "line", "detail")
    severity = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("rule_id"))
    grave = F.when(F.col("rule_id") == "PY-HIGH-COMPLEXITY", F.when(F.col("detail").cast("int") <= 20, "warning").otherwise("high"))
    return found.unionByName(unused).select("id", "rule_id", F.coalesce(grave, severity).alias("severity"), "line", "detail")


def resolve_calls(rows: DataFrame, definitions: DataFrame) -> DataFrame:
    """``id, target, line``: calls by name, joined to the definition of that name; the first (by file, line, id) of several.

    ``definitions`` has ``id, name, file, line_start``. Both sides are aggregated before the join, so a name
    that is called everywhere meets one definition row.
    """
    first = definitions.where("name is not null").groupBy("name").agg(F.min(F.struct("file", "line_start", "id")).alias("d")).select("name", F.col("d.id").alias("target"))
    calls = rows.where("kind = 'call'").groupBy("id", "name").agg(F.min("line").alias("line"))
    return calls.join(first, "name").where("id <> target").groupBy("id", "target").agg(F.min("line").alias("line"))
