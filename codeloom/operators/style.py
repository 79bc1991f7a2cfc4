"""Coding style: which rules elements follow, what a corpus usually does, and who deviates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import materialize

# Style rules as (category, name, pattern, column, element types, languages); no types or languages: all.
RULES = [
    ("naming", "snake_case_functions", r"^[a-z][a-z0-9_]*$", "name", ["function", "method"], ["python", "rust", "go"]),
    ("naming", "camel_case_functions", r"^[a-z][a-zA-Z0-9]*$", "name", ["function", "method"], ["javascript", "typescript"]),
    ("naming", "pascal_case_classes", r"^[A-Z][a-zA-Z0-9]*$", "name", ["class"], []),
    ("naming", "private_pascal_case_classes", r"^_[A-Z][a-zA-Z0-9]*$", "name", ["class"], ["python"]),
    ("naming", "private_prefix_underscore", r"^_[a-z][a-z0-9_]*$", "name", ["function", "method"], ["python"]),
    ("naming", "dunder_methods", r"^__[a-z][a-z0-9_]*__$", "name", ["method"], ["python"]),
    ("naming", "ast_visitor_methods", r"^visit_[A-Z][a-zA-Z0-9]*$|^generic_visit$", "name", ["function", "method"], ["python"]),
    ("docstring", "google_docstring", r"(Args:|Returns:|Raises:|Attributes:|Example:)", "docstring", [], ["python"]),
    ("docstring", "numpy_docstring", r"(Parameters\n-+|Returns\n-+|Raises\n-+)", "docstring", [], ["python"]),
    ("docstring", "sphinx_docstring", r"(:param\s|:returns:|:raises:|:type\s)", "docstring", [], ["python"]),
    ("docstring", "jsdoc", r"@param\s|@returns?\s|@throws?\s", "docstring", [], ["javascript", "typescript"]),
    ("docstring", "rustdoc", r"///|//!", "code", [], ["rust"]),
    ("docstring", "godoc", r"^// [A-Z]", "code", [], ["go"]),
    ("typing", "type_hints_parameters", r"def\s+\w+\s*\([^)]*:\s*\w+", "code", [], ["python"]),
    ("typing", "type_hints_return", r"def\s+\w+\s*\([^)]*\)\s*->\s*\w+", "code", [], ["python"]),
    ("typing", "optional_types", r"Optional\[|Union\[.*None\]|\s*\|\s*None", "code", [], ["python"]),
    ("typing", "list_type_hints", r"List\[|list\[", "code", [], ["python"]),
    ("typing", "dict_type_hints", r"Dict\[|dict\[", "code", [], ["python"]),
    ("typing", "typescript_interfaces", r"interface\s+\w+|type\s+\w+\s*=", "code", [], ["typescript"]),
    ("typing", "rust_result_option", r"\bResult<|\bOption<", "code", [], ["rust"]),
    ("import", "absolute_imports", r"^from\s+\w+\.\w+", "code", [], []),
    ("import", "relative_imports", r"^from\s+\.", "code", [], []),
    ("import", "from_imports", r"^from\s+\S+\s+import\s+", "code", [], []),
    ("error_handling", "exception_chaining", r"raise\s+\w+\s+from\s+\w+", "code", [], ["python"]),
    ("error_handling", "context_managers", r"with\s+\w+\([^)]*\)\s*(as\s+\w+)?:", "code", [], ["python"]),
]
CONFIDENCE = {"naming": 0.8, "docstring": 0.8}


def style_matches(elements: DataFrame) -> DataFrame:
    """``id, category, style, confidence``: the rules each element follows. One pass, no shuffle; lines count in code."""

    def holds(rx: str, col: str, types: list, langs: list) -> Column:
        c = F.coalesce(F.col(col), F.lit("")).rlike("(?m)" + rx if col == "code" else rx)
        if col == "name":
            c = F.coalesce(F.col("name").rlike(rx), F.lit(False))
        if types:
            c = c & F.col("type").isin(types)
        return c & F.coalesce(F.col("language").isin(langs), F.lit(False)) if langs else c

    each = [F.when(holds(rx, col, ts, ls), F.struct(F.lit(c).alias("category"), F.lit(n).alias("style"), F.lit(CONFIDENCE.get(c, 0.7)).alias("confidence"))) for c, n, rx, col, ts, ls in RULES]
    return elements.select("id", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("s")).select("id", "s.*")


def aggregate_styles(matches: DataFrame) -> DataFrame:
    return matches.groupBy("category", "style").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def learned_styles(matches: DataFrame, min_count: int = 2, min_confidence: float = 0.5) -> DataFrame:
    """Styles seen often enough, with their first example."""
    agg = matches.groupBy("category", "style").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.min("id").alias("example"))
    return agg.where((F.col("n") >= min_count) & (F.col("c") >= min_confidence)).select("category", "style", "n", F.round("c", 6).alias("confidence"), "example")


def naming(c: Column) -> Column:
    """Naming pattern of a name, its last part if dotted; null for no name, which so deviates from nothing."""
    last = F.element_at(F.split(c, r"\."), -1)
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(last.rlike("^[A-Z][A-Z0-9_]*$"), "screaming")
        .when(last.rlike("^[A-Z][a-zA-Z0-9]*$"), "pascal")
        .when(last.rlike("^[a-z][a-z0-9_]*$") & (last.contains("_") | (last == F.lower(last))), "snake")
        .when(last.rlike("^[a-z][a-zA-Z0-9]*$"), "camel")
        .otherwise("other")
    )


def habits() -> dict[str, Column]:
    """What baselines need to know of a text: whether it handles errors, and whether it handles a password in the plain."""
    code = F.coalesce(F.col("code"), F.lit(""))
    return {"tried": code.rlike(r"\b(try|except|catch|Err)\b"), "careless": code.contains("password") & ~code.rlike("hash|bcrypt|scrypt")}


def baseline(elements: DataFrame) -> DataFrame:
    """Per language and type: dominant naming with its rate, rate of error handling, mean and deviation of length.

    Takes ``language, type, name, line_start, line_end`` and ``tried`` (see :func:`habits`) of all elements; lengths are summed as integers, so that any order of adding gives the same.
    """
    named = elements.where("name is not null").groupBy("language", "type", naming(F.col("name")).alias("p")).agg(F.count("*").alias("n"))
    top = named.groupBy("language", "type").agg(F.max_by("p", F.struct("n", "p")).alias("dominant"), F.max("n").alias("_m"), F.sum("n").alias("_n"))
    size = F.col("line_end") - F.col("line_start") + 1
    stats = elements.groupBy("language", "type").agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("tried"), 1.0).otherwise(0.0)).alias("t"), F.sum(size).alias("s"), F.sum((size * size).cast("long")).alias("q"), F.count(size).alias("k")
    )
    mean = F.col("s") / F.col("k")
    var = F.greatest(F.lit(0.0), F.col("q") / F.col("k") - mean * mean)
    out = stats.join(top.withColumnsRenamed({"language": "_l", "type": "_t"}), F.col("language").eqNullSafe(F.col("_l")) & F.col("type").eqNullSafe(F.col("_t")), "left")
    return out.select("language", "type", "n", "dominant", F.round(F.col("_m") / F.col("_n"), 9).alias("dominant_rate"), F.round("t", 9).alias("error_handling_rate"), F.round(mean, 9).alias("mean_length"), F.round(F.sqrt(var), 6).alias("std_length"))


def deviations(elements: DataFrame, base: DataFrame, min_rate: float = 0.7) -> DataFrame:
    """``id, rule_id``: elements that deviate from the baseline of their language and type in naming, length or error handling."""
    b = materialize(base.select("language", "type", "dominant", "dominant_rate", "error_handling_rate", "mean_length", "std_length"), "baseline")  # so that its size is known to the join
    size = F.col("line_end") - F.col("line_start") + 1
    own = naming(F.col("name"))
    rules = F.array(
        F.when((F.col("dominant_rate") >= min_rate) & (own != F.col("dominant")) & (own == "other"), "PAT-NAMING-CONVENTION"),
        F.when((F.col("error_handling_rate") >= min_rate) & ~F.col("tried"), "PAT-MISSING-ERROR-HANDLING"),
        F.when((F.col("std_length") > 0) & (size > 40) & (size > F.col("mean_length") + 2 * F.col("std_length")), "PAT-COMPLEXITY-SPIKE"),
        F.when(F.col("careless"), "PAT-PASSWORD-HANDLING"),
    )
    return elements.join(b, ["language", "type"], "left").select("id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule_id"))
