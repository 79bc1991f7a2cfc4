"""Relations read from source text by patterns, for languages without a parser here; all inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import short_id

# Words before a bracket that call nothing.
KEYWORDS = [
    "if", "for", "while", "switch", "catch", "return", "function", "fn", "func", "def", "class", "match", "loop", "else", "elif", "except", "with", "print", "new", "await", "typeof", "sizeof",
    "in", "not", "and", "or", "is", "as", "async", "super", "self", "this", "lambda", "assert", "raise", "throw", "yield", "del", "case", "when", "where", "impl", "let", "const", "var",
]


def called_names(code: Column) -> Column:
    """Distinct names followed by a bracket, without keywords and single letters."""
    names = F.array_distinct(F.regexp_extract_all(code, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1))
    return F.filter(names, lambda x: (F.length(x) > 1) & ~x.isin(KEYWORDS))


def calls_by_text(elements: DataFrame) -> DataFrame:
    """``src, dst``: routines whose text calls the name of another one.

    Takes ``id, type, name, file, line_start`` and ``called`` (see :func:`called_names`). A dotted name is known by its last part; of several definitions the first (by file, line
    and id) is meant. Self-calls are left out. Names are reduced to one definition before
    the join, and calls to one row per element and name.
    """
    simple = F.element_at(F.split("name", r"\."), -1)
    defs = elements.where("name is not null").groupBy(simple.alias("called")).agg(F.min(F.struct("file", "line_start", "id")).alias("d")).select("called", F.col("d.id").alias("dst"))
    calls = elements.where("type in ('function', 'method')").select(F.col("id").alias("src"), F.explode("called").alias("called"))
    return calls.join(defs, "called").where("src <> dst").select("src", "dst").distinct()


def inheritance_by_text(elements: DataFrame) -> DataFrame:
    """``child, base``: class text that extends, derives from or implements a base, by the base's plain name."""
    code = F.coalesce("code", F.lit(""))
    js = F.regexp_extract(code, r"class\s+[A-Za-z_]\w*(?:<[^>{]*>)?\s+extends\s+([A-Za-z_][\w.]*)", 1)
    py = F.regexp_extract(code, r"^\s*class\s+[A-Za-z_]\w*\s*\(([^)]*)\)", 1)
    bases = F.when(F.col("language") == "python", F.split(py, r"\s*,\s*")).otherwise(F.array(js))
    rows = elements.where("type in ('class', 'struct')").select(F.col("id").alias("child"), F.explode(bases).alias("b"))
    return rows.select("child", F.element_at(F.split(F.trim("b"), r"\."), -1).alias("base")).where("base <> '' and not base like '%=%'").distinct()


# How languages import a module, the first group being its path.
IMPORTS = {
    "python": [r"(?m)^[ \t]*import[ \t]+([A-Za-z_][A-Za-z0-9_.]*)", r"(?m)^[ \t]*from[ \t]+([A-Za-z_.][A-Za-z0-9_.]*)[ \t]+import\b"],
    "rust": [r"(?m)^[ \t]*(?:pub[ \t]+)?use[ \t]+(?:::)?([A-Za-z_][A-Za-z0-9_]*)"],
    "go": [r"(?m)^[ \t]*import[ \t]+(?:[A-Za-z0-9_.]+[ \t]+)?\"([^\"\n]+)\"", r"(?m)^[ \t]*(?:[A-Za-z0-9_.]+[ \t]+)?\"([^\"\n]+)\"[ \t]*\r?$"],
    "javascript": [r"(?m)^[ \t]*import\b[^'\"\n]*['\"]([^'\"\n]+)['\"]"],
}
IMPORTS["typescript"] = IMPORTS["javascript"]


def imported_modules(language: Column, code: Column) -> Column:
    """Distinct modules a text imports: a Rust path's crate, the last part of a Go path (not a relative one), the first part of a JavaScript or TypeScript path, a Python module's name."""
    empty = F.array().cast("array<string>")

    def paths(name: str) -> Column:
        return F.flatten(F.array(*[F.regexp_extract_all(code, F.lit(p), F.lit(1)) for p in IMPORTS[name]]))

    go = F.transform(F.filter(paths("go"), lambda x: ~x.startswith(".")), lambda x: F.substring_index(x, "/", -1))
    js = F.transform(paths("javascript"), lambda x: F.substring_index(F.regexp_replace(x, r"^[./]+", ""), "/", 1))
    found = F.when(language == "python", paths("python")).when(language == "rust", paths("rust")).when((language == "go") & code.rlike(r"(?m)^[ \t]*import\b"), go).when(language.isin("javascript", "typescript"), js)
    return F.array_distinct(F.filter(F.coalesce(found, empty), lambda x: x != ""))


def import_edges(elements: DataFrame) -> DataFrame:
    """``file, language, module, source_id, target_id``: one IMPORTS edge per file and module, over ``file, language, modules``.

    Files and modules are nodes named by a hash of their kind and name.
    """
    rows = elements.where("file is not null").select("file", "language", F.explode("modules").alias("module")).distinct()
    return rows.select("file", "language", "module", short_id(F.lit("file"), F.col("file")).alias("source_id"), short_id(F.lit("module"), F.col("module")).alias("target_id"))


def contains_edges(elements: DataFrame) -> DataFrame:
    """``source_id, target_id, container``: each element in its class, by the class's name before the dot and the file, or else in its file.

    Of several classes of one name in a file the first (by line and id) is meant. Classes are one row per name before the join.
    """
    rows = elements.where("file is not null and type <> 'file'")
    dotted = F.col("name").contains(".")
    owner = F.when(dotted, F.element_at(F.slice(F.split("name", r"\."), -2, 1), 1))
    simple = F.element_at(F.split("name", r"\."), -1)
    classes = rows.where("type in ('class', 'struct') and name is not null").groupBy("file", simple.alias("owner")).agg(F.min(F.struct("line_start", "id")).alias("c")).select("file", "owner", F.col("c.id").alias("class_id"))
    members = rows.select("id", "file", owner.alias("owner")).join(classes, ["file", "owner"], "left")
    own = F.when(F.col("class_id") != F.col("id"), F.col("class_id"))
    return members.select(F.coalesce(own, short_id(F.lit("file"), F.col("file"))).alias("source_id"), F.col("id").alias("target_id"), F.when(own.isNotNull(), "class").otherwise("file").alias("container"))


def trait_edges(elements: DataFrame) -> DataFrame:
    """``child, base``: Rust types that implement a trait, over ``id, type, name, impls`` (see :func:`trait_impls`); a trait goes by its plain name."""
    named = elements.where("type in ('struct', 'enum', 'class') and name is not null").groupBy(F.col("name").alias("of")).agg(F.min("id").alias("child"))
    return elements.select(F.explode("impls").alias("i")).select("i.of", "i.base").distinct().join(named, "of").select("child", "base").distinct()


def trait_impls(language: Column, code: Column) -> Column:
    """(trait, type) of every ``impl Trait for Type`` of a Rust text."""
    rx = r"\bimpl(?:\s*<[^>]*>)?\s+([A-Za-z0-9_:]+)(?:<[^>]*>)?\s+for\s+([A-Za-z0-9_]+)"
    both = F.arrays_zip(F.regexp_extract_all(code, F.lit(rx), F.lit(1)).alias("base"), F.regexp_extract_all(code, F.lit(rx), F.lit(2)).alias("of"))
    pairs = F.transform(both, lambda x: F.struct(F.element_at(F.split(x["base"], "::"), -1).alias("base"), x["of"].alias("of")))
    return F.when(language == "rust", pairs)


# What branches in each language, and how names are written: (element types, pattern, rule).
BRANCHES = {"rust": r"\b(?:if|while|for|loop)\b|=>", "go": r"\b(?:if|for|case|select)\b", "javascript": r"\b(?:if|for|while|case)\b|\s\?\s", "typescript": r"\b(?:if|for|while|case)\b|\s\?\s"}
NAMES = {
    "rust": [(["function", "method"], "^[a-z][a-z0-9_]*$", "TS-RUST-NAMING"), (["struct", "enum"], "^[A-Z][a-zA-Z0-9]*$", "TS-RUST-NAMING")],
    "go": [(["function", "method"], "^[a-zA-Z][a-zA-Z0-9]*$", "TS-GO-NAMING")],
    "javascript": [(["function", "method"], r"^[a-z_$][a-zA-Z0-9_$]*$|^[A-Z][a-zA-Z0-9]*$", "TS-JS-NAMING"), (["class"], "^[A-Z][a-zA-Z0-9]*$", "TS-JS-NAMING")],
    "typescript": [(["function", "method"], r"^[a-z_$][a-zA-Z0-9_$]*$|^[A-Z][a-zA-Z0-9]*$", "TS-TS-NAMING"), (["class", "interface"], "^[A-Z][a-zA-Z0-9]*$", "TS-TS-NAMING")],
}
_NO_CODE = {
    True: r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`|//[^\n]*|/\*[\s\S]*?\*/",
    False: r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|`[^`]*`|//[^\n]*|/\*[\s\S]*?\*/",
}


def bare_code(language: Column, code: Column) -> Column:
    """A text without its strings and comments."""
    return F.when(language.isin("javascript", "typescript"), F.regexp_replace(code, _NO_CODE[True], " ")).otherwise(F.regexp_replace(code, _NO_CODE[False], " "))


def complexity(language: Column, code: Column) -> Column:
    """One more than the branches of a text, for the languages that have a rule; null for others."""
    bare, out = bare_code(language, code), F.lit(None).cast("int")
    for name, rx in BRANCHES.items():
        out = F.when(language == name, F.regexp_count(bare, F.lit(rx)) + 1).otherwise(out)
    return out


def block_depth(language: Column, code: Column) -> Column:
    """How deep blocks with a head (if, for, while, loop, match, switch, do, select) nest in a text; other brackets do not count."""
    tokens = F.regexp_extract_all(bare_code(language, code), F.lit(r"(\b(?:if|else|for|while|loop|match|switch|do|select)\b[^{};]*\{|[{}])"), F.lit(1))
    zero = F.struct(F.array().cast("array<int>").alias("open"), F.lit(0).alias("depth"), F.lit(0).alias("most"))

    def step(acc: Column, t: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc["open"], F.lit(-1)), F.lit(0))
        counts = F.when(F.length(t) > 1, 1).otherwise(0)
        depth = F.when(t == "}", acc["depth"] - last).otherwise(acc["depth"] + counts).cast("int")
        stack = F.when(t == "}", F.slice(acc["open"], 1, F.greatest(F.size(acc["open"]) - 1, F.lit(0)))).otherwise(F.array_append(acc["open"], counts))
        return F.struct(stack.alias("open"), depth.alias("depth"), F.greatest(acc["most"], depth).alias("most"))

    return F.when(language.isin(list(BRANCHES)), F.aggregate(tokens, zero, step, lambda acc: acc["most"]))


def text_checks(elements: DataFrame, max_complexity: int = 10, max_lines: int = 60, max_depth: int = 4, max_params: int = 5) -> DataFrame:
    """``id, rule_id, severity, detail`` for languages without a parser here, over ``type, name, language, line_start, line_end, parameters, complexity, depth``."""
    routine, last = F.col("type").isin("function", "method"), F.element_at(F.split("name", r"\."), -1)
    lines, n = F.col("line_end") - F.col("line_start") + 1, F.size(F.filter("parameters", lambda p: ~p.rlike(r"^&?(?:mut )?self\b")))
    hit = lambda rule, how, when, detail: F.when(when, F.struct(F.lit(rule).alias("rule_id"), F.lit(how).alias("severity"), detail.cast("string").alias("detail")))
    rules = [
        hit("TS-COMPLEXITY", "warning", routine & (F.col("complexity") > max_complexity), F.col("complexity")),
        hit("TS-LONG-FN", "warning", routine & (lines > max_lines), lines),
        hit("TS-DEEP-NEST", "warning", routine & (F.col("depth") > max_depth), F.col("depth")),
        hit("TS-TOO-MANY-PARAMS", "suggestion", routine & (n > max_params), n),
    ]
    rules += [hit(rule, "suggestion", (F.col("language") == lang) & F.col("type").isin(types) & (F.length(last) > 1) & ~last.rlike(rx), last) for lang, kinds in NAMES.items() for types, rx, rule in kinds]
    rows = elements.where(F.col("language").isin(list(BRANCHES)))
    return rows.select("id", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("r")).select("id", "r.*")


def ranges(elements: DataFrame) -> DataFrame:
    """``id, file, line_start, end_guess``: routines end where the next of their file begins, the last at its own end."""
    w = Window.partitionBy("file").orderBy("line_start", "id")
    rows = elements.where("file is not null and line_start is not null")
    nxt = F.lead("line_start").over(w)
    return rows.select("id", "file", "line_start", F.greatest(F.col("line_start"), F.coalesce(nxt - 1, F.col("line_end"))).alias("end_guess"))


def once(rows: DataFrame, keys: Sequence[str], item: str, order: Sequence[str]) -> DataFrame:
    """Each item once per key, where it comes first in the given order: later lists lose what earlier ones had."""
    first = rows.groupBy(*keys, item).agg(F.min(F.struct(*order)).alias("_o"))
    return first.select(*keys, item, "_o.*")


def mentions(texts: DataFrame, text_id: str, text: str, elements: DataFrame) -> DataFrame:
    """``text id, word, id``: words of texts (three letters and more) that are the full name of an element; its first bearer."""
    names = elements.where("name is not null").groupBy("name").agg(F.min(F.struct("file", "line_start", "id")).alias("d")).select(F.col("name").alias("word"), F.col("d.id").alias("id"))
    words = texts.where(F.col(text).isNotNull()).select(text_id, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"([A-Za-z_][A-Za-z0-9_.]{2,})"), 1))).alias("word"))
    return words.join(names, "word").select(text_id, "word", "id").distinct()


def structure_marks() -> dict[str, Column]:
    """Which structures a text uses."""
    code = F.coalesce("code", F.lit(""))
    marks = {"decorators": r"(?m)^\s*@\w", "context_managers": r"(?m)^\s*(?:async\s+)?with\s", "dataclasses": r"@dataclass|\bNamedTuple\b", "generators": r"\byield\b", "asynchronous": r"\basync\b|\bawait\b", "closures": r"=>|\blambda\b"}
    return {k: code.rlike(p) for k, p in marks.items()}


def structures(elements: DataFrame) -> DataFrame:
    """Per language: elements that use decorators, context managers, data classes, generators or asynchronous code."""
    return elements.groupBy("language").agg(F.count("*").alias("n"), *[F.count_if(k).alias(k) for k in structure_marks()])


def glob_regex(glob: Column) -> Column:
    """A file glob as a pattern; '*' crosses directories."""
    quoted = F.regexp_replace(glob, r"([.+^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def suppress_by_glob(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings (``file, rule_id`` and more) with ``suppressed`` where a project rule (``rule_id`` or null or '*', ``glob`` or null) covers them.

    Findings meet the rules of their rule id, gathered into a row per id (a project states few), and
    those for all ids; the globs are then tested inside the row. A null file matches no glob but '*'.
    """
    rx = glob_regex(F.coalesce("glob", F.lit("*")))
    packed = rules.select(F.coalesce("rule_id", F.lit("*")).alias("_rule"), rx.alias("_rx")).groupBy("_rule").agg(F.collect_set("_rx").alias("_globs"))
    own = findings.join(packed.where("_rule <> '*'"), F.col("rule_id") == F.col("_rule"), "left").drop("_rule")
    every = packed.where("_rule = '*'").agg(F.flatten(F.collect_list("_globs")).alias("_every"))
    globs = F.concat(F.coalesce("_globs", F.array().cast("array<string>")), F.coalesce("_every", F.array().cast("array<string>")))
    both = own.join(every, F.lit(True), "left")  # one row on the right
    return both.withColumn("suppressed", F.exists(globs, lambda g: F.regexp_like(F.coalesce(F.col("file"), F.lit("")), g))).drop("_globs", "_every")


