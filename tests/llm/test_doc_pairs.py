import pytest

from codeloom.llm.doc_pairs import clean, doc_pairs, extent, informative, parse, parse_all
from codeloom.llm.peg import State, balanced, either, many, rx, seq
from tests.conftest import rows

CASES = [
    ("python", 'def f(a, b=")"):\n    """Adds both numbers together."""\n    return a', "Adds both numbers together."),
    ("python", "# Adds both numbers together.\ndef f(a):\n    return a", "Adds both numbers together."),
    ("python", "# Far away remark about it.\n\ndef f(a):\n    return a", ""),
    ("python", "@dec(x=[1, (2)])\nasync def f(\n    a: dict[str, int] = {'k': 1},\n) -> int:\n    r'''Raw docs follow the signature here.'''\n", "Raw docs follow the signature here."),
    ("python", "# pylint: disable=too-many-locals\ndef f():\n    pass", ""),
    ("python", "# x = compute(y)\ndef f():\n    pass", ""),
    ("python", "def f():\r\n\t\"\"\"Windows line ends\r\n\tdo no harm.\"\"\"\r\n\tpass", "Windows line ends\n\tdo no harm."),
    ("python", 'def f():\n    """Cut off in the middle of', "Cut off in the middle of"),
    ("python", "def f():\n    x = 'not documentation at all'\n", ""),
    ("javascript", "/**\n * Joins all parts again.\n * @param a first\n */\nfunction f(a) {", "Joins all parts again.\n@param a first"),
    ("typescript", "// eslint-disable-next-line complexity\n// Joins all parts again.\nfoo(a: Map<string, X>) {\n // inner words of no matter\n", "Joins all parts again."),
    ("javascript", "// Copyright 2016 the authors. All rights reserved.\nf() {", ""),
    ("rust", "/// Splits the given input.\n#[inline]\npub fn f(&self) -> Result<u32, String> {", "Splits the given input."),
    ("go", "// Splits the given input.\r\nfunc f() error {\r\n", "Splits the given input."),
    ("go", "// Splits the given input.\r\n\r\nfunc f() error {\r\n", ""),
    ("rust", "/// Holds the 'a lifetime.\npub fn f<'a>(x: &'a str, c: char) -> &'a str { x }", "Holds the 'a lifetime."),
    ("go", "//nolint:gocyclo\nfunc (s *T) f() error {", ""),
    ("go", "// if x > 5 {\n// return y\n// }\nfunc f() {", ""),
]


@pytest.mark.parametrize("language,code,doc", CASES)
def test_documentation_is_parsed(language, code, doc):
    got = parse(code, language)
    assert got["doc"] == doc
    if doc:
        assert doc.split()[0] in code[got["doc_start"] : got["doc_end"]]


@pytest.mark.parametrize("text", ["TODO: write documentation", "Write me!", "[summary]", "<summary>", "***", "N/A", "docs follow", "@param value\n@returns", "Args:\n    value:\n\nReturns:", ":param x:\n:return:", "load_file()", "Loads the file", "FIXME - document this later", "A method", "To be documented.", ""])
def test_says_nothing(text):
    assert not informative(clean([*text.split("\n")]), "load_file")


@pytest.mark.parametrize("text", ["Loads whatever lies at the given place.", "Reserves ivory cobbles for violet vessel.", "この配列は古い索引を生成する", "Args:\n    value: the number of rows"])
def test_says_something(text):
    assert informative(clean(text.split("\n")), "load_file")


def test_packrat_memo_and_choice():
    rule = seq(many(either(rx("ab", "x"), rx("a", "y"))), rx(r"\Z"))
    assert rule(State("aabab"), 0)[1] == (("y", 0, 1), ("x", 1, 3), ("x", 3, 5)) and rule(State("ac"), 0) is None


def test_brackets_nest_to_any_depth():
    rule = balanced(r'"[^"]*"')
    assert rule(State("(" * 5000 + '")"' + ")" * 5000 + "x"), 0) == (10003, ()) and rule(State("(]"), 0) is None and rule(State("([{"), 0) == (3, ())
    for language in ("python", "javascript", "go", "rust", "typescript"):
        assert parse("f(" + "[(" * 3000 + ")]" * 3000 + ") {", language)["doc"] == ""


@pytest.mark.parametrize(
    "language,code,names",
    [
        ("python", "def one():\n    '''First of the two here.'''\n    def inner(x):\n        # no doc\n        return x\n\n# Second of the two here.\n@wraps\ndef two():\n    text = '# def three():'\n    return 1\n", ["one", "inner", "two"]),
        ("javascript", "/** First of them all. */\nfunction one(a) { if (a) { return 1; } }\n// Second of them all.\nconst two = async (b) => { return `function no() {`; };\nclass X {\n  // Third of them all.\n  three(c) { for (;;) { } }\n}", ["one", "two", "three"]),
        ("typescript", "// First of them all.\nexport async function one<T>(a: T): Promise<T> {\n}\n/* Second of them all. */\n  private two(b?: number): string {\n  }", ["one", "two"]),
        ("go", "// First of them all.\nfunc one(a int) (int, error) {\n  if a > 1 { }\n}\n\n// Second of them all.\nfunc (s *T[K]) two() {\n x := `func no() {`\n}", ["one", "two"]),
        ("rust", "/// First of them all.\npub fn one<T: Into<u8>>(a: T) -> u8 { a.into() }\n/// Second of them all.\n#[inline]\npub(crate) async fn two(c: char) -> bool {\n c == '{'\n}", ["one", "two"]),
    ],
)
def test_several_routines_in_a_text(language, code, names):
    got = parse_all(code, language)
    assert [r["name"] for r in got] == names
    assert got[0]["doc"].startswith("First of") and [r["doc"] for r in got if r["name"] == "two"][0].startswith("Second of")
    body = extent(code, language, next(r["head"] for r in got if r["name"] == "two"))
    assert "two" in body and "First" not in body and "Third" not in body and body.rstrip()[-1] in "};1"


def test_deep_nesting_and_long_text():
    assert parse("def f(" + "(" * 60 + ")" * 60 + "):\n    '''Handles very deep nests.'''", "python")["doc"] == "Handles very deep nests."
    assert parse("/* " + "word " * 100_000 + "*/\nf() {", "javascript")["doc"].startswith("word word")


def test_operator_edge_cases(spark):
    schema = "id string, type string, language string, name string, signature string, code string, docstring string, description string"
    data = [("a", "function", "python", "f", None, CASES[0][1], None), ("b", "method", None, None, None, None, "Some real words of documentation."), ("c", "class", "python", "C", None, CASES[0][1], None), ("d", "function", "python", "f", None, None, "  "), ("e", "function", "python", None, None, "def g_h():\n    '''g h'''", None), (None, "function", "go", "f", None, "", "Words enough to be real."), ("a", "function", "python", "f", None, CASES[0][1], None)]
    df = spark.createDataFrame([(*x, "clash") for x in data], schema)
    assert rows(doc_pairs(df), "id") == [("a",), ("a",), ("b",), (None,)]
    assert rows(doc_pairs(df.where("id = 'zz'"))) == []
