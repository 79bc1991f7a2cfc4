"""Functions paired with their documentation.

Each language has a packrat parsing-expression grammar of its own: comments, annotations,
signatures with nested brackets and strings, and a documentation string at the start of
a body. The first routine of a text is read leniently, as texts may be cut off; further
ones, in it or after it, by the language's heads. Semantic actions turn the parsed spans
into descriptions; descriptions that say nothing are then dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import spread
from codeloom.llm.peg import Rule, State, balanced, either, many, maybe, rx, seq, span

_NL = r"(?:\r\n|\r|\n)"
_QUOTED = r"""\"(?:\\[\s\S]|[^"\\\r\n])*\"?|'(?:\\[\s\S]|[^'\\\r\n])*'?"""
_STR = r"""[A-Za-z]{0,2}(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|%s)""" % _QUOTED
_TEMPLATE = r"`(?:\\[\s\S]|[^`\\])*(?:`|\Z)"
_BRACE_STRINGS = {
    "javascript": f"{_QUOTED}|{_TEMPLATE}",
    "typescript": f"{_QUOTED}|{_TEMPLATE}",
    "go": rf"""\"(?:\\.|[^"\\\r\n])*\"?|`[^`]*(?:`|\Z)|'(?:\\[^']{{1,9}}|[^'\\\r\n])'""",
    "rust": r"""b?r#*"[\s\S]*?(?:"#*|\Z)|b?"(?:\\[\s\S]|[^"\\])*(?:"|\Z)|b?'(?:\\[^']{1,9}|[^'\\\r\n])'|'[A-Za-z_]\w*""",
}
_LINE_START = rx(r"(?<![^\r\n])(?:[ \t]*)")
_NOT_HEADS = r"(?!(?:if|for|while|switch|catch|with|return|function|await|new|typeof|else|do|throw|super)\b)"


def _python() -> Rule:
    group = balanced(rf"{_STR}|#[^\r\n]*")
    blank = rx(r"[ \t\f]*" + _NL)
    comment = seq(rx(r"[ \t]*"), rx(r"#[^\r\n]*", "line"), rx(_NL + r"|\Z"))
    decorator = seq(rx(r"[ \t]*@[\w.]+"), maybe(group), rx(r"[^\r\n]*(?:" + _NL + r"|\Z)"))
    head = seq(rx(r"[ \t]*(?:async[ \t]+)?def[ \t]+"), rx(r"\w+", "name"), maybe(rx(r"\[[^\]]*\]")), rx(r"[ \t]*"), maybe(group), rx(r"[^:\r\n]*(?::(?=[^\r\n]*)|\Z|(?=[\r\n]))"))
    body = seq(many(either(blank, rx(r"[ \t]+"), rx(r"#[^\r\n]*" + _NL))), rx(_STR, "string"))
    notes = many(either(comment, blank))
    routine = seq(span("signature", head), maybe(body))
    marks = many(either(decorator, comment, blank))
    first = span("unit", seq(notes, marks, maybe(routine)))
    unit = span("unit", seq(_LINE_START, maybe(many(either(comment, decorator), 1)), routine))
    other = either(many(either(comment, blank), 1), rx(_STR), rx(r"#[^\r\n]*"), rx(_NL), rx(r"[^\"'#\r\n]+"), rx(r"[\s\S]"))
    return seq(first, many(either(unit, other)))


def _braces(language: str, note: Rule, head: Rule, group: Rule) -> Rule:
    """The grammar around the heads of a language that has C's comments and brackets."""
    strings = rx(_BRACE_STRINGS[language])
    blank = rx(r"[ \t\f]*" + _NL)
    line = seq(rx(r"[ \t]*"), rx(r"//[^\r\n]*", "line"), rx(_NL + r"|\Z"))
    block = seq(rx(r"[ \t]*"), rx(r"/\*[\s\S]*?(?:\*/|\Z)", "block"), rx(r"[ \t]*(?:" + _NL + r")?"))
    plain = rx(r"(?:(?!//|/\*)[^(){}\[\]\"'`])+")
    lenient = many(either(strings, seq(rx(r"(?=[(\[])"), group), plain))
    first = span("unit", seq(many(either(line, block, note, blank)), maybe(span("signature", lenient))))
    unit = span("unit", seq(_LINE_START, maybe(many(either(line, block, note), 1)), span("signature", head)))
    other = either(many(either(line, block, blank), 1), strings, rx(r"//[^\r\n]*"), rx(_NL), rx(r"[^\"'`/\r\n]+"), rx(r"[\s\S]"))
    return seq(first, many(either(unit, other)))


def _javascript(language: str = "javascript") -> Rule:
    group = balanced(rf"{_BRACE_STRINGS[language]}|//[^\r\n]*|/\*[\s\S]*?(?:\*/|\Z)")
    typed = language == "typescript"
    words = "export|default|async|static|get|set" + ("|public|private|protected|readonly|abstract|override|declare" if typed else "")
    modifiers = rx(rf"[ \t]*(?:(?:{words})[ \t]+)*")
    generics = maybe(rx(r"[ \t]*<[^(){};]*>")) if typed else rx("")
    result = maybe(rx(r"\s*:[^{};=\r\n]+(?:\{[^{}]*\}[^{};=\r\n]*)?(?=\{|=>)")) if typed else rx("")
    name = rx(r"#?[A-Za-z_$][\w$]*", "name")
    function = seq(rx(r"function\b\s*\*?\s*"), name, generics, rx(r"\s*"), group, result)
    method = seq(rx(r"\*?[ \t]*" + _NOT_HEADS), name, generics, rx(r"[ \t]*"), group, result, rx(r"\s*(?=\{)"))
    held = seq(rx(r"(?:const|let|var)\s+"), name, rx(r"\s*(?::[^=\r\n]+)?=\s*(?:async\b\s*)?"), either(seq(generics, group, result, rx(r"\s*=>")), rx(r"[A-Za-z_$][\w$]*\s*=>"), seq(rx(r"function\b\s*\*?\s*[\w$]*\s*"), group)))
    note = seq(rx(r"[ \t]*@[\w.]+"), maybe(group), rx(r"[^\r\n]*(?:" + _NL + r"|\Z)"))
    return _braces(language, note, seq(modifiers, either(function, held, method)), group)


def _go() -> Rule:
    group = balanced(rf"{_BRACE_STRINGS['go']}|//[^\r\n]*|/\*[\s\S]*?(?:\*/|\Z)")
    head = seq(rx(r"func[ \t]*"), maybe(seq(rx(r"(?=\()"), group, rx(r"[ \t]*"))), rx(r"[^\W\d]\w*", "name"), maybe(rx(r"\[[^\]\r\n]*\]")), rx(r"[ \t]*(?=\()"), group, maybe(seq(rx(r"[ \t]*(?=\()"), group)), rx(r"[^{\r\n]*"))
    return _braces("go", rx(r"(?!)"), head, group)


def _rust() -> Rule:
    group = balanced(rf"{_BRACE_STRINGS['rust']}|//[^\r\n]*|/\*[\s\S]*?(?:\*/|\Z)")
    head = seq(rx(r"[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+"), rx(r"[^\W\d]\w*", "name"), maybe(rx(r"\s*<[^(){};]*>")), rx(r"\s*(?=\()"), group, rx(r"[^{};]*"))
    note = seq(rx(r"[ \t]*#!?(?=\[)"), group, rx(r"[^\r\n]*(?:" + _NL + r"|\Z)"))
    return _braces("rust", note, head, group)


@lru_cache(maxsize=None)
def grammar(language: str) -> Rule:
    return {"python": _python, "go": _go, "rust": _rust, "typescript": lambda: _javascript("typescript")}.get(language, _javascript)()


def language_of(language: str | None, code: str) -> str:
    """The grammar for a row: by its language, or else by the look of the code."""
    known = (language or "").strip().lower()
    for start, name in (("py", "python"), ("ts", "typescript"), ("ty", "typescript"), ("js", "javascript"), ("ja", "javascript"), ("go", "go"), ("rs", "rust"), ("ru", "rust")):
        if known.startswith(start):
            return name
    for look, name in ((r"^\s*(?:async\s+)?def\s", "python"), (r"^\s*func\s", "go"), (r"^\s*(?:pub\b.*)?\bfn\s", "rust")):
        if re.search(look, code, re.M):
            return name
    return "typescript"


# What marks a directive for a tool, a licence line, and a note that text is still to come.
_DIRECTIVE = re.compile(
    r"^\W*(?:no(?:lint|qa|sec|inspection|cover)\b|pylint\b|pyright\b|mypy\b|flake8\b|ruff\b|isort\b|yapf\b|fmt\b|black\b|bandit\b|eslint\b|tslint\b|jshint\b|jslint\b|prettier\b|istanbul\b|c8 ignore|v8 ignore|@ts-|ts-ignore|ts-expect|biome-|"
    r"clippy\b|rustfmt\b|go:|golangci|lint:|type:|pragma\b|region\b|endregion\b|coding[:=]|-\*-|vim?:|!/|sourcery\b|sonar\b|NOSONAR|webpack|@flow|@preserve|cspell|spell-?checker|codespell)",
    re.I,
)
_LICENCE = re.compile(r"copyright|\(c\)\s*\d{4}|all rights reserved|spdx-|licen[cs]ed? (?:under|to|as)|apache license|mit license|permission is hereby|without warranty|gnu general", re.I)
_TODO = re.compile(r"^\W*(?:todo|fixme|xxx|tbd|tbc|hack|wip)\b", re.I)
_TO_COME = re.compile(
    r"\bto be (?:documented|written|done|added|completed|described|determined|filled)|\b(?:docs?|documentation|docstrings?|descriptions?|comments?|text)(?: is| are)? (?:follows?|to follow|(?:goes )?here|later|pending|missing|needed|to come|coming|tbd|todo)|"
    r"\b(?:write|add|insert|fill|provide|put|enter|need|needs)(?: in)? (?:me|docs?|documentation|docstrings?|descriptions?|summary|comments?|text|this)\b|\bdocument (?:me|this|it|later)|\b(?:missing|no|empty|placeholder|generic|auto-?generated) (?:docs?|documentation|docstrings?|descriptions?|comments?)|"
    r"\bundocumented\b|\bnot (?:yet )?documented|\blorem ipsum",
    re.I,
)
_PLACEHOLDERS = {"summary", "description", "function", "method", "class", "documentation", "docstring", "docs", "doc", "comment", "none", "null", "na", "n a", "a method", "a function", "the method", "the function", "this method", "this function", "short description", "long description", "one line summary", "brief description", "details", "see above", "see below", "same as above", "self explanatory", "helper", "helper function", "helper method", "internal", "private"}
_CODE = re.compile(
    r"^(?:.*[\w\])\"']\s*(?:=(?![=>])|[+\-*/|&%]=|:=|\|\|=)\s*\S|.*[{(\[]\s*$|\W*[})\]]\S*\s*$|.*[)\]}]\s*;\s*$|(?:default|else|try|finally):?\s*$|(?:break|continue|pass|return)\b\s*;?\s*$|case\b.*:\s*$|"
    r"(?:return|throw|raise|defer|yield|await|del|import|from)\s.*(?:[()\[\]{};=\"']|import\b)|(?:if|for|while|with|switch|match|elif|except|catch|func|fn|def|let|const|var|async|print|assert)\s.*[:;{)]\s*$|"
    r"\w+(?:\.\w+)+\(.*\)|\w+\((?:.+)\)\s*;?\s*$|.*=>\s*\S|\w+\.\w+\s*[+\-]?=.*|.*\)\s*(?:->\s*\w+\s*)?:\s*$)"
)
_TAG = re.compile(
    r"^\s*(?:[@\\](?:param|arg|argument|property|prop|tparam|typeparam)\s*(?:\{[^}]*\})?\s*\[?[\w.$]*\]?|[@\\](?:returns?|throws?|exception|raises?|yields?|type|see|since|deprecated|async|private|public|override)\b(?:\s*\{[^}]*\})?|"
    r":(?:param|parameter|arg|argument|key|keyword|type|raises?|raise|except|var|ivar|cvar)\s*[^:\n]*:|:(?:returns?|rtype|yields?)\s*:|(?:args|arguments|parameters|params|returns?|raises|yields|throws|attributes|examples?|notes?)\s*:|#+\s*(?:arguments|parameters|returns|errors|panics|examples?|safety)\s*$|"
    r"(?:parameters|returns|raises|yields|args)\s*$|[-=~^*_]{3,}\s*$)",
    re.I,
)
_CJK = "\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af"  # scripts without spaces: a character counts as a word
_WORD = re.compile(rf"[{_CJK}]|[^\W\d_{_CJK}]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(_CAMEL.sub(" ", text))]


def clean(lines: list[str]) -> str:
    """Documentation text without tool directives, licence lines, notes to write it, and disabled code."""
    kept = [x.rstrip() for x in lines if not _DIRECTIVE.match(x.strip()) and not _LICENCE.search(x)]
    full = [x.strip() for x in kept if x.strip()]
    if full and sum(bool(_CODE.match(x)) for x in full) * 2 > len(full):
        return ""
    kept = [x for x in kept if not _TODO.match(x)]
    return "\n".join(kept).strip()


def informative(text: str, name: str | None, min_words: int = 3) -> bool:
    """Whether enough words remain besides markup, tags of parameters and results, and the words of the name."""
    plain = re.sub(r"<[^<>\n]{1,60}>", " ", text)
    said = " ".join(_words(plain))
    if said in _PLACEHOLDERS or (len(said.split()) <= 8 and _TO_COME.search(plain)):
        return False
    rest, section = [], False
    for line in plain.split("\n"):
        m = _TAG.match(line)
        if m:
            section = bool(re.match(r"\s*(?:args|arguments|parameters|params|raises|attributes|throws)\b", line, re.I))
            line = line[m.end() :]
        elif section and (m := re.match(r"\s+\*{0,2}`?[\w.]+`?\s*(?:\([^)]*\))?\s*(?::|--? )", line)):
            line = line[m.end() :]
        elif m := re.match(r"\s*[*-]\s+`\w+`\s*[-:]", line):
            line = line[m.end() :]
        rest.append(line)
    own = set(_words((name or "").replace("_", " ")))
    return sum(w not in own for w in _words("\n".join(rest).replace("_", " "))) >= min_words


def _unquote(s: str) -> list[str]:
    body = re.sub(r"^[A-Za-z]{0,2}(\"\"\"|'''|\"|')", "", s)
    body = re.sub(r"(?:\"\"\"|'''|\"|')\s*$", "", body)
    return re.split(_NL, body)


def _uncomment(kind: str, s: str) -> list[str]:
    if kind == "line":
        return [re.sub(r"^(?:#+!?|/{2,}!?) ?", "", s)]
    body = re.sub(r"^/\*+!?", "", re.sub(r"\*+/\s*$", "", s))
    return [re.sub(r"^\s*\*(?!\*\S) ?", "", x) for x in re.split(_NL, body)]


_BLANK_LINE = re.compile(r"(?:\r\n|\r(?!\n)|\n)[ \t]*(?:\r\n|\r|\n)")


def _routine(code: str, values: list) -> dict:
    """Signature and documentation of one parsed unit. A documentation string counts before comments above the signature, which must touch it."""
    head = next((v for v in values if v[0] == "signature"), None)
    name = next((code[v[1] : v[2]] for v in values if v[0] == "name"), None)
    signature = code[head[1] : head[2]].strip() if head else None
    out = {"signature": signature, "name": name or name_of(signature), "head": head[1:] if head else None, "doc": "", "doc_start": -1, "doc_end": -1}
    string = next((v for v in values if v[0] == "string"), None)
    if string:
        text = clean(_unquote(code[string[1] : string[2]]))
        return out | {"doc": text, "doc_start": string[1], "doc_end": string[2]}
    above = [v for v in values if v[0] in ("line", "block") and (not head or v[1] < head[1])]
    stop = head[1] if head else len(code)
    run: list = []
    for v in reversed(above):  # the comments that touch the signature, or each other
        if _BLANK_LINE.search(code[v[2] : stop]):
            break
        run.insert(0, v)
        stop = v[1]
    if run:
        text = clean([x for v in run for x in _uncomment(v[0], code[v[1] : v[2]])])
        out |= {"doc": text, "doc_start": run[0][1], "doc_end": run[-1][2]}
    return out


def parse_all(code: str, language: str | None) -> list[dict]:
    """The routines of a text in order: ``signature, name, doc`` and ``doc_start, doc_end`` (-1: none). There is always a first one."""
    _, values = grammar(language_of(language, code))(State(code), 0)
    out, unit = [], []
    for v in values:
        if v[0] == "unit":
            out.append(_routine(code, unit))
            unit = []
        else:
            unit.append(v)
    return out


def parse(code: str, language: str | None) -> dict:
    """The first routine of a text."""
    return parse_all(code, language)[0]


def extent(code: str, language: str | None, head: tuple[int, int]) -> str:
    """The text of a routine from its head on: to the bracket that closes its body, or while the lines are indented deeper."""
    lang = language_of(language, code)
    if lang == "python":
        start = max(code.rfind("\n", 0, head[0]), code.rfind("\r", 0, head[0])) + 1
        depth = len(re.match(r"[ \t]*", code[start:]).group())
        end = re.compile(rf"(?:{_NL})(?=[ \t]{{0,{depth}}}[^\s#])").search(code, head[1])
        return code[head[0] : end.start() if end else len(code)].strip("\r\n")
    at = code.find("{", head[1])
    if at < 0 or code[head[1] : at].strip(" \t\r\n=>"):
        return code[head[0] :]
    strings = rf"{_BRACE_STRINGS[lang]}|//[^\r\n]*|/\*[\s\S]*?(?:\*/|\Z)"
    got = balanced(strings)(State(code), at)
    return code[head[0] : got[0] if got else len(code)].strip("\r\n")


def name_of(signature: str | None) -> str | None:
    """The routine's own name, read from its signature."""
    m = re.search(r"([A-Za-z_$][\w$]*)\s*(?:<(?:[^<>]|<[^<>]*>)*>)?\s*\(", re.sub(r"^\s*func\s*\([^)]*\)", "", signature or ""))
    return m.group(1) if m else None


_COLUMNS = ["id", "position", "language", "name", "signature", "code", "description", "doc_start", "doc_end"]
_PAIR = "id string, position int, language string, name string, signature string, code string, description string, doc_start int, doc_end int"


def _pair_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, lang, name, sig, code, doc in zip(b["id"], b["language"], b["name"], b["signature"], b["code"], b["docstring"]):
            code = code or ""
            first, *others = parse_all(code, lang)
            said = clean(re.split(_NL, doc)) if doc and doc.strip() else first["doc"]
            own = (name or name_of(sig) or first["name"] or "").rsplit(".", 1)[-1]
            if said and informative(said, own):
                rows.append((i, 0, lang, name, sig or first["signature"], code, said, first["doc_start"], first["doc_end"]))
            for k, r in enumerate(others, 1):
                if r["doc"] and informative(r["doc"], r["name"]):
                    rows.append((i, k, lang, r["name"], r["signature"], extent(code, lang, r["head"]), r["doc"], r["doc_start"], r["doc_end"]))
        yield pd.DataFrame(rows, columns=_COLUMNS)


def doc_pairs(elements: DataFrame) -> DataFrame:
    """Routines with real documentation, a row each: the code, its description, and where in the row's code that stood.

    Reads ``id, type, language, name, signature, code, docstring``. Position 0 is the row's own
    routine; further ones are those written inside or after it in the same text. Every row is
    parsed; the documentation of the row's own routine is ``docstring`` if it is not null or
    blank, else what the grammar finds (offsets are always those of the documentation in ``code``,
    -1 where it has none). Null code counts as empty; null ids are kept; a routine without real
    documentation gives no row. The work is per row, so nothing is shuffled and no key can be hot.
    """
    rows = elements.where(F.col("type").isin("function", "method")).select("id", "language", "name", "signature", "code", "docstring")
    return spread(rows).mapInPandas(_pair_batches, _PAIR)
