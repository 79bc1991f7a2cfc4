"""Credentials embedded in source code.

Code is tokenized lexically (strings with their delimiters, comments, identifiers,
operators); a literal that is assigned or passed to a credential-named identifier is a
secret unless it is a placeholder or a reference. Well-known key formats, key blocks,
passwords in URLs and in command lines are found wherever they stand. Only the literal
contents are masked: delimiters, escapes and line ends stay, so the code still parses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import spread

# Last words of names that hold a credential, and words that make a key one.
CREDENTIAL_WORDS = {"password", "passwd", "passphrase", "passcode", "pass", "pwd", "pw", "secret", "secrets", "token", "credential", "credentials", "apikey", "pem", "authorization", "jwt", "bearer"}
KEY_KINDS = {"api", "access", "secret", "service", "encryption", "deploy", "private", "signing", "auth", "master", "account", "client", "storage", "app", "crypto", "ssh", "license", "webhook", "session", "admin"}
TRAILING = {"value", "default", "str", "string", "raw", "plain", "prod", "dev", "staging", "test", "local", "old", "new", "current", "copy", "backup"}
LOGIN_CALLS = {"login", "log_in", "signin", "sign_in", "authenticate", "connect", "auth", "logon"}
# First words of calls that look a credential up or make one, from a name or other input.
LOOKUPS = {"get", "read", "fetch", "load", "find", "lookup", "look", "resolve", "retrieve", "query", "list", "has", "is", "delete", "remove", "revoke", "create", "make", "generate", "issue", "parse", "expect", "next"}
# Calls that return the literal in another type or encoding, and the types whose new, from and of do so.
CONVERSIONS = {"byte", "bytes", "bytearray", "str", "string", "some", "ok", "strdup", "encode", "b64decode", "atob", "fromhex", "unhexlify"}
MAKERS = {"new", "from", "from_str", "fromstring", "of", "ofnullable", "valueof", "wrap"}
HOLDERS = {"string", "cstring", "str", "bytes", "bytestring", "buffer", "box", "rc", "arc", "cow", "vec", "zeroizing", "secretstring", "secretvec", "secretbox", "optional", "option", "array", "uint8array"}
# Formats of keys that are known by their look.
FORMATS = [
    ("aws", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("github", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{30,}(?![A-Za-z0-9])"),
    ("github", r"(?<![A-Za-z0-9])github_pat_[A-Za-z0-9_]{22,}"),
    ("gitlab", r"(?<![A-Za-z0-9])glpat-[A-Za-z0-9_-]{18,}"),
    ("slack", r"(?<![A-Za-z0-9])xox[abeoprs]-[A-Za-z0-9-]{20,}"),
    ("stripe", r"(?<![A-Za-z0-9])[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    ("google", r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"),
    ("npm", r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    ("sendgrid", r"(?<![A-Za-z0-9])SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    ("jwt", r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
_KNOWN = re.compile("|".join(f"(?P<f{i}>{p})" for i, (_, p) in enumerate(FORMATS)))
_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BLOCK_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://([^\s:/@\"'`<>{}$]*):([^\s@\"'`/]+)@")
_CURL = re.compile(r"(?:(?<=\s)|^)(?:-u|--user|--proxy-user)[ =]+([^\s:\"'`]+):([^\s\"'`]+)")
_HEADER = re.compile(r"\b(?:Bearer|Basic)\s+([A-Za-z0-9+/_.=~-]{12,})")
_SCHEME = re.compile(r"^(?:bearer|basic|token|digest)\s+", re.I)
_PLACEHOLDER = re.compile(
    r"x{4,}|\*{3,}|\.{3}|change[-_]?me|placeholder|example|redacted|replace[-_]?me|(?<![a-z0-9])(?:dummy|replace|todo|fixme|insert)(?![a-z0-9])|your[-_ ]|my[-_]?(?:secret|password|token|key)\b|<[^>]*>|\$\{|\{\{|\}\}|%\(|#\{|^\{.*\}$|^\$|^%[A-Za-z_]+%$|vault:|secret://|ssm:|arn:|"
    r"\benv\b|getenv|environ|process\.|^null$|^none$|^true$|^false$|^undefined$",
    re.I,
)
_TALK = re.compile(r"pass|token|secret|key|auth|credential|login|user|test|default|sample|value", re.I)
_TOKEN_HASH = r"(?P<comment>\#[^\n]*)"
_TOKEN_SLASH = r"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))"
_STRING = r"""(?P<string>[A-Za-z]{0,2}(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|"(?:\\[\s\S]|[^"\\\n])*(?:"|(?=\n)|\Z)|%s|`(?:\\[\s\S]|[^`\\])*(?:`|\Z)))"""
_SINGLE, _CHAR = r"'(?:\\[\s\S]|[^'\\\n])*(?:'|(?=\n)|\Z)", r"'(?:\\.[^']{0,8}|[^'\\\n])'"
_REST = r"|(?P<name>[A-Za-z_$][\w$]*)|(?P<op>\|\|=|\?\?=|:=|=>|==|!=|<=|>=|\|\||\?\?|[^\s\w])"
_LEX = {
    "hash": re.compile(f"{_TOKEN_HASH}|{_STRING % _SINGLE}{_REST}"),
    "slash": re.compile(f"{_TOKEN_SLASH}|{_STRING % _SINGLE}{_REST}"),
    "rust": re.compile(f"{_TOKEN_SLASH}|{_STRING % _CHAR}{_REST}"),
    "none": re.compile(f"{_STRING % _SINGLE}{_REST}"),
}
_ASSIGN = {"=", ":", ":=", "=>", "||=", "??=", "||", "??"}
_OPENING = re.compile(r"^[A-Za-z]{0,2}(\"\"\"|'''|[\"'`])")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_PAIR = re.compile(r"(?i)(?<![\w./+-])((?:[A-Za-z][\w.-]*?)?(?:pass\w*|pwd|pw|secrets?|token|keys?|credentials?|auth\w*|pem|jwt))[\"']?\s*(?:=|:(?!//))\s*[\"'`]?([^\s\"'`,;)}\]]+)")
_LINE = re.compile(r"^[ \t]*(?:export[ \t]+|-[ \t]+)?[\"']?([A-Za-z_][\w.-]*)[\"']?[ \t]*[=:][ \t]*(?:\"((?:\\.|[^\"\\\n])*)\"?|'([^'\n]*)'?|([^\s#;,][^\n]*?))[ \t]*,?[ \t]*(?:[ \t][#;][^\n]*)?$", re.M)
_TAIL = r"(?:[_-]?(?:value|default|str|string|raw|plain|prod|dev|staging|test|local|old|new|current|copy|backup|[0-9]+))*[\"'`\]]*\s*(?:[:=,(|?]|\w+\s*=)"
#: What a text must hold for each rule to look at it; linear-time patterns, run over whole columns.
TRIGGERS = {
    "named": r"(?i)(?:passw(?:or)?d|passphrase|passcode|pass|pwd|pw|secrets?|token|credentials?|authorization|auth|pem|jwt|bearer|(?:"
    + "|".join(sorted(KEY_KINDS))
    + r")[_.-]?keys?)s?"
    + _TAIL
    + r"|(?:log_?in|logon|sign_?in|authenticate|connect)\s*\(",
    "known": r"(?:AKIA|ASIA)[A-Z0-9]{4}|gh[pousr]_[A-Za-z0-9]{4}|github_pat_|glpat-|xox[abeoprs]-|[sr]k_(?:live|test)_|AIza[A-Za-z0-9_-]{4}|npm_[A-Za-z0-9]{8}|SG\.[A-Za-z0-9]|eyJ[A-Za-z0-9_-]{4}",
    "block": r"PRIVATE KEY(?: BLOCK)?-----",
    "url": r"://[^\s/@\"'`]*:[^\s/@\"'`]+@",
    "curl": r"(?:-u|user)[ =]+[^\s:]+:",
    "header": r"(?:Bearer|Basic)\s+[A-Za-z0-9+/_.=~-]{12}",
}
ALL = frozenset(TRIGGERS)


def credential_name(name: str) -> bool:
    """Whether the last words of a name (snake, kebab, dotted or camel case) say that it holds a credential."""
    words = [w.lower() for w in _WORDS.findall(name)]
    while len(words) > 1 and (words[-1] in TRAILING or words[-1].isdigit()):
        words.pop()
    if not words:
        return False
    last = words[-1]
    if last in CREDENTIAL_WORDS or last.endswith(("password", "passwd", "apikey")):
        return True
    if last in ("key", "keys") and len(words) > 1:
        return words[-2] in KEY_KINDS
    return last == "auth" and len(words) == 1


def secret_value(v: str, named: bool = False) -> bool:
    """Whether a literal can be a live secret: not a placeholder, reference, sentence, path or URL, and no plain word.

    A value ``named`` by its target needs less: digits alone will do, and so will a long run of letters
    of one case that holds no word for credentials.
    """
    v = _SCHEME.sub("", v.strip())
    if len(v) < 6 or re.search(r"\s", v) or "://" in v or "-----" in v or _path(v) or len(set(v)) < 4 or _PLACEHOLDER.search(v):
        return False
    digit, letter = re.search(r"\d", v), re.search(r"[A-Za-z]", v)
    if digit and letter:
        return True
    if letter and re.search(r"[a-z]", v) and re.search(r"[A-Z]", v) and (len(v) >= 16 or re.search(r"[^\w]", v)):
        return True
    return named and (v.isdigit() or (len(v) >= 16 and v.isascii() and v.isalpha() and (v.islower() or v.isupper()) and not _TALK.search(v)))


def _path(v: str) -> bool:
    """A path in a file system; key material may begin with a slash too, but has parts that no name has."""
    if not re.match(r"\.{0,2}/", v):
        return False
    return not v.endswith("=") and not any(len(x) >= 12 and all(re.search(k, x) for k in ("[a-z]", "[A-Z]", "[0-9]")) for x in v.split("/"))


def _url_password(p: str) -> bool:
    return len(p) >= 4 and not _PLACEHOLDER.search(p) and p[0] not in "$<{%" and p.lower() not in ("password", "passwd", "pass", "pwd", "secret", "token")


def style(language: str | None, file: str | None) -> str:
    """Comment style of a file, from its language or else its name."""
    known = (language or "").strip().lower()
    tail = (file or "").lower().rsplit(".", 1)[-1]
    if known.startswith(("py", "ini", "toml", "yaml", "yml", "dotenv", "env", "sh", "ruby", "rb", "cfg")):
        return "hash"
    if known.startswith("json") or tail == "json":
        return "none"
    if known in ("ru", "rs") or known.startswith("rust") or tail == "rs":
        return "rust"
    if known.startswith(("ja", "ty", "go", "js", "ts")) or tail in ("js", "ts", "go", "jsx", "tsx", "java"):
        return "slash"
    return "hash"


Span = tuple[int, int, str]


def _inside(text: str, at: int, rules: frozenset[str] = ALL) -> Iterator[Span]:
    """Secrets known by their look, at any place of a text."""
    for m in _KNOWN.finditer(text) if "known" in rules else ():
        if secret_value(m.group()):
            yield at + m.start(), at + m.end(), FORMATS[int(m.lastgroup[1:])][0]
    for m in _BLOCK.finditer(text) if "block" in rules else ():
        end = _BLOCK_END.search(text, m.end())
        stop = end.start() if end else len(text)
        if re.search(r"[A-Za-z0-9+/]{16}", text[m.end() : stop]) and not re.search(r"x{8}|\.\.\.|\*{4}", text[m.end() : stop][:80]):
            yield at + m.start(), at + (end.end() if end else stop), "key block"
    for m in _URL.finditer(text) if "url" in rules else ():
        if _url_password(m.group(2)):
            yield at + m.start(2), at + m.end(2), "url password"
    for m in _CURL.finditer(text) if "curl" in rules else ():
        if _url_password(m.group(2)):
            yield at + m.start(2), at + m.end(2), "command line"
    for m in _HEADER.finditer(text) if "header" in rules else ():
        if secret_value(m.group(1)):
            yield at + m.start(1), at + m.end(1), "header"


def _pairs(text: str, at: int) -> Iterator[Span]:
    """name=value or name: value in running text."""
    for m in _PAIR.finditer(text):
        if credential_name(m.group(1)) and secret_value(m.group(2).rstrip(".,")):
            yield at + m.start(2), at + m.end(2), "assigned"


def _content(text: str, start: int, end: int) -> tuple[int, int]:
    """Content of a string token without its prefix and delimiters."""
    m = _OPENING.match(text[start:end])
    d = m.group(1)
    a = start + m.end()
    b = end - len(d) if end - len(d) >= a and text.startswith(d, end - len(d)) else end
    return a, b


def _literals(code: str, lexer: re.Pattern, at: int) -> Iterator[Span]:
    """Literals assigned or passed to credential-named identifiers."""
    toks = [(m.lastgroup, m.start(), m.end()) for m in lexer.finditer(code)]
    text = [code[s:e] for _, s, e in toks]
    opener = _openers(text)
    i, n = 0, len(toks)
    while i < n:
        kind, s, e = toks[i]
        if kind == "comment":
            body = re.match(r"^(?:#+|//+!?|/\*+)", text[i]).end()
            inner = code[s + body : e]
            yield from _literals(inner, _LEX["none"], at + s + body)
            yield from _pairs(inner, at + s + body)
            i += 1
            continue
        if kind != "string":
            i += 1
            continue
        a, b = _content(code, s, e)
        pieces, j = [(a, b)], i + 1
        callee = text[i - 2] + text[i - 1] if i > 1 else ""
        joined = callee == "!(" and i > 2 and text[i - 3] == "concat"
        while j < n:  # a literal in several pieces: "a" + "b", "a" "b", concat!("a", "b")
            k = j + 1 if text[j] == "+" or (joined and text[j] == ",") else j
            if k < n and toks[k][0] == "string" and (k > j or "\n" in code[toks[j - 1][2] : toks[k][1]] or code[s] == code[toks[k][1]]):
                pieces.append(_content(code, toks[k][1], toks[k][2]))
                j = k + 1
            else:
                break
        value = "".join(code[x:y] for x, y in pieces)
        spans = [(at + x, at + y) for x, y in pieces]
        if secret_value(value, True) and _named(code, toks, text, i, j, opener):
            yield spans[0][0], spans[0][1], "assigned"
            yield from ((x, y, "continued") for x, y in spans[1:])
        else:
            if len(pieces) > 1 and any(True for _ in _inside(value, 0)):
                yield spans[0][0], spans[0][1], "pieces"
                yield from ((x, y, "continued") for x, y in spans[1:])
            if len(value) > 8:
                for x, y in pieces:
                    yield from _pairs(code[x:y], at + x)
        i = j
    return


def _openers(text: list[str]) -> list[int]:
    """For every token the bracket around it, -1 for none."""
    out, stack = [], [-1]
    for k, t in enumerate(text):
        if t in (")", "]", "}") and len(stack) > 1:
            stack.pop()
        out.append(stack[-1])
        if t in ("(", "[", "{"):
            stack.append(k)
    return out


def _dotted(toks: list, text: list[str], k: int) -> tuple[list[str], int]:
    """Names of the path (a.b, a::b, a().b) that ends at token k, last first, and the token before it."""
    names = [text[k]]
    k -= 1
    while k > 0:
        at = k - 1 if text[k] == "." else k - 2 if text[k] == ":" and text[k - 1] == ":" else -1
        if at > 0 and text[at] == ")" and text[at - 1] == "(":
            at -= 2
        if at < 0 or toks[at][0] != "name":
            break
        names.append(text[at])
        k = at - 1
    return names, k - 1 if k >= 0 and text[k] == "new" else k


def _setter(names: list[str]) -> bool:
    """Whether a call takes a credential: named like one in any case, or made by a type of such a name; no look-up."""
    name = names[0]
    if name.lower() in MAKERS and len(names) > 1:
        return credential_name(names[1]) and names[1][0].isupper()
    if not credential_name(name) or name.lower() in LOGIN_CALLS:
        return False
    return name[0].isupper() or _WORDS.findall(name)[0].lower() not in LOOKUPS


def _listed(name: str) -> bool:
    """Whether a list of this name holds credentials: also plurals, of 'token' only with a word of its kind."""
    if credential_name(name):
        return True
    words = [w.lower() for w in _WORDS.findall(name)]
    return name[-1:] in ("s", "S") and credential_name(name[:-1]) and (words[-1] != "tokens" or any(w in KEY_KINDS for w in words[:-1]))


def _assigned(code: str, toks: list, text: list[str], k: int, holds=credential_name) -> bool:
    """Whether the operator k assigns to something named like a credential."""
    line, k = k, k - 1
    while k >= 0 and text[k] not in (",", "(", "{", ";") and "\n" not in code[toks[k][2] : toks[line][1]]:
        if toks[k][0] == "name" and holds(text[k]):
            return True
        if toks[k][0] == "string":
            a, b = _content(code, toks[k][1], toks[k][2])
            if holds(code[a:b]) and not re.search(r"\s", code[a:b]):
                return True
        line, k = k, k - 1
    return False


def _list_start(toks: list, text: list[str], k: int) -> int:
    """The token before a list that the bracket k opens ([..., vec![..., []string{..., (... after an assignment); -1 if it opens none."""
    if k > 1 and text[k] == "[" and text[k - 1] == "!" and text[k - 2] == "vec":
        return k - 3
    if k > 2 and text[k] == "{" and toks[k - 1][0] == "name" and text[k - 2] == "]":
        at = k - 3
        while at >= 0 and text[at] != "[":
            at = at - 1 if toks[at][0] != "string" and text[at] not in ("(", ")", "{", "}", ";") else -1
        return at - 1 if at > 0 else -1
    while k > 0 and text[k] in ("[", "{", "(", "&"):
        k -= 1
    return k if text[k] in _ASSIGN else -1


def _named(code: str, toks: list, text: list[str], i: int, after: int, opener: list[int]) -> bool:
    """Whether the string token i (its last piece before token ``after``) is given to something named like a credential."""
    k, nested, holds = i - 1, i, credential_name
    while k >= 0 and text[k] == "(":
        if k > 1 and text[k - 1] == "!" and text[k - 2] == "concat":
            k, nested = k - 3, k - 2
        elif k and text[k - 1] in _ASSIGN:
            if after < len(toks) and text[after] == ",":
                holds = _listed
            k -= 1
        elif k and toks[k - 1][0] == "name":
            names, before = _dotted(toks, text, k - 1)
            if _setter(names):
                pair = after + 1 < len(toks) and text[after] == "," and toks[after + 1][0] == "string"  # a name and its value
                return names[0][0].isupper() or not pair
            first = names[0].lower()
            if not (first in CONVERSIONS or (first in MAKERS and len(names) > 1 and names[1].lower() in HOLDERS)):
                return False
            k, nested = before, k - 1
            if k > 0 and text[k] == "]" and text[k - 1] == "[":  # []byte(
                k -= 2
        else:
            break
    while k >= 0 and text[k] in ("&", "*"):
        k -= 1
    if k < 0:
        return False
    if text[k] == "," and k > 0 and toks[k - 1][0] == "string":
        a, b = _content(code, toks[k - 1][1], toks[k - 1][2])
        if credential_name(code[a:b]) and not re.search(r"\s", code[a:b]):
            return True
    if text[k] in (",", "[", "{", "("):
        around = opener[nested] if text[k] == "," else k
        if text[k] == "," and around > 0 and text[around] == "(" and toks[around - 1][0] == "name":  # a later argument
            names, _ = _dotted(toks, text, around - 1)
            return names[0].lower() in LOGIN_CALLS or _setter(names)
        if around >= 0 and (after >= len(toks) or text[after] not in (":", "=>", "=")):
            start = _list_start(toks, text, around)
            return start >= 0 and text[start] in _ASSIGN and _assigned(code, toks, text, start, _listed)
        return False
    return text[k] in _ASSIGN and _assigned(code, toks, text, k, holds)


def find(code: str, language: str | None = None, file: str | None = None, kind: str | None = None, rules: frozenset[str] = ALL) -> list[Span]:
    """Spans (start, end, kind) of the secrets of one text, in order, without overlaps."""
    how = style(language, file)
    spans = list(_inside(code, 0, rules))
    if "named" in rules or "known" in rules or "url" in rules:
        spans += _literals(code, _LEX[how], 0)
    if "named" in rules and (kind == "file" or how == "none"):
        for m in _LINE.finditer(code):
            g = next(x for x in (2, 3, 4) if m.group(x) is not None) if m.lastindex and m.lastindex > 1 else 0
            if g and credential_name(m.group(1)) and secret_value(m.group(g), True):
                lead = _SCHEME.match(m.group(g))
                spans.append((m.start(g) + (lead.end() if lead else 0), m.end(g), "assigned"))
    out: list[Span] = []
    for s in sorted(set(spans), key=lambda x: (x[0], -x[1])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def mask(code: str, spans: list[Span]) -> str:
    """The code with the contents of the spans replaced by '*'; escapes, line ends and block markers stay."""
    out, last = [], 0
    for s, e, kind in spans:
        out.append(code[last:s])
        body = code[s:e]
        if kind == "key block":
            begin, end = _BLOCK.match(body), _BLOCK_END.search(body)
            stop = end.start() if end else len(body)
            out.append(begin.group() + re.sub(r"(\\[nrt]|\\?[\r\n\t ]+)|.", lambda m: m.group(1) or "*", body[begin.end() : stop]) + body[stop:])
        else:
            out.append(re.sub(r"(\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)|[\r\n])|.", lambda m: m.group(1) or "*", body))
        last = e
    return "".join(out) + code[last:]


_FOUND = "id string, line_no int, kind string, start int, length int"


def _spans(b: pa.RecordBatch) -> dict[int, list[Span]]:
    """Spans by row number; only rows that hold a trigger are tokenized."""
    code = b.column("code")
    on = {rule: pc.fill_null(pc.match_substring_regex(code, rx), False).to_numpy(zero_copy_only=False) for rule, rx in TRIGGERS.items()}
    some = np.flatnonzero(np.logical_or.reduce(list(on.values())))
    rows = b.take(pa.array(some)).select(["code", "language", "file", "type"]).to_pydict()
    each = zip(some.tolist(), rows["code"], rows["language"], rows["file"], rows["type"])
    return {i: found for i, *row in each if (found := find(*row, frozenset(r for r in on if on[r][i])))}


def _find_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: tuple[list, ...] = ([], [], [], [], [])
        for i, spans in _spans(b).items():
            code, key = b.column("code")[i].as_py(), b.column("id")[i].as_py()
            for s, e, k in spans:
                for c, v in zip(cols, (key, code.count("\n", 0, s) + 1, k, s, e - s)):
                    c.append(v)
        types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "line_no", "kind", "start", "length"])


def _mask_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = _spans(b)
        code = b.column("code").to_pylist()
        for i, spans in found.items():
            code[i] = mask(code[i], spans)
        n = [sum(x[2] != "continued" for x in found.get(i, ())) for i in range(len(code))]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int32()), pa.array(code, pa.string())], ["id", "n_secrets", "code"])


def _columns(elements: DataFrame) -> DataFrame:
    return spread(elements.select(*[F.col(c).cast("string").alias(c) for c in ("id", "code", "language", "file", "type")]))


def find_secrets(elements: DataFrame) -> DataFrame:
    """``id, line_no, kind, start, length`` for every secret in ``code`` (needs ``id, code, language, file, type``).

    ``line_no`` counts from 1 and is split at line feeds; ``start`` and ``length`` are in
    code points. Null and empty code gives no row; repeated rows give repeated rows; a
    secret in pieces has kind ``continued`` for all but the first. Nothing is shuffled.
    """
    return _columns(elements).mapInArrow(_find_batches, "id string, line_no int, kind string, start int, length int")


def redact(elements: DataFrame) -> DataFrame:
    """``id, n_secrets, code``: every row, its secrets masked and all else unchanged; null code stays null."""
    return _columns(elements).mapInArrow(_mask_batches, "id string, n_secrets int, code string")
