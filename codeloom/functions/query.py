"""Query understanding as column expressions: intent, expansion, ambiguity, confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that speak for an intent, each counting once.
INTENTS = {
    "explain": [r"how (does|do|is|are|can|should)", r"what (is|are|does|do)", r"explain", r"tell me about", r"show me", r"understand", r"meaning of"],
    "implement": [r"add\b", r"create\b", r"implement\b", r"build\b", r"write\b", r"generate\b", r"new (feature|function|method|class)", r"support\b"],
    "debug": [r"fix\b", r"bug\b", r"error\b", r"issue\b", r"broken\b", r"not working", r"fails?\b", r"crash", r"exception", r"debug\b"],
    "refactor": [r"refactor\b", r"clean\b", r"restructure", r"simplify", r"improve\b", r"better\b", r"optimize\b", r"rename\b", r"extract\b", r"move\b"],
    "review": [r"review\b", r"check\b", r"analyze\b", r"audit\b", r"quality", r"security", r"vulnerability", r"smell"],
    "search": [r"find\b", r"search\b", r"locate\b", r"where (is|are)", r"look for", r"get\b", r"show\b"],
    "explore": [r"explore\b", r"discover", r"learn about", r"overview", r"architecture", r"structure", r"patterns?\b"],
}
# Terms with several readings, and these readings.
READINGS = {
    "auth": ["Authentication (login/signup)", "Authorization (permissions/RBAC)", "API authentication (keys/tokens)"],
    "handler": ["HTTP request handler", "Exception handler", "Event handler"],
    "model": ["Data model/ORM", "MVC Model", "AI/ML model"],
    "service": ["Business logic service", "Microservice", "External API service"],
    "controller": ["MVC Controller", "Game controller", "Hardware controller"],
    "client": ["API client", "Frontend/client-side", "Customer/client entity"],
    "worker": ["Background job worker", "Web worker", "Service worker"],
    "queue": ["Message queue", "Task queue", "Job queue"],
    "config": ["Configuration files", "App settings", "Environment config"],
    "manager": ["Resource manager", "State manager", "Connection manager"],
}
AMBIGUOUS = list(READINGS)
# Vague words, and what is vague about them.
VAGUE = [("it|this|that|these|those", "unclear reference"), ("all|every|each", "overly broad scope"), ("some|few|many", "imprecise quantity")]
# Words that say a query is about technology.
TECHNICAL = ["function", "class", "method", "api", "database", "query", "async"]
# Terms and their synonyms.
SYNONYMS = {
    "auth": ["authentication", "authorization", "login", "logout", "session", "credential", "password", "oauth", "jwt", "identity"],
    "login": ["authentication", "signin", "auth", "session", "credential"],
    "logout": ["signout", "session", "invalidate", "clear"],
    "dto": ["data transfer object", "model", "schema", "payload", "request", "response"],
    "orm": ["object relational mapping", "database", "sql", "model", "entity"],
    "db": ["database", "storage", "persistence", "sql", "query"],
    "cache": ["memoization", "redis", "memcached", "storage", "buffer", "ttl"],
    "api": ["endpoint", "route", "controller", "handler", "rest", "graphql"],
    "endpoint": ["api", "route", "url", "path", "handler"],
    "middleware": ["interceptor", "filter", "pipeline", "handler"],
    "test": ["unittest", "pytest", "mock", "fixture", "coverage", "assert"],
    "mock": ["stub", "fake", "test double", "unittest.mock", "monkeypatch"],
    "perf": ["performance", "optimization", "speed", "latency", "throughput", "efficiency", "fast", "slow", "bottleneck"],
    "optimize": ["performance", "improve", "efficient", "fast", "speed up"],
    "memory": ["ram", "heap", "leak", "usage", "consumption"],
    "error": ["exception", "raise", "catch", "handle", "error handling", "fail"],
    "exception": ["error", "raise", "catch", "try", "except", "finally"],
    "debug": ["debugger", "breakpoint", "trace", "logging", "print", "inspect"],
    "service": ["business logic", "use case", "interactor", "domain"],
    "repo": ["repository", "data access", "dao", "persistence", "store"],
    "controller": ["handler", "endpoint", "view", "api", "route"],
    "model": ["entity", "domain", "data class", "schema", "orm"],
    "singleton": ["single instance", "global", "shared", "one instance"],
    "factory": ["creator", "builder", "constructor", "instantiate"],
    "observer": ["pub sub", "event", "listener", "callback", "subscribe"],
    "decorator": ["wrapper", "aspect", "annotation", "attribute"],
}
# Words that are no search terms.
STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall can need dare ought used to of in for on with at by from as into through during "
    "before after above below between under and but or yet so if because although though while where when that which who whom whose what this these those i you he she it we they"
).split()


def total(parts: list[Column]) -> Column:
    return reduce(Column.__add__, parts)


def intent_scores(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    return {k: total([F.when(low.rlike(p), 1).otherwise(0) for p in ps]) for k, ps in INTENTS.items()}


def intent(scores: dict[str, Column]) -> tuple[Column, Column]:
    """The intent with the highest score and its confidence: unknown if nothing speaks for one (0.3) or several tie (0.4)."""
    best = F.greatest(*scores.values())
    ties = total([F.when(s == best, 1).otherwise(0) for s in scores.values()])
    name = F.coalesce(*[F.when(s == best, k) for k, s in scores.items()])
    sure = (best > 0) & (ties == 1)
    return (
        F.when(sure, name).otherwise("unknown"),
        F.when(sure, F.least(F.lit(0.9), 0.5 + 0.1 * best)).when(best > 0, 0.4).otherwise(0.3),
    )


def n_words(text: Column) -> Column:
    """Words split at white space; 0 for an empty text."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def dynamic_threshold(text: Column, base: float = 0.2) -> Column:
    """Similarity threshold for a query: higher for short or technical ones and for code names, within 0.1 and 0.5."""
    n = n_words(text)
    low = F.lower(text)
    step = (
        F.when(n <= 2, 0.15).when(n >= 6, -0.05).otherwise(0.0)
        + F.when(low.rlike(r"\b(" + "|".join(TECHNICAL) + r")\b"), 0.05).otherwise(0.0)
        + F.when(text.contains("_") | text.rlike("[a-z][A-Z]"), 0.1).otherwise(0.0)
    )
    return F.round(F.greatest(F.lit(0.1), F.least(F.lit(0.5), F.lit(base) + step)), 6)


def _holds(text: Column, word: str) -> Column:
    """Whether a text holds a word (or one of 'a|b') as a whole, in any script."""
    return text.rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{word})(?![\p{{L}}\p{{N}}_])")


def ambiguous_terms(text: Column) -> Column:
    """Terms of several meanings that a text holds as whole words, in their listed order, then the kinds of vague language in it."""
    low = F.lower(text)
    found = [F.when(_holds(low, t), F.lit(t)) for t in AMBIGUOUS] + [F.when(_holds(low, w), F.lit(f"vague language ({hint})")) for w, hint in VAGUE]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def clarifications(text: Column, most: int = 6) -> Column:
    """The first readings of the ambiguous terms of a text, to ask back with."""
    low = F.lower(text)
    empty = F.array().cast("array<string>")
    return F.slice(F.flatten(F.array(*[F.when(_holds(low, t), F.array(*map(F.lit, r))).otherwise(empty) for t, r in READINGS.items()])), 1, most)


def terms(text: Column) -> Column:
    """Distinct lower-case words of three letters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z_]+)"), 1), lambda x: F.length(x) > 2))


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1))


def expanded(own: Column) -> Column:
    """Words (a column computed before, as it is used often) with the synonyms of each, sorted, without stop words and those of one or two letters.

    A term and its synonyms join wherever the term lies in a word or a word in the term; a synonym brings the first
    term it belongs to, and that term's other synonyms.
    """

    def near(k: str) -> Column:
        return F.exists(own, lambda w: F.contains(w, F.lit(k)) | F.contains(F.lit(k), w))

    lists = [F.when(near(k), F.array(F.lit(k), *map(F.lit, v))) for k, v in SYNONYMS.items()]
    back: dict[str, list[str]] = {}
    for k, v in SYNONYMS.items():
        for x in v:
            if x not in SYNONYMS and x not in back:
                back[x] = [k, *(y for y in v if y != x)]
    pairs = F.create_map(*[c for x, v in back.items() for c in (F.lit(x), F.array(*map(F.lit, v)))])
    empty = F.array().cast("array<string>")
    roots = F.flatten(F.transform(F.filter(own, lambda w: w.isin(list(back))), lambda w: F.coalesce(F.element_at(pairs, w), empty)))
    every = F.array_distinct(F.flatten(F.array(own, roots, *[F.coalesce(x, empty) for x in lists])))
    return F.array_sort(F.filter(every, lambda x: (F.length(x) > 2) & ~x.isin(STOPWORDS)))


def query_confidence(text: Column, intent_confidence: Column, n_terms: Column, is_ambiguous: Column) -> Column:
    n = n_words(text)
    return F.round(
        F.greatest(
            F.lit(0.0),
            F.least(
                F.lit(1.0),
                intent_confidence
                + F.when(n >= 5, 0.1).when(n <= 2, -0.15).otherwise(0.0)
                + F.when(n_terms >= 5, 0.1).when(n_terms <= 2, -0.1).otherwise(0.0)
                + F.when(is_ambiguous, -0.25).otherwise(0.0),
            ),
        ),
        6,
    )
