"""All queries of the library proper; those of ``codeloom.llm`` are added by the entry module."""

from __future__ import annotations

from codeloom.plans import extraction, graph, indexing, memory, problems, review, search

MODULES = [problems, graph, memory, search, review, indexing, extraction]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
