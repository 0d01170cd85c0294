"""All queries of the matrix engine with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from .plans import embedding, harmonize, ingest, layouts, preprocessing, scalars, selection, storing, versioning, viewer

MODULES: tuple = (layouts, selection, ingest, harmonize, preprocessing, embedding, viewer, versioning, storing, scalars)


def queries() -> dict[str, Callable]:
    found: dict[str, Callable] = {}
    for module in MODULES:
        found.update(module.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found.update(module.ORACLE)
    return found
