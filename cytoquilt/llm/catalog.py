"""Queries of the training-data operators with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from . import bpe, decontaminate, interpolation, itq, labeller, lines, neardup, passages, toxicity, warc

MODULES = (decontaminate, warc, labeller, interpolation, passages, lines, bpe, toxicity, itq, neardup)


def queries() -> dict[str, Callable]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
