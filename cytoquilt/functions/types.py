"""Common supertypes for relaxed unions: what ANSI resolution would refuse at run time is settled before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANK = ["tinyint", "smallint", "int", "bigint", "float", "double"]


def supertype(kinds: list[str]) -> str:
    """The type that holds all: the wider number, or string as soon as one is no number."""
    kinds = [k for k in kinds if k != "void"]
    if not kinds:
        return "string"
    if len(set(kinds)) == 1:
        return kinds[0]
    if all(k in _RANK for k in kinds):
        top = max(kinds, key=_RANK.index)
        return "double" if top == "float" and any(k in ("int", "bigint") for k in kinds) else top
    return "string"


def union_relaxed(frames: list[DataFrame]) -> DataFrame:
    """Union of all columns in order of first sight; missing ones are null, types go to their supertype."""
    names: list[str] = []
    for f in frames:
        names += [c for c in f.columns if c not in names]
    kinds = {c: supertype([dict(f.dtypes)[c] for f in frames if c in f.columns]) for c in names}
    out = None
    for f in frames:
        one = f.select(*((F.col(f"`{c}`") if c in f.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names))
        out = one if out is None else out.union(one)
    return out
