"""Chunk and shard arithmetic, names and small scalar rules."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def shard_shape(n_rows: int, n_cols: int, row_chunk: int, col_chunk: int, factor: int) -> tuple[int, int] | None:
    """Shard of factor x factor chunks, never more chunks than the axis has; None without sharding."""
    if factor <= 1:
        return None
    side = lambda n, c: c * min(factor, max(1, math.ceil(n / c)))
    return side(n_rows, row_chunk), side(n_cols, col_chunk)


def shard_side(n: Column, chunk: Column, factor: Column) -> Column:
    """The same rule for one axis as a column."""
    return F.when(factor > 1, chunk * F.least(factor, F.greatest(F.lit(1), F.ceil(n / chunk)))).cast("int")


def slug(value: Column) -> Column:
    """A file-safe name: other characters to single underscores, outer ones off, 'subset' if nothing is left."""
    text = F.regexp_replace(F.regexp_replace(value, r"[^0-9A-Za-z._-]+", "_"), r"^_+|_+$", "")
    return F.when(text == "", F.lit("subset")).otherwise(text)


def slug_name(value: str) -> str:
    return re.sub(r"[^0-9A-Za-z._-]+", "_", value).strip("_") or "subset"


def strip_space(value: Column) -> Column:
    """Strip every kind of white space, not blanks only."""
    return F.regexp_replace(F.regexp_replace(value, r"^\s+", ""), r"\s+$", "")


def replace_first(value: Column, old: str, new: str) -> Column:
    """Replace the first match of a literal only."""
    at = F.locate(old, value)
    return F.when(at > 0, F.concat(F.substring(value, F.lit(1), at - 1), F.lit(new), F.substring(value, at + len(old), F.length(value)))).otherwise(value)


def first_part(value: Column, sep: str) -> Column:
    return F.split(value, re.escape(sep))[0]
