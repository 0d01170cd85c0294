"""Sorting, group ranges, concatenation of several inputs on the cell axis, and the checks they need."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .positions import positions, running_total


class IngestError(ValueError):
    """Inputs that do not fit together."""


@dataclass
class Part:
    """One input: its cells, genes and triplets; categories of its categorical columns by name."""

    obs: DataFrame
    var: DataFrame
    x: DataFrame
    categories: dict[str, list[str]] = field(default_factory=dict)
    integral: bool = False


def sort_positions(obs: DataFrame, keys: list[str], row_id: str = "row_id", categories: dict[str, list[str]] | None = None, check: bool = True) -> DataFrame:
    """Adds `position` in the stable order of the keys. Categorical keys sort by their declared order; a null key is an error."""
    missing = [k for k in keys if k not in obs.columns]
    if missing:
        raise IngestError(f"sort columns not found: {missing}")
    if check and keys:
        bad = obs.where(" or ".join(f"`{k}` is null" for k in keys)).limit(1).count()
        if bad:
            raise IngestError(f"null in sort columns {keys}")
    order = []
    for k in keys:
        if categories and k in categories:
            at = F.array_position(F.array(*map(F.lit, categories[k])), F.col(k))
            obs = obs.withColumn(f"__order_{k}", at)
            order.append(f"__order_{k}")
        else:
            order.append(k)
    return positions(obs, order, row_id).drop(*(f"__order_{k}" for k in keys))


def group_sizes(obs: DataFrame, keys: list[str]) -> DataFrame:
    return obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))


def group_ranges(obs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., start, end) of each observed group in sorted order; the window runs over groups only."""
    w = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    sized = group_sizes(obs, keys).withColumn("end", F.sum("size").over(w))
    return sized.select(*keys, (F.col("end") - F.col("size")).cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def sorted_matrix(x: DataFrame, placed: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Triplets with the rows' new positions; every obs-aligned frame is permuted by the same join."""
    return x.join(placed.select(F.col(row_id).alias("__r"), "position"), F.col(row_id) == F.col("__r")).select(F.col("position").alias("row_id"), "col_id", "value")


def row_counts(parts: list[Part]) -> list[int]:
    return [p.obs.count() for p in parts]


def var_mismatch(a: DataFrame, b: DataFrame, name: str = "var_name") -> DataFrame:
    """(position, left, right) wherever names or order of two gene tables differ."""
    left, right = a.select("col_id", F.col(name).alias("left")), b.select(F.col("col_id").alias("c2"), F.col(name).alias("right"))
    both = left.join(right, F.col("col_id") == F.col("c2"), "full_outer")
    return both.where(~F.col("left").eqNullSafe(F.col("right"))).select(F.coalesce("col_id", "c2").alias("position"), "left", "right")


def check_parts(parts: list[Part], obs_columns: list[str] | None) -> list[str]:
    """Errors as exceptions; what was dropped or coerced as warnings."""
    warnings, first = [], parts[0]
    for n, p in enumerate(parts[1:], 1):
        if var_mismatch(first.var, p.var).limit(1).count():
            raise IngestError(f"var mismatch between inputs 0 and {n}")
        if dict(p.x.dtypes)["value"] != dict(first.x.dtypes)["value"]:
            raise IngestError(f"X dtype mismatch between inputs 0 and {n}")
        if obs_columns is None and p.obs.dtypes != first.obs.dtypes:
            raise IngestError(f"obs schema mismatch between inputs 0 and {n}")
    if obs_columns is not None:
        for n, p in enumerate(parts):
            gone = [c for c in obs_columns if c not in p.obs.columns]
            if gone:
                raise IngestError(f"obs columns not found in input {n}: {gone}")
            extra = [c for c in p.obs.columns if c not in obs_columns and c != "row_id"]
            if extra:
                warnings.append(f"input {n}: dropped obs columns {extra}")
        for c in obs_columns:
            sets = {frozenset(p.categories[c]) for p in parts if c in p.categories}
            if len(sets) > 1 or sets and any(c not in p.categories for p in parts):
                raise IngestError(f"mismatched categorical categories in {c}")
            kinds = {dict(p.obs.dtypes)[c] for p in parts}
            if len(kinds) > 1:
                warnings.append(f"{c}: coerced from {sorted(kinds)}")
    return warnings


def concat_obs(parts: list[Part], obs_columns: list[str] | None = None, sizes: list[int] | None = None) -> DataFrame:
    """Cells appended in input order: row ids are 0-based within each input, and shifted by the rows before it."""
    sizes, at, out = sizes or row_counts(parts), 0, None
    kinds = {c: _wider([dict(p.obs.dtypes)[c] for p in parts]) for c in obs_columns or [c for c in parts[0].obs.columns if c != "row_id"]}
    for p, n in zip(parts, sizes):
        rows = p.obs.select((F.col("row_id") + at).alias("row_id"), *(F.col(f"`{c}`").cast(k).alias(c) for c, k in kinds.items()))
        out = rows if out is None else out.unionByName(rows)
        at += n
    return out


def _wider(kinds: list[str]) -> str:
    from ..functions.types import supertype

    return supertype(kinds)


def concat_x(parts: list[Part], sizes: list[int] | None = None) -> DataFrame:
    sizes, at, out = sizes or row_counts(parts), 0, None
    for p, n in zip(parts, sizes):
        rows = p.x.select((F.col("row_id") + at).alias("row_id"), "col_id", "value")
        out = rows if out is None else out.union(rows)
        at += n
    return out


def concat_indptr(nnz: DataFrame) -> DataFrame:
    """(slot, indptr) over the concatenated rows (row_id, nnz); offsets are 64-bit throughout."""
    return running_total(nnz, "row_id", "nnz", "indptr").select((F.col("row_id") + 1).alias("slot"), "indptr")


def duplicate_names(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def validate(obs: DataFrame, var: DataFrame, has_x: bool = True, uns: dict | None = None, obsm: tuple[str, ...] = (), require_non_empty: bool = True, reject_spatial: bool = True) -> list[str]:
    """Errors as exceptions, duplicate names as warnings."""
    if require_non_empty and not (obs.limit(1).count() and var.limit(1).count()):
        raise IngestError("empty matrix")
    if not has_x:
        raise IngestError("X is missing")
    if reject_spatial and ("spatial" in (uns or {}) or any("spatial" in k.lower() for k in obsm)):
        raise IngestError("spatial data is not supported")
    out = []
    for what, df, name in (("obs", obs, "obs_name"), ("var", var, "var_name")):
        if name in df.columns and duplicate_names(df, name).limit(1).count():
            out.append(f"duplicate {what} names")
    return out
