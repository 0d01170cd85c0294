"""Selections on either axis: by position, at random, by metadata value, by name, by polygon; and their run statistics."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .positions import runs

#: Runs shorter than this on average read scattered pieces: a warning, not an error.
SCATTERED = 4.0
#: Ids up to which a selection goes to all executors; a longer one is joined by a shuffle.
BROADCAST_IDS = 1_000_000


class SelectionError(ValueError):
    """A selection that names what is not there."""


def sequential(df: DataFrame, key: str, count: int, length: int) -> DataFrame:
    """The first `count` by position; the filter reaches the scan."""
    if count > length:
        raise SelectionError(f"{count} asked for, the axis has {length}")
    return df.where(F.col(key) < count)


def random_ids(length: int, count: int, seed: int) -> list[int]:
    """Sorted distinct positions, the same for the same seed."""
    if count > length:
        raise SelectionError(f"{count} asked for, the axis has {length}")
    return np.sort(np.random.default_rng(seed).choice(length, count, replace=False)).tolist()


def by_ids(df: DataFrame, key: str, ids: list[int]) -> DataFrame:
    chosen = df.sparkSession.createDataFrame([(int(i),) for i in ids], "__id long")
    return df.join(F.broadcast(chosen) if len(ids) <= BROADCAST_IDS else chosen, F.col(key) == F.col("__id"), "left_semi")


def by_frame(df: DataFrame, key: str, chosen: DataFrame, chosen_key: str) -> DataFrame:
    """Semi join; the planner broadcasts the chosen side only where its size is known to be small."""
    return df.join(chosen.select(F.col(chosen_key).alias("__id")), F.col(key) == F.col("__id"), "left_semi")


def matching(obs: DataFrame, **wanted) -> DataFrame:
    """Rows of obs equal to every wanted value."""
    missing = sorted(set(wanted) - set(obs.columns))
    if missing:
        raise SelectionError(f"no obs column {missing}; there are {sorted(obs.columns)}")
    return obs.where(reduce(Column.__and__, [F.col(f"`{k}`") == v for k, v in sorted(wanted.items())]))


def checked(obs: DataFrame, **wanted) -> DataFrame:
    """matching(), with an error that lists the values there are if nothing matches."""
    found = matching(obs, **wanted)
    if found.limit(1).count() == 0:
        column = sorted(wanted)[0]
        n = obs.select(column).distinct().count()
        shown = [r[0] for r in obs.select(column).distinct().orderBy(column).limit(50).collect()]
        raise SelectionError(f"no row with {wanted}; {column} has {shown}" + (f" (+{n - 50} more)" if n > 50 else ""))
    return found


def subset(x: DataFrame, obs: DataFrame, **wanted) -> tuple[DataFrame, DataFrame]:
    """Cells and their entries, filtered together."""
    kept = checked(obs, **wanted)
    return by_frame(x, "row_id", kept, "row_id"), kept


def run_stats(ids: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(n_selected, n_runs, mean_run, scattered); no rows give no runs and a mean of 0."""
    r = runs(ids, row_id).agg(F.count(F.lit(1)).alias("n_runs"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("long").alias("n_selected"))
    mean = F.when(F.col("n_runs") > 0, F.col("n_selected") / F.col("n_runs")).otherwise(F.lit(0.0))
    return r.select("n_selected", "n_runs", F.round(mean, 6).alias("mean_run"), ((mean < SCATTERED) & (F.col("n_runs") > 0)).alias("scattered"))


def read_runs(x: DataFrame, spans: DataFrame, block: int = 4096) -> DataFrame:
    """Rows of x inside half-open spans: an equi join on blocks of rows, then the exact bounds. Spans do not overlap."""
    cut = spans.select("start", "end", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))).alias("__b"))
    rows = x.withColumn("__rb", F.floor(F.col("row_id") / block))
    return rows.join(cut, (F.col("__rb") == F.col("__b")) & (F.col("row_id") >= F.col("start")) & (F.col("row_id") < F.col("end")), "left_semi").drop("__rb")


def by_names(obs: DataFrame, names: DataFrame, name: str = "name", strict: bool = True) -> DataFrame:
    """Rows whose name is in names, each once; with strict, every name must be there."""
    wanted = names.select(F.col(name).alias("__n")).distinct()
    if strict and (gone := missing_names(obs, names, name).limit(5).collect()):
        raise SelectionError(f"names that are not there: {[r[0] for r in gone]}")
    return obs.join(wanted, F.col(name) == F.col("__n"), "left_semi")


def missing_names(obs: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    return names.select(name).distinct().join(obs.select(F.col(name).alias("__n")), F.col(name) == F.col("__n"), "left_anti")


def reindexed(var: DataFrame, kept: DataFrame, key: str = "col_id") -> DataFrame:
    """The kept genes with new contiguous ids in the old order: (key, new_id)."""
    from .positions import positions

    return positions(by_frame(var.select(key), key, kept, key), [], key, "new_id")


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd rule as one expression per edge; fewer than three corners select nothing."""
    if len(polygon) < 3:
        return F.lit(False)
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1]):
        if y1 != y2:
            hit = ((F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)) & (x < (y - y1) * (float(x2) - x1) / (float(y2) - y1) + x1)
            crossings = crossings + hit.cast("int")
    return crossings % 2 == 1
