"""Harmonising the metadata of many cohorts into one table, and checks of the merged result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import union_relaxed  # noqa: F401  (part of this interface)


class HarmonizeError(ValueError):
    """Metadata that breaks a rule of the merged table."""


def rename_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Old names to canonical ones where present; dots in names are plain characters."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def drop_present(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*(c for c in names if c in df.columns))


def select_present(df: DataFrame, names: list[str]) -> DataFrame:
    """The canonical columns that are there, in canonical order."""
    return df.select(*(F.col(f"`{c}`") for c in names if c in df.columns))


def drop_all_null(df: DataFrame) -> DataFrame:
    """Without the columns that hold nothing; all are counted in one pass."""
    if not df.columns:
        return df
    n = df.agg(*(F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns))).first()
    return df.select(*(F.col(f"`{c}`") for i, c in enumerate(df.columns) if n[i]))


def one_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first by `order`: unlike a plain distinct by subset, always the same one."""
    others = [c for c in df.columns if c != key]
    least = F.min_by(F.struct(*(F.col(f"`{c}`") for c in others)), F.struct(*(F.col(f"`{c}`") for c in order))).alias("r")
    return df.groupBy(key).agg(least).select(key, *(F.col(f"r.`{c}`").alias(c) for c in others))


def left_join_unique(df: DataFrame, right: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Left join with the right side made unique first, so no row multiplies; null keys match nothing."""
    one = one_per_key(right, key, order)
    return df.join(one.withColumnRenamed(key, "__k"), F.col(f"`{key}`") == F.col("__k"), "left").drop("__k")


def relabel_from_leaf(df: DataFrame, tree: DataFrame, leaf: str, parents: list[str]) -> DataFrame:
    """Parent labels taken anew from a leaf-to-parents table; a leaf with two parents is an error."""
    one = tree.select(leaf, *parents).distinct()
    if one.groupBy(leaf).count().where("count > 1").limit(1).count():
        raise HarmonizeError(f"{leaf} has several parents")
    return drop_present(df, parents).join(one.withColumnRenamed(leaf, "__leaf"), F.col(leaf) == F.col("__leaf"), "left").drop("__leaf")


def quality_report(df: DataFrame) -> DataFrame:
    """(column, nulls, zeros): columns with any null, or with any zero if they are numbers; one aggregation."""
    numbers = {c for c, k in df.dtypes if k in ("tinyint", "smallint", "int", "bigint", "float", "double")}
    cells = []
    for i, c in enumerate(df.columns):
        cells += [F.coalesce(F.sum(F.col(f"`{c}`").isNull().cast("long")), F.lit(0)).alias(f"n{i}"), (F.coalesce(F.sum((F.col(f"`{c}`") == 0).cast("long")), F.lit(0)) if c in numbers else F.lit(0).cast("long")).alias(f"z{i}")]
    row = df.agg(*cells)
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls"), F.col(f"z{i}").alias("zeros")) for i, c in enumerate(df.columns)))
    return row.select(F.inline(each)).where("nulls > 0 or zeros > 0")


def keep_first_by_precedence(df: DataFrame, key: str, precedence: Column, tie: str) -> DataFrame:
    """Of rows with the same key the one of highest precedence, by an aggregate: no window over a hot key."""
    rest = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*(F.col(c) for c in rest)), F.struct(precedence, F.col(tie))).alias("r")
    return df.groupBy(key).agg(best).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def common_genes(tables: list[DataFrame], name: str = "var_name") -> DataFrame:
    return reduce(DataFrame.intersect, [t.select(name) for t in tables])


def merge_order(sources: list[DataFrame], keys: list[str], local: str = "local_row") -> DataFrame:
    """Sorted sources merged: adds source_id and the merged `position`, ties by (source, local row)."""
    from .positions import positions

    out = None
    for n, s in enumerate(sources):
        one = s.withColumn("source_id", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return positions(out, [*keys, "source_id"], local)


def merge_runs(merged: DataFrame) -> DataFrame:
    """(run, source_id, start, end): stretches of one source in the merged order.

    A run starts where the row before it is of another source; that row is found by an equi
    join on position, so no window runs over all rows. Starts only meet in a window.
    """
    before = merged.select((F.col("position") + 1).alias("__p"), F.col("source_id").alias("__s"))
    starts = merged.join(before, F.col("position") == F.col("__p"), "left").where(~F.col("source_id").eqNullSafe(F.col("__s"))).select("source_id", F.col("position").alias("start"))
    total = merged.agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("start")
    return starts.join(total, F.lit(True)).select((F.row_number().over(w) - 1).cast("long").alias("run"), "source_id", "start", F.coalesce(F.lead("start").over(w), F.col("__n")).alias("end"))


def order_breaks(rows: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """Rows whose keys are below those of the row before: none in a sorted store. An equi join on position."""
    key = F.struct(*keys)
    before = rows.select((F.col(position) + 1).alias("__p"), key.alias("__k"))
    return rows.join(before, F.col(position) == F.col("__p")).where(F.struct(*keys) < F.col("__k")).drop("__p", "__k")


def tree_breaks(df: DataFrame, child: str, parent: str) -> DataFrame:
    """Children with several parents: none in a tree."""
    return df.groupBy(child).agg(F.count_distinct(parent).alias("parents")).where("parents > 1")


def alignment_breaks(a: DataFrame, b: DataFrame, position: str = "position", name: str = "name") -> DataFrame:
    """Positions at which two name columns differ or one has none."""
    left, right = a.select(position, F.col(name).alias("left")), b.select(F.col(position).alias("__p"), F.col(name).alias("right"))
    return left.join(right, F.col(position) == F.col("__p"), "full_outer").where(~F.col("left").eqNullSafe(F.col("right"))).select(F.coalesce(position, "__p").alias(position), "left", "right")
