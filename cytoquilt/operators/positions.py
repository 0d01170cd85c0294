"""Contiguous positions and running totals without a single-partition window.

Positions come from range partitions and their sizes. For running totals, rows are cut into
blocks of consecutive ids: only one small row per block meets in a global window; sums
inside a block run in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import cut

BLOCK = 1 << 16


def _offsets(small: DataFrame, keys: list[str], amount: str, out: str) -> DataFrame:
    """Exclusive running total of `amount` over the small table in key order."""
    w = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return small.withColumn(out, F.coalesce(F.sum(amount).over(w), F.lit(0)).cast("long"))


def positions(df: DataFrame, keys: list[str], row_id: str = "row_id", out: str = "position") -> DataFrame:
    """Adds the 0-based position of each row in the order (keys..., row_id); row_id breaks ties and is unique.

    Rows are sorted by range partitions, however many different keys there are, and kept that
    way in the shared folder; a row's position is its place in its partition after the sizes
    of the partitions before it. One number for each partition reaches the driver.
    """
    order = [F.col(f"`{k}`") for k in (*keys, row_id)]
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("__at", F.monotonically_increasing_id())
    part, place = F.shiftright("__at", 33).cast("int"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, []
    for p in range(max(sizes, default=-1) + 1):
        starts.append(before)
        before += sizes.get(p, 0)
    offset = F.element_at(F.lit(starts), part + 1) if starts else F.lit(0)
    return placed.withColumn(out, (place + offset).cast("long")).drop("__at")


def running_total(df: DataFrame, order: str, amount: str, out: str, block: int = BLOCK) -> DataFrame:
    """Adds the inclusive running total of `amount` in the order of the integer column `order`."""
    cells = df.withColumn("__block", F.floor(F.col(order) / block).cast("long"))
    small = cells.groupBy(F.col("__block").alias("__b")).agg(F.sum(amount).alias("__n"))
    small = _offsets(small, ["__b"], "__n", "__offset").drop("__n")
    inside = F.sum(amount).over(Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return cells.join(small, F.col("__block") == F.col("__b")).withColumn(out, (F.col("__offset") + inside).cast("long")).drop("__block", "__b", "__offset")


def runs(ids: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Half-open runs (start, end) of consecutive ids, by gaps and islands over blocks of ids.

    A run that crosses blocks is first found in pieces; pieces that touch are joined by a
    window over pieces only.
    """
    one = ids.select(F.col(row_id).cast("long").alias("i")).distinct().withColumn("b", F.floor(F.col("i") / BLOCK))
    piece = one.withColumn("g", F.col("i") - F.row_number().over(Window.partitionBy("b").orderBy("i"))).groupBy("b", "g").agg(F.min("i").alias("s"), (F.max("i") + 1).alias("e"))
    # only pieces at a block's edge can touch another one
    edge = (F.col("s") % BLOCK == 0) | (F.col("e") % BLOCK == 0)
    inner = piece.where(~edge).select(F.col("s").alias("start"), F.col("e").alias("end"))
    w = Window.orderBy("s")
    outer = (
        piece.where(edge)
        .withColumn("new", F.coalesce((F.col("s") != F.lag("e").over(w)).cast("int"), F.lit(1)))
        .withColumn("run", F.sum("new").over(w))
        .groupBy("run")
        .agg(F.min("s").alias("start"), F.max("e").alias("end"))
        .select("start", "end")
    )
    return inner.union(outer)


def joined(values: Column) -> Column:
    """An array as comma-separated text."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")
