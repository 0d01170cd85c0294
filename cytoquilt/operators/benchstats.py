"""Statistics of benchmark runs: percentiles, interval unions, splits of wall time, comparison and step reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def timing_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., n, min, median, p95), percentiles by linear interpolation."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.95)).alias("p95"))


def cpu_time(total: Column, io: Column, convert: Column) -> Column:
    return F.greatest(F.lit(0.0), total - io - convert)


def interval_union(df: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(by..., length): total length of the union of intervals; touching ones merge."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = df.withColumn("__new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    islands = cut.withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "__i").agg((F.max(end) - F.min(start)).alias("l"))
    return islands.groupBy(*by).agg(F.sum("l").alias("length"))


def compared(runs: DataFrame, value: str, tie: list[str]) -> DataFrame:
    """Runs in order, missing values last, with their ratio to the fastest; the fastest is one row, broadcast."""
    best = runs.agg(F.min(value).alias("__best"))
    out = runs.join(F.broadcast(best), F.lit(True)).withColumn("xslow", F.col(value) / F.col("__best")).drop("__best")
    return out.orderBy(F.asc_nulls_last(value), *tie)


def step_report(steps: DataFrame, by: str, wall: str, host: str) -> DataFrame:
    """Each step, and a last line 'total' with the sum of wall times and the highest peak."""
    per = steps.groupBy(by).agg(F.sum(wall).alias("wall"), F.max(host).alias("peak"))
    return per.union(steps.agg(F.lit("total"), F.sum(wall), F.max(host)))


def table_text(rows: list[dict], columns: list[str], markdown: bool = False) -> str:
    """Plain or markdown text of a small result."""
    cells = [[("" if r.get(c) is None else f"{r[c]:.3f}" if isinstance(r[c], float) else str(r[c])) for c in columns] for r in rows]
    if markdown:
        lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)] + ["| " + " | ".join(c) + " |" for c in cells]
        return "\n".join(lines)
    width = [max(len(columns[i]), *(len(c[i]) for c in cells)) if cells else len(columns[i]) for i in range(len(columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(row, width)).rstrip() for row in [columns, *cells])
