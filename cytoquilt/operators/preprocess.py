"""Quality metrics, normalisation, variable genes and scaling on triplets. Zeros stay implicit: every mean divides by all cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..sources.files import cut

#: Ranks of the shares of the most expressed genes.
TOPS = (50, 100, 200, 500)


def is_raw(x: DataFrame) -> bool:
    """Counts are raw if the values' type is integral; anything else has been normalised."""
    return isinstance(x.schema["value"].dataType, IntegralType)


def qc_cells(obs: DataFrame, x: DataFrame) -> DataFrame:
    """Per cell, empty ones too: genes with counts, total, and log1p of both."""
    per = x.where("value <> 0").groupBy(F.col("row_id").alias("r")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("t"))
    out = obs.select("row_id").join(per, F.col("row_id") == F.col("r"), "left")
    n, t = F.coalesce("n", F.lit(0)).cast("long"), F.coalesce("t", F.lit(0.0))
    return out.select("row_id", n.alias("n_genes_by_counts"), t.alias("total_counts"), F.log1p(n.cast("double")).alias("log1p_n_genes_by_counts"), F.log1p(t).alias("log1p_total_counts"))


def qc_top_share(x: DataFrame, tops: tuple[int, ...] = TOPS) -> DataFrame:
    """Per cell, the percentage of its counts in its most expressed genes."""
    rank = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("value"), "col_id"))
    share = lambda k: (100 * F.sum(F.when(F.col("rank") <= k, F.col("value")).otherwise(0.0)) / F.sum("value")).alias(f"pct_counts_in_top_{k}")
    return x.withColumn("rank", rank).groupBy("row_id").agg(*(share(k) for k in tops))


def qc_genes(var: DataFrame, x: DataFrame, n_obs: DataFrame) -> DataFrame:
    """Per gene: cells with counts, mean over all cells, dropout percentage, total. n_obs has one row (n)."""
    per = x.where("value <> 0").groupBy(F.col("col_id").alias("g")).agg(F.count(F.lit(1)).alias("k"), F.sum("value").alias("t"))
    out = var.select("col_id").join(per, F.col("col_id") == F.col("g"), "left").join(F.broadcast(n_obs), F.lit(True))
    k, t = F.coalesce("k", F.lit(0)).cast("long"), F.coalesce("t", F.lit(0.0))
    return out.select("col_id", k.alias("n_cells_by_counts"), (t / F.col("n")).alias("mean_counts"), F.log1p(t / F.col("n")).alias("log1p_mean_counts"), (100 * (1 - k / F.col("n"))).alias("pct_dropout_by_counts"), t.alias("total_counts"), F.log1p(t).alias("log1p_total_counts"))


def normalize_total(x: DataFrame, target: float | None = None) -> DataFrame:
    """Values scaled so that each cell's total is the target: the exact median of the positive totals if none is given.

    Totals, their median and the values come from one copy of x in the shared folder.
    """
    x = cut(x)
    totals = x.groupBy(F.col("row_id").alias("r")).agg(F.sum("value").alias("total")).where("total > 0")
    if target is None:
        goal = totals.agg(F.percentile("total", F.lit(0.5)).alias("target"))
        scaled = totals.join(F.broadcast(goal), F.lit(True))  # one row
    else:
        scaled = totals.withColumn("target", F.lit(float(target)))
    return x.join(scaled, F.col("row_id") == F.col("r"), "left").select("row_id", "col_id", F.when(F.col("total").isNull(), F.col("value")).otherwise(F.col("value") * F.col("target") / F.col("total")).alias("value"))


def log1p(x: DataFrame) -> DataFrame:
    return x.withColumn("value", F.log1p("value"))


def gene_moments(logged: DataFrame, n_obs: DataFrame, expm1: bool = True, genes: DataFrame | None = None) -> DataFrame:
    """(col_id, mean, var) of each gene over all cells, zeros included, of the values before log1p.

    With `genes`, those without any entry are there too, with zeros.
    """
    v = F.expm1("value") if expm1 else F.col("value")
    sums = logged.groupBy("col_id").agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    if genes is not None:
        every = genes.select(F.col("col_id").alias("__g"))
        sums = every.join(sums, F.col("__g") == F.col("col_id"), "left").select(F.col("__g").alias("col_id"), F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("q", F.lit(0.0)).alias("q"))
    sums = sums.join(F.broadcast(n_obs), F.lit(True))
    return sums.select("col_id", (F.col("s") / F.col("n")).alias("mean"), ((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("var"))


def variable_stats(logged: DataFrame, n_obs: DataFrame, bins: int = 20, genes: DataFrame | None = None) -> DataFrame:
    """(col_id, mean, dispersion, bin, norm): dispersion against the genes of like mean, in right-closed equal-width bins."""
    m = gene_moments(logged, n_obs, genes=genes).withColumn("mean", F.when(F.col("mean") == 0, 1e-12).otherwise(F.col("mean")))
    g = m.select("col_id", F.log1p("mean").alias("mean"), F.when(F.col("var") > 0, F.log(F.col("var") / F.col("mean"))).alias("dispersion"))
    g = cut(g)  # one row for each gene, read for the bounds, the bins and the result
    ends = g.agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    b = F.greatest(F.lit(0), F.ceil(F.lit(bins) * (F.col("mean") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))) - 1)
    binned = g.join(F.broadcast(ends), F.lit(True)).select("col_id", "mean", "dispersion", F.coalesce(b, F.lit(0)).cast("int").alias("bin"))
    per = binned.groupBy(F.col("bin").alias("b")).agg(F.avg("dispersion").alias("bm"), F.stddev_samp("dispersion").alias("bs"))
    per = per.select("b", F.when(F.col("bs").isNull(), 0.0).otherwise(F.col("bm")).alias("bm"), F.coalesce("bs", "bm").alias("bs"))
    return binned.join(F.broadcast(per), F.col("bin") == F.col("b")).select("col_id", "mean", "dispersion", "bin", (F.try_divide(F.col("dispersion") - F.col("bm"), F.col("bs"))).alias("norm"))


def variable_genes(stats: DataFrame, n: int) -> DataFrame:
    """The n genes of highest normalised dispersion, ties by id (a top-k, not a sort of all)."""
    return stats.where("norm is not null").orderBy(F.desc(F.round("norm", 9)), "col_id").limit(n).select("col_id", "norm")


def scale(x: DataFrame, n_obs: DataFrame, top: float = 10.0) -> DataFrame:
    """Values over their gene's sample deviation, clipped; not centred, so zeros stay zeros. Moments and values come from one copy of x."""
    x = cut(x)
    sd = gene_moments(x, n_obs, expm1=False).select(F.col("col_id").alias("g"), F.when(F.col("var") > 0, F.sqrt("var")).otherwise(F.lit(1.0)).alias("sd"))
    return x.join(sd, F.col("col_id") == F.col("g")).select("row_id", "col_id", F.least(F.col("value") / F.col("sd"), F.lit(float(top))).alias("value"))
