"""Preprocessing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import preprocess as P
from ..operators.select import reindexed
from .binding import X, counts, obs, var

N_TOP = 200


def _n(spark, d):
    return obs(spark, d).agg(F.count(F.lit(1)).alias("n"))


def _rounded(df, *keep: str):
    return df.select(*(F.col(c) if c in keep or dict(df.dtypes)[c] != "double" else F.round(c, 6).alias(c) for c in df.columns))


def qc_cells(spark, d):
    return _rounded(P.qc_cells(obs(spark, d), counts(spark, d)))


def qc_genes(spark, d):
    return _rounded(P.qc_genes(var(spark, d), counts(spark, d), _n(spark, d)))


def qc_top_pct(spark, d):
    return _rounded(P.qc_top_share(counts(spark, d), (2, 5)))


def normalize_total(spark, d):
    return _rounded(P.normalize_total(counts(spark, d)))


def log1p(spark, d):
    return _rounded(P.log1p(P.normalize_total(counts(spark, d))))


def _stats(spark, d):
    return P.variable_stats(P.log1p(P.normalize_total(counts(spark, d))), _n(spark, d), genes=var(spark, d))


def hvg_stats(spark, d):
    s = _stats(spark, d)
    return s.select("col_id", F.round("mean", 5).alias("mean"), F.round("dispersion", 5).alias("dispersion"), "bin", F.round("norm", 5).alias("norm"))


def hvg(spark, d):
    return P.variable_genes(_stats(spark, d), N_TOP).select("col_id", F.round("norm", 5).alias("norm"))


def hvg_subset(spark, d):
    new = reindexed(var(spark, d), P.variable_genes(_stats(spark, d), N_TOP)).withColumnRenamed("col_id", "g")
    return counts(spark, d).join(new, F.col("col_id") == F.col("g")).select("row_id", F.col("new_id").alias("col_id"), "value")


def scale(spark, d):
    return _rounded(P.scale(P.log1p(P.normalize_total(counts(spark, d))), _n(spark, d)))


_FUNCTIONS = (qc_cells, qc_genes, qc_top_pct, normalize_total, log1p, hvg_stats, hvg, hvg_subset, scale)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_NORM = f"{X}, tot as (select r, sum(v) as t from x group by r), med as (select quantile_cont(t, 0.5) as m from tot), e as (select x.r, x.c, v * m / t as v from x join tot on tot.r = x.r cross join med)"
_HVG = f"""{_NORM}, n as (select count(*) as n from orders), s as (select p_partkey as c, coalesce(sum(v), 0) / n as mu, (coalesce(sum(v * v), 0) - coalesce(sum(v), 0) * coalesce(sum(v), 0) / n) / (n - 1) as va from part left join e on c = p_partkey cross join n group by 1, n),
g as (select c, ln(1 + (case when mu = 0 then 1e-12 else mu end)) as mean, case when va > 0 then ln(va / (case when mu = 0 then 1e-12 else mu end)) end as d from s),
b as (select g.*, greatest(0, ceil(20 * (mean - lo) / (hi - lo)) - 1)::int as bin from g cross join (select min(mean) as lo, max(mean) as hi from g)),
p as (select bin as pb, avg(d) as bm, stddev_samp(d) as bs from b group by bin),
h as (select c as col_id, mean, d as dispersion, bin, (d - (case when bs is null then 0 else bm end)) / coalesce(bs, bm) as norm from b join p on pb = bin),
top as (select col_id, norm from h where norm is not null order by round(norm, 9) desc, col_id limit {N_TOP})"""
ORACLE = {
    "qc_cells": f"with {X}, p as (select r, count(*) as n, sum(v) as t from x group by r) select o_orderkey as row_id, coalesce(n, 0) as n_genes_by_counts, round(coalesce(t, 0), 6) as total_counts, round(ln(1 + coalesce(n, 0)), 6) as log1p_n_genes_by_counts, round(ln(1 + coalesce(t, 0)), 6) as log1p_total_counts from orders left join p on r = o_orderkey",
    "qc_genes": f"with {X}, p as (select c, count(*) as k, sum(v) as t from x group by c), n as (select count(*) as n from orders) select p_partkey as col_id, coalesce(k, 0) as n_cells_by_counts, round(coalesce(t, 0) / n, 6) as mean_counts, round(ln(1 + coalesce(t, 0) / n), 6) as log1p_mean_counts, round(100 * (1 - coalesce(k, 0) / n), 6) as pct_dropout_by_counts, round(coalesce(t, 0), 6) as total_counts, round(ln(1 + coalesce(t, 0)), 6) as log1p_total_counts from part left join p on c = p_partkey cross join n",
    "qc_top_pct": f"with {X}, k as (select *, row_number() over (partition by r order by v desc, c) as n from x) select r as row_id, " + ", ".join(f"round(100 * sum(case when n <= {k} then v else 0 end) / sum(v), 6) as pct_counts_in_top_{k}" for k in (2, 5)) + " from k group by r",
    "normalize_total": f"with {_NORM} select r as row_id, c as col_id, round(v, 6) as value from e",
    "log1p": f"with {_NORM} select r as row_id, c as col_id, round(ln(1 + v), 6) as value from e",
    "hvg_stats": f"with {_HVG} select col_id, round(mean, 5) as mean, round(dispersion, 5) as dispersion, bin, round(norm, 5) as norm from h",
    "hvg": f"with {_HVG} select col_id, round(norm, 5) as norm from top",
    "hvg_subset": f"with {_HVG}, i as (select p_partkey as g, row_number() over (order by p_partkey) - 1 as new_id from part where p_partkey in (select col_id from top)) select r as row_id, new_id as col_id, v as value from x join i on g = c",
    "scale": f"with {_NORM}, l as (select r, c, ln(1 + v) as v from e), n as (select count(*) as n from orders), s as (select c, (sum(v * v) - sum(v) * sum(v) / n) / (n - 1) as va from l cross join n group by c, n) select r as row_id, l.c as col_id, round(least(v / (case when va > 0 then sqrt(va) else 1 end), 10), 6) as value from l join s on s.c = l.c",
}
