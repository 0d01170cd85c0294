"""Benchmark statistics and viewer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchstats as B
from ..operators.embed import fit_view as view
from ..session import table
from ..sources.files import scratch
from ..sources.readers import read_runs


def _timed(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "event_type", "user_id", "ts", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("start"))


def bench_stats(spark, d):
    t = _timed(spark, d).withColumn("cpu", B.cpu_time(F.col("value"), F.lit(2.0), F.col("value") * 0.25))
    s = B.timing_stats(t, ["event_type"], "value").join(t.groupBy(F.col("event_type").alias("k")).agg(F.round(F.sum("cpu"), 4).alias("cpu")), F.col("event_type") == F.col("k")).drop("k")
    return s.select("event_type", "n", F.round("min", 6).alias("min"), F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), "cpu")


def interval_union(spark, d):
    t = _timed(spark, d).select("user_id", F.col("start"), (F.col("start") + F.abs("value") * 600).alias("end"))
    return B.interval_union(t, ["user_id"]).select("user_id", F.round("length", 3).alias("length"))


def compare_runs(spark, d):
    """Runs written as JSON in three forms, read again and compared."""
    t = _timed(spark, d).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("median_s"))
    where = scratch(spark, "runs")
    t.coalesce(1).write.json(where)
    runs = read_runs(spark, where, "event_type: string, median_s: double")
    return B.compared(runs, "median_s", ["event_type"]).select(F.col("event_type").alias("store"), "median_s", F.round("xslow", 6).alias("xslow"))


def step_report(spark, d):
    return B.step_report(_timed(spark, d), "event_type", "value", "user_id").select(F.col("event_type").alias("step"), F.round("wall", 4).alias("wall"), "peak")


def fit_view(spark, d):
    p = table(spark, d, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    v = view(p, 1200.0, 800.0)
    return v.select(*(F.round(c, 6).alias(c) for c in v.columns))


_FUNCTIONS = (bench_stats, interval_union, compare_runs, step_report, fit_view)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
_T = "t as (select *, epoch_us(ts) / 1e6 as start from events)"
ORACLE = {
    "bench_stats": "select event_type, count(value) as n, round(min(value), 6) as min, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.95), 6) as p95, round(sum(greatest(0, value - 2.0 - value * 0.25)), 4) as cpu from events group by 1",
    "interval_union": f"with {_T}, i as (select user_id, start as s, start + abs(value) * 600 as e from t), p as (select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) as pe from i), g as (select *, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by user_id order by s, e rows unbounded preceding) as k from p), u as (select user_id, k, max(e) - min(s) as l from g group by 1, 2) select user_id, round(sum(l), 3) as length from u group by 1",
    "compare_runs": "with r as (select event_type as store, round(avg(value), 6) as median_s from events group by 1) select store, median_s, round(median_s / (select min(median_s) from r), 6) as xslow from r",
    "step_report": "select event_type as step, round(sum(value), 4) as wall, max(user_id) as peak from events group by 1 union all select 'total', round(sum(value), 4), max(user_id) from events",
    "fit_view": "with p as (select embedding[1]::double as x, embedding[2]::double as y from embeddings), b as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from p where isfinite(x) and isfinite(y)) select round((x0 + x1) / 2, 6) as target_x, round((y0 + y1) / 2, 6) as target_y, round(least(10, greatest(-2, log2(least(1200 / greatest(x1 - x0, 1e-6), 800 / greatest(y1 - y0, 1e-6)) * 0.9))), 6) as zoom from b",
}
