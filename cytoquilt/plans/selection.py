"""Selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shapes import slug
from ..operators import select as S
from ..operators.positions import positions, runs
from ..session import table
from .binding import X, counts, extent, obs, var

TYPE = "1-URGENT"
SEED, COUNT = 7, 500
SEQUENTIAL = 1000
POLYGON = [(-0.15, -0.1), (0.1, -0.2), (0.2, 0.05), (0.02, 0.2), (-0.1, 0.12)]


def select_rows_seq(spark, d):
    return S.sequential(counts(spark, d), "row_id", SEQUENTIAL, SEQUENTIAL)


def select_cols_seq(spark, d):
    return S.sequential(counts(spark, d), "col_id", 50, 50)


def select_rows_rand(spark, d):
    return S.by_ids(counts(spark, d), "row_id", S.random_ids(1500, COUNT, SEED))


def select_cols_rand(spark, d):
    return S.by_ids(counts(spark, d), "col_id", S.random_ids(200, 50, SEED))


def select_rows_rand_whole(spark, d):
    """As select_rows_rand, whose twin has the ids in its text, drawn from all rows."""
    return S.by_ids(counts(spark, d), "row_id", S.random_ids(extent(obs(spark, d), "row_id"), COUNT, SEED))


def select_cols_rand_whole(spark, d):
    return S.by_ids(counts(spark, d), "col_id", S.random_ids(extent(var(spark, d), "col_id"), 50, SEED))


def select_celltype(spark, d):
    return S.by_frame(counts(spark, d), "row_id", S.matching(obs(spark, d), cell_type=TYPE), "row_id")


def select_celltype_means(spark, d):
    """Mean expression per gene over the cells of one type; cells without the gene count as 0."""
    cells = S.matching(obs(spark, d), cell_type=TYPE)
    n = cells.agg(F.count(F.lit(1)).alias("n"))
    sums = S.by_frame(counts(spark, d), "row_id", cells, "row_id").groupBy("col_id").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n_cells"))
    named = sums.join(var(spark, d).select(F.col("col_id").alias("g"), "var_name"), F.col("col_id") == F.col("g")).join(F.broadcast(n), F.lit(True))
    return named.select("col_id", "var_name", "n_cells", F.round(F.col("total") / F.col("n"), 6).alias("mean"))


def celltype_values(spark, d):
    return obs(spark, d).select("cell_type").distinct()


def obs_column(spark, d):
    return obs(spark, d).select("row_id", "cell_type")


def _places(spark, d):
    return positions(obs(spark, d).select("row_id", "cell_type"), [])


def span_runs(spark, d):
    return runs(_places(spark, d).where(F.col("cell_type") == TYPE), "position")


def span_stats(spark, d):
    return S.run_stats(_places(spark, d).where(F.col("cell_type") == TYPE), "position")


def read_spans(spark, d):
    return S.read_runs(counts(spark, d), runs(obs(spark, d).where((F.col("cell_type") == TYPE) & (F.col("batch") == "F"))))


def subset_rows(spark, d):
    x, kept = S.subset(counts(spark, d), obs(spark, d), batch="P")
    per = x.groupBy(F.col("row_id").alias("r")).agg(F.count(F.lit(1)).alias("nnz"), F.sum("value").alias("sum_value"))
    return kept.join(per, F.col("row_id") == F.col("r"), "left").select("row_id", "cell_type", F.coalesce("nnz", F.lit(0)).cast("long").alias("nnz"), F.coalesce("sum_value", F.lit(0.0)).alias("total"))


def subset_multikey(spark, d):
    return S.matching(obs(spark, d), cell_type=TYPE, batch="F").select("row_id", "cell_type", "batch")


def _named(spark, d):
    return obs(spark, d).select("row_id", F.concat(F.lit("cell-"), F.col("row_id")).alias("name"))


def _wanted(spark, d, extra: bool):
    ids = table(spark, d, "events").select(F.concat(F.lit("cell-"), F.col("user_id") * (1 if not extra else 1000)).alias("name"))
    return ids


def selection_rows(spark, d):
    return S.by_names(_named(spark, d), _wanted(spark, d, False), strict=False)


def selection_missing(spark, d):
    return S.missing_names(_named(spark, d), _wanted(spark, d, True))


def subset_view(spark, d):
    """Metadata of a subset without its matrix, by name."""
    kept = S.matching(obs(spark, d), cell_type=TYPE)
    return kept.select(F.concat(F.lit("cell-"), F.col("row_id")).alias("name"), "cell_type", "batch")


def subset_slug(spark, d):
    return obs(spark, d).select("cell_type").distinct().select("cell_type", slug(F.concat(F.lit(" "), F.col("cell_type"), F.lit("/x ?"))).alias("slug"))


def _points(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")


def lasso_select(spark, d):
    return _points(spark, d).where(S.in_polygon(F.col("x"), F.col("y"), POLYGON)).select("vec_id")


def selection_export(spark, d):
    """One row per selected point, coordinates at four decimals, as JSON."""
    p = _points(spark, d).where(S.in_polygon(F.col("x"), F.col("y"), POLYGON))
    return p.select("vec_id", F.to_json(F.struct(F.col("vec_id").alias("index"), F.concat(F.lit("cell-"), "vec_id").alias("barcode"))).alias("json"), F.round("x", 4).alias("x4"), F.round("y", 4).alias("y4"))


_FUNCTIONS = (select_rows_seq, select_cols_seq, select_rows_rand, select_cols_rand, select_rows_rand_whole, select_cols_rand_whole, select_celltype, select_celltype_means, celltype_values, obs_column, span_runs, span_stats, read_spans, subset_rows, subset_multikey, selection_rows, selection_missing, subset_view, subset_slug, lasso_select, selection_export)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_XR = "r as row_id, c as col_id, v as value from x"
_SPANS = f"s as (select row_number() over (order by o_orderkey) - 1 as rid, o_orderpriority as p from orders), m as (select rid, rid - row_number() over (order by rid) as g from s where p = '{TYPE}'), spans as (select min(rid) as start, max(rid) + 1 as \"end\" from m group by g)"


def _inside() -> str:
    terms = []
    for (x1, y1), (x2, y2) in zip(POLYGON, POLYGON[1:] + POLYGON[:1]):
        if y1 != y2:
            terms.append(f"((({y1}::double > y) <> ({y2}::double > y)) and x < (y - {y1}::double) * ({x2}::double - {x1}::double) / ({y2}::double - {y1}::double) + {x1}::double)::int")
    return "(" + " + ".join(terms) + ") % 2 = 1"


_P = "p as (select vec_id, embedding[1]::double as x, embedding[2]::double as y from embeddings)"
ORACLE = {
    "select_rows_seq": f"with {X} select {_XR} where r < {SEQUENTIAL}",
    "select_cols_seq": f"with {X} select {_XR} where c < 50",
    "select_rows_rand": f"with {X} select {_XR} where r in ({', '.join(map(str, S.random_ids(1500, COUNT, SEED)))})",
    "select_cols_rand": f"with {X} select {_XR} where c in ({', '.join(map(str, S.random_ids(200, 50, SEED)))})",
    "select_celltype": f"with {X} select {_XR} where r in (select o_orderkey from orders where o_orderpriority = '{TYPE}')",
    "select_celltype_means": f"with {X}, o as (select o_orderkey from orders where o_orderpriority = '{TYPE}') select c as col_id, p_name as var_name, count(*) as n_cells, round(sum(v) / (select count(*) from o), 6) as mean from x join o on r = o_orderkey join part on p_partkey = c group by 1, 2",
    "celltype_values": "select distinct o_orderpriority as cell_type from orders",
    "obs_column": "select o_orderkey as row_id, o_orderpriority as cell_type from orders",
    "span_runs": f"with {_SPANS} select * from spans",
    "span_stats": f"with {_SPANS} select sum(\"end\" - start)::bigint as n_selected, count(*) as n_runs, round(sum(\"end\" - start) / count(*), 6) as mean_run, sum(\"end\" - start) / count(*) < 4 as scattered from spans",
    "read_spans": f"with {X} select {_XR} where r in (select o_orderkey from orders where o_orderpriority = '{TYPE}' and o_orderstatus = 'F')",
    "subset_rows": f"with {X} select o_orderkey as row_id, o_orderpriority as cell_type, count(c) as nnz, coalesce(sum(v), 0) as total from orders left join x on r = o_orderkey where o_orderstatus = 'P' group by 1, 2",
    "subset_multikey": f"select o_orderkey as row_id, o_orderpriority as cell_type, o_orderstatus as batch from orders where o_orderpriority = '{TYPE}' and o_orderstatus = 'F'",
    "selection_rows": "select o_orderkey as row_id, 'cell-' || o_orderkey as name from orders where o_orderkey in (select user_id from events)",
    "selection_missing": "select distinct 'cell-' || (user_id * 1000) as name from events where user_id * 1000 not in (select o_orderkey from orders)",
    "subset_view": f"select 'cell-' || o_orderkey as name, o_orderpriority as cell_type, o_orderstatus as batch from orders where o_orderpriority = '{TYPE}'",
    "subset_slug": "select distinct o_orderpriority as cell_type, trim(regexp_replace(' ' || o_orderpriority || '/x ?', '[^0-9A-Za-z._-]+', '_', 'g'), '_') as slug from orders",
    "lasso_select": f"with {_P} select vec_id from p where {_inside()}",
    "selection_export": f"with {_P} select vec_id, '{{\"index\":' || vec_id || ',\"barcode\":\"cell-' || vec_id || '\"}}' as json, round(x, 4) as x4, round(y, 4) as y4 from p where {_inside()}",
}
