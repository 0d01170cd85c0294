"""Metadata harmonisation queries. Cohort metadata is customers with their nations; labels form the tree nation to region."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shapes import first_part, replace_first, strip_space
from ..operators import harmonize as H
from ..operators.positions import positions
from ..session import table
from ..sources.files import scratch
from ..sources.readers import read_csv
from .binding import obs

STATUSES = ["F", "O", "P"]


def _meta(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))


def _tree(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("leaf"), F.col("r_name").alias("parent"))


def filter_eq(spark, d):
    return table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_mktsegment")


def filter_not_in(spark, d):
    """Null predicates drop their rows."""
    seg = F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment")
    return table(spark, d, "customer").select("c_custkey", seg).where(~F.col("segment").isin("BUILDING", "MACHINERY"))


def left_join_meta(spark, d):
    """The right side repeats keys and is made unique by its least order first."""
    right = table(spark, d, "orders").select(F.col("o_custkey").alias("kit"), F.col("o_orderkey").alias("first_order"), "o_orderstatus")
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("kit"), "c_name")
    return H.left_join_unique(left, right, "kit", ["first_order"])


def left_join_filemap(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("sample.kit"), "c_mktsegment")
    right = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("sample.kit"), F.concat(F.lit("file-"), "o_orderkey").alias("file.id"))
    best = right.groupBy("`sample.kit`").agg(F.min("`file.id`").alias("file_id")).withColumnRenamed("sample.kit", "__k")
    return left.join(best, F.col("`sample.kit`") == F.col("__k"), "left").select(F.col("`sample.kit`").alias("kit"), "c_mktsegment", "file_id")


def relabel_from_leaf(spark, d):
    rows = _meta(spark, d).select("c_custkey", F.concat(F.lit("\t"), "n_name", F.lit("  ")).alias("leaf"), F.lit("old").alias("parent"))
    return H.relabel_from_leaf(rows.withColumn("leaf", strip_space(F.col("leaf"))), _tree(spark, d), "leaf", ["parent"])


def distinct_meta(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("kit"), F.col("o_orderkey").alias("order_id"), "o_orderpriority")
    return H.one_per_key(rows, "kit", ["order_id"])


def rename_cols(spark, d):
    rows = table(spark, d, "customer").withColumnRenamed("c_custkey", "subject.subjectGuid").withColumnRenamed("c_name", "pool")
    out = H.rename_present(rows, {"subject.subjectGuid": "subject_id", "pool": "pool_id", "absent": "x"})
    return out.select("subject_id", "pool_id", replace_first(F.col("pool_id"), "0", "K").alias("kit"), first_part(F.col("c_mktsegment"), "I").alias("seg"))


def drop_cols(spark, d):
    return H.drop_present(table(spark, d, "customer"), ["c_acctbal", "c_nationkey", "absent"])


def drop_all_null(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", F.lit(None).cast("string").alias("nothing"), F.when(F.col("n_nationkey") == 3, F.col("n_name")).alias("little"))
    return H.drop_all_null(rows)


def project_canonical(spark, d):
    return H.select_present(table(spark, d, "customer"), ["c_mktsegment", "absent", "c_custkey"])


def union_relaxed(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), "c_mktsegment")
    b = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_nationkey").cast("double").alias("nation"), "s_acctbal")
    return H.union_relaxed([a, b])


def dq_report(spark, d):
    both = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels").withColumnRenamed("doc_id", "k"), F.col("doc_id") == F.col("k"), "left").drop("k")
    return H.quality_report(both)


def csv_nulls(spark, d):
    """Customers written as CSV with NA, blank and broken cells, read again with these as nulls."""
    where = scratch(spark, "csv")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, F.lit("NA")).when(F.col("c_custkey") % 5 == 1, F.lit("")).otherwise(F.col("c_mktsegment")).alias("seg"), F.when(F.col("c_custkey") % 7 == 0, F.lit("x")).otherwise(F.col("c_nationkey").cast("string")).alias("n"))
    rows.write.option("header", True).option("quoteAll", True).csv(where)
    return read_csv(spark, where, "id long, seg string, n int")


def stage_rows(spark, d):
    return obs(spark, d).join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), F.col("row_id") == F.col("k"), "left_anti").select("row_id", "cell_type")


def dedup_precedence(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("barcode"), F.col("o_orderstatus").alias("cohort"), "o_orderkey")
    rank = F.array_position(F.array(*map(F.lit, ["P", "O", "F"])), F.col("cohort"))
    return H.keep_first_by_precedence(rows, "barcode", rank, "o_orderkey")


def gene_intersection(spark, d):
    sold = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return H.common_genes([sold.where(F.col("o_orderstatus") == s).select(F.col("l_partkey").alias("var_name")) for s in STATUSES])


def _sources(spark, d):
    return [positions(obs(spark, d).where(F.col("batch") == s), ["cell_type"]).select(F.col("position").alias("local_row"), "row_id", "cell_type") for s in STATUSES]


def kway_merge(spark, d):
    return H.merge_order(_sources(spark, d), ["cell_type"]).select("position", "source_id", "local_row", "row_id", "cell_type")


def merge_runs(spark, d):
    return H.merge_runs(H.merge_order(_sources(spark, d), ["cell_type"]))


def check_monotonic(spark, d):
    """The store in order of ids is not sorted by type: its breaks."""
    return H.order_breaks(positions(obs(spark, d), []), ["cell_type"]).select("position", "cell_type")


def check_tree(spark, d):
    rows = _meta(spark, d).select(F.col("c_mktsegment").alias("child"), F.col("n_name").alias("parent"))
    return H.tree_breaks(rows, "child", "parent")


def check_alignment(spark, d):
    a = positions(obs(spark, d), []).select("position", F.col("row_id").cast("string").alias("name"))
    b = a.select("position", F.when(F.col("position") % 1000 == 1, F.lit("moved")).otherwise(F.col("name")).alias("name"))
    return H.alignment_breaks(a, b)


_FUNCTIONS = (filter_eq, filter_not_in, left_join_meta, left_join_filemap, relabel_from_leaf, distinct_meta, rename_cols, drop_cols, drop_all_null, project_canonical, union_relaxed, dq_report, csv_nulls, stage_rows, dedup_precedence, gene_intersection, kway_merge, merge_runs, check_monotonic, check_tree, check_alignment)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_K = "l as (select o_orderkey as row_id, o_orderpriority as cell_type, position - 1 as source_id, row_number() over (partition by o_orderstatus order by o_orderpriority, o_orderkey) - 1 as local_row from (select *, instr('FOP', o_orderstatus)::int as position from orders)), k as (select row_number() over (order by cell_type, source_id, local_row) - 1 as position, source_id, local_row, row_id, cell_type from l)"
ORACLE = {
    "filter_eq": "select c_custkey, c_mktsegment from customer where c_mktsegment = 'BUILDING'",
    "filter_not_in": "select c_custkey, c_mktsegment as segment from customer where c_custkey % 7 <> 0 and c_mktsegment not in ('BUILDING', 'MACHINERY')",
    "left_join_meta": "select c_custkey as kit, c_name, o_orderkey as first_order, o_orderstatus from customer left join (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders) o on o_custkey = c_custkey and n = 1",
    "left_join_filemap": "select c_custkey::varchar as kit, c_mktsegment, (select min('file-' || o_orderkey) from orders where o_custkey = c_custkey and o_orderstatus = 'F') as file_id from customer",
    "relabel_from_leaf": "select c_custkey, n_name as leaf, r_name as parent from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey",
    "distinct_meta": "select o_custkey as kit, o_orderkey as order_id, o_orderpriority from (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders) where n = 1",
    "rename_cols": "select c_custkey as subject_id, c_name as pool_id, regexp_replace(c_name, '0', 'K') as kit, split_part(c_mktsegment, 'I', 1) as seg from customer",
    "drop_cols": "select c_custkey, c_name, c_mktsegment from customer",
    "drop_all_null": "select n_nationkey, case when n_nationkey = 3 then n_name end as little from nation",
    "project_canonical": "select c_mktsegment, c_custkey from customer",
    "union_relaxed": "select c_custkey::varchar as id, c_nationkey::double as nation, c_mktsegment, null::double as s_acctbal from customer union all select 's' || s_suppkey, s_nationkey, null, s_acctbal from supplier",
    "dq_report": "with b as (select d.doc_id, lang, source, quality, toxic from documents d left join labels l on l.doc_id = d.doc_id), r as (select 'doc_id' as \"column\", count(*) filter (where doc_id is null) as nulls, count(*) filter (where doc_id = 0) as zeros from b union all select 'lang', count(*) filter (where lang is null), 0 from b union all select 'source', count(*) filter (where source is null), 0 from b union all select 'quality', count(*) filter (where quality is null), count(*) filter (where quality = 0) from b union all select 'toxic', count(*) filter (where toxic is null), count(*) filter (where toxic = 0) from b) select * from r where nulls > 0 or zeros > 0",
    "csv_nulls": "select c_custkey as id, case when c_custkey % 5 > 1 then c_mktsegment end as seg, case when c_custkey % 7 <> 0 then c_nationkey end as n from customer",
    "stage_rows": "select o_orderkey as row_id, o_orderpriority as cell_type from orders where o_orderkey not in (select l_orderkey from lineitem)",
    "dedup_precedence": "select o_custkey as barcode, o_orderstatus as cohort, o_orderkey from (select *, row_number() over (partition by o_custkey order by instr('POF', o_orderstatus), o_orderkey) as n from orders) where n = 1",
    "gene_intersection": "select l_partkey as var_name from lineitem join orders on o_orderkey = l_orderkey group by 1 having count(distinct o_orderstatus) = 3",
    "kway_merge": f"with {_K} select * from k",
    "merge_runs": f"with {_K}, s as (select source_id, position as start from (select *, lag(source_id) over (order by position) as p from k) where p is distinct from source_id) select row_number() over (order by start) - 1 as run, source_id, start, coalesce(lead(start) over (order by start), (select count(*) from k)) as \"end\" from s",
    "check_monotonic": "with p as (select row_number() over (order by o_orderkey) - 1 as position, o_orderpriority as cell_type, lag(o_orderpriority) over (order by o_orderkey) as b from orders) select position, cell_type from p where cell_type < b",
    "check_tree": "select c_mktsegment as child, count(distinct n_name) as parents from customer join nation on n_nationkey = c_nationkey group by 1 having count(distinct n_name) > 1",
    "check_alignment": "with p as (select row_number() over (order by o_orderkey) - 1 as position, o_orderkey::varchar as name from orders) select position, name as \"left\", 'moved' as \"right\" from p where position % 1000 = 1",
}
