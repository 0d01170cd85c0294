"""Scalar rules over whole tables: casts, strings, conditions, numbers and awkward column names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shapes import first_part, replace_first, slug, strip_space
from ..operators import harmonize as H
from ..session import table


def cast_types(spark, d):
    """Strings, unsigned 16-bit numbers (out of range is null) and categories as codes of sorted names."""
    c = table(spark, d, "customer")
    code = F.array_position(F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))), F.col("c_mktsegment")) - 1
    small = F.when(F.col("c_custkey").between(0, 65535), F.col("c_custkey").cast("int"))
    return c.select(F.col("c_custkey").cast("string").alias("id"), small.alias("u16"), F.when(F.col("c_custkey") * 1000 <= 65535, F.col("c_custkey").cast("int") * 1000).alias("u16_big"), code.cast("long").alias("code"))


def first_match_replaced(spark, d):
    """The first match only, of a literal."""
    c = table(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit("-"), "p_brand").alias("twice"))
    return c.select("p_partkey", replace_first(F.col("twice"), "Brand", "KT").alias("kit"))


def split_first(spark, d):
    return table(spark, d, "orders").select("o_orderkey", first_part(F.col("o_orderpriority"), "-").alias("rank"))


def stripped(spark, d):
    """All white space at both ends, not blanks only."""
    return table(spark, d, "nation").select("n_nationkey", strip_space(F.concat(F.lit("\t \n"), "n_name", F.lit(" \r\n"))).alias("name"))


def when_otherwise(spark, d):
    """A null condition takes the other branch."""
    seg = F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", F.when(seg == "BUILDING", "yes").otherwise("no").alias("building"))


def membership(spark, d):
    """Membership and its negation where the value may be null: both are null then."""
    seg = F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    inside = seg.isin("BUILDING", "MACHINERY")
    return table(spark, d, "customer").select("c_custkey", inside.alias("inside"), (~inside).alias("outside"))


def null_and_zero_counts(spark, d):
    seg = F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    c = table(spark, d, "customer").select(seg.alias("s"), (F.col("c_custkey") % 3).alias("n"))
    return c.agg(F.sum(F.col("s").isNull().cast("long")).alias("nulls"), F.sum((F.col("n") == 0).cast("long")).alias("zeros"), F.count("s").alias("present"))


def constants(spark, d):
    return table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.lit("v1").alias("version"), F.lit(2.5).alias("weight"))


def slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", slug(F.concat(F.lit("/"), "p_name", F.lit(" (x)?"))).alias("slug"), slug(F.lit("///")).alias("nothing"))


def clamped_logs(spark, d):
    """log2 between bounds, of finite values only."""
    v = F.when(F.col("event_id") % 9 == 0, F.lit(float("inf"))).when(F.col("event_id") % 9 == 1, F.lit(float("nan"))).otherwise(F.abs("value") + 0.001)
    e = table(spark, d, "events").select("event_id", v.alias("v"))
    finite = ~F.isnan("v") & (F.abs("v") < float("inf"))
    return e.select("event_id", finite.alias("finite"), F.round(F.when(finite, F.least(F.lit(10.0), F.greatest(F.lit(-2.0), F.log2(F.when(finite, F.col("v")))))), 6).alias("zoom"))


def rounded(spark, d):
    return table(spark, d, "events").select("event_id", F.round(F.col("value") * 7, 4).alias("v4"))


def path_names(spark, d):
    """The base name of a path, and a shape as text."""
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("u"))
    return p.select("page_id", F.element_at(F.split("u", "/"), -1).alias("base"), F.array_join(F.array(F.col("page_id").cast("string"), F.lit("64")), " x ").alias("shape"))


def number_functions(spark, d):
    v = F.abs("value")
    return table(spark, d, "events").select("event_id", F.round(F.log1p(v), 6).alias("log1p"), F.round(F.expm1(F.log1p(v)), 6).alias("back"), F.round(F.sqrt(v), 6).alias("sqrt"))


def sample_variance(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.var_samp("value"), 6).alias("var"), F.round(F.stddev_samp("value"), 6).alias("sd"))


def dotted_columns(spark, d):
    """Columns with dots in their names, renamed, dropped and selected."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("subject.subjectGuid"), F.col("c_mktsegment").alias("cohort.cohortGuid"), F.col("c_name").alias("pipeline.fileGuid"))
    out = H.rename_present(c, {"subject.subjectGuid": "subject_id", "gone.gone": "x"}).drop("pipeline.fileGuid")
    return out.select("subject_id", F.col("`cohort.cohortGuid`").alias("cohort"))


_FUNCTIONS = (cast_types, first_match_replaced, split_first, stripped, when_otherwise, membership, null_and_zero_counts, constants, slugs, clamped_logs, rounded, path_names, number_functions, sample_variance, dotted_columns)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
_SEG = "(case when c_custkey % 5 <> 0 then c_mktsegment end)"
ORACLE = {
    "cast_types": "select c_custkey::varchar as id, case when c_custkey between 0 and 65535 then c_custkey::int end as u16, case when c_custkey * 1000 <= 65535 then (c_custkey * 1000)::int end as u16_big, (list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) - 1)::bigint as code from customer",
    "first_match_replaced": "select p_partkey, regexp_replace(p_brand || '-' || p_brand, 'Brand', 'KT') as kit from part",
    "split_first": "select o_orderkey, string_split(o_orderpriority, '-')[1] as rank from orders",
    "stripped": "select n_nationkey, n_name as name from nation",
    "when_otherwise": f"select c_custkey, case when {_SEG} = 'BUILDING' then 'yes' else 'no' end as building from customer",
    "membership": f"select c_custkey, {_SEG} in ('BUILDING', 'MACHINERY') as inside, {_SEG} not in ('BUILDING', 'MACHINERY') as outside from customer",
    "null_and_zero_counts": f"select count(*) filter (where {_SEG} is null) as nulls, count(*) filter (where c_custkey % 3 = 0) as zeros, count({_SEG}) as present from customer",
    "constants": "select r_regionkey as key, 'v1' as version, 2.5::double as weight from region",
    "slugs": "select p_partkey, trim(regexp_replace('/' || p_name || ' (x)?', '[^0-9A-Za-z._-]+', '_', 'g'), '_') as slug, 'subset' as nothing from part",
    "clamped_logs": "select event_id, event_id % 9 not in (0, 1) as finite, case when event_id % 9 not in (0, 1) then round(least(10, greatest(-2, log2(abs(value) + 0.001))), 6) end as zoom from events",
    "rounded": "select event_id, round(value * 7, 4) as v4 from events",
    "path_names": "select page_id, string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1] as base, page_id || ' x 64' as shape from pages",
    "number_functions": "select event_id, round(ln(1 + abs(value)), 6) as log1p, round(abs(value), 6) as back, round(sqrt(abs(value)), 6) as sqrt from events",
    "sample_variance": "select event_type, round(var_samp(value), 6) as var, round(stddev_samp(value), 6) as sd from events group by 1",
    "dotted_columns": "select c_custkey as subject_id, c_mktsegment as cohort from customer",
}
