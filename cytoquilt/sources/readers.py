"""Readers: tolerant CSV, selections, benchmark runs and triplet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULLS = ("NA", "")


def read_csv(spark: SparkSession, path: str, schema: str, nulls: tuple[str, ...] = NULLS) -> DataFrame:
    """CSV with a header: null tokens, quoted or not, and cells that do not parse are null."""
    fields = spark.createDataFrame([], schema).schema.fields
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path, schema=", ".join(f"`{f.name}` string" for f in fields))
    value = lambda n: F.when(~F.col(f"`{n}`").isin(*nulls), F.col(f"`{n}`"))
    return raw.select(*(value(f.name).try_cast(f.dataType).alias(f.name) for f in fields))


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """(index, name) of a selection file; positions and names run in parallel."""
    one = spark.read.option("multiLine", True).json(path)
    return one.select(F.explode(F.arrays_zip("indices", "barcodes")).alias("s")).select(F.col("s.indices").alias("index"), F.col("s.barcodes").alias("name"))


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Benchmark runs from files that hold one object, an array, or one object per line; `_file` is the base name."""
    text = spark.read.text(path, wholetext=True).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("_file"))
    body = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    listed = F.from_json(body, f"array<struct<{schema}>>")
    single = F.from_json(body, f"struct<{schema}>")
    lines = F.transform(F.filter(F.split(body, r"\r?\n"), lambda x: F.length(F.trim(x)) > 0), lambda x: F.from_json(x, f"struct<{schema}>"))
    several = F.size(F.filter(F.split(body, r"\r?\n"), lambda x: F.trim(x).startswith("{") & F.trim(x).endswith("}"))) > 1
    runs = F.when(body.startswith("["), listed).when(several, lines).otherwise(F.array(single))
    return text.select("_file", F.explode(runs).alias("run")).select("run.*", "_file")


def read_triplets(spark: SparkSession, path: str, sized: bool = True) -> DataFrame:
    """MatrixMarket coordinate files: 1-based places become 0-based triplets; comment lines are left out, and the size line if there is one."""
    lines = spark.read.text(path).where(~F.col("value").startswith("%"))
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(parts.alias("p"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    if sized:
        size = rows.agg(F.min_by("p", F.struct("b", "i")).alias("s"))
        rows = rows.join(size, F.lit(True)).where(~((F.col("p") == F.col("s")) & (F.col("b") == 0) & (F.col("i") == 0)))
    return rows.select((F.col("p")[0].cast("long") - 1).alias("row_id"), (F.col("p")[1].cast("long") - 1).alias("col_id"), F.col("p")[2].cast("double").alias("value"))
