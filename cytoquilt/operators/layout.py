"""Layouts of the matrix: triplets are the algebra; rows, columns, flat arrays and dense tiles are derived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .positions import running_total

#: Dense cells that one task writes out, about, and tasks at most.
TASK_CELLS, TASKS = 1 << 23, 10_000
#: Columns of a dense slice of a row.
SLICE = 64


def summed(triplets: DataFrame) -> DataFrame:
    """Triplets (row_id, col_id, value) with repeated places added up."""
    return triplets.groupBy("row_id", "col_id").agg(F.sum("value").alias("value"))


def compressed(x: DataFrame, major: str = "row_id", minor: str = "col_id") -> DataFrame:
    """One row per major: (major, indices, data), minors ascending. CSR for rows, CSC for columns."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(minor).alias("i"), F.col("value").alias("v"))))
    return x.groupBy(major).agg(cells.alias("c")).select(major, F.col("c.i").alias("indices"), F.col("c.v").alias("data"))


def triplets(packed: DataFrame, major: str = "row_id", minor: str = "col_id") -> DataFrame:
    """Back from compressed(); a column layout becomes a row layout by way of these."""
    return packed.select(major, F.explode(F.arrays_zip("indices", "data")).alias("c")).select(major, F.col("c.indices").alias(minor), F.col("c.data").alias("value"))


def major_nnz(axis: DataFrame, x: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, nnz) of every major of the axis, empty ones as 0."""
    n = x.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("n"))
    return axis.select(key).join(n, F.col(key) == F.col("__k"), "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("nnz"))


def indptr(nnz: DataFrame, order: str) -> DataFrame:
    """(slot, indptr): cumulative nnz by position, n + 1 slots from 0."""
    ends = running_total(nnz, order, "nnz", "indptr").select((F.col(order) + 1).cast("long").alias("slot"), "indptr")
    return ends.union(nnz.sparkSession.range(1).select(F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("indptr")))


def _gap(cells: Column, e: Column, k: Column) -> Column:
    """Empty places before the k-th of the cells (p, v), which ascend; a place that occurs twice is an error."""
    gap = e["p"] - F.coalesce(F.get(cells, k - 1)["p"], F.lit(-1)) - 1
    return F.when(gap < 0, F.raise_error(F.lit("two values at one place of a dense block")).cast("int")).otherwise(gap)


def _rest(cells: Column, size: Column) -> Column:
    """Empty places after the last of the cells."""
    return size - 1 - F.coalesce(F.get(cells, F.size(cells) - 1)["p"], F.lit(-1))


def filled(cells: Column, size: Column) -> Column:
    """The values of a block of `size` places, of which `cells` (p, v) are in order and all others are zero."""
    runs = F.transform(cells, lambda e, k: F.concat(F.array_repeat(F.lit(0.0), _gap(cells, e, k)), F.array(F.coalesce(e["v"], F.lit(0.0)))))
    return F.concat(F.flatten(runs), F.array_repeat(F.lit(0.0), _rest(cells, size)))


def filled_text(cells: Column, size: Column) -> Column:
    """filled() as whole numbers with commas between them, without a value for every zero: a run of zeros is one repeated text."""
    runs = F.transform(cells, lambda e, k: F.concat(F.repeat(F.lit("0,"), _gap(cells, e, k)), F.coalesce(e["v"], F.lit(0.0)).cast("long").cast("string")))
    first = F.when(F.size(cells) > 0, F.array_join(runs, ",")).when(size > 0, F.lit("0")).otherwise(F.lit(""))
    return F.concat(first, F.repeat(F.lit(",0"), _rest(cells, size) - F.when(F.size(cells) > 0, 0).otherwise(1)))


def _dealt(df: DataFrame, n_cells: int, *key: str) -> DataFrame:
    """Rows dealt out by the dense cells that they become: the sparse cells before are too small to tell."""
    return df.repartition(max(1, min(TASKS, -(-n_cells // TASK_CELLS))), *key)


def _tiled(x: DataFrame, n_rows: int, n_cols: int, row_chunk: int, col_chunk: int) -> DataFrame:
    """(row_block, col_block, n_rows, n_cols, nnz, cells): every tile of the grid with what it holds, in order of place."""
    spark = x.sparkSession
    down, across = -(-n_rows // row_chunk), -(-n_cols // col_chunk)
    grid = spark.range(down * across).select(F.floor(F.col("id") / max(across, 1)).cast("long").alias("row_block"), (F.col("id") % max(across, 1)).alias("col_block"))
    grid = grid.select("row_block", "col_block", F.least(F.lit(row_chunk), n_rows - F.col("row_block") * row_chunk).cast("int").alias("n_rows"), F.least(F.lit(col_chunk), n_cols - F.col("col_block") * col_chunk).cast("int").alias("n_cols"))
    key = [F.floor(F.col("row_id") / row_chunk).alias("rb"), F.floor(F.col("col_id") / col_chunk).alias("cb")]
    wide = F.least(F.lit(col_chunk), n_cols - F.floor(F.col("col_id") / col_chunk) * col_chunk)
    place = ((F.col("row_id") % row_chunk) * wide + F.col("col_id") % col_chunk).cast("int")
    cells = x.where((F.col("row_id") < n_rows) & (F.col("col_id") < n_cols)).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("value").alias("v")))).alias("c"))
    out = grid.join(cells, (F.col("row_block") == F.col("rb")) & (F.col("col_block") == F.col("cb")), "left")
    none = F.array().cast(cells.schema["c"].dataType)
    return _dealt(out.select("row_block", "col_block", "n_rows", "n_cols", F.coalesce("c", none).alias("cells")), n_rows * n_cols, "row_block", "col_block").select("*", F.size("cells").cast("long").alias("nnz"))


def tiles(x: DataFrame, n_rows: int, n_cols: int, row_chunk: int, col_chunk: int) -> DataFrame:
    """(row_block, col_block, n_rows, n_cols, nnz, values): dense tiles of 0-based triplets, edges truncated, zeros filled.

    Every tile of the grid is there. A tile's entries are sorted by place and runs of zeros
    put between them, so the fill takes one pass over the tile in the JVM.
    """
    size = F.col("n_rows") * F.col("n_cols")
    return _tiled(x, n_rows, n_cols, row_chunk, col_chunk).select("row_block", "col_block", "n_rows", "n_cols", "nnz", filled(F.col("cells"), size).alias("values"))


def tiles_text(x: DataFrame, n_rows: int, n_cols: int, row_chunk: int, col_chunk: int) -> DataFrame:
    """tiles() with the values as text of whole numbers."""
    size = F.col("n_rows") * F.col("n_cols")
    return _tiled(x, n_rows, n_cols, row_chunk, col_chunk).select("row_block", "col_block", "n_rows", "n_cols", "nnz", filled_text(F.col("cells"), size).alias("values"))


def tile_counts(x: DataFrame, row_chunk: int, col_chunk: int) -> DataFrame:
    """(row_block, col_block, nnz) of the tiles that hold anything."""
    return x.groupBy(F.floor(F.col("row_id") / row_chunk).cast("long").alias("row_block"), F.floor(F.col("col_id") / col_chunk).cast("long").alias("col_block")).agg(F.count(F.lit(1)).alias("nnz"))


def _row_cells(packed: DataFrame, n_cols: int, first: int = 0) -> DataFrame:
    """(row_id, cells): what compressed rows hold in columns first..first + n_cols - 1; nulls are empty rows."""
    kind = packed.schema["data"].dataType.elementType.simpleString()
    cells = F.zip_with("indices", "data", lambda i, v: F.struct((i - first).alias("p"), v.alias("v")))
    cells = F.array_sort(F.filter(cells, lambda e: (e["p"] >= 0) & (e["p"] < n_cols)).cast(f"array<struct<p:int,v:{kind}>>"))
    return packed.select("row_id", F.coalesce(cells, F.array().cast(f"array<struct<p:int,v:{kind}>>")).alias("cells"))


def dense_rows(packed: DataFrame, n_cols: int, first: int = 0) -> DataFrame:
    """(row_id, values): compressed rows with zeros filled in, columns first..first + n_cols - 1."""
    return _row_cells(packed, n_cols, first).select("row_id", filled(F.col("cells"), F.lit(n_cols)).alias("values"))


def dense_rows_text(packed: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """dense_rows() of about n_rows rows with the values as text of whole numbers."""
    return _dealt(_row_cells(packed, n_cols), n_rows * n_cols, "row_id").select("row_id", filled_text(F.col("cells"), F.lit(n_cols)).alias("values"))


def dense_slices(x: DataFrame, n_cols: int, width: int = SLICE) -> DataFrame:
    """(row_id, slice, values): rows in dense slices of `width` columns. A slice without entries, which is all zeros, is left out."""
    at = F.floor(F.col("col_id") / width).cast("long")
    cell = F.struct((F.col("col_id") % width).cast("int").alias("p"), F.col("value").alias("v"))
    kept = x.where((F.col("col_id") >= 0) & (F.col("col_id") < n_cols)).groupBy("row_id", at.alias("slice")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return kept.select("row_id", "slice", filled(F.col("cells"), F.least(F.lit(width), n_cols - F.col("slice") * width).cast("int")).alias("values"))


def from_slices(slices: DataFrame, width: int = SLICE) -> DataFrame:
    """Triplets of dense slices; zeros are dropped."""
    cells = slices.select("row_id", "slice", F.posexplode("values").alias("p", "value")).where("value <> 0")
    return cells.select("row_id", (F.col("slice") * width + F.col("p")).cast("long").alias("col_id"), "value")


def from_dense(rows: DataFrame, first: int = 0) -> DataFrame:
    """Triplets of dense rows; zeros are dropped."""
    return rows.select("row_id", F.posexplode("values").alias("p", "value")).where("value <> 0").select("row_id", (F.col("p") + first).cast("long").alias("col_id"), "value")


def canonical(x: DataFrame) -> DataFrame:
    """Single-precision values and 32-bit columns, sorted within rows."""
    return compressed(x.select("row_id", F.col("col_id").cast("int").alias("col_id"), F.col("value").cast("float").alias("value")))
