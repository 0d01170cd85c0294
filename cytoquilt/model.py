"""The annotated matrix: a sparse matrix of cells by genes with the tables that belong to its axes, all lazy."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import ingest, layout, preprocess, select
from .operators.ingest import sort_positions, sorted_matrix


@dataclass(frozen=True)
class AnnMatrix:
    """obs has row_id, var has col_id; X and layers are triplets (row_id, col_id, value); a view has no X."""

    obs: DataFrame
    var: DataFrame | None = None
    x: DataFrame | None = None
    layers: dict[str, DataFrame] = field(default_factory=dict)
    obsm: dict[str, DataFrame] = field(default_factory=dict)
    varm: dict[str, DataFrame] = field(default_factory=dict)
    obsp: dict[str, DataFrame] = field(default_factory=dict)
    varp: dict[str, DataFrame] = field(default_factory=dict)
    uns: dict = field(default_factory=dict)
    raw: AnnMatrix | None = None

    def subset(self, **wanted) -> AnnMatrix:
        """Cells with the wanted metadata, in every table that follows the cells."""
        kept = select.checked(self.obs, **wanted)
        follow = lambda df: select.by_frame(df, "row_id", kept, "row_id")
        return replace(self, obs=kept, x=follow(self.x) if self.x is not None else None, layers={k: follow(v) for k, v in self.layers.items()}, obsm={k: follow(v) for k, v in self.obsm.items()}, obsp={})

    def sorted(self, keys: list[str], categories: dict[str, list[str]] | None = None) -> AnnMatrix:
        """Rows renumbered in the stable order of the keys; X, layers, obsm, obsp and raw follow."""
        placed = sort_positions(self.obs, keys, categories=categories)
        move = lambda df: df.join(placed.select(F.col("row_id").alias("__r"), "position"), F.col("row_id") == F.col("__r")).drop("row_id", "__r").withColumnRenamed("position", "row_id")

        def both(df: DataFrame) -> DataFrame:
            second = placed.select(F.col("row_id").alias("__r"), F.col("position").alias("__p"))
            return move(df).join(second, F.col("row_id2") == F.col("__r")).drop("row_id2", "__r").withColumnRenamed("__p", "row_id2")

        obs = placed.drop("row_id").withColumnRenamed("position", "row_id")
        x = sorted_matrix(self.x, placed) if self.x is not None else None
        raw = replace(self.raw, obs=obs, x=sorted_matrix(self.raw.x, placed)) if self.raw is not None and self.raw.x is not None else self.raw
        return replace(self, obs=obs, x=x, layers={k: sorted_matrix(v, placed) for k, v in self.layers.items()}, obsm={k: move(v) for k, v in self.obsm.items()}, obsp={k: both(v) for k, v in self.obsp.items()}, raw=raw)

    def genes(self, kept: DataFrame) -> AnnMatrix:
        """Only the kept genes, renumbered without gaps in their old order."""
        new = select.reindexed(self.var, kept).withColumnRenamed("col_id", "__c")
        move = lambda df: df.join(new, F.col("col_id") == F.col("__c")).drop("col_id", "__c").withColumnRenamed("new_id", "col_id")
        shaped = lambda df: move(df).select("row_id", "col_id", "value")
        return replace(self, var=move(self.var), x=shaped(self.x), layers={k: shaped(v) for k, v in self.layers.items()}, varm={k: move(v) for k, v in self.varm.items()}, varp={})

    def rows_layout(self) -> DataFrame:
        return layout.compressed(self.x)

    def columns_layout(self) -> DataFrame:
        return layout.compressed(self.x, "col_id", "row_id")

    def validate(self, **rules) -> list[str]:
        return ingest.validate(self.obs, self.var, self.x is not None, self.uns, tuple(self.obsm), **rules)

    def n_obs(self) -> DataFrame:
        return self.obs.agg(F.count(F.lit(1)).alias("n"))

    def normalized(self) -> AnnMatrix:
        """log1p of totals scaled to their median, unless the values are no raw counts any more."""
        whole = preprocess.is_raw(self.x) or not self.x.where(F.col("value") != F.floor("value")).limit(1).count()
        return replace(self, x=preprocess.log1p(preprocess.normalize_total(self.x))) if whole else self
