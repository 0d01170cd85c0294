"""The library interface: configuration, conversions and validation under one roof."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .model import AnnMatrix
from .operators.ingest import IngestError as ConversionError
from .operators.ingest import IngestError as ValidationError
from .plans import convert as _convert
from .session import build_session
from .sources.config import AppConfig, load_config
from .sources.config import Grouping as GroupingConfig

__all__ = ["AppConfig", "GroupingConfig", "load_config", "ConversionError", "ValidationError", "convert_h5ad", "convert_10x_h5", "concat_h5ads", "validate", "health"]


def convert_h5ad(source: str, target: str, config: AppConfig | None = None, spark: SparkSession | None = None) -> list[str]:
    """One annotated input (an .h5ad file, a folder, or a store) into a store; returns warnings."""
    return _convert.convert(spark or build_session(), source, target, config)


convert_10x_h5 = convert_h5ad


def concat_h5ads(sources: list[str], target: str, config: AppConfig | None = None, spark: SparkSession | None = None) -> list[str]:
    return _convert.concat(spark or build_session(), sources, target, config)


def validate(ann: AnnMatrix, **rules) -> list[str]:
    return ann.validate(**rules)


def health() -> dict[str, str]:
    return {"status": "ok"}
