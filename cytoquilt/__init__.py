"""cytoquilt: annotated sparse matrices (cells x genes) as lazy Spark DataFrames."""

__version__ = "0.1.0"
