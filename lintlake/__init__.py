"""lintlake: static analysis of stored web documents as Spark DataFrames."""

__version__ = "0.1.0"
