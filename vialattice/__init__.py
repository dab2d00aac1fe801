"""Lane-behaviour analytics expressed as Spark DataFrame and SQL plans."""

__version__ = "0.1.0"
