"""semloom: tables to linked data and back, as Spark DataFrame operators."""

__version__ = "0.1.0"
