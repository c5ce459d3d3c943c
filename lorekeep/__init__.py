"""Governed document memory on PySpark: DataFrame operators for curated text corpora."""
__version__ = "0.1.0"
