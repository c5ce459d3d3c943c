"""Parquet that keeps arriving, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files in a folder, or of one file (which streams read by its folder and name)."""
    schema = spark.read.parquet(path).schema
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)
