"""Windowed counts over arriving events (an extension: curation itself has no windows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.arrivals import arriving
from ..storage import shared_path


def hourly(stream: DataFrame, late: str | None = "2 hours") -> DataFrame:
    """start, event_type and n of each hour; events later than ``late`` behind the newest one are dropped, and finished hours leave the state.

    Without ``late`` every event counts, whenever it comes, and the state keeps a row for each hour and type.
    """
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = (timed.withWatermark("ts", late) if late else timed).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def hourly_once(spark: SparkSession, path: str) -> DataFrame:
    """Counts of all that lies at ``path`` now, in whatever order its files come. The last hours are still open when the stream stops, so it is run in update mode and the newest count of each hour is taken."""
    out = shared_path(spark, "hourly")
    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    started = hourly(arriving(spark, path), None).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", shared_path(spark, "hourly-state")).trigger(availableNow=True).start()
    started.awaitTermination()
    rows = spark.read.schema("start timestamp_ntz, event_type string, n long, batch int").parquet(out)
    return rows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
