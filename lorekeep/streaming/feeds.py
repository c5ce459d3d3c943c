"""Feeds and files that keep arriving: each micro-batch goes through the batch operators, whose names and log make a repeated batch harmless."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import feed, provenance
from ..sources.arrivals import arriving
from ..storage import durable, shared_path


def records(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines that arrive in ``folder``; unknown keys are ignored."""
    return spark.readStream.schema(feed.SCHEMA).json(folder)


def ingest(stream: DataFrame, custody: feed.Custody, checkpoint: str, refused: Callable[[DataFrame], None] | None = None, once: bool = False) -> StreamingQuery:
    """Stores each micro-batch as ``feed.ingest`` does; refused records go to ``refused``."""

    def batch(rows: DataFrame, n: int) -> None:
        _, bad = feed.ingest(rows, custody)
        if refused is not None:
            refused(bad)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def unseen(stream: DataFrame, seen_path: str, handle: Callable[[DataFrame], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Hands each file (root_idx, path, sha256, size) whose hash wasn't seen to ``handle``, and adds it to the ledger at ``seen_path`` afterwards.

    A batch that failed half-way is handed over again, so ``handle`` must be idempotent.
    """

    def batch(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(seen_path)
        there = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)
        known = spark.read.schema("sha256 string").parquet(seen_path) if there else spark.createDataFrame([], "sha256 string")
        fresh = durable(provenance.unseen(rows, known.distinct()), "fresh")
        handle(fresh)
        fresh.select("sha256").write.mode("append").parquet(seen_path)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingested_once(spark: SparkSession, path: str) -> DataFrame:
    """The distinct evidence documents of the events at ``path``, by a stream that reads what is there and stops."""
    out = shared_path(spark, "evidence")
    e = arriving(spark, path)
    rows = e.select(
        F.col("event_type").alias("kind"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("work_unit_id"), F.col("event_id").cast("string").alias("source_ref"),
        F.col("props").alias("summary"), F.sha2("props", 256).alias("sha256"),
    )

    def write(batch: DataFrame, n: int) -> None:
        feed.evidence(batch).where("problem is null").select("kind", "work_unit_id", "evidence_sha256").write.mode("overwrite").parquet(f"{out}/batch={n}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", shared_path(spark, "evidence-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("kind string, work_unit_id string, evidence_sha256 string, batch int").parquet(out).dropDuplicates(["evidence_sha256"])
