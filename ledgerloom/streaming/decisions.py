"""Human decisions as a stream: each batch is appended to the log, exactly once by its batch number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def decision_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def start_log(stream: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """A batch that is run again overwrites its own partition of the log."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(log)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decisions_per_hour(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts by decision and hour, closed behind the watermark."""
    return stream.withWatermark("reviewed_at", late).groupBy(F.window("reviewed_at", "1 hour"), "decision").agg(F.count(F.lit(1)).alias("n"))
