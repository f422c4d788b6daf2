"""Observations as a stream: windowed summaries with late rows, and typed micro-batches into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def summaries(stream: DataFrame, time: str = "ts", variable: str = "variable", value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean, least, greatest and last value of each variable in tumbling windows; rows later than `late` don't count."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width), variable)
    return w.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.max_by(value, time).alias("last")).select(F.col("window.start").alias("start"), variable, "n", "mean", "low", "high", "last")


def into_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has come to Parquet, each micro-batch once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
