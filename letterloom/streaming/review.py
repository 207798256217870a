"""The review queue and event counts as streams; each equals its batch twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def arrivals(spark: SparkSession, folder: str, schema: T.StructType, per_trigger: int = 1000) -> DataFrame:
    """New Parquet files in a folder, each read once; the checkpoint of the query remembers them."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events by day and type; rows later than the watermark are left out of the stream's result."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def distinct_rows(rows: DataFrame, keys: list[str], time: str, late: str = "2 days") -> DataFrame:
    """Repeated rows once, with a state that the watermark bounds."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process all that is there and stop; ``sink`` gets each batch and its number and must be idempotent by it."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()


def to_files(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch into a folder of its own; a batch that is run again replaces it."""
    return lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/batch={n}")
