"""An extension beyond batch: records dropped into a folder, processed as they arrive.

Every micro-batch goes through the same DataFrame operators as a batch job. Records loaded twice within
the watermark are counted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, folder: str, schema: str, key: str, arrived: str, late: str = "30 days") -> DataFrame:
    """A stream of the records in a folder of Parquet, each key once within the watermark."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.withWatermark(arrived, late).dropDuplicatesWithinWatermark([key])


def counted(stream: DataFrame, arrived: str, window: str, by: list[str]) -> DataFrame:
    """Records per time window and group, final once the watermark has passed the window."""
    w = F.window(arrived, window)
    return stream.groupBy(w, *by).agg(F.count(F.lit(1)).alias("records")).select(F.col("window.start").alias("from"), F.col("window.end").alias("to"), *by, "records")


def write_batches(stream: DataFrame, process, out: str, checkpoint: str) -> StreamingQuery:
    """Run ``process`` (DataFrame to DataFrame) on each micro-batch and append its result.

    The batch number names the folder it writes, so a batch that is repeated after a failure overwrites itself.
    """

    def each(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
