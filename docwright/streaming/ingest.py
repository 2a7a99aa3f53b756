"""Optional streams, an addition to the batch engine: documents that arrive as files, and request limits over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import sliding_windows
from ..schemas import DOCUMENT


def incoming_documents(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def chunk_stream(documents: DataFrame, target: str, checkpoint: str):
    """Appends the window chunks of every new document; each batch is a plain DataFrame job."""

    def write(batch: DataFrame, batch_id: int) -> None:
        sliding_windows(batch.select("id", "content")).withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(target)

    return documents.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def limited_requests(events: DataFrame, limit: int = 10, late: str = "2 minutes") -> DataFrame:
    """Requests of each client in each minute, with a watermark for late ones."""
    per = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 minute")).agg(F.count("*").alias("requests"))
    return per.select("user_id", F.col("window.start").alias("minute"), "requests", F.greatest(F.col("requests") - limit, F.lit(0)).alias("rejected"))
