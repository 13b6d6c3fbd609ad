"""Incremental ingest: new record files replace their books, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.files import RECORD, replace_books


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, settings: str = "1") -> None:
    """Take in the record files that arrived since the last call; of a book's files in a batch all count.

    A batch is written before the stream commits it, and writing it again gives the same
    partitions, so a failed run is simply repeated. The registry row comes last.
    """

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.filter(~F.coalesce("front_matter", F.lit(False))).withColumn("rec_no", F.expr("try_cast(substring_index(id, '#', -1) AS INT)"))
        if rows.isEmpty():
            return
        replace_books(rows, f"{target}/records")
        done = rows.groupBy("book").agg(F.count(F.lit(1)).alias("records")).withColumn("settings", F.lit(settings)).withColumn("batch", F.lit(number))
        replace_books(done, f"{target}/registry")

    stream = spark.readStream.schema(RECORD).json(source)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
