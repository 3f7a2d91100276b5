"""Deliveries of new books as a stream of files: each batch goes into the index, and repeats change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.index import deliver


def stream_index(spark: SparkSession, folder: str, schema: str, root: str, checkpoint: str, fields: list[str], gram_fields: list[str]) -> StreamingQuery:
    """Read what has arrived in folder (parquet with book_id, update_id and fields) and add it to the index at root.

    Of each book the newest version counts, whether its versions come in one batch or in several. A batch that runs again
    after a failure changes nothing where the index has its number: the checkpoint's path names the stream.
    """

    def add(batch: DataFrame, number: int) -> None:
        deliver(batch, root, fields, gram_fields, checkpoint, number)

    arrived = spark.readStream.schema(schema).parquet(folder)
    return arrived.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
