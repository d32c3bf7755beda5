"""Resumable ingest: a file stream whose rows reach the sink once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ingest_once(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, key: str, files_per_batch: int = 20):
    """Appends the stream's new keys to a Parquet sink and returns the query; a restart adds nothing twice.

    The checkpoint remembers files; the anti join against the sink covers rows
    that come again in another file, and a batch that is run again.
    """

    def append(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates([key])
        try:
            done = spark.read.schema(batch.schema).parquet(sink).select(key)
            new = new.join(done, key, "left_anti")
        except Exception as e:  # the sink does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.select(*batch.columns).write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
