"""The event log as a stream: new files of events are folded into the store batch by batch. Batch replay gives the same state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspan.names import file_of, name_of
from quillspan.operators.changefeed import DELETE, PUT, MergeStore


def follow(spark: SparkSession, folder: str, schema, checkpoint: str, store: MergeStore) -> StreamingQuery:
    """Appends each batch of events to a merge store of the files that are there; stops when all that has arrived is read.

    The store takes repeated and out-of-order events, so a batch that runs again after a failure changes nothing.
    """
    def fold(batch: DataFrame, _: int) -> None:
        kind = name_of("event_type")
        store.append(batch.select(file_of("fileid").alias("fileid"), "seq", F.when(kind == "file_ingested", PUT).when(kind == "file_removed", DELETE).alias("op"), F.col("session_id").alias("set_by")).filter("fileid is not null"))

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_store(spark: SparkSession) -> MergeStore:
    return MergeStore(spark, ["fileid"], ["seq"], "op", ["set_by"])


def per_window(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per window and kind, for a stream or a batch; a stream drops what is later than ``late``."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    at = at.withWatermark("ts", late) if events.isStreaming else at
    return at.groupBy(F.window("ts", width).alias("w"), name_of("event_type").alias("event_type")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
