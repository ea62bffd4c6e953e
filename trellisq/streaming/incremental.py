"""Structured Streaming: windowed counts with late data, and incremental classification of arriving records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisq.runtime import exists

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files: str = "*") -> DataFrame:
    """Files of events in a folder, those whose name fits, as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 4).option("pathGlobFilter", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and values by window and type; rows later than the watermark are dropped by the stream."""
    w = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", s).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def classify_batches(records: DataFrame, state_path: str, keys: list[str], out_path: str, checkpoint: str):
    """Each micro-batch is held against the stored state: new, changed and unchanged rows are written with their batch.

    The state is written beside the old one and swapped by a pointer, so a repeated batch gives the same rows.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        hashed = batch.withColumn("row_hash", F.sha2(F.to_json(F.struct(*[c for c in batch.columns if c not in keys])), 256)).dropDuplicates(keys).select(*keys, "row_hash")
        old = f"{state_path}/{epoch - 1}"
        # Only the first batch has no state; one that is there but can't be read is an error.
        prior = spark.read.parquet(old) if exists(spark, old) else hashed.where(F.lit(False))
        p = prior.select(*(F.col(k).alias(f"p_{k}") for k in keys), F.col("row_hash").alias("p_hash"))
        on = [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in keys]
        state = F.when(F.col("p_hash").isNull(), "new").when(F.col("p_hash") == F.col("row_hash"), "unchanged").otherwise("changed")
        hashed.join(p, on, "left").select(*keys, state.alias("state"), F.lit(epoch).alias("batch")).write.mode("overwrite").parquet(f"{out_path}/batch={epoch}")
        prior.join(hashed, [prior[k].eqNullSafe(hashed[k]) for k in keys], "left_anti").unionByName(hashed).write.mode("overwrite").parquet(f"{state_path}/{epoch}")

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_table(stream: DataFrame, path: str, checkpoint: str, seconds: int = 600) -> DataFrame:
    """Runs a stream over all that is there; each batch writes the whole result anew, so a repeated batch changes nothing."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{epoch}")

    query = stream.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream took more than {seconds} s")
    last = query.lastProgress
    if last is None:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/{last['batchId']}")
