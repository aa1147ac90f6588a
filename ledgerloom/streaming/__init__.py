"""Streaming twins of the batch operators over an event stream (event_id, ts, user_id, event_type, value, props)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(SCHEMA)
    if fs.getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", p.getName()).parquet(str(p.getParent()))


def activity(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n, total): counts and sums by tumbling window; events later than `late` are dropped on a stream."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, finish, n): runs of a user's events without a pause of `gap`."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    return g.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("finish"), "n")


def distinct_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events once each, by id, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def latest_states(events: DataFrame) -> DataFrame:
    """(user_id, state, since, changes): the last event type of each user and how often it changed; batch twin of latest_on_stream."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events.withColumn("was", F.lag("event_type").over(w))
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("since"), F.count_if(F.col("was").isNotNull() & (F.col("was") != F.col("event_type"))).alias("changes"))


def latest_on_stream(events: DataFrame) -> DataFrame:
    """(user_id, state, since): the last state so far, in update or complete mode."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("since"))


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process all that is there and return what the sink holds.

    Checkpoint and output lie in the given folder, which all executors share; a
    restarted query goes on where it stopped.  In complete mode the last result
    replaces the earlier ones.
    """
    spark, out = stream.sparkSession, f"{folder}/out-{uuid.uuid4().hex}"
    w = stream.writeStream.option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
    if mode == "append":
        q = w.outputMode("append").format("parquet").option("path", out).start()
    else:
        q = w.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
