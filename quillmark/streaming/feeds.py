"""Streams: the activity log, and snapshots that arrive in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..operators import snapshot
from ..sinks import tables as sinks
from ..sources import tables
from ..sources.schemas import ACTIVITY, POSTING


def activity_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events as they are appended, with time and type; repeats within an hour are dropped."""
    events = spark.readStream.schema(ACTIVITY).option("mode", "DROPMALFORMED").json(folder)
    events = events.withColumns({"ts": F.to_timestamp("timestamp"), "activity_type": text.activity_type(F.col("action"))})
    return events.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["timestamp", "action", "subject"])


def activity_counts(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """Events per window and type; rows late by over an hour are left out."""
    return events.groupBy(F.window("ts", window), "activity_type").agg(F.count("*").alias("n"))


def snapshot_stream(spark: SparkSession, folder: str, state: str, changes: str, checkpoint: str) -> StreamingQuery:
    """Every batch of posting files is one run: its changes are appended, the history replaced.

    A batch that is delivered again overwrites the changes of its own number.
    """

    def run(batch: DataFrame, number: int) -> None:
        history = snapshot.with_role_keys(spark.read.parquet(state)) if tables.exists(spark, state) else spark.createDataFrame([], snapshot.HISTORY)
        found = snapshot.detect_changes(batch, history)
        sinks.json_lines(found.changes, f"{changes}/batch={number}")
        sinks.state(found.history, state)

    stream = spark.readStream.schema(POSTING).option("maxFilesPerTrigger", 1).json(folder)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
