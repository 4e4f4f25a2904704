"""Items as a stream: files of a landing folder are taken in once each, late and repeated ones included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexloom.functions import text as T
from lexloom.operators.merge import latest, upsert
from lexloom.streaming.store import BucketStore


def ingest(spark: SparkSession, landing: str, schema: StructType, store: str, checkpoint: str, files_per_batch: int | None = None) -> None:
    """Take in what is new in the landing folder and end; ``store`` is kept in buckets, of which a batch writes those it hits.

    The stream's checkpoint is the set of files seen; a batch that is run again leaves the same table.
    """
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(landing)
    table = BucketStore(spark, store, schema, "sprs_id")

    def put(batch: DataFrame, number: int) -> None:
        table.merge(number, latest(batch, "sprs_id", "created_at", "id"), lambda old, new: upsert(old, new, "sprs_id", keep=("id",)))

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, store: str, schema: StructType) -> DataFrame:
    """The table as the last finished batch left it; empty before the first."""
    return BucketStore(spark, store, schema, "sprs_id").read()


def lookback(items: DataFrame, today: str, days: int = 7) -> DataFrame:
    """Items of sittings within so many days before a date."""
    day = T.iso_date(F.col("sitting_date"))
    return items.where((day <= today) & (day >= F.date_format(F.date_sub(F.lit(today).cast("date"), days), "yyyy-MM-dd")))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums per event type and window of event time; rows later than the watermark are left out of a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    out = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with less than the gap between them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def late_events(spark: SparkSession, landing: str, schema: StructType, store: str, checkpoint: str, late: str = "10 minutes", width: str = "1 hour") -> None:
    """Windowed counts of a stream of events, appended when their window is closed; rows behind the watermark are left out.

    Each file of the landing folder is a batch of its own, in the order of their names' times.
    """
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
    out = windowed_counts(events, late, width)
    out.writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
