"""Streams over the same transformations as batch.

Delivery is at least once: a batch that runs again appends rows that readers
collapse by identity, so nothing waits for late data and nothing is dropped.
Rollups are read from deduplicated storage and so equal the batch result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ravelin.functions.text import bucket
from ravelin.operators import overview

DAY_MS = 86_400_000


#: The greatest file of an inbox that is read whole.
MAX_FILE_BYTES = 256 << 20


def accepted(raw: DataFrame, most: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files to read and files that are too large, which are only named: as
    binary files come, with their length and without reading the content."""
    fits = F.col("length") <= most
    return raw.filter(fits), raw.filter(~fits).select("path", "length", F.lit("too large").alias("reason"))


def files(spark: SparkSession, folder: str, done: str | None = None, per_trigger: int = 100) -> DataFrame:
    """Finished text files of an inbox, a row a file (source name from the
    path); taken files move to ``done``."""
    reader = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", per_trigger)
    if done:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", done)
    return reader.load(folder).withColumn("file", F.input_file_name())


def kafka(spark: SparkSession, servers: str, topic: str, per_trigger: int = 100_000) -> DataFrame:
    """Records of a topic, bounded per trigger (needs the Kafka connector)."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", per_trigger).option("failOnDataLoss", "false").load()


def store(events: DataFrame, folder: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Append events, partitioned by receipt day and sorted for range scans.
    Copies within a batch are collapsed; copies across batches when read."""

    def write(batch: DataFrame, _: int) -> None:
        once = overview.dedupe(batch).withColumn("received_day", bucket(F.col("received"), DAY_MS))
        once.sortWithinPartitions("received_day", "class_uid", "time", "id").write.mode("append").partitionBy("received_day").parquet(folder)

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def read_stored(stored: DataFrame) -> DataFrame:
    """Stored events once each."""
    return overview.dedupe(stored.drop("received_day"))


def detect(events: DataFrame, find, folder: str, checkpoint: str) -> StreamingQuery:
    """Run ``find`` (a frame of findings from a frame of events) on each batch;
    it may read its static side anew each time. Findings carry a stable uid."""

    def write(batch: DataFrame, _: int) -> None:
        find(batch).dropDuplicates(["uid"]).write.mode("append").parquet(folder)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Counts by source and receipt hour as a stream, for dashboards: the
    watermark only bounds state, stored data stay the truth."""
    at = F.timestamp_millis("received")
    return events.withColumn("at", at).withWatermark("at", delay).groupBy("source", F.window("at", "1 hour")).agg(F.count("*").alias("events"), F.max("received").alias("last_received"))


def correlate(rows: DataFrame, keys: list[str], span: str, least: int, slide: str | None = None, delay: str = "1 hour", time_col: str = "time") -> DataFrame:
    """Windows in which rows alike in ``keys`` come at least ``least`` times:
    (keys, from, to, n, first, last). The same for a table and for a stream,
    where a window is reported when the watermark has passed it."""
    at = rows.withColumn("at", F.timestamp_millis(time_col))
    if rows.isStreaming:
        at = at.withWatermark("at", delay)
    counted = at.groupBy(*keys, F.window("at", span, slide or span).alias("w")).agg(F.count("*").alias("n"), F.min(time_col).alias("first"), F.max(time_col).alias("last"))
    return counted.filter(F.col("n") >= least).select(*keys, F.unix_millis("w.start").alias("from"), F.unix_millis("w.end").alias("to"), "n", "first", "last")


def sessions(rows: DataFrame, keys: list[str], gap: str, delay: str = "1 hour", time_col: str = "time") -> DataFrame:
    """Runs of rows alike in ``keys`` without a pause of ``gap``: (keys, first,
    last, n). The same for a table and for a stream; a table's rows without a
    time are a run of their own, which a stream, waiting for times, leaves out."""
    at = rows.withColumn("at", F.timestamp_millis(time_col))
    when, timeless = F.col("at"), []
    if rows.isStreaming:
        at = at.withWatermark("at", delay)
    else:
        when, timeless = F.coalesce("at", F.timestamp_millis(F.lit(0))), [F.isnull("at").alias("__timeless")]
    # a session window goes on at a pause of exactly its gap
    window = F.session_window(when, f"{gap} -1 microseconds").alias("session_window")
    return at.groupBy(*keys, *timeless, window).agg(F.min(time_col).alias("first"), F.max(time_col).alias("last"), F.count("*").alias("n")).drop("session_window", "__timeless")


def rematch(stored: DataFrame, ranges: DataFrame, find, folder: str) -> int:
    """Run ``find`` on stored events whose receipt lies in ``ranges`` (lo, hi),
    which detection skipped; overlapping ranges are joined first. Findings carry
    a stable uid, so those that were there collapse when read."""
    todo = overview.merge_ranges(ranges.withColumn("all", F.lit(1)), "all").collect()  # few: one for each outage
    for r in todo:
        find(overview.received_between(read_stored(stored), r.lo, r.hi)).dropDuplicates(["uid"]).write.mode("append").parquet(folder)
    return len(todo)


def topic(spark: SparkSession, folder: str, schema, per_trigger: int = 100) -> DataFrame:
    """A topic on disk as a stream: the Parquet files that ``publish`` appends."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def publish(rows: DataFrame, folder: str, checkpoint: str | None = None) -> StreamingQuery | None:
    """Append rows to a topic on disk; with a stream, as it comes."""
    if not rows.isStreaming:
        rows.write.mode("append").parquet(folder)
        return None
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", folder).trigger(availableNow=True).start()


def to_kafka(rows: DataFrame, servers: str, topic_name: str, checkpoint: str) -> StreamingQuery:
    """Write (key, value) rows to a topic (needs the Kafka connector)."""
    return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic_name).option("checkpointLocation", checkpoint).start()
