"""Time series, top lists, rollups and store upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions.text import bucket


def series(events: DataFrame, step_ms: int, *keys: str) -> DataFrame:
    """Counts by time bucket and keys."""
    return events.groupBy(bucket(F.col("time"), step_ms).alias("bucket"), *keys).agg(F.count("*").alias("n"))


def top(events: DataFrame, key: str, limit: int) -> DataFrame:
    """The most frequent values; equal counts by value."""
    return events.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(limit)


def top_series(events: DataFrame, key: str, limit: int, step_ms: int) -> DataFrame:
    """The series of the most frequent values only. The list of them has
    ``limit`` rows, so it is broadcast."""
    return series(events.join(F.broadcast(top(events, key, limit).select(key)), key, "left_semi"), step_ms, key)


def hourly(events: DataFrame, hour_ms: int = 3_600_000) -> DataFrame:
    """(source, hour, events, last_received)."""
    return events.groupBy("source", bucket(F.col("received"), hour_ms).alias("hour")).agg(F.count("*").alias("events"), F.max("received").alias("last_received"))


def merge_rollups(*parts: DataFrame) -> DataFrame:
    """Partial rollups as one: sums of counts, the latest receipt."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("source", "hour").agg(F.sum("events").alias("events"), F.max("last_received").alias("last_received"))


def dedupe(events: DataFrame) -> DataFrame:
    """One of each event within its receipt day. Copies share day, class, time
    and id, so a filter on these may run first."""
    return events.withColumn("received_day", bucket(F.col("received"), 86_400_000)).dropDuplicates(["received_day", "class_uid", "time", "id"])


#: Days that tables are kept, by the time of their rows.
KEPT_DAYS = {"events": 365, "claims": 365, "rollups": 35, "reports": 1}


def retain_table(rows: DataFrame, table: str, now_ms: int, time_col: str, days: dict[str, int] | None = None) -> DataFrame:
    """Whole days of a table within its own retention; a table that is not named is an error."""
    kept = (days or KEPT_DAYS)[table]
    return rows.filter(bucket(F.col(time_col), 86_400_000) >= now_ms // 86_400_000 * 86_400_000 - kept * 86_400_000)


def retain(events: DataFrame, now_ms: int, days: int) -> DataFrame:
    """Whole receipt days within the retention."""
    return events.filter(bucket(F.col("received"), 86_400_000) >= now_ms // 86_400_000 * 86_400_000 - days * 86_400_000)


def received_between(events: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    return events.filter((F.col("received") >= from_ms) & (F.col("received") < to_ms))


def lookup(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Each cursor (time, id) with the event there; the event's columns are null
    where there is none. Equal cursors and copies of an event count once."""
    return cursors.select("time", "id").distinct().join(events.dropDuplicates(["time", "id"]), ["time", "id"], "left")


def latest_per(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each group, by an aggregate that combines map-side."""
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rows.columns if c not in (*keys, order)])).alias("r")).select(*keys, "r.*")


def newest_version(rows: DataFrame) -> DataFrame:
    """Rows of the greatest complete version."""
    return rows.join(F.broadcast(rows.agg(F.max("version").alias("version"))), "version", "left_semi")


def publish_version(rows: DataFrame, folder: str, version: int, keep: int = 3) -> None:
    """Write a new version of a table beside the old ones: its rows, then a row
    that says it is complete, so that a reader never sees half of it; then all
    but the newest ``keep`` complete versions go."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{folder}/rows/version={version}")
    spark.createDataFrame([(version,)], "version long").write.mode("append").parquet(f"{folder}/complete")
    complete = sorted({r.version for r in spark.read.parquet(f"{folder}/complete").collect()}, reverse=True)  # a number a run
    jvm = spark.sparkContext._jvm  # noqa: SLF001 - there is no public way to a file system
    for old in complete[keep:]:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/rows/version={old}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001


def read_version(spark: SparkSession, folder: str) -> DataFrame:
    """The newest complete version of a table."""
    newest = spark.read.parquet(f"{folder}/complete").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{folder}/rows/version={newest}").withColumn("version", F.lit(newest))


def merge_ranges(ranges: DataFrame, *keys: str) -> DataFrame:
    """Ranges [lo, hi) that overlap or touch, as one each."""
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("new", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0))
    return marked.withColumn("island", F.sum("new").over(w)).groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def replace_feed(old: DataFrame, new: DataFrame, feed: str) -> DataFrame:
    """A feed's rows replaced as a whole; a row that was there keeps its
    ``added``, also an unknown one."""
    kept = old.filter(F.col("feed") == feed).select("kind", "value", F.col("added").alias("was"), F.lit(True).alias("known"))
    fresh = new.join(kept, ["kind", "value"], "left").withColumn("added", F.when(F.col("known"), F.col("was")).otherwise(F.col("added")))
    return old.filter(F.col("feed") != feed).unionByName(fresh.select(old.columns))
