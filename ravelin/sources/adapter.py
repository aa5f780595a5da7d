"""The driver's tables as frames of the event model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.text import epoch_ms

#: Event classes by the table's event types.
CLASSES = {"signup": 3001, "error": 2004, "click": 4002, "view": 6003}
OTHER_CLASS = 1007


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive_uids(events: DataFrame) -> DataFrame:
    """category and type from class and activity."""
    return events.withColumns(
        {
            "category_uid": F.floor(F.col("class_uid") % 100000 / 1000).cast("int"),
            "type_uid": F.col("class_uid").cast("bigint") * 100 + F.col("activity_id"),
        }
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat event rows: typed key columns beside the promoted hot paths."""
    raw = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    cls = F.lit(OTHER_CLASS)
    for name, uid in CLASSES.items():
        cls = F.when(kind == name, uid).otherwise(cls)
    out = raw.select(
        F.col("event_id").alias("id"),
        epoch_ms(F.col("ts")).alias("time"),
        (epoch_ms(F.col("ts")) + F.col("event_id") % 7 * 1000).alias("received"),
        cls.alias("class_uid"),
        (F.col("event_id") % 5 + 1).cast("int").alias("activity_id"),
        F.when(kind == "error", 4).when(kind == "purchase", 2).otherwise(1).alias("severity_id"),
        F.concat(F.lit("host-"), (F.col("user_id") % 20).cast("string")).alias("host"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user_name"),
        F.concat_ws(".", F.lit("10"), F.lit("0"), (F.col("user_id") % 8).cast("string"), (F.col("event_id") % 256).cast("string")).alias("src_ip"),
        kind.alias("source"),
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        "props",
    )
    return derive_uids(out)


#: The same frame in DuckDB.
EVENTS_SQL = """ev AS (SELECT *, (class_uid % 100000 // 1000)::INT AS category_uid, class_uid::BIGINT * 100 + activity_id AS type_uid FROM (
  SELECT event_id AS id, epoch_ns(ts) // 1000000 AS time, epoch_ns(ts) // 1000000 + event_id % 7 * 1000 AS received,
    (CASE event_type WHEN 'signup' THEN 3001 WHEN 'error' THEN 2004 WHEN 'click' THEN 4002 WHEN 'view' THEN 6003 ELSE 1007 END)::INT AS class_uid,
    (event_id % 5 + 1)::INT AS activity_id, (CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 2 ELSE 1 END)::INT AS severity_id,
    'host-' || (user_id % 20) AS host, 'user' || user_id AS user_name, '10.0.' || (user_id % 8) || '.' || (event_id % 256) AS src_ip,
    event_type AS source, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props FROM events))"""
