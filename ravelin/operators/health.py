"""Source health, platform health and measures over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000


def source_health(hours: DataFrame, dead: DataFrame, now_ms: int, silent_after_ms: int = HOUR) -> DataFrame:
    """The state of each source, the first that holds: rejecting, waiting,
    silent, low, high, ok, learning. The baseline is the median of the same
    hour of the seven days before, zero-filled, from the first counted hour on,
    of at least three; an even number gives the integer middle."""
    last = now_ms // HOUR * HOUR - HOUR
    per = hours.groupBy("source").agg(F.min("hour").alias("first"), F.max("last_received").alias("seen"), F.sum(F.when(F.col("hour") == last, F.col("events")).otherwise(0)).alias("last_hour"))
    days = [last - d * 24 * HOUR for d in range(1, 8)]
    counts = hours.filter(F.col("hour").isin(*days)).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("hour", "events"))).alias("by_hour"))
    per = per.join(counts, "source", "left")
    held = F.filter(F.array(*[F.lit(d) for d in days]), lambda h: h >= F.col("first"))
    values = F.array_sort(F.transform(held, lambda h: F.coalesce(F.try_element_at(F.col("by_hour"), h), F.lit(0).cast("bigint"))))
    n = F.size("values")
    mid = F.when(n % 2 == 1, F.get("values", F.floor(n / 2).cast("int"))).otherwise(F.floor((F.get("values", (n / 2).cast("int") - 1) + F.get("values", (n / 2).cast("int"))) / 2))
    gone = dead.filter(F.col("hour") == last).groupBy("source").agg(F.sum("events").alias("dead"))
    out = per.withColumn("values", values).withColumn("baseline", F.when(n >= 3, mid).cast("bigint")).join(gone, "source", "left").withColumn("dead", F.coalesce("dead", F.lit(0)))
    state = (
        F.when((F.col("dead") >= 10) & (F.col("dead") * 100 >= F.col("last_hour") + F.col("dead")), "rejecting")
        .when(F.col("seen").isNull(), "waiting")
        .when(now_ms - F.col("seen") > silent_after_ms, "silent")
        .when((F.col("baseline") >= 20) & (F.col("last_hour") * 4 < F.col("baseline")), "low")
        .when((F.col("baseline") >= 20) & (F.col("last_hour") > F.col("baseline") * 4), "high")
        .when(F.col("baseline").isNotNull(), "ok")
        .otherwise("learning")
    )
    return out.select("source", state.alias("status"), F.col("last_hour").cast("bigint").alias("last_hour"), "baseline", F.col("dead").cast("bigint").alias("dead"))


def peak_concurrency(runs: DataFrame, *keys: str) -> DataFrame:
    """The most runs [started, received] at one time; a run that ended an
    instant before another starts does not meet it."""
    edges = runs.select(*keys, F.col("started").alias("at"), F.lit(1).alias("step")).unionByName(runs.select(*keys, (F.col("received") + 1).alias("at"), F.lit(-1).alias("step")))
    sums = edges.groupBy(*keys, "at").agg(F.sum("step").alias("step"))
    w = Window.partitionBy(*keys).orderBy("at")
    return sums.withColumn("open", F.sum("step").over(w)).groupBy(*keys).agg(F.max("open").cast("bigint").alias("peak"))


def intervals(rows: DataFrame, keys: list[str], at: str, status: str) -> DataFrame:
    """Stretches of one status: (keys, status, since, until, n)."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.when(F.lag(status).over(w).eqNullSafe(F.col(status)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w)).groupBy(*keys, "__run", status).agg(F.min(at).alias("since"), F.max(at).alias("until"), F.count("*").alias("n")).drop("__run")


def rolling_sum(rows: DataFrame, keys: list[str], at: str, value: str, span: int) -> DataFrame:
    """The sum of ``value`` over the last ``span`` of ``at``, its own row included."""
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(-span + 1, 0)
    return rows.withColumn("rolling", F.sum(value).over(w))


def slope(rows: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Least-squares slope; null under three points or without variance."""
    return rows.groupBy(*keys).agg(F.when(F.count("*") >= 3, F.regr_slope(y, x)).alias("slope"))


def replay(events: DataFrame, start_ms: int, speed: float) -> DataFrame:
    """Events on a new clock: the first at ``start_ms``, gaps divided by the speed."""
    first = events.agg(F.min("time").alias("__first")).withColumn("__one", F.lit(1))
    return events.withColumn("__one", F.lit(1)).join(F.broadcast(first), "__one").withColumn("time", (F.lit(start_ms) + F.floor((F.col("time") - F.col("__first")) / speed)).cast("bigint")).drop("__first", "__one")


def quantile(buckets: DataFrame, q: float, *keys: str) -> DataFrame:
    """A quantile from cumulative buckets (upper, count), linear within one."""
    w = Window.partitionBy(*keys).orderBy("upper")
    total = F.max("count").over(Window.partitionBy(*keys))
    b = buckets.withColumn("below", F.coalesce(F.lag("count").over(w), F.lit(0))).withColumn("lower", F.coalesce(F.lag("upper").over(w), F.lit(0.0))).withColumn("rank", total * q)
    hit = b.filter((F.col("count") >= F.col("rank")) & (F.col("count") > F.col("below")))
    value = F.col("lower") + (F.col("upper") - F.col("lower")) * (F.col("rank") - F.col("below")) / (F.col("count") - F.col("below"))
    return hit.withColumn("value", value).groupBy(*keys).agg(F.min_by("value", "upper").alias("value"))


def flows(reports: DataFrame) -> DataFrame:
    """The greatest backlog of each topic and reader over all instances, from
    counters named ``backlog:<topic>:<reader>``; a topic may hold colons."""
    c = reports.select(F.explode("counters").alias("name", "value")).filter(F.col("name").startswith("backlog:"))
    return c.groupBy(F.regexp_extract("name", "^backlog:(.*):([^:]*)$", 1).alias("topic"), F.regexp_extract("name", "^backlog:(.*):([^:]*)$", 2).alias("reader")).agg(F.max("value").alias("backlog"))


def role_state(reporting: Column, failing: Column, starts: Column, degraded: Column, running: Column, peak: Column) -> Column:
    """The state of a role, the first that holds."""
    return F.when(reporting == 0, "failing").when(failing > 0, "failing").when(starts > 3, "restarting").when(degraded > 0, "degraded").when(running < peak, "fewer_instances").otherwise("ok")
