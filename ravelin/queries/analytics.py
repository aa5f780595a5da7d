"""Search, paging, overview, rollups and health over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.operators import health, overview
from ravelin.operators.search import Filter, Schema, Search, findings_queue, matching, page
from ravelin.queries import ingest
from ravelin.sources import generator
from ravelin.sources.adapter import EVENTS_SQL, events, table
from ravelin.streaming import jobs

DAY = 86_400_000
START = 1_704_067_200_000  # 2024-01-01
NOW = START + 29 * DAY + 7 * 3_600_000
EV = "WITH " + EVENTS_SQL


def _search(filters: list[Filter], where: str, classes: list[int] | None = None, days: tuple[int, int] = (3, 25)):
    s = Search(START + days[0] * DAY, START + days[1] * DAY, classes or [], filters)
    cond = f"time >= {s.from_ms} AND time < {s.to_ms}" + (f" AND class_uid IN ({', '.join(map(str, classes))})" if classes else "") + (f" AND ({where})" if where else "")
    return lambda spark, d: matching(events(spark, d), s).select("id", "time"), f"{EV} SELECT id, time FROM ev WHERE {cond}"


def _partial(spark, d):
    """A frame with gaps, so that missing values are met."""
    return events(spark, d).withColumn("value", F.when(F.col("id") % 7 != 0, F.col("value"))).withColumn("host", F.when(F.col("id") % 11 != 0, F.col("host")))


GAPS = EV + ", e AS (SELECT * REPLACE (CASE WHEN id % 7 <> 0 THEN value END AS value, CASE WHEN id % 11 <> 0 THEN host END AS host) FROM ev)"


def _gaps(filters, where):
    s = Search(START, START + 30 * DAY, [], filters)
    return lambda spark, d: matching(_partial(spark, d), s).select("id"), f"{GAPS} SELECT id FROM e WHERE time >= {s.from_ms} AND time < {s.to_ms} AND ({where})"


def _searchable(spark, d):
    """Normalized events with their time."""
    return ingest._normalized(spark, d).filter("stage is null").join(events(spark, d).select("id", "time"), "id")


def _inner(filters, where, classes=None):
    """A search of paths within events and of what they left."""
    s = Search(START, START + 30 * DAY, classes or [], filters)
    own = f" AND class_uid IN ({', '.join(map(str, classes))})" if classes else ""
    return lambda spark, d: matching(_searchable(spark, d), s, Schema.of([ingest.SOURCE])).select("id"), f"{ingest.OUT_SQL} SELECT id FROM o WHERE stage IS NULL AND time >= {START} AND time < {START + 30 * DAY}{own} AND ({where})"


PAGE = Search(START, START + 30 * DAY, [2004, 3001], [], 50)


def _next_page(spark, d):
    last = page(events(spark, d), PAGE).agg(F.min(F.struct("time", "id")).alias("x")).first().x
    return page(events(spark, d), Search(PAGE.from_ms, PAGE.to_ms, PAGE.classes, [], 50, (last.time, last.id))).select("id", "time")


PAGE_SQL = f"SELECT id, time FROM ev WHERE time >= {PAGE.from_ms} AND time < {PAGE.to_ms} AND class_uid IN (2004, 3001) ORDER BY time DESC, id DESC LIMIT 50"


def _dead(spark, d):
    """Dead letters: events whose value is too low to be one."""
    return events(spark, d).filter("value < 2")


HOURS_SQL = "SELECT source, received // 3600000 * 3600000 AS hour, count(*) AS events, max(received) AS last_received FROM {} GROUP BY ALL"


def _twice(spark, d):
    e = events(spark, d)
    return e.unionByName(e.filter("id % 3 = 0").withColumn("received", F.col("received")))


def _health(spark, d):
    return health.source_health(overview.hourly(events(spark, d)), overview.hourly(_dead(spark, d)), NOW)


HEALTH_SQL = f"""{EV}, h AS ({HOURS_SQL.format("ev")}), x AS ({HOURS_SQL.format("(SELECT * FROM ev WHERE value < 2)")}),
  l AS (SELECT {NOW} // 3600000 * 3600000 - 3600000 AS last),
  per AS (SELECT source, min(hour) AS first, max(last_received) AS seen, coalesce(sum(events) FILTER (hour = (SELECT last FROM l)), 0)::BIGINT AS last_hour FROM h GROUP BY source),
  cal AS (SELECT source, (SELECT last FROM l) - k * {DAY} AS hour FROM per, range(1, 8) t(k) WHERE (SELECT last FROM l) - k * {DAY} >= first),
  base AS (SELECT cal.source, count(*) AS n, floor(median(coalesce(h.events, 0)))::BIGINT AS mid FROM cal LEFT JOIN h ON h.source = cal.source AND h.hour = cal.hour GROUP BY cal.source),
  j AS (SELECT per.source, last_hour, seen, CASE WHEN n >= 3 THEN mid END AS baseline, coalesce((SELECT sum(events) FROM x WHERE x.source = per.source AND x.hour = (SELECT last FROM l)), 0)::BIGINT AS dead FROM per LEFT JOIN base USING (source))
  SELECT source, CASE WHEN dead >= 10 AND dead * 100 >= last_hour + dead THEN 'rejecting' WHEN seen IS NULL THEN 'waiting' WHEN {NOW} - seen > 3600000 THEN 'silent'
    WHEN baseline >= 20 AND last_hour * 4 < baseline THEN 'low' WHEN baseline >= 20 AND last_hour > baseline * 4 THEN 'high' WHEN baseline IS NOT NULL THEN 'ok' ELSE 'learning' END AS status, last_hour, baseline, dead FROM j"""


def _runs(spark, d):
    o = table(spark, d, "orders")
    at = T.epoch_ms(F.col("o_orderdate")) / DAY
    return o.select(F.col("o_orderpriority").alias("role"), at.cast("bigint").alias("started"), (at + F.col("o_orderkey") % 9).cast("bigint").alias("received"))


RUNS_SQL = f"r AS (SELECT o_orderpriority AS role, epoch_ms(o_orderdate) // {DAY} AS started, epoch_ms(o_orderdate) // {DAY} + o_orderkey % 9 AS received FROM orders)"


def _reports(spark, d):
    e = events(spark, d)
    return e.select(F.create_map(F.concat(F.lit("backlog:raw:"), F.col("source"), F.lit(":"), F.col("host")), F.col("k"), F.lit("sent"), F.col("id")).alias("counters"))


def _platform(spark, d):
    """Roles are event types, instances hosts; conditions come from values."""
    e = events(spark, d)
    inst = overview.latest_per(e.select("source", "host", "received", "value", "activity_id"), ["source", "host"], "received")
    per = inst.groupBy("source").agg(
        F.sum((F.col("received") > NOW - DAY).cast("int")).alias("reporting"),
        F.sum((F.col("value") > 95).cast("int")).alias("failing"),
        F.max("activity_id").alias("starts"),
        F.sum((F.col("value") > 60).cast("int")).alias("degraded"),
        F.count("*").alias("running"),
    )
    state = health.role_state(F.col("reporting"), F.col("failing"), F.col("starts"), F.col("degraded"), F.col("running"), F.lit(20))
    return per.select("source", "reporting", "failing", state.alias("state"))


def _customer_runs(spark, d):
    """Every order as a range of days of its customer, with gaps between them."""
    at = F.floor(T.epoch_ms(F.col("o_orderdate")) / DAY).cast("bigint")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("who"), at.alias("lo"), (at + F.col("o_orderkey") % 60 + 1).alias("hi"))


def _findings_next(spark, d):
    """The page after the first one, by the key of its last row."""
    last = findings_queue(events(spark, d)).agg(F.min(F.struct("severity_id", "time", "id")).alias("x")).first().x
    return findings_queue(events(spark, d), after=(last.severity_id, last.time, last.id)).select("id", "severity_id", "time")


def _by_cursor(spark, d):
    """The first event of each user by its place, and a place without an event."""
    first = events(spark, d).groupBy("user_name").agg(F.min(F.struct("time", "id")).alias("c")).select("c.*")
    none = spark.createDataFrame([(7, 1)], "time long, id long")
    return overview.lookup(events(spark, d), first.unionByName(none)).select("id", "time", "source", "severity_id")


def _drawn(spark, d):
    return generator.telemetry(events(spark, d), 60, START, 4.0).select("id", "user", "product", "time", F.get_json_object("record", "$.properties.userId").alias("uid"))


LIMITS = ", ".join(map(repr, generator.zipf_limits(60)))
DRAWN_SQL = f"""{EV}, u AS (SELECT id, ('0x' || md5('1:user:' || id)[1:8])::BIGINT / 4294967296.0 AS a, ('0x' || md5('1:product:' || id)[1:8])::BIGINT / 4294967296.0 AS b FROM ev),
  r AS (SELECT id, len(list_filter([{LIMITS}], lambda x: x <= a))::INT AS "user", CASE WHEN b < 0.6 THEN 'sysmon' WHEN b < 0.75 THEN 'entra' ELSE 'suricata' END AS product FROM u)
  SELECT id, "user", product, {START} + floor(id * 1000 / 4.0)::BIGINT AS time, CASE WHEN product = 'entra' THEN 'oid-' || "user" END AS uid FROM r"""

QUERIES = {
    "search_time_range": _search([], "", None, (5, 8)),
    "search_class": _search([], "", [2004, 4002]),
    "search_equals": _search([Filter("host", "equals", "HOST-7")], "lower(host) = 'host-7'"),
    "search_not_equals": _gaps([Filter("host", "not_equals", "host-7")], "coalesce(lower(host) <> 'host-7', true)"),
    "search_contains": _search([Filter("user_name", "contains", "R1")], "contains(lower(user_name), 'r1')", [2004, 3001]),
    "search_starts_with": _search([Filter("src_ip", "starts_with", "10.0.3.")], "starts_with(src_ip, '10.0.3.')"),
    "search_ends_with": _search([Filter("src_ip", "ends_with", ".77")], "ends_with(src_ip, '.77')"),
    "search_in": _search([Filter("activity_id", "in", [1, 4])], "activity_id IN (1, 4)", [6003]),
    "search_range": _search([Filter("k", "gte", 20), Filter("k", "lt", 40)], "k >= 20 AND k < 40"),
    "search_exists": _gaps([Filter("value", "exists"), Filter("host", "exists")], "value IS NOT NULL AND host IS NOT NULL"),
    "search_missing": _gaps([Filter("value", "missing")], "value IS NULL"),
    "search_float": _search([Filter("value", "gt", 50)], "value > 50"),
    "search_unmapped": _inner([Filter("unmapped.extra", "in", [2, 4]), Filter("unmapped.note", "not_equals", "-")], "severity_id IN (2, 4) AND id % 4 <> 0"),
    "search_unmapped_text": _inner([Filter("unmapped.extra", "equals", "4")], "false"),
    "search_nested": _inner([Filter("actor.user.name", "starts_with", "USER1"), Filter("web.k", "gte", 50)], "starts_with(user_name, 'user1') AND k >= 50", [6003]),
    "search_object": _inner([Filter("src_endpoint", "exists"), Filter("finding", "missing")], "source = 'view' AND id % 13 <> 0"),
    "search_page": (lambda spark, d: page(events(spark, d), PAGE).select("id", "time"), f"{EV} SELECT * FROM ({PAGE_SQL})"),
    "search_next_page": (_next_page, f"{EV} SELECT * FROM ({PAGE_SQL} OFFSET 50)"),
    "findings_queue": (lambda spark, d: findings_queue(events(spark, d)).select("id", "severity_id", "time"), f"{EV} SELECT id, severity_id, time FROM ev WHERE class_uid = 2004 ORDER BY severity_id DESC, time DESC, id DESC LIMIT 100"),
    "findings_next": (_findings_next, f"{EV} SELECT id, severity_id, time FROM ev WHERE class_uid = 2004 ORDER BY severity_id DESC, time DESC, id DESC LIMIT 100 OFFSET 100"),
    "event_by_cursor": (_by_cursor, f"{EV}, c AS (SELECT user_name, min({{'time': time, 'id': id}}) AS c FROM ev GROUP BY 1) SELECT id, time, source, severity_id FROM ev JOIN c ON c.time = time AND c.id = id UNION ALL SELECT 1, 7, NULL, NULL"),
    "range_scan_received": (lambda spark, d: overview.received_between(events(spark, d), START + DAY, START + 3 * DAY).select("id", "received"), f"{EV} SELECT id, received FROM ev WHERE received >= {START + DAY} AND received < {START + 3 * DAY}"),
    "severity_facets": (lambda spark, d: events(spark, d).groupBy("severity_id").agg(F.count("*").alias("n")), f"{EV} SELECT severity_id, count(*) AS n FROM ev GROUP BY 1"),
    "top_classes": (lambda spark, d: overview.top(events(spark, d), "class_uid", 3), f"{EV} SELECT class_uid, count(*) AS n FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"),
    "top_hosts": (lambda spark, d: overview.top(events(spark, d), "host", 10), f"{EV} SELECT host, count(*) AS n FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "overview_series": (lambda spark, d: overview.series(events(spark, d), 6 * 3_600_000, "severity_id"), f"{EV} SELECT time // 21600000 * 21600000 AS bucket, severity_id, count(*) AS n FROM ev GROUP BY ALL"),
    "overview_host_series": (lambda spark, d: overview.top_series(events(spark, d), "host", 5, DAY), f"{EV}, t AS (SELECT host FROM ev GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) SELECT time // {DAY} * {DAY} AS bucket, host, count(*) AS n FROM ev WHERE host IN (FROM t) GROUP BY ALL"),
    "dead_letter_count": (lambda spark, d: _dead(spark, d).agg(F.count("*").alias("n")), f"{EV} SELECT count(*) AS n FROM ev WHERE value < 2"),
    "arrivals": (lambda spark, d: overview.received_between(events(spark, d), NOW - DAY, NOW).groupBy(T.bucket(F.col("received"), 1000).alias("second")).agg(F.count("*").alias("n")), f"{EV} SELECT received // 1000 * 1000 AS second, count(*) AS n FROM ev WHERE received >= {NOW - DAY} AND received < {NOW} GROUP BY 1"),
    "source_hours": (lambda spark, d: overview.hourly(events(spark, d)), f"{EV} {HOURS_SQL.format('ev')}"),
    "dead_letter_hours": (lambda spark, d: overview.hourly(_dead(spark, d)), f"{EV} {HOURS_SQL.format('(SELECT * FROM ev WHERE value < 2)')}"),
    "rollup_merge": (lambda spark, d: overview.merge_rollups(*[overview.hourly(events(spark, d).filter(F.col("id") % 3 == k)) for k in range(3)]), f"{EV} {HOURS_SQL.format('ev')}"),
    "source_health": (_health, HEALTH_SQL),
    "dedupe_events": (lambda spark, d: overview.dedupe(_twice(spark, d)).select("id", "time", "class_uid"), f"{EV} SELECT id, time, class_uid FROM ev"),
    "retention": (lambda spark, d: overview.retain(events(spark, d), NOW, 7).select("id"), f"{EV} SELECT id FROM ev WHERE received // {DAY} * {DAY} >= {NOW // DAY * DAY - 7 * DAY}"),
    "latest_per_group": (lambda spark, d: overview.latest_per(events(spark, d).withColumn("at", F.struct("time", "id")), ["source", "host"], "at").select("source", "host", "at.time", "at.id"), f"{EV} SELECT source, host, time, id FROM ev QUALIFY row_number() OVER (PARTITION BY source, host ORDER BY time DESC, id DESC) = 1"),
    "newest_version": (lambda spark, d: overview.newest_version(table(spark, d, "lineitem").withColumn("version", F.col("l_orderkey") % 5).select("version", "l_partkey")).groupBy("version").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("s")), "SELECT l_orderkey % 5 AS version, count(*) AS n, sum(l_partkey)::BIGINT AS s FROM lineitem WHERE l_orderkey % 5 = (SELECT max(l_orderkey % 5) FROM lineitem) GROUP BY 1"),
    "merge_ranges": (lambda spark, d: overview.merge_ranges(_customer_runs(spark, d), "who"), f"WITH x AS (SELECT o_custkey AS who, epoch_ms(o_orderdate) // {DAY} AS lo, epoch_ms(o_orderdate) // {DAY} + o_orderkey % 60 + 1 AS hi FROM orders), m AS (SELECT *, max(hi) OVER (PARTITION BY who ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY who ORDER BY lo, hi) AS island FROM m) SELECT who, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY who, island"),
    "peak_concurrency": (lambda spark, d: health.peak_concurrency(_runs(spark, d), "role"), f"WITH {RUNS_SQL}, e AS (SELECT role, started AS m, 1 AS s FROM r UNION ALL SELECT role, received + 1 AS m, -1 AS s FROM r), a AS (SELECT role, m, sum(s) AS s FROM e GROUP BY ALL), o AS (SELECT role, sum(s) OVER (PARTITION BY role ORDER BY m) AS open FROM a) SELECT role, max(open)::BIGINT AS peak FROM o GROUP BY 1"),
    "condition_intervals": (lambda spark, d: health.intervals(events(spark, d).withColumn("status", F.when(F.col("value") > 40, "bad").otherwise("ok")).withColumn("at", F.col("time") * 100_000 + F.col("id")), ["host"], "at", "status"), f"{EV}, s AS (SELECT host, time * 100000 + id AS m, CASE WHEN value > 40 THEN 'bad' ELSE 'ok' END AS status FROM ev), mm AS (SELECT s.*, CASE WHEN lag(status) OVER (PARTITION BY host ORDER BY m) = status THEN 0 ELSE 1 END AS new FROM s), g AS (SELECT *, sum(new) OVER (PARTITION BY host ORDER BY m) AS run FROM mm) SELECT host, status, min(m) AS since, max(m) AS until, count(*) AS n FROM g GROUP BY host, run, status"),
    "rolling_hour": (lambda spark, d: health.rolling_sum(events(spark, d).groupBy("source", T.bucket(F.col("time"), 60_000).alias("minute")).agg(F.count("*").alias("n")), ["source"], "minute", "n", 3_600_000).select("source", "minute", "rolling"), f"{EV}, m AS (SELECT source, time // 60000 * 60000 AS minute, count(*) AS n FROM ev GROUP BY ALL) SELECT source, minute, (sum(n) OVER (PARTITION BY source ORDER BY minute RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW))::BIGINT AS rolling FROM m"),
    "backlog_slope": (lambda spark, d: health.slope(events(spark, d).withColumn("x", F.col("time") / 3_600_000.0 - START / 3_600_000), "x", "value", "host").select("host", F.round("slope", 8).alias("slope")), f"{EV} SELECT host, round(regr_slope(value, time / 3600000.0 - {START / 3_600_000}), 8) AS slope FROM ev GROUP BY host"),
    "backlog_growth": (lambda spark, d: events(spark, d).groupBy("host", T.bucket(F.col("time"), 10 * DAY).alias("span")).agg(F.min_by("k", F.struct("time", "id")).alias("first"), F.max_by("k", F.struct("time", "id")).alias("last")).select("host", "span", "first", "last", (F.col("last") > F.col("first")).alias("grew")), f"{EV} SELECT host, time // {10 * DAY} * {10 * DAY} AS span, arg_min(k, time * 1000000 + id) AS first, arg_max(k, time * 1000000 + id) AS last, last > first AS grew FROM ev GROUP BY ALL"),
    "generated_telemetry": (_drawn, DRAWN_SQL),
    "correlate_sliding": (lambda spark, d: jobs.correlate(events(spark, d).filter("source = 'error'"), ["user_name"], "6 hours", 2, "1 hour").select("user_name", "from", "n", "first", "last"), f"{EV}, x AS (SELECT user_name, time, unnest(range(0, 6)) AS j FROM ev WHERE source = 'error') SELECT user_name, time // 3600000 * 3600000 - j * 3600000 AS \"from\", count(*) AS n, min(time) AS first, max(time) AS last FROM x GROUP BY ALL HAVING count(*) >= 2"),
    "sessions": (lambda spark, d: jobs.sessions(events(spark, d), ["user_name"], "3 hours"), f"{EV}, m AS (SELECT user_name, time, CASE WHEN time - lag(time) OVER w < 10800000 THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY user_name ORDER BY time)), g AS (SELECT user_name, time, sum(new) OVER (PARTITION BY user_name ORDER BY time) AS s FROM m) SELECT user_name, min(time) AS first, max(time) AS last, count(*) AS n FROM g GROUP BY user_name, s"),
    "replay_shift": (lambda spark, d: health.replay(events(spark, d), START, 4.0).select("id", "time"), f"{EV} SELECT id, {START} + floor((time - (SELECT min(time) FROM ev)) / 4.0)::BIGINT AS time FROM ev"),
    "histogram_quantile": (lambda spark, d: _quantiles(spark, d), f"""{EV}, b AS (SELECT source, u::DOUBLE AS upper, count(*) FILTER (value <= u) AS count FROM ev, (VALUES (5.0), (20.0), (50.0), (100.0), (100000.0)) t(u) GROUP BY ALL),
      w AS (SELECT *, coalesce(lag(count) OVER p, 0) AS below, coalesce(lag(upper) OVER p, 0.0) AS lower, max(count) OVER (PARTITION BY source) * 0.95 AS rank FROM b WINDOW p AS (PARTITION BY source ORDER BY upper))
      SELECT source, round(arg_min(lower + (upper - lower) * (rank - below) / (count - below), upper), 6) AS value FROM w WHERE count >= rank AND count > below GROUP BY source"""),
    "platform_flows": (lambda spark, d: health.flows(_reports(spark, d)), f"{EV} SELECT 'raw:' || source AS topic, host AS reader, max(k) AS backlog FROM ev GROUP BY ALL"),
    "platform_health": (_platform, f"""{EV}, i AS (SELECT source, host, received, value, activity_id FROM ev QUALIFY row_number() OVER (PARTITION BY source, host ORDER BY received DESC, value DESC, activity_id DESC) = 1),
      p AS (SELECT source, sum((received > {NOW - DAY})::INT)::BIGINT AS reporting, sum((value > 95)::INT)::BIGINT AS failing, max(activity_id) AS starts, sum((value > 60)::INT) AS degraded, count(*) AS running FROM i GROUP BY 1)
      SELECT source, reporting, failing, CASE WHEN reporting = 0 OR failing > 0 THEN 'failing' WHEN starts > 3 THEN 'restarting' WHEN degraded > 0 THEN 'degraded' WHEN running < 20 THEN 'fewer_instances' ELSE 'ok' END AS state FROM p"""),
}


def _quantiles(spark, d):
    e = events(spark, d).select("source", "value")
    edges = F.array(*[F.lit(x) for x in (5.0, 20.0, 50.0, 100.0, 100000.0)])
    b = e.select("source", "value", F.explode(edges).alias("upper")).groupBy("source", "upper").agg(F.sum((F.col("value") <= F.col("upper")).cast("bigint")).alias("count"))
    return health.quantile(b, 0.95, "source").select("source", F.round("value", 6).alias("value"))
