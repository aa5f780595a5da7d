"""Framing, decoding and normalization of records made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.operators.overview import dedupe
from ravelin.plans import normalize as N
from ravelin.sources import decoding as D
from ravelin.sources import feeds
from ravelin.sources.adapter import EVENTS_SQL, events, table

EV = "WITH " + EVENTS_SQL
NOW = 1_706_700_000_000

#: A definition over records of the events table: three kinds, the rest is dead.
SOURCE = N.load(
    {
        "name": "shop",
        "version": 1,
        "nil": ["-"],
        "unmapped": ["who", "props", "."],
        "kinds": [
            {"name": "fault", "when": {"type": "error"}, "class": 2004, "fields": {"finding.score": {"from": "value", "as": "integer"}, "actor.user.name": "who.user", "src_endpoint.ip": {"from": "net.ip", "as": "ip"}, "time": {"from": "at", "as": "unix-seconds"}, "status": {"from": "who.group", "map": {"g0": "low", "g1": "high"}}}},
            {"name": "visit", "when": {"type": "view"}, "class": 6003, "fields": {"actor.user.name": "who.user", "src_endpoint.ip": {"from": "net.ip", "as": "ip"}, "web.k": {"from": "props.k", "as": "integer"}, "product": {"constant": "shop"}}},
            {"name": "buy", "when": {"type": "purchase", "who.group": "g1"}, "class": 1007, "fields": {"actor.user.name": "who.user", "evidences.0.data": "note", "evidences.1.data": "who.group"}},
        ],
    }
)


def _records(spark, d, broken=True):
    """Each event as a raw JSON record; some are broken, some have no kind."""
    e = events(spark, d)
    obj = F.to_json(
        F.struct(
            F.col("source").alias("type"),
            F.struct(F.col("user_name").alias("user"), F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("group")).alias("who"),
            F.when(F.col("id") % 13 == 0, "not-an-ip").otherwise(F.col("src_ip")).alias("net.ip"),
            F.concat(F.floor(F.col("time") / 1000).cast("string"), F.lit("."), F.lpad((F.col("time") % 1000).cast("string"), 3, "0")).alias("at"),
            F.round("value").cast("int").cast("string").alias("value"),
            F.struct(F.col("k").alias("k")).alias("props"),
            F.when(F.col("id") % 4 == 0, "-").otherwise(F.concat(F.lit("n"), F.col("k").cast("string"))).alias("note"),
            F.col("severity_id").alias("extra"),
        )
    )
    return e.select("id", F.when(F.lit(broken) & (F.col("id") % 50 == 0), F.substring(obj, 1, 20)).otherwise(obj).alias("record"))


def _normalized(spark, d):
    return N.normalize(_records(spark, d), SOURCE)


OUT_SQL = EV + """, o AS (SELECT *, CASE WHEN id % 50 = 0 THEN 'decoding' WHEN source IN ('error', 'view') OR (source = 'purchase' AND id % 3 = 1) THEN NULL ELSE 'mapping' END AS stage FROM ev)"""


def _text_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("value"))


def _csv_lines(spark, d):
    p = table(spark, d, "part")
    q = F.lit('"')
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), F.concat(q, F.col("p_name"), F.lit(', "" x'), q), "p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(""))
    return p.select("p_partkey", F.when(F.col("p_partkey") % 100 == 0, F.concat(line, F.lit(',1,"open'))).otherwise(line).alias("line"))


def _audit(spark, d):
    """Two lines an event that come apart, and a line without a key."""
    e = events(spark, d)
    far = e.agg(F.max("id")).first()[0] + 1
    key = F.concat(F.lit("msg=audit("), F.floor(F.col("time") / 1000).cast("string"), F.lit(".123:"), F.col("id").cast("string"), F.lit("): "))
    one = F.concat(F.lit("type=SYSCALL "), key, F.lit("exe="), F.hex("user_name"), F.lit(" uid="), F.col("k").cast("string"), F.lit(' comm="'), F.col("source"), F.lit('"'))
    two = F.concat(F.lit("type=PATH "), key, F.lit("item=0 name="), F.hex("host"))
    return e.select((F.col("id") % 10).alias("file"), F.explode(F.array(F.struct(F.col("id").alias("pos"), one.alias("line")), F.struct((F.col("id") + far).alias("pos"), two.alias("line")), F.struct((F.col("id") + 2 * far).alias("pos"), F.when(F.col("id") % 100 == 0, "junk").alias("line")))).alias("x")).select("file", "x.*").filter("line is not null")


def _audit_decoded(spark, d):
    rows = D.frame_audit(_audit(spark, d), "file").filter("dead is null").withColumn("j", D.decode_auditd(F.col("record")))
    g = lambda p: F.get_json_object("j", p)
    return rows.select(g("$.serial").cast("bigint").alias("id"), g("$.SYSCALL.exe").alias("exe"), g("$.SYSCALL.comm").alias("comm"), g("$.SYSCALL.uid").cast("bigint").alias("uid"), g("$['PATH.0'].name").alias("path"))


def _syslog(spark, d):
    e = events(spark, d)
    at = F.timestamp_add("MILLISECOND", F.floor(F.col("time") / 1000) * 1000, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    new = F.concat(F.lit("<"), (F.col("k") % 24 * 8 + F.col("severity_id")).cast("string"), F.lit(">1 "), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z "), F.col("host"), F.lit(" app "), F.col("id").cast("string"), F.lit(' - [x@1 a="b"] '), F.concat(F.lit('{"user":"'), F.col("user_name"), F.lit('"}')))
    old = F.concat(F.lit("<"), (F.col("k") % 24 * 8 + F.col("severity_id")).cast("string"), F.lit(">"), F.date_format(at, "MMM"), F.lit(" "), F.lpad(F.date_format(at, "d"), 2, " "), F.lit(" "), F.date_format(at, "HH:mm:ss"), F.lit(" "), F.col("host"), F.lit(" app["), F.col("id").cast("string"), F.lit("]: "), F.concat(F.lit('{"user":"'), F.col("user_name"), F.lit('"}')))
    return e.select("id", F.when(F.col("id") % 2 == 0, new).otherwise(old).alias("line"))


def _syslog_decoded(spark, d):
    return _syslog(spark, d).withColumn("s", D.decode_syslog(F.col("line"), NOW))


SYSLOG_SQL = f"{EV} SELECT id, (k % 24)::INT AS facility, severity_id AS severity, time // 1000 * 1000 AS time, host, 'app' AS app, id::VARCHAR AS pid"


def _otlp(spark, d):
    e = events(spark, d)
    log = F.struct(F.when(F.col("id") % 2 == 0, "0").otherwise((F.col("time") * 1_000_000).cast("string")).alias("timeUnixNano"), (F.col("time") * 1_000_000).cast("string").alias("observedTimeUnixNano"), F.col("severity_id").alias("severityNumber"), F.lit("").alias("severityText"), F.struct(F.col("user_name").alias("stringValue")).alias("body"), F.lit("").alias("traceId"))
    per = e.groupBy("host", "source").agg(F.collect_list(log).alias("logRecords")).groupBy("host").agg(F.collect_list(F.struct(F.struct(F.col("source").alias("name")).alias("scope"), "logRecords")).alias("scopeLogs"))
    return per.select(F.to_json(F.struct(F.array(F.struct(F.struct(F.col("host").alias("host")).alias("resource"), "scopeLogs")).alias("resourceLogs"))).alias("value"))


def _joined_records(spark, d):
    """Records of a host one after the other; one host's last is broken."""
    r = _records(spark, d, broken=False).select((F.col("id") % 40).alias("file"), "id", "record")
    return r.groupBy("file").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "record"))), lambda x: x["record"]), " "), F.when(F.col("file") % 4 == 0, '{"cut').otherwise("")).alias("value"))


def _framed_syslog(spark, d):
    """Messages of a host: by octet count for even hosts, by line for odd."""
    s = _syslog(spark, d).select((F.col("id") % 40).alias("file"), "id", F.concat("line", F.when(F.col("id") % 3 == 0, " é 中 🎉").otherwise("")).alias("line"))
    one = F.when(F.col("file") % 2 == 0, F.concat(F.octet_length("line").cast("string"), F.lit(" "), F.col("line"))).otherwise(F.concat("line", F.lit("\n")))
    return s.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", one.alias("m")))), lambda x: x["m"]), "").alias("value"))


def _stix(spark, d):
    p = table(spark, d, "part")
    pattern = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("[url:value = 'http://x' AND file:size = 3]"))).otherwise(F.concat(F.lit("[domain-name:value = 'n"), F.col("p_partkey").cast("string"), F.lit(".example' OR file:hashes.'SHA-256' = '"), F.sha2("p_name", 256), F.lit("']")))
    obj = F.struct(F.lit("indicator").alias("type"), F.lit("stix").alias("pattern_type"), pattern.alias("pattern"), (F.col("p_size") == 7).alias("revoked"), F.col("p_size").alias("confidence"), F.lit("2024-01-01T00:00:00Z").alias("valid_from"))
    return p.groupBy((F.col("p_partkey") % 16).alias("b")).agg(F.to_json(F.struct(F.lit("bundle").alias("type"), F.collect_list(obj).alias("objects"))).alias("bundle")).select("bundle")


def _indicators(spark, d):
    """Parts as rows of a list whose kinds, confidences and times stand in columns."""
    p, n = table(spark, d, "part"), F.col("p_size") % 4
    value = F.when(n == 0, F.concat(F.lit("N"), F.col("p_partkey").cast("string"), F.lit("[.]Example"))).when(n == 1, F.concat(F.lit("10.0.0."), F.when(F.col("p_size") % 8 == 1, F.col("p_partkey") % 200).otherwise(999).cast("string"))).otherwise(F.upper(F.sha2("p_name", 256)))
    word = F.element_at(F.array(F.lit("host"), F.lit("addr"), F.lit("file"), F.lit("other")), (n + 1).cast("int"))
    rows = p.select(value.alias("v"), word.alias("k"), F.when(F.col("p_size") > 45, F.col("p_size") * 3).otherwise(F.col("p_size")).cast("string").alias("c"), (F.col("p_partkey") + 1704067200).cast("string").alias("t"), F.col("p_brand").alias("l"))
    feed = feeds.Feed("list", "v", kind_column="k", kinds={"host": "domain", "addr": "ip", "file": "sha256"}, confidence_column="c", first_seen="t", label="l", valid_days=10)
    return feeds.indicators(rows, feed, 0).drop("last_seen")


def _context(spark, d):
    s = table(spark, d, "supplier")
    rows = s.select(F.col("s_suppkey"), F.concat(F.col("s_name"), F.lit("; alias"), F.col("s_suppkey").cast("string")).alias("names"), F.element_at(F.array(F.lit("Low"), F.lit("HIGH"), F.lit("3"), F.lit("odd")), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("rank"), F.element_at(F.array(F.lit("Yes"), F.lit("0"), F.lit("maybe")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("is_active"))
    return feeds.context_rows(rows, "names", ";", F.col("rank")).select("s_suppkey", F.explode("ids").alias("name"), "criticality", feeds.flag(F.col("is_active")).alias("active"))


def _coerced(how: str, make):
    return lambda spark, d: events(spark, d).select("id", N.coerce(make(), how).alias("v"))


def _iso(offset: str):
    at = F.timestamp_add("MILLISECOND", F.col("time"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.when(F.col("id") % 3 == 0, "").otherwise(offset))


QUERIES = {
    "frame_lines": (lambda spark, d: D.frame_lines(_text_lines(spark, d)).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars")), r"SELECT doc_id, count(*) AS lines, sum(length(l))::BIGINT AS chars FROM (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '\r$', '') AS l FROM documents) WHERE trim(l) <> '' GROUP BY 1"),
    "frame_json_values": (lambda spark, d: D.frame_json_values(_joined_records(spark, d)).groupBy("file").agg(F.count("record").alias("records"), F.count("dead").alias("dead")), f"{EV} SELECT id % 40 AS file, count(*) AS records, CASE WHEN id % 40 % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS dead FROM ev GROUP BY ALL"),
    "frame_syslog": (lambda spark, d: D.frame_syslog(_framed_syslog(spark, d)).groupBy("file").agg(F.count("record").alias("records"), F.count("dead").alias("dead"), F.sum((F.startswith("record", F.lit("<")) & F.endswith("record", F.lit("🎉"))).cast("bigint")).alias("marked")), f"{EV} SELECT id % 40 AS file, count(*) AS records, 0::BIGINT AS dead, sum((id % 3 = 0)::INT)::BIGINT AS marked FROM ev GROUP BY ALL"),
    "frame_audit": (lambda spark, d: D.frame_audit(_audit(spark, d), "file").groupBy("file").agg(F.count("record").alias("records"), F.count("dead").alias("dead")), f"{EV} SELECT id % 10 AS file, count(*) AS records, sum((id % 100 = 0)::INT)::BIGINT AS dead FROM ev GROUP BY 1"),
    "decode_json": (lambda spark, d: _records(spark, d).withColumn("v", F.try_parse_json("record")).select("id", F.col("v").isNotNull().alias("good"), F.try_variant_get("v", "$.who.user", "string").alias("user")), f"{EV} SELECT id, id % 50 <> 0 AS good, CASE WHEN id % 50 <> 0 THEN user_name END AS \"user\" FROM ev"),
    "decode_auditd": (_audit_decoded, f"{EV} SELECT id, user_name AS exe, source AS comm, k AS uid, host AS path FROM ev"),
    "decode_syslog": (lambda spark, d: _syslog_decoded(spark, d).select("id", "s.facility", "s.severity", "s.time", "s.host", "s.app", "s.pid"), f"{SYSLOG_SQL} FROM ev"),
    "decode_syslog_json": (lambda spark, d: _syslog_decoded(spark, d).select("id", F.try_variant_get(F.try_parse_json(F.col("s.message")), "$.user", "string").alias("user")), f"{EV} SELECT id, user_name AS \"user\" FROM ev"),
    "decode_csv": (lambda spark, d: D.decode_csv(_csv_lines(spark, d), ["key", "name", "brand", "size"]).drop("line"), """SELECT p_partkey, CASE WHEN p_partkey % 100 <> 0 THEN p_partkey::VARCHAR END AS key, CASE WHEN p_partkey % 100 <> 0 THEN p_name || ', " x' END AS name, CASE WHEN p_partkey % 100 <> 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 100 <> 0 AND p_size % 2 = 0 THEN p_size::VARCHAR END AS size, CASE WHEN p_partkey % 100 = 0 THEN 'malformed' END AS error FROM part"""),
    "unwrap_batch": (lambda spark, d: _records(spark, d, broken=False).groupBy((F.col("id") % 30).alias("b")).agg(F.concat(F.lit('{"records":['), F.array_join(F.collect_list("record"), ","), F.lit("]}")).alias("batch")).select(F.explode(D.unwrap(F.col("batch"), "records")).alias("r")).select(F.get_json_object("r", "$.who.user").alias("user")).groupBy("user").agg(F.count("*").alias("n")), f"{EV} SELECT user_name AS \"user\", count(*) AS n FROM ev GROUP BY 1"),
    "otlp_flatten": (lambda spark, d: D.otlp_flatten(_otlp(spark, d)).select(F.get_json_object("resource", "$.host").alias("host"), F.get_json_object("scope", "$.name").alias("scope"), "time_ns", "severity", "body"), f"{EV} SELECT host, source AS scope, time * 1000000 AS time_ns, severity_id AS severity, user_name AS body FROM ev"),
    "source_path": (lambda spark, d: _records(spark, d).withColumn("v", F.try_parse_json("record")).select("id", N.source_path(F.col("v"), "net.ip").alias("ip"), N.source_path(F.col("v"), "who.group").alias("g")), f"{EV} SELECT id, CASE WHEN id % 50 = 0 THEN NULL WHEN id % 13 = 0 THEN 'not-an-ip' ELSE src_ip END AS ip, CASE WHEN id % 50 <> 0 THEN 'g' || (id % 3) END AS g FROM ev"),
    "kind_router": (lambda spark, d: _normalized(spark, d).select("id", "kind"), f"{OUT_SQL} SELECT id, CASE WHEN stage IS NULL THEN CASE source WHEN 'error' THEN 'fault' WHEN 'view' THEN 'visit' ELSE 'buy' END END AS kind FROM o"),
    "field_copy": (lambda spark, d: _normalized(spark, d).filter("kind is not null").select("id", F.get_json_object("event", "$.actor.user.name").alias("user")), f"{OUT_SQL} SELECT id, user_name AS \"user\" FROM o WHERE stage IS NULL"),
    "normalize_events": (lambda spark, d: _normalized(spark, d).filter("class_uid = 1007").select("id", "event"), f"""{OUT_SQL} SELECT id, '{{"actor":{{"user":{{"name":"' || user_name || '"}}}},"evidences":[{{' || CASE WHEN id % 4 = 0 THEN '' ELSE '"data":"n' || k || '"' END || '}},{{"data":"g1"}}]}}' AS event FROM o WHERE stage IS NULL AND class_uid = 1007"""),
    "translate_map": (lambda spark, d: _normalized(spark, d).filter("kind = 'fault'").select("id", F.get_json_object("event", "$.status").alias("status")), f"{OUT_SQL} SELECT id, CASE id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS status FROM o WHERE stage IS NULL AND source = 'error'"),
    "issues": (lambda spark, d: _normalized(spark, d).filter("kind is not null").select("id", F.explode("issues").alias("i")).select("id", "i.*"), f"{OUT_SQL} SELECT id, 'src_endpoint.ip' AS target, 'net.ip' AS source, 'no ip' AS reason FROM o WHERE stage IS NULL AND id % 13 = 0 AND source IN ('error', 'view') UNION ALL SELECT id, 'status', 'who.group', 'not listed' FROM o WHERE stage IS NULL AND id % 3 = 2 AND source = 'error'"),
    "unmapped_rest": (lambda spark, d: _normalized(spark, d).filter("kind in ('visit', 'fault')").select("id", *[F.get_json_object("unmapped", f"$['{m}']").alias(n) for m, n in (("extra", "extra"), ("note", "note"), ("group", "group"), ("k", "k"), ("who", "who"), ("net.ip", "ip"))]), f"""{OUT_SQL} SELECT id, severity_id::VARCHAR AS extra, CASE WHEN id % 4 = 0 THEN '-' ELSE 'n' || k END AS note, CASE WHEN source = 'view' OR id % 3 = 2 THEN 'g' || (id % 3) END AS "group",
      CASE WHEN source = 'error' THEN k::VARCHAR END AS k, '{{"group":"g' || (id % 3) || '","user":"' || user_name || '"}}' AS who, CASE WHEN id % 13 = 0 THEN 'not-an-ip' END AS ip FROM o WHERE stage IS NULL AND source IN ('view', 'error')"""),
    "nil_values": (lambda spark, d: _normalized(spark, d).filter("kind = 'buy'").select("id", F.get_json_object("event", "$.evidences[0].data").alias("note")), f"{OUT_SQL} SELECT id, CASE WHEN id % 4 <> 0 THEN 'n' || k END AS note FROM o WHERE stage IS NULL AND source = 'purchase'"),
    "dead_letters": (lambda spark, d: _normalized(spark, d).filter("stage is not null").groupBy("stage", "error").agg(F.count("*").alias("n")), f"{OUT_SQL} SELECT stage, CASE stage WHEN 'decoding' THEN 'not JSON' ELSE 'no kind fits' END AS error, count(*) AS n FROM o WHERE stage IS NOT NULL GROUP BY ALL"),
    "outcome_rows": (lambda spark, d: dedupe(_normalized(spark, d).join(events(spark, d).select("id", "time", "received"), "id").filter("stage is null").withColumn("time", F.coalesce("time", "received"))).select("id", "class_uid", "time"), f"{OUT_SQL} SELECT id, CASE source WHEN 'error' THEN 2004 WHEN 'view' THEN 6003 ELSE 1007 END::INT AS class_uid, time FROM o WHERE stage IS NULL"),
    "coerce_string": (_coerced("string", lambda: F.col("k").cast("string")), f"{EV} SELECT id, k::VARCHAR AS v FROM ev"),
    "coerce_integer": (_coerced("integer", lambda: F.when(F.col("id") % 3 == 0, F.concat(F.lit("0x"), F.lower(F.hex("id")))).when(F.col("id") % 3 == 1, F.concat(F.lit(" "), F.col("id").cast("string"))).otherwise("1.5")), f"{EV} SELECT id, CASE WHEN id % 3 < 2 THEN id END AS v FROM ev"),
    "coerce_timestamp": (_coerced("timestamp", lambda: _iso("+01:00")), f"{EV} SELECT id, CASE WHEN id % 3 <> 0 THEN time - 3600000 END AS v FROM ev"),
    "coerce_utc_timestamp": (_coerced("utc-timestamp", lambda: _iso("-02:00")), f"{EV} SELECT id, CASE WHEN id % 3 <> 0 THEN time + 7200000 ELSE time END AS v FROM ev"),
    "coerce_unix_seconds": (_coerced("unix-seconds", lambda: F.concat(F.floor(F.col("time") / 1000).cast("string"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("."), F.lpad((F.col("time") % 1000).cast("string"), 3, "0"), F.lit("999"))).otherwise(".5"))), f"{EV} SELECT id, CASE WHEN id % 2 = 0 THEN time ELSE time // 1000 * 1000 + 500 END AS v FROM ev"),
    "coerce_ip": (_coerced("ip", lambda: F.element_at(F.array(F.col("src_ip"), F.concat(F.lit("2001:db8::"), F.lower(F.hex("k"))), F.concat("src_ip", F.lit(".1")), F.lit("1:2:3:4:5:6:7:8:9")), (F.col("id") % 4 + 1).cast("int"))), f"{EV} SELECT id, CASE id % 4 WHEN 0 THEN src_ip WHEN 1 THEN '2001:db8::' || lower(to_hex(k)) END AS v FROM ev"),
    "fingerprints": (lambda spark, d: table(spark, d, "part").select("p_partkey", F.explode(N.fingerprints(F.concat(F.lit("MD5="), F.md5("p_name"), F.lit(", sha256="), F.sha2("p_name", 256), F.lit(",junk")))).alias("f")).select("p_partkey", "f.*"), "SELECT p_partkey, 'MD5' AS algorithm, md5(p_name) AS value FROM part UNION ALL SELECT p_partkey, 'SHA256', sha256(p_name) FROM part"),
    "derive_uids": (lambda spark, d: events(spark, d).select("id", "category_uid", "type_uid"), f"{EV} SELECT id, category_uid, type_uid FROM ev"),
    "validate_event": (lambda spark, d: events(spark, d).select("id", N.validate(F.col("time"), F.col("class_uid"), F.col("activity_id"), F.when(F.col("id") % 9 == 0, 1).otherwise(F.col("type_uid")), F.col("category_uid"), F.col("k"), F.when(F.col("id") % 2 == 0, 50), F.when(F.col("id") % 11 != 0, "1.5.0")).alias("good")), f"{EV} SELECT id, id % 9 <> 0 AND id % 11 <> 0 AND (id % 2 = 1 OR k <= 50) AS good FROM ev"),
    "record_id": (lambda spark, d: table(spark, d, "documents").select("doc_id", N.record_id(F.col("source"), F.col("text")).alias("record_id")), "SELECT doc_id, substring(sha256(length(source) || ':' || source || text), 1, 32) AS record_id FROM documents"),
    "feed_csv": (lambda spark, d: feeds.feed_csv(table(spark, d, "part").select(F.explode(F.array(F.lit("# list"), F.concat(F.lit(" n"), F.col("p_partkey").cast("string"), F.lit(' , "'), F.col("p_name"), F.lit('" ,')))).alias("line")), ["host", "label", "none"]), "SELECT 'n' || p_partkey AS host, p_name AS label, NULL::VARCHAR AS none FROM part"),
    "feed_indicators": (_indicators, "SELECT 'list' AS feed, CASE p_size % 4 WHEN 0 THEN 'domain' WHEN 1 THEN 'ip' WHEN 2 THEN 'sha256' END AS kind, CASE p_size % 4 WHEN 0 THEN 'n' || p_partkey || '.example' WHEN 1 THEN CASE WHEN p_size % 8 = 1 THEN '10.0.0.' || (p_partkey % 200) END ELSE sha256(p_name) END AS value, p_brand AS label, CASE WHEN p_size > 45 THEN p_size * 3 ELSE p_size END AS confidence, 1704067200 + p_partkey AS first_seen, 1704067200 + p_partkey AS valid_from, 1704067200 + p_partkey + 864000 AS valid_until, (p_size % 4 = 1 AND p_size % 8 <> 1) OR (p_size > 45 AND p_size * 3 > 100) AS rejected FROM part WHERE p_size % 4 < 3"),
    "feed_stix": (lambda spark, d: feeds.feed_stix(_stix(spark, d)).select("kind", "value", "confidence"), "SELECT 'domain' AS kind, 'n' || p_partkey || '.example' AS value, p_size::INT AS confidence FROM part WHERE p_size % 5 <> 0 AND p_size <> 7 UNION ALL SELECT 'sha256', sha256(p_name), p_size::INT FROM part WHERE p_size % 5 <> 0 AND p_size <> 7"),
    "context_load": (_context, "SELECT s_suppkey, unnest([s_name, 'alias' || s_suppkey]) AS name, (CASE s_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 3 END)::INT AS criticality, CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS active FROM supplier"),
}
