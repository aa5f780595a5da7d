"""Rule modifiers and multi-rule evaluation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.plans import mappings, normalize, sigma
from ravelin.sources import definitions
from ravelin.sources.adapter import EVENTS_SQL, events, table

PART = sigma.Fields({"name": ["p_name"], "type": ["p_type"], "brand": ["p_brand"], "any": ["p_name", "p_type"], "size": ["p_size"], "price": ["p_retailprice"]}, ["p_name", "p_type", "p_brand"], ascii_only=True)
PAGE = sigma.Fields({"url": ["url"], "html": ["html"]}, ["url", "html"])
TALK = sigma.Fields({"role": ["role"], "text": ["text"], "turn": ["turn"]}, ["role", "text"])
EVENT = sigma.Fields({"user": ["user_name"], "host": ["host"], "kind": ["source"], "value": ["value"], "k": ["k"], "address": ["src_ip"], "class": ["class_uid"], "flag": ["flag"], "id": ["id"]}, ["user_name", "host", "source", "src_ip"], ascii_only=True)


def _rule(detection: dict) -> sigma.Rule:
    return sigma.load({"title": "query", "logsource": {}, "detection": detection})


def _over(name: str, fields: sigma.Fields, detection: dict, *keep: str):
    def run(spark, d):
        return table(spark, d, name).filter(sigma.compile_rule(_rule(detection), fields)).select(*keep)

    return run


def _event_rows(spark, d):
    return events(spark, d).withColumn("flag", F.col("value") > 50).withColumn("value", F.when(F.col("id") % 10 != 0, F.col("value")))


EV = EVENTS_SQL + ", e AS (SELECT * REPLACE (CASE WHEN id % 10 <> 0 THEN value END AS value), value > 50 AS flag FROM ev)"


def _events(detection: dict):
    def run(spark, d):
        return _event_rows(spark, d).filter(sigma.compile_rule(_rule(detection), EVENT)).select("id")

    return run


def _part(detection: dict, where: str):
    return _over("part", PART, detection, "p_partkey"), f"SELECT p_partkey FROM part WHERE {where}"


def _ev(detection: dict, where: str):
    return _events(detection), f"WITH {EV} SELECT id FROM e WHERE {where}"


def _encoded(spark, d):
    """Parts with their names as encoded texts, as rules meet them in scripts."""
    p = table(spark, d, "part")
    return p.withColumn("enc", F.base64(F.col("p_name").cast("binary"))).withColumn("wide", F.base64(F.encode("p_name", "UTF-16LE"))).withColumn("cmd", F.concat(F.lit("tool "), F.when(F.col("p_partkey") % 2 == 0, "-").otherwise("/"), "p_name"))


ENCODED = sigma.Fields({"enc": ["enc"], "wide": ["wide"], "cmd": ["cmd"]}, ascii_only=True)


def _enc(detection: dict):
    return lambda spark, d: _encoded(spark, d).filter(sigma.compile_rule(_rule(detection), ENCODED)).select("p_partkey")


def _offset_sql(texts, col: str) -> str:
    return " OR ".join(f"contains({col}, '{t}')" for t in texts)


#: (detection, class, SQL) of the rule set that one projection evaluates.
RULE_SET = [
    ({"s": {"kind": "error", "value|gte": 50}, "condition": "s"}, None, "source = 'error' AND coalesce(value >= 50, false)"),
    ({"s": {"kind|startswith": "pur"}, "f": {"user|endswith": "7"}, "condition": "s and not f"}, 1007, "class_uid = 1007 AND starts_with(source, 'pur') AND NOT ends_with(user_name, '7')"),
    ({"s": {"k|lt": 10}, "t": {"host": "host-3"}, "condition": "s or t"}, 6003, "class_uid = 6003 AND (coalesce(k < 10, false) OR host = 'host-3')"),
    ({"a1": {"address|cidr": "10.0.2.0/24"}, "a2": {"value": None}, "condition": "all of a*"}, None, "starts_with(src_ip, '10.0.2.') AND value IS NULL"),
    ({"k": ["host-1", "signup"], "condition": "not k"}, 3001, "class_uid = 3001 AND NOT (contains(user_name || '|' || host || '|' || source || '|' || src_ip, 'host-1') OR source = 'signup')"),
    ({"s": {"user|re": "^user1[0-4]$"}, "condition": "1 of them"}, None, "regexp_matches(user_name, '^user1[0-4]$')"),
]


def _multi(spark, d):
    rules = [(_rule(det), EVENT, cls) for det, cls, _ in RULE_SET]
    found = sigma.match_all(_event_rows(spark, d), rules)
    return found.filter(F.size("rules") > 0).select("id", F.explode("rules").alias("rule"))


MULTI_SQL = f"WITH {EV} " + " UNION ALL ".join(f"SELECT id, {i}::INT AS rule FROM e WHERE {w}" for i, (_, _, w) in enumerate(RULE_SET))

#: Rules of the large set: in four kinds, each for a class of events or for all, with literals of their own.
MANY = 2000
CLASSES = (2004, 3001, 4002, 6003, 1007, None)


def large_set(n: int = MANY) -> list[tuple[sigma.Rule, sigma.Fields, int | None]]:
    out = []
    for i in range(n):
        cls, user, host = CLASSES[i % 6], f"user{i * 7 % 1500}", f"host-{i % 20}"
        detection = (
            {"s": {"user": [user, f"USER{i % 1400}"], "k|gte": i % 90}, "f": {"host|endswith": f"-{i % 10}"}, "condition": "s and not f"},
            {"s1": {"user|startswith": user}, "s2": {"host": host}, "s3": {"address|contains": f".{i % 8}.{i % 250}"}, "condition": "s1 and s2 or s3 and s2"},
            {"s": {"host": host, "user|contains|all": [f"r{i % 150}", str(i % 10)]}, "f": {"value|lt": i % 60}, "condition": "s and not 1 of f*"},
            {"s": {"address|endswith": f".{i % 256}"}, "t": {"user|re": f"^user[0-9]*{i % 100:02d}$"}, "condition": "all of them"},
        )[i // 6 % 4]
        out.append((_rule(detection), EVENT, cls))
    return out


def _large(spark, d):
    return sigma.match_all(_event_rows(spark, d), large_set()).filter(F.size("rules") > 0).select("id", F.explode("rules").alias("rule"))


LARGE_SQL = f"""WITH {EV}, n AS (SELECT i::INT AS i, i // 6 % 4 AS kind, [2004, 3001, 4002, 6003, 1007, NULL][i % 6 + 1] AS cls, 'user' || (i * 7 % 1500) AS u, 'host-' || (i % 20) AS h FROM range({MANY}) t(i))
  SELECT id, i AS rule FROM e JOIN n ON kind = 0 AND user_name = u AND k >= i % 90 AND NOT ends_with(host, '-' || (i % 10)) AND (cls IS NULL OR class_uid = cls)
  UNION SELECT id, i FROM e JOIN n ON kind = 0 AND user_name = 'user' || (i % 1400) AND k >= i % 90 AND NOT ends_with(host, '-' || (i % 10)) AND (cls IS NULL OR class_uid = cls)
  UNION SELECT id, i FROM e JOIN n ON kind = 1 AND host = h AND (starts_with(user_name, u) OR contains(src_ip, '.' || (i % 8) || '.' || (i % 250))) AND (cls IS NULL OR class_uid = cls)
  UNION SELECT id, i FROM e JOIN n ON kind = 2 AND host = h AND contains(user_name, 'r' || (i % 150)) AND contains(user_name, (i % 10)::VARCHAR) AND NOT coalesce(value < i % 60, false) AND (cls IS NULL OR class_uid = cls)
  UNION SELECT id, i FROM e JOIN n ON kind = 3 AND ends_with(src_ip, '.' || (i % 256)) AND regexp_matches(user_name, '^user[0-9]*' || lpad((i % 100)::VARCHAR, 2, '0') || '$') AND (cls IS NULL OR class_uid = cls)"""


#: Rules as products' rule sets write them, which find their fields by the shipped mappings.
MAPPED = [
    ({"category": "process_creation"}, {"s": {"Image|endswith": ["\\error.exe", "\\view.exe"], "CommandLine|contains": " -k 1"}, "f": {"OriginalFileName": "HOST-3.exe"}, "condition": "s and not f"}),
    ({"category": "process_creation"}, {"s": {"Hashes|contains": "md5=0"}, "condition": "s"}),
    ({"category": "network_connection"}, {"s": {"DestinationIp|cidr": "10.0.2.0/23", "DestinationPort": [1, 2, 3, 4, 5], "Initiated": "true"}, "condition": "s"}),
    ({"category": "file_event"}, {"s": {"TargetFilename|startswith": "d:\\user1", "ParentImage": None}, "condition": "s"}),
]


def _sysmon_records(spark, d, rows=None, keep=()):
    """Each event as a record of the system monitor, of three kinds; of other
    ``rows`` than the table's, with the columns ``keep`` beside it."""
    rows = events(spark, d) if rows is None else rows
    system = F.struct(
        F.struct(F.struct(F.lit("Microsoft-Windows-Sysmon").alias("Name")).alias("#attributes")).alias("Provider"),
        F.element_at(F.array(F.lit(1), F.lit(3), F.lit(11)), (F.col("id") % 3 + 1).cast("int")).alias("EventID"),
        F.col("host").alias("Computer"),
        F.col("id").alias("EventRecordID"),
    )
    data = F.struct(
        F.concat(F.lit("CORP\\"), "user_name").alias("User"),
        F.concat(F.lit("C:\\w\\"), "source", F.lit(".exe")).alias("Image"),
        F.concat(F.lit("run -u "), "user_name", F.lit(" -k "), F.col("k").cast("string")).alias("CommandLine"),
        F.concat("host", F.lit(".exe")).alias("OriginalFileName"),
        F.concat(F.lit("MD5="), F.md5("user_name"), F.lit(",SHA256="), F.sha2("user_name", 256)).alias("Hashes"),
        F.col("src_ip").alias("DestinationIp"),
        F.col("k").cast("string").alias("DestinationPort"),
        F.when(F.col("id") % 2 == 0, "true").otherwise("false").alias("Initiated"),
        F.concat(F.lit("D:\\"), "user_name", F.lit(".txt")).alias("TargetFilename"),
    )
    return rows.select("id", *keep, F.to_json(F.struct(F.struct(system.alias("System"), data.alias("EventData")).alias("Event"))).alias("record"))


def _mapped(spark, d):
    normalized = normalize.normalize(_sysmon_records(spark, d), definitions.sources()["sysmon"][2])
    rules = [sigma.load({"title": "query", "logsource": source | {"product": "windows"}, "detection": detection}) for source, detection in MAPPED]
    return mappings.match(normalized, rules, mappings.shipped()).select("id", F.explode("rules").alias("rule"))


MAPPED_SQL = f"""WITH {EV} SELECT id, 0 AS rule FROM e WHERE id % 3 = 0 AND source IN ('error', 'view') AND contains('run -u ' || user_name || ' -k ' || k, ' -k 1') AND host <> 'host-3'
  UNION ALL SELECT id, 1 FROM e WHERE id % 3 = 0 AND md5(user_name)[1] = '0'
  UNION ALL SELECT id, 2 FROM e WHERE id % 3 = 1 AND split_part(src_ip, '.', 3) IN ('2', '3') AND k BETWEEN 1 AND 5 AND id % 2 = 0
  UNION ALL SELECT id, 3 FROM e WHERE id % 3 = 2 AND starts_with(user_name, 'user1')"""

_NAME = "lower(p_name)"
QUERIES = {
    "sigma_equals": _part({"s": {"type": ["STANDARD", "promo tin", "economy"], "brand": "brand#11"}, "t": {"name|contains": "1"}, "condition": "s or t"}, "lower(p_type) IN ('standard','promo tin','economy') AND lower(p_brand) = 'brand#11' OR contains(lower(p_name), '1')"),
    "sigma_contains": _part({"s": {"name|contains": ["ED W", "ring"]}, "condition": "s"}, f"contains({_NAME}, 'ed w') OR contains({_NAME}, 'ring')"),
    "sigma_startswith": _part({"s": {"brand|startswith": ["BRAND#1", "brand#2"]}, "condition": "s"}, "starts_with(lower(p_brand), 'brand#1') OR starts_with(lower(p_brand), 'brand#2')"),
    "sigma_endswith": _part({"s": {"any|endswith": ["5", "R"]}, "condition": "s"}, f"ends_with({_NAME}, '5') OR ends_with(lower(p_type), '5') OR ends_with({_NAME}, 'r') OR ends_with(lower(p_type), 'r')"),
    "sigma_wildcard": (_over("pages", PAGE, {"s": {"url": "http?://*.example.?e?/*/1*"}, "condition": "s"}, "page_id"), "SELECT page_id FROM pages WHERE lower(url) LIKE 'http_://%.example._e_/%/1%'"),
    "sigma_cased": (_over("pages", PAGE, {"s": {"html|cased|contains": "The "}, "condition": "s"}, "page_id"), "SELECT page_id FROM pages WHERE contains(html, 'The ')"),
    "sigma_all": (_over("pages", PAGE, {"s": {"url|contains|all": ["www.", "/en/", "example.com"]}, "condition": "s"}, "page_id"), "SELECT page_id FROM pages WHERE contains(lower(url), 'www.') AND contains(lower(url), '/en/') AND contains(lower(url), 'example.com')"),
    "sigma_and_not": (_over("conversations", TALK, {"s": {"role": "user"}, "f": {"turn|gte": 2}, "condition": "s and not f"}, "conv_id", "turn"), "SELECT conv_id, turn FROM conversations WHERE lower(role) = 'user' AND NOT coalesce(turn >= 2, false)"),
    "sigma_one_of": (_over("pages", PAGE, {"sel_a": {"url|contains": "blog."}, "sel_b": {"url|endswith": ".html"}, "_hidden": {"url|contains": "http"}, "condition": "1 of sel_*"}, "page_id"), "SELECT page_id FROM pages WHERE contains(lower(url), 'blog.') OR ends_with(lower(url), '.html')"),
    "sigma_all_of": (_over("pages", PAGE, {"a": {"url|contains": "example.net"}, "b": {"url|contains": "/fr/"}, "_c": {"url": "nothing"}, "condition": "all of them"}, "page_id"), "SELECT page_id FROM pages WHERE contains(lower(url), 'example.net') AND contains(lower(url), '/fr/')"),
    "sigma_re": (_over("pages", PAGE, {"s": {"url|re|i": r"//(WWW|m)\.[a-z]+\.example\.(com|org)/e[ns]/[0-9]{3}"}, "condition": "s"}, "page_id"), r"SELECT page_id FROM pages WHERE regexp_matches(url, '(?i)//(WWW|m)\.[a-z]+\.example\.(com|org)/e[ns]/[0-9]{3}')"),
    "sigma_windash": (_enc({"s": {"cmd|windash|contains": " -r"}, "condition": "s"}), "SELECT p_partkey FROM part WHERE contains(lower('tool ' || CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '/' END || p_name), ' -r') OR contains(lower('tool ' || CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '/' END || p_name), ' /r')"),
    "sigma_base64": (_enc({"s": {"enc|base64|startswith": "red"}, "t": {"enc|base64|startswith": "sma"}, "condition": "s or t"}), f"SELECT p_partkey FROM part WHERE starts_with(base64(encode(p_name)), '{T.base64_of(b'red')}') OR starts_with(base64(encode(p_name)), '{T.base64_of(b'sma')}')"),
    "sigma_base64offset": (_enc({"s": {"enc|base64offset|contains": ["widget", "ring"]}, "condition": "s"}), "SELECT p_partkey FROM part WHERE " + _offset_sql([*T.base64_offsets(b"widget"), *T.base64_offsets(b"ring")], "base64(encode(p_name))")),
    "sigma_wide_base64": (_enc({"s": {"wide|wide|base64offset|contains": "widget"}, "condition": "s"}), "SELECT p_partkey FROM part WHERE contains(p_name, 'widget')"),
    "sigma_number": _ev({"s": {"k": [1, 2, 3]}, "condition": "s"}, "coalesce(k IN (1, 2, 3), false)"),
    "sigma_compare": _ev({"s": {"value|gt": 20, "k|lte": 50}, "condition": "s"}, "coalesce(value > 20, false) AND coalesce(k <= 50, false)"),
    "sigma_boolean": _ev({"s": {"flag": True}, "condition": "s"}, "coalesce(flag, false)"),
    "sigma_null": _ev({"s": {"value": None}, "condition": "s"}, "value IS NULL"),
    "sigma_exists": _ev({"s": {"value|exists": True, "k|exists": True}, "condition": "s"}, "value IS NOT NULL AND k IS NOT NULL"),
    "sigma_fieldref": _ev({"s": {"class|fieldref": "id"}, "t": {"k|fieldref": "id"}, "condition": "s or t"}, "coalesce(class_uid = id, false) OR coalesce(k = id, false)"),
    "sigma_cidr": _ev({"s": {"address|cidr": ["10.0.1.0/25", "10.0.4.0/22", "2001:db8::/32"]}, "condition": "s"}, "split_part(src_ip, '.', 3) = '1' AND CAST(split_part(src_ip, '.', 4) AS INT) < 128 OR CAST(split_part(src_ip, '.', 3) AS INT) BETWEEN 4 AND 7"),
    "sigma_class_gate": (lambda spark, d: _event_rows(spark, d).filter(sigma.compile_rule(_rule({"s": {"host|endswith": "1"}, "condition": "not s"}), EVENT, F.col("class_uid") == 2004)).select("id"), f"WITH {EV} SELECT id FROM e WHERE class_uid = 2004 AND NOT ends_with(host, '1')"),
    "sigma_keyword": _ev({"k": ["host-1", "purch*e"], "condition": "k"}, "contains(host, 'host-1') OR source LIKE '%purch%e%'"),
    "sigma_multi_rule": (_multi, MULTI_SQL),
    "sigma_rule_set": (_large, LARGE_SQL),
    "sigma_mapped": (_mapped, MAPPED_SQL),
}
