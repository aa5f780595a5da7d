"""Functions, indicators and context over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.operators import intel, overview
from ravelin.sources.adapter import EVENTS_SQL, events, table

DAY = 86_400_000
EV = "WITH " + EVENTS_SQL


def _select(name: str, make, *keep: str):
    return lambda spark, d: table(spark, d, name).select(*keep, *[c.alias(n) for n, c in make().items()])


def _pages(spark, d):
    return table(spark, d, "pages").withColumn("host", T.url_host(F.col("url")))


HOST = "nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '')"
PAGES_SQL = f"p AS (SELECT page_id, url, {HOST} AS host FROM pages)"


def _indicators(spark, d):
    """Hosts of every third page are indicators of a feed, with a validity."""
    p = _pages(spark, d).filter("page_id % 3 = 0")
    return p.select(
        F.lit("domain").alias("kind"),
        F.col("host").alias("value"),
        F.concat(F.lit("feed"), (F.col("page_id") % 4).cast("string")).alias("feed"),
        (F.col("page_id") * 7 % 101).alias("confidence"),
        F.when(F.col("page_id") % 5 != 0, F.col("page_id") % 50).alias("valid_from"),
        F.when(F.col("page_id") % 7 != 0, F.col("page_id") % 50 + 60).alias("valid_until"),
        F.when(F.col("page_id") % 11 != 0, F.col("page_id")).alias("added"),
    )


IND_SQL = """i AS (SELECT 'domain' AS kind, host AS value, 'feed' || (page_id % 4) AS feed, page_id * 7 % 101 AS confidence, CASE WHEN page_id % 5 <> 0 THEN page_id % 50 END AS valid_from,
  CASE WHEN page_id % 7 <> 0 THEN page_id % 50 + 60 END AS valid_until, CASE WHEN page_id % 11 <> 0 THEN page_id END AS added FROM p WHERE page_id % 3 = 0)"""
OBS_SQL = "o AS (SELECT page_id AS id, 'domain' AS kind, host AS value, page_id % 100 AS moment FROM p WHERE host IS NOT NULL)"
BASE = f"WITH {PAGES_SQL}, {IND_SQL}, {OBS_SQL}"


def _observed(spark, d):
    seen = intel.observables(_pages(spark, d), "page_id", {"url.hostname": ("domain", F.col("host")), "url.text": ("url", T.url(F.col("url"))), "referrer": ("domain", F.col("host"))})
    return seen.withColumn("moment", F.col("id") % 100)


def _hits(spark, d):
    found = intel.match_exact(_observed(spark, d).select("id", "kind", "value", "moment"), _indicators(spark, d))
    return found.filter(intel.valid_at(F.col("moment")))


HITS_SQL = BASE + ", h AS (SELECT o.id, kind, value, moment, feed, confidence, added FROM o JOIN i USING (kind, value) WHERE (valid_from IS NULL OR valid_from <= moment) AND (valid_until IS NULL OR moment < valid_until))"


def _allow(spark, d):
    """Allowlist entries from hosts: some exact, some for all below a parent."""
    p = _pages(spark, d).filter("page_id % 10 = 0")
    return p.select(F.when(F.col("page_id") % 20 == 0, F.col("host")).otherwise(F.concat(F.lit("*."), F.regexp_replace("host", r"^[^.]*\.", ""))).alias("entry"), F.lit(1).alias("list_no")).distinct()


ALLOW_SQL = "a AS (SELECT DISTINCT CASE WHEN page_id % 20 = 0 THEN host ELSE '*.' || regexp_replace(host, '^[^.]*\\.', '') END AS entry FROM p WHERE page_id % 10 = 0)"
ALLOWED_SQL = """k AS (SELECT host, s AS step, unnest(CASE WHEN s = 0 THEN [array_to_string(l[s + 1:], '.'), '*.' || array_to_string(l[s + 1:], '.')] ELSE ['*.' || array_to_string(l[s + 1:], '.')] END) AS entry
    FROM (SELECT host, l, unnest(range(0, greatest(len(l) - 1, 1))) AS s FROM (SELECT DISTINCT host, string_split(host, '.') AS l FROM p WHERE host IS NOT NULL))),
  b AS (SELECT host, arg_min(entry, (CASE WHEN starts_with(entry, '*') THEN 100 ELSE 0 END) + step) AS allowed_by FROM k JOIN a USING (entry) GROUP BY host)"""


def _findings(spark, d):
    per = intel.summarize(_hits(spark, d), "id", "kind", "value").withColumn("host", F.col("value"))
    return intel.findings(intel.allowed(per, _allow(spark, d)))


FINDINGS_SQL = f"""{HITS_SQL}, {ALLOW_SQL}, {ALLOWED_SQL}, s AS (SELECT id, kind, value, max(confidence) AS confidence FROM h GROUP BY ALL)
  SELECT sha256(id || '|' || kind || '|' || value) AS uid, id, kind, value, confidence, (CASE WHEN allowed_by IS NOT NULL THEN 1 WHEN confidence >= 90 THEN 4 WHEN confidence >= 50 THEN 3 ELSE 2 END)::INT AS severity_id,
    allowed_by IS NULL AS is_alert, CASE WHEN allowed_by IS NULL THEN 'New' ELSE 'Suppressed' END AS status FROM s LEFT JOIN b ON b.host = s.value"""


def _finding_events(spark, d):
    hits = intel.allowed(_hits(spark, d).withColumn("host", F.col("value")), _allow(spark, d))
    none = lambda name: F.lit(None).cast("bigint").alias(name)
    full = hits.select("id", "kind", "value", F.lit("url.hostname").alias("path"), "feed", F.lit("1").alias("version"), "confidence", "valid_from", "valid_until", F.col("added").alias("first_seen"), none("last_seen"), "allowed_by")
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") * 1000).alias("time"), F.lit(4002).alias("class_uid"))
    found = intel.finding_events(full, pages, 1_704_067_200_000)
    g = lambda path: F.get_json_object("event", path)
    return found.select("uid", "id", "time", "severity_id", "is_alert", g("$.status").alias("status"), g("$.status_detail").alias("detail"), F.size(F.from_json(g("$.osint"), "array<string>")).alias("feeds"), g("$.osint[0].vendor_name").alias("first_feed"), g("$.osint[0].type_id").alias("type_id"), g("$.evidences[0].data.event_uid").alias("event_uid"), g("$.finding_info.uid").alias("info_uid"), g("$.unmapped.assertions[0].valid_from").cast("bigint").alias("valid_from"))


FINDING_EVENTS_SQL = f"""{HITS_SQL.replace("feed, confidence, added FROM o", "feed, confidence, added, valid_from, valid_until FROM o")}, {ALLOW_SQL}, {ALLOWED_SQL}, dh AS (SELECT DISTINCT * FROM h),
  s AS (SELECT id, kind, value, max(confidence) AS confidence, count(*) AS feeds, min(feed) AS first_feed, arg_min({{'v': valid_from}}, {{'f': feed, 'c': confidence, 'n': valid_from IS NOT NULL, 'a': coalesce(valid_from, 0)}}).v AS valid_from FROM dh GROUP BY ALL)
  SELECT sha256(id || '|' || kind || '|' || value)[1:32] AS uid, id, id * 1000 AS time, (CASE WHEN allowed_by IS NOT NULL THEN 1 WHEN confidence >= 90 THEN 4 WHEN confidence >= 50 THEN 3 ELSE 2 END)::INT AS severity_id, allowed_by IS NULL AS is_alert, CASE WHEN allowed_by IS NULL THEN 'New' ELSE 'Suppressed' END AS status, allowed_by AS detail, feeds::INT AS feeds, first_feed, '2' AS type_id, id::VARCHAR AS event_uid,
    sha256(id || '|' || kind || '|' || value)[1:32] AS info_uid, valid_from FROM s LEFT JOIN b ON b.host = s.value"""


def _addresses(spark, d):
    return events(spark, d).select("id", "src_ip").withColumn("number", T.ipv4_number(F.col("src_ip")))


def _networks(spark):
    rows = [("10.0.0.0", 22, "n0"), ("10.0.1.0", 24, "n1"), ("10.0.1.128", 25, "n2"), ("10.0.5.64", 26, "n3"), ("10.0.6.7", 32, "n4")]
    return spark.createDataFrame(rows, "address string, prefix int, record string").withColumn("net", T.ipv4_number(F.col("address"))).drop("address")


LENGTHS = [32, 26, 25, 24, 22]
NET_SQL = """n(lo, prefix, record) AS (VALUES (167772160, 22, 'n0'), (167772416, 24, 'n1'), (167772544, 25, 'n2'), (167773504, 26, 'n3'), (167773703, 32, 'n4')),
  x AS (SELECT id, src_ip, 167772160 + CAST(split_part(src_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(src_ip, '.', 4) AS BIGINT) AS number FROM ev),
  m AS (SELECT id, src_ip, prefix, record FROM x, n WHERE number >= lo AND number < lo + (1 << (32 - prefix)))"""


#: Networks of both families, one of them IPv4 mapped into IPv6.
CIDRS = ("2001:db8::/32", "2001:db8:3::/48", "2001:DB8:4:0::10/124", "::ffff:10.0.2.0/120", "10.0.3.0/24", "2001:db8:5::a/128", "::/0")


def _both(spark, d):
    """Events' addresses: IPv4, IPv6, and what is none."""
    six = F.concat(F.lit("2001:DB8:"), F.lower(F.hex(F.col("id") % 16)), F.lit("::"), F.lower(F.hex("k")))
    mapped = F.concat(F.lit("::ffff:"), "src_ip")
    text = F.when(F.col("id") % 4 == 0, F.col("src_ip")).when(F.col("id") % 4 == 1, mapped).when(F.col("id") % 4 == 2, "none").otherwise(six)
    return events(spark, d).select("id", T.ip_hex(text).alias("address"))


def _v6(spark, d):
    net, prefix = intel.network(F.col("cidr"))
    networks = spark.createDataFrame([(c,) for c in CIDRS], "cidr string").select("cidr", net.alias("net"), prefix.alias("prefix"))
    return intel.match_addresses(_both(spark, d), networks, [0, 32, 48, 120, 124, 128]).select("id", "cidr")


V6_SQL = f"""{EV}, x AS (SELECT id, id % 4 AS f, id % 16 AS g, k, split_part(src_ip, '.', 3) AS three FROM ev)
  SELECT id, '2001:db8::/32' AS cidr FROM x WHERE f = 3 UNION ALL SELECT id, '2001:db8:3::/48' FROM x WHERE f = 3 AND g = 3 UNION ALL SELECT id, '2001:DB8:4:0::10/124' FROM x WHERE f = 3 AND g = 4 AND k BETWEEN 16 AND 31
  UNION ALL SELECT id, '::ffff:10.0.2.0/120' FROM x WHERE f < 2 AND three = '2' UNION ALL SELECT id, '10.0.3.0/24' FROM x WHERE f < 2 AND three = '3' UNION ALL SELECT id, '2001:db8:5::a/128' FROM x WHERE f = 3 AND g = 5 AND k = 10 UNION ALL SELECT id, '::/0' FROM x WHERE f <> 2"""


def _records(spark, d):
    """Context records of customers: each order is one, valid for some days."""
    o = table(spark, d, "orders")
    day = F.floor(T.epoch_ms(F.col("o_orderdate")) / DAY).cast("bigint")
    return o.select(F.col("o_custkey").alias("who"), F.col("o_orderkey").alias("record"), F.col("o_orderpriority").alias("source"), day.alias("valid_from"), (day + 30 + F.col("o_orderkey") % 60).alias("valid_until"))


REC_SQL = f"r AS (SELECT o_custkey AS who, o_orderkey AS record, o_orderpriority AS source, epoch_ms(o_orderdate) // {DAY} AS valid_from, epoch_ms(o_orderdate) // {DAY} + 30 + o_orderkey % 60 AS valid_until FROM orders)"


def _asks(spark, d):
    """Every event asks about a customer, at a day of the orders' years."""
    n = table(spark, d, "customer").count()
    return events(spark, d).select("id", (F.col("id") % n).alias("who"), (F.lit(8000) + F.col("id") * 7 % 2600).alias("moment"))


ASK_SQL = EV + ", a AS (SELECT id, id % (SELECT count(*) FROM customer) AS who, 8000 + id * 7 % 2600 AS moment FROM ev), " + REC_SQL


def _found(spark, d):
    return _asks(spark, d).join(_records(spark, d), "who")


def _groups(spark, d):
    """Customers are held by nations, nations by regions."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("who"), F.col("c_nationkey").alias("n"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("nation"), F.col("n_regionkey").alias("r_regionkey"))
    regions = table(spark, d, "region")
    return c.join(nations, "n").join(regions, "r_regionkey").select("who", F.array_sort(F.array("nation", "r_name")).alias("groups")).select("who", F.explode("groups").alias("group"))


def _feed(spark, d):
    p = table(spark, d, "part")
    return p.select(F.lit("digest").alias("kind"), F.md5("p_name").alias("value"), F.col("p_brand").alias("feed"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey")).alias("added")).groupBy("kind", "value", "feed").agg(F.max("added").alias("added"))


def _replace(spark, d):
    old = _feed(spark, d)
    new = old.filter("feed = 'Brand#2' and added % 2 = 0").withColumn("added", F.lit(5_000_000).cast("bigint")).unionByName(spark.createDataFrame([("digest", "fresh", "Brand#2", 7)], "kind string, value string, feed string, added long"))
    return overview.replace_feed(old, new, "Brand#2")


def _fn(select: str, frm: str) -> str:
    return f"SELECT {select} FROM {frm}"


URL_SQL = r"""CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]') THEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) END"""

QUERIES = {
    "fn_fold": (_select("part", lambda: {"folded": T.fold(F.concat("p_type", F.lit(" "), "p_brand"))}, "p_partkey"), "SELECT p_partkey, lower(p_type || ' ' || p_brand) AS folded FROM part"),
    "fn_domain": (lambda spark, d: _pages(spark, d).select("page_id", T.domain(F.concat(F.upper(F.replace("host", F.lit("."), F.lit("[.]"))), F.lit("."))).alias("domain")), f"WITH {PAGES_SQL} SELECT page_id, host AS domain FROM p"),
    "fn_url": (_select("pages", lambda: {"canonical": T.url(F.regexp_replace("url", "^http", "hXXp"))}, "page_id"), f"SELECT page_id, {URL_SQL} AS canonical FROM pages"),
    "fn_url_host": (lambda spark, d: _pages(spark, d).select("page_id", "host"), f"WITH {PAGES_SQL} SELECT page_id, host FROM p"),
    "fn_url_build": (lambda spark, d: _pages(spark, d).select("page_id", T.url_build(F.lit("https"), F.col("host"), F.when(F.col("page_id") % 2 == 0, 443).otherwise(8443), F.concat(F.lit("x/"), F.col("page_id").cast("string"))).alias("built")), f"WITH {PAGES_SQL} SELECT page_id, 'https://' || host || CASE WHEN page_id % 2 = 0 THEN '' ELSE ':8443' END || '/x/' || page_id AS built FROM p"),
    "fn_hash_key": (lambda spark, d: table(spark, d, "part").select("p_partkey", T.hash_kind(F.when(F.col("p_partkey") % 3 == 0, F.md5("p_name")).when(F.col("p_partkey") % 3 == 1, F.sha2("p_name", 256)).otherwise(F.col("p_name"))).alias("kind")), "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'md5' WHEN 1 THEN 'sha256' END AS kind FROM part"),
    "fn_ip_port": (lambda spark, d: events(spark, d).select("id", T.ip_port(F.concat("src_ip", F.when(F.col("id") % 2 == 0, ":443").otherwise(""))).alias("address")), f"{EV} SELECT id, src_ip AS address FROM ev"),
    "fn_asn": (lambda spark, d: table(spark, d, "part").select("p_partkey", T.asn(F.concat(F.when(F.col("p_partkey") % 2 == 0, "as").otherwise(""), (F.col("p_partkey") * 3_000_000).cast("string"))).alias("asn")), "SELECT p_partkey, CASE WHEN p_partkey * 3000000 <= 4294967295 THEN p_partkey * 3000000 END AS asn FROM part"),
    "fn_identifier": (lambda spark, d: events(spark, d).select("id", T.identifier("email", F.concat(F.upper("user_name"), F.lit("@"), "host", F.lit(".Example"))).alias("email"), T.identifier("host", F.when(F.col("id") % 4 == 0, "Unknown").otherwise(F.concat(F.upper("host"), F.lit(".")))).alias("name"), T.identifier("mac", F.concat(F.lit("AA-BB-CC-DD-EE-"), F.lpad((F.col("id") % 90 + 10).cast("string"), 2, "0"))).alias("mac")), f"{EV} SELECT id, user_name || '@' || host || '.example' AS email, CASE WHEN id % 4 <> 0 THEN host END AS name, 'aa:bb:cc:dd:ee:' || (id % 90 + 10) AS mac FROM ev"),
    "fn_strength": (lambda spark, d: events(spark, d).select("id", T.strength(F.when(F.col("id") % 3 == 0, "host").when(F.col("id") % 3 == 1, "name").otherwise("uid"), F.when(F.col("id") % 2 == 0, F.concat("host", F.lit(".example"))).otherwise(F.concat("host", F.lit("\\"), "user_name"))).alias("strong")), f"{EV} SELECT id, CASE id % 3 WHEN 0 THEN id % 2 = 0 WHEN 1 THEN id % 2 = 1 ELSE true END AS strong FROM ev"),
    "fn_technique": (_select("part", lambda: {"technique": T.technique(F.concat(F.when(F.col("p_size") % 4 == 0, "car.").otherwise("attack."), F.lit("t1"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.when(F.col("p_size") % 2 == 0, ".001").otherwise("")))}, "p_partkey"), "SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN 'T1' || lpad(p_size::VARCHAR, 3, '0') || CASE WHEN p_size % 2 = 0 THEN '.001' ELSE '' END END AS technique FROM part"),
    "fn_hex_base64": (_select("part", lambda: {"hex": F.lower(F.hex("p_name")), "base64": F.base64(F.col("p_name").cast("binary"))}, "p_partkey"), "SELECT p_partkey, lower(hex(p_name)) AS hex, base64(encode(p_name)) AS base64 FROM part"),
    "fn_feed_time": (_select("orders", lambda: {"seconds": T.feed_time(F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T02:00:00+02:00"))).otherwise(F.floor(T.epoch_ms(F.col("o_orderdate")) / 1000).cast("string")))}, "o_orderkey"), "SELECT o_orderkey, epoch_ms(o_orderdate) // 1000 AS seconds FROM orders"),
    "fn_buckets": (lambda spark, d: events(spark, d).select("id", T.bucket(F.col("time") - 1_705_000_000_000, 3_600_000).alias("hour"), T.bucket(F.col("time"), DAY).alias("day")), f"{EV} SELECT id, (floor((time - 1705000000000) / 3600000.0) * 3600000)::BIGINT AS hour, time // {DAY} * {DAY} AS day FROM ev"),
    "fn_band": (lambda spark, d: events(spark, d).select("id", T.band(F.col("k")).alias("band")), f"{EV} SELECT id, (CASE WHEN k >= 90 THEN 3 WHEN k >= 50 THEN 2 ELSE 1 END)::INT AS band FROM ev"),
    "fn_mask": (lambda spark, d: _addresses(spark, d).select("id", T.ipv4_text(T.mask(F.col("number"), 22)).alias("net22"), T.ipv4_text(T.mask(F.col("number"), 30)).alias("net30")), f"{EV} SELECT id, '10.0.' || (CAST(split_part(src_ip, '.', 3) AS INT) // 4 * 4) || '.0' AS net22, '10.0.' || split_part(src_ip, '.', 3) || '.' || (CAST(split_part(src_ip, '.', 4) AS INT) // 4 * 4) AS net30 FROM ev"),
    "fn_array_path": (_select("embeddings", lambda: {"n": F.size("embedding"), "positive": F.size(F.filter("embedding", lambda x: x > 0))}, "vec_id"), "SELECT vec_id, len(embedding)::INT AS n, len(list_filter(embedding, lambda x: x > 0))::INT AS positive FROM embeddings"),
    "observables": (lambda spark, d: intel.observables(_pages(spark, d), "page_id", {"url.hostname": ("domain", F.col("host")), "url.text": ("url", T.url(F.col("url"))), "referrer": ("domain", F.col("host"))}), f"WITH {PAGES_SQL} SELECT page_id AS id, 'domain' AS kind, host AS value, 'url.hostname' AS path FROM p WHERE host IS NOT NULL UNION ALL SELECT page_id, 'url', {URL_SQL}, 'url.text' FROM pages WHERE {URL_SQL} IS NOT NULL"),
    "intel_exact": (lambda spark, d: intel.match_exact(_observed(spark, d).select("id", "kind", "value"), _indicators(spark, d).select("kind", "value", "feed", "confidence")), f"{BASE} SELECT id, kind, value, feed, confidence FROM o JOIN i USING (kind, value)"),
    "intel_validity": (lambda spark, d: _hits(spark, d).select("id", "value", "feed", "moment"), f"{HITS_SQL} SELECT id, value, feed, moment FROM h"),
    "intel_cidr": (lambda spark, d: intel.match_networks(_addresses(spark, d), _networks(spark), LENGTHS).select("id", "src_ip", "prefix", "record"), f"{EV}, {NET_SQL} SELECT id, src_ip, prefix, record FROM m"),
    "intel_cidr_v6": (_v6, V6_SQL),
    "intel_allow": (lambda spark, d: intel.allowed(_pages(spark, d).select("page_id", "host"), _allow(spark, d)), f"WITH {PAGES_SQL}, {ALLOW_SQL}, {ALLOWED_SQL} SELECT page_id, host, allowed_by FROM p LEFT JOIN b USING (host)"),
    "intel_confidence": (lambda spark, d: intel.summarize(_hits(spark, d), "id", "value"), f"{HITS_SQL} SELECT id, value, max(confidence) AS confidence, CASE WHEN count(*) = count(added) THEN min(added) END AS known_since, array_to_string(list_sort(list_distinct(list(feed))), ',') AS feeds FROM h GROUP BY ALL"),
    "intel_findings": (_findings, FINDINGS_SQL),
    "finding_events": (_finding_events, FINDING_EVENTS_SQL),
    "intel_look_back": (lambda spark, d: intel.summarize(_hits(spark, d).filter("added >= 100"), "id", "value").select("id", "value", "confidence"), f"{HITS_SQL} SELECT id, value, max(confidence) AS confidence FROM h WHERE added >= 100 GROUP BY ALL"),
    "feed_gate": (lambda spark, d: intel.feed_gate(table(spark, d, "part").select(F.col("p_brand").alias("feed"), (F.col("p_retailprice") < 910).alias("rejected"))), "SELECT p_brand AS feed, count(*) AS rows, sum((p_retailprice < 910)::INT)::BIGINT AS rejected, rows > 0 AND sum((p_retailprice < 910)::INT) <= count(*) * 0.1 AS accepted FROM part GROUP BY 1"),
    "feed_replace": (_replace, "WITH f AS (SELECT 'digest' AS kind, md5(p_name) AS value, p_brand AS feed, max(CASE WHEN p_partkey % 3 <> 0 THEN p_partkey END) AS added FROM part GROUP BY ALL) SELECT * FROM f WHERE feed <> 'Brand#2' OR added % 2 = 0 UNION ALL SELECT 'digest', 'fresh', 'Brand#2', 7"),
    "planted_indicators": (lambda spark, d: events(spark, d).select(F.col("id"), F.when(F.col("id") % 20 < 9, "ip").when(F.col("id") % 20 < 15, "domain").when(F.col("id") % 20 < 18, "url").otherwise("sha256").alias("kind"), F.when(F.col("id") % 20 < 9, F.concat(F.lit("198.18."), F.floor(F.col("id") / 256).cast("string"), F.lit("."), (F.col("id") % 256).cast("string"))).when(F.col("id") % 20 < 15, F.concat(F.lit("n"), F.col("id").cast("string"), F.lit(".example"))).when(F.col("id") % 20 < 18, F.concat(F.lit("http://n"), F.col("id").cast("string"), F.lit(".example/a"))).otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("value")), f"{EV} SELECT id, CASE WHEN id % 20 < 9 THEN 'ip' WHEN id % 20 < 15 THEN 'domain' WHEN id % 20 < 18 THEN 'url' ELSE 'sha256' END AS kind, CASE WHEN id % 20 < 9 THEN '198.18.' || (id // 256) || '.' || (id % 256) WHEN id % 20 < 15 THEN 'n' || id || '.example' WHEN id % 20 < 18 THEN 'http://n' || id || '.example/a' ELSE sha256(id::VARCHAR) END AS value FROM ev"),
    "enrich_id": (lambda spark, d: intel.holding(_found(spark, d), F.col("moment")).select("id", "record", "source"), f"{ASK_SQL} SELECT id, record, source FROM a JOIN r USING (who) WHERE valid_from <= moment AND moment < valid_until"),
    "enrich_asof_ended": (lambda spark, d: intel.with_ended(_found(spark, d), ["id"], F.col("moment")).select("id", "record", "source", "holds"), f"""{ASK_SQL}, f AS (SELECT id, record, source, valid_until, valid_from <= moment AND moment < valid_until AS holds, valid_until <= moment AS ended FROM a JOIN r USING (who)),
      g AS (SELECT *, bool_or(holds) OVER (PARTITION BY id, source) AS held, row_number() OVER (PARTITION BY id, source ORDER BY holds DESC, valid_until DESC, record) AS rn FROM f WHERE holds OR ended) SELECT id, record, source, holds FROM g WHERE holds OR (NOT held AND rn = 1)"""),
    "enrich_range": (lambda spark, d: intel.narrowest(intel.match_networks(_addresses(spark, d), _networks(spark).withColumn("source", F.when(F.col("record").isin("n0", "n2", "n4"), "a").otherwise("b")), LENGTHS), ["id", "source"]).select("id", "source", "record"), f"{EV}, {NET_SQL} SELECT id, CASE WHEN record IN ('n0', 'n2', 'n4') THEN 'a' ELSE 'b' END AS source, arg_max(record, prefix) AS record FROM m GROUP BY ALL"),
    "enrich_domain": (lambda spark, d: _pages(spark, d).filter("host is not null").select("page_id", F.posexplode(intel.parents(F.col("host"))).alias("step", "name")).join(table(spark, d, "pages").select(F.regexp_extract("url", r"://[^/?#]*?([a-z]+\.[a-z]+)(?:[/?#]|$)", 1).alias("name")).distinct(), "name").groupBy("page_id").agg(F.min_by("name", "step").alias("list_name")), r"WITH l AS (SELECT DISTINCT regexp_extract(url, '://[^/?#]*?([a-z]+\.[a-z]+)(?:[/?#]|$)', 1) AS name FROM pages) SELECT page_id, regexp_extract(url, '://[^/?#]*?([a-z]+\.[a-z]+)(?:[/?#]|$)', 1) AS list_name FROM pages"),
    "enrich_groups": (lambda spark, d: _asks(spark, d).join(_groups(spark, d), "who").select("id", "group"), f"{EV}, a AS (SELECT id, id % (SELECT count(*) FROM customer) AS who FROM ev), c AS (SELECT c_custkey AS who, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT id, n_name AS \"group\" FROM a JOIN c USING (who) UNION ALL SELECT id, r_name FROM a JOIN c USING (who)"),
    "enrichments_cap": (lambda spark, d: intel.cap(_found(spark, d), ["id"], ["source", "record"], 5).select("id", "record"), f"{ASK_SQL} SELECT id, record FROM a JOIN r USING (who) QUALIFY row_number() OVER (PARTITION BY id ORDER BY source, record) <= 5"),
}

