"""Entity graph and coverage over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.functions.text import epoch_ms
from ravelin.operators import graph, intel, observe
from ravelin.operators.search import Schema
from ravelin.plans import normalize
from ravelin.queries import rules
from ravelin.sources import attack, definitions
from ravelin.sources.adapter import EVENTS_SQL, events, table

DAY = 86_400_000


def _rows(spark, d):
    """Customers link to order priorities' desks; each order is an event."""
    o = table(spark, d, "orders")
    return o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.lit("ordered").alias("link"), F.col("o_orderpriority").alias("dst"), epoch_ms(F.col("o_orderdate")).alias("time"), F.col("o_orderkey").alias("id"))


ROWS_SQL = "r AS (SELECT 'c' || o_custkey AS src, 'ordered' AS link, o_orderpriority AS dst, epoch_ms(o_orderdate) AS time, o_orderkey AS id FROM orders)"
LINKS_SQL = f"WITH {ROWS_SQL}, l AS (SELECT src, link, dst, time // {30 * DAY} AS hour, count(*) AS events, min({{'time': time, 'id': id}}) AS first_seen, max({{'time': time, 'id': id}}) AS last_seen FROM r GROUP BY ALL)"


def _links(spark, d):
    return graph.links(_rows(spark, d), 30 * DAY)


def _edges(spark, d):
    """Suppliers and the parts of their lines."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).agg(F.count("*").alias("events"), F.min("l_orderkey").alias("first_seen"), F.max("l_orderkey").alias("last_seen")).withColumn("link", F.lit("supplied"))


EDGES_SQL = "e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, 'supplied' AS link, count(*) AS events, min(l_orderkey) AS first_seen, max(l_orderkey) AS last_seen FROM lineitem GROUP BY ALL), b AS (SELECT src AS node, dst AS other, events, first_seen, last_seen, 'out' AS direction, link FROM e UNION ALL SELECT dst, src, events, first_seen, last_seen, 'in', link FROM e)"


def _claims(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("one"), F.concat(F.lit("k"), F.floor(F.col("o_totalprice") / 7000).cast("string"), F.lit("-"), F.floor(F.col("o_custkey") / 6).cast("string")).alias("other"), F.lit("paid").alias("rule"), epoch_ms(F.col("o_orderdate")).alias("time"))


CLAIM_SQL = f"q AS (SELECT 'c' || o_custkey AS one, 'k' || floor(o_totalprice / 7000)::BIGINT || '-' || floor(o_custkey / 6)::BIGINT AS other, 'paid' AS rule, epoch_ms(o_orderdate) AS time FROM orders), dd AS (SELECT one, other, rule, time // {DAY} AS day, count(*) AS events, min(time) AS first_seen, max(time) AS last_seen FROM q GROUP BY ALL), t AS (SELECT one, other, rule, sum(events)::BIGINT AS events, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM dd GROUP BY ALL)"


def _total(spark, d):
    return graph.claims_total(graph.claims(_claims(spark, d)))


ENTITY_SQL = f"{CLAIM_SQL}, u AS (SELECT one AS a, other AS b FROM t UNION SELECT other, one FROM t), cc(node, entity) AS (SELECT a, a FROM u UNION SELECT u.b, cc.entity FROM cc JOIN u ON u.a = cc.node), ent AS (SELECT node AS identifier, min(entity) AS entity FROM cc GROUP BY node)"


def _entities(spark, d):
    return graph.resolve(_total(spark, d))


def _evidence(spark, d):
    """Orders claim that a customer has a mailbox, a bare name or an account."""
    o = table(spark, d, "orders")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("bigint").cast("string") for p in parts])
    group, price = F.floor(F.col("o_custkey") / 6), F.col("o_totalprice")
    other = F.when(F.col("o_orderkey") % 3 == 0, text("user:email:k", F.floor(price / 7000), "-", group, "@x.y")).when(F.col("o_orderkey") % 3 == 1, text("user:name:k", F.floor(price / 20000))).otherwise(text("user:sid:s-1-5-21-", F.floor(F.col("o_custkey") / 4)))
    rows = o.select(text("user:uid:c", F.col("o_custkey")).alias("one"), other.alias("other"), F.lit("paid").alias("rule"), epoch_ms(F.col("o_orderdate")).alias("time"))
    return graph.claims_total(graph.claims(rows))


IDENTITY_SQL = """WITH RECURSIVE q AS (SELECT 'user:uid:c' || o_custkey AS one, CASE o_orderkey % 3 WHEN 0 THEN 'user:email:k' || floor(o_totalprice / 7000)::BIGINT || '-' || floor(o_custkey / 6)::BIGINT || '@x.y' WHEN 1 THEN 'user:name:k' || floor(o_totalprice / 20000)::BIGINT ELSE 'user:sid:s-1-5-21-' || floor(o_custkey / 4)::BIGINT END AS other, epoch_ms(o_orderdate) AS time FROM orders),
  t AS (SELECT one, other, 'paid' AS rule, count(*) AS events, min(time) AS first_seen, max(time) AS last_seen FROM q GROUP BY ALL),
  p AS (SELECT one AS id, split_part(other, ':', 2) AS form, other AS partner FROM t WHERE NOT starts_with(other, 'user:name:') UNION SELECT other, 'uid', one FROM t),
  sh AS (SELECT DISTINCT id FROM (SELECT id FROM p GROUP BY id, form HAVING count(DISTINCT partner) > 3)),
  g AS (SELECT * FROM t WHERE NOT starts_with(other, 'user:name:') AND one NOT IN (FROM sh) AND other NOT IN (FROM sh)),
  u AS (SELECT one AS a, other AS b FROM g UNION SELECT other, one FROM g), cc(node, entity) AS (SELECT a, a FROM u UNION SELECT u.b, cc.entity FROM cc JOIN u ON u.a = cc.node),
  n AS (SELECT node, min({'r': CASE split_part(entity, ':', 2) WHEN 'sid' THEN 0 WHEN 'uid' THEN 1 ELSE 2 END, 'e': entity}).e AS entity FROM cc GROUP BY node),
  f AS (SELECT * FROM (SELECT one AS id, * FROM g UNION ALL SELECT other, * FROM g) QUALIFY row_number() OVER (PARTITION BY id ORDER BY events DESC, one, other, rule) = 1),
  al AS (SELECT other AS weak, coalesce(n.entity, one) AS entity, one AS strong, t.* FROM t LEFT JOIN n ON n.node = one WHERE starts_with(other, 'user:name:') AND one NOT IN (FROM sh)),
  r AS (SELECT id AS identifier, entity, 'member' AS standing, CASE WHEN id <> entity THEN CASE WHEN one = id THEN other ELSE one END END AS "with", CASE WHEN id = entity THEN '' ELSE rule END AS rule, CASE WHEN id = entity THEN 0 ELSE events END AS events, CASE WHEN id = entity THEN 0 ELSE first_seen END AS first_seen, CASE WHEN id = entity THEN 0 ELSE last_seen END AS last_seen FROM f JOIN n ON node = id
    UNION ALL SELECT id, id, 'shared', NULL, '', 0, 0, 0 FROM sh
    UNION ALL SELECT weak, entity, 'alias', min(strong), 'paid', sum(events)::BIGINT, min(first_seen), max(last_seen) FROM al GROUP BY weak, entity)"""


def _sysmon(spark, d):
    return normalize.normalize(rules._sysmon_records(spark, d), definitions.sources()["sysmon"][2])


def _observables(spark, d):
    places = intel.places_of({p for own in Schema.of([definitions.sources()["sysmon"][2]]).classes.values() for p in own})
    return intel.event_observables(_sysmon(spark, d), places)


OBSERVABLES_SQL = f"""WITH {EVENTS_SQL} SELECT id, 'user' AS kind, 'CORP\\' || user_name AS value, CASE WHEN id % 3 = 0 THEN 'process.user.name' ELSE 'actor.user.name' END AS path FROM ev
  UNION ALL SELECT id, 'file_path', 'C:\\w\\' || source || '.exe', CASE WHEN id % 3 = 0 THEN 'process.file.path' ELSE 'actor.process.file.path' END FROM ev UNION ALL SELECT id, 'ip', src_ip, 'dst_endpoint.ip' FROM ev WHERE id % 3 = 1
  UNION ALL SELECT id, 'file_path', 'D:\\' || user_name || '.txt', 'file.path' FROM ev WHERE id % 3 = 2 UNION ALL SELECT id, 'md5', md5(user_name), 'process.file.hashes' FROM ev WHERE id % 3 = 0 UNION ALL SELECT id, 'sha256', sha256(user_name), 'process.file.hashes' FROM ev WHERE id % 3 = 0"""


def _seen(spark, d):
    """What the system monitor's records show. A few small files are dealt to
    all tasks first: records cost far more than their events' columns."""
    records = rules._sysmon_records(spark, d, events(spark, d).repartition("id"), ["time"])
    return observe.observe(normalize.normalize(records, definitions.sources()["sysmon"][2]))


def _identities(spark, d):
    return graph.resolve_identities(_evidence(spark, d))


def _decided(spark, d):
    """With people's word: two mailboxes of one and another customer are one
    account, and customers next to each other are not; tested by brute force."""
    same = spark.createDataFrame([("user:uid:c1", "user:uid:c30"), ("user:uid:c2", "user:uid:c31")], "a string, b string")
    apart = spark.createDataFrame([(f"user:uid:c{i}", f"user:uid:c{i + 1}") for i in range(0, 60, 2)], "a string, b string")
    return graph.resolve_identities(_evidence(spark, d), same, apart)


def _members(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("identifier"), F.concat(F.lit("brand:"), "p_brand").alias("entity"))


def _cannot(spark, d):
    """Entities while some pairs must stay apart; tested by brute force."""
    apart = spark.createDataFrame([("c0", "c1"), ("c6", "c7"), ("c12", "c13")], "a string, b string")
    return graph.resolve(_total(spark, d), None, apart)


def _with_forms(spark, d):
    return _total(spark, d).withColumn("form_one", F.lit("customer")).withColumn("form_other", F.lit("card"))


def _needs(spark, d):
    p = table(spark, d, "part")
    return p.select(F.concat(F.lit("T"), (1000 + F.col("p_partkey") % 500).cast("string")).alias("technique"), F.col("p_brand").alias("component")).distinct()


def _ruled(spark, d):
    return table(spark, d, "part").filter("p_size < 6").select(F.concat(F.lit("T"), (1000 + F.col("p_partkey") % 500).cast("string")).alias("technique"), F.col("p_brand").alias("component")).distinct()


def _available(spark, d):
    return table(spark, d, "part").filter("p_brand like 'Brand#1%'").select(F.col("p_brand").alias("component")).distinct()


def _verdicts(spark, d):
    return graph.coverage(_needs(spark, d), _available(spark, d), _ruled(spark, d))


COVER_SQL = """WITH n AS (SELECT DISTINCT 'T' || (1000 + p_partkey % 500) AS technique, p_brand AS component, p_size < 6 AS small FROM part), c AS (SELECT technique, count(DISTINCT component) AS components, bool_or(component LIKE 'Brand#1%') AS held, bool_or(small) AS any_rule, bool_or(small AND component LIKE 'Brand#1%') AS ruled FROM n GROUP BY 1),
  v AS (SELECT technique, components, CASE WHEN ruled THEN 'detected' WHEN any_rule THEN 'blind' WHEN held THEN 'collected' ELSE 'uncovered' END AS verdict FROM c)"""

#: A bundle as text, to be read back.
STIX_PART = """to_json(named_struct('type', 'bundle', 'objects', collect_list(named_struct('type', 'attack-pattern', 'id', concat('attack-pattern--', p_partkey), 'name', p_name, 'external_references', array(named_struct('source_name', 'mitre-attack', 'external_id', concat('T', 1000 + p_partkey))), 'revoked', p_size = 7))))"""


def _attack(spark, d):
    from ravelin.sources.feeds import attack_techniques

    bundles = table(spark, d, "part").groupBy((F.col("p_partkey") % 16).alias("b")).agg(F.expr(STIX_PART).alias("bundle"))
    return attack_techniques(bundles.select("bundle"))


def _bundles(spark, d):
    """A framework made of the parts: techniques, their relations, and brands as components."""
    p = table(spark, d, "part")
    k, own = F.col("p_partkey"), lambda kind, key: F.concat(F.lit(f"{kind}--"), key.cast("string"))
    ref = lambda x: F.array(F.struct(F.lit("mitre-attack").alias("source_name"), x.alias("external_id")))
    phase = lambda chain, name: F.struct(F.lit(chain).alias("kill_chain_name"), name.alias("phase_name"))
    tie = lambda kind, a, b: F.to_json(F.struct(F.lit("relationship").alias("type"), F.lit(kind).alias("relationship_type"), a.alias("source_ref"), b.alias("target_ref")))
    pattern = own("attack-pattern", k)
    per = p.select(
        (k % 8).alias("b"),
        F.explode(
            F.array_compact(
                F.array(
                    F.to_json(F.struct(F.lit("attack-pattern").alias("type"), pattern.alias("id"), F.col("p_name").alias("name"), ref(F.concat(F.lit("T"), (1000 + k).cast("string"))).alias("external_references"), F.array(phase("mitre-attack", F.concat(F.lit("ta"), (k % 3).cast("string"))), phase("mitre-attack", F.lit("ta0")), phase("other", F.lit("x"))).alias("kill_chain_phases"), F.array(F.col("p_brand")).alias("x_mitre_platforms"), (F.col("p_size") == 7).alias("revoked"), (F.col("p_size") == 9).alias("x_mitre_deprecated"))),
                    F.when((k % 4 == 1) & (k > 1), tie("subtechnique-of", pattern, own("attack-pattern", k - 1))),
                    F.when((F.col("p_size") == 7) & (k % 2 == 0), tie("revoked-by", pattern, own("attack-pattern", F.lit(1)))),
                    F.when(k % 3 == 0, tie("detects", own("ds", k), pattern)),
                    F.to_json(F.struct(F.lit("x-mitre-detection-strategy").alias("type"), own("ds", k).alias("id"), F.array(own("an", k), own("an", k + 1)).alias("x_mitre_analytic_refs"))),
                    F.to_json(F.struct(F.lit("x-mitre-analytic").alias("type"), own("an", k).alias("id"), F.array(F.struct(own("dc", F.col("p_brand")).alias("x_mitre_data_component_ref"))).alias("x_mitre_log_source_references"))),
                )
            )
        ).alias("o"),
    )
    brands = p.select("p_brand").distinct().select(F.lit(0).cast("bigint").alias("b"), F.to_json(F.struct(F.lit("x-mitre-data-component").alias("type"), own("dc", F.col("p_brand")).alias("id"), F.col("p_brand").alias("name"), ref(F.concat(F.lit("DC"), F.col("p_brand"))).alias("external_references"), F.col("p_brand").like("%5").alias("revoked"))).alias("o"))
    fixed = ['{"type":"x-mitre-collection","name":"Parts","x_mitre_version":"1.0"}', '{"type":"x-mitre-matrix","external_references":[{"source_name":"mitre-attack","external_id":"parts"}],"tactic_refs":["t--2","t--0","t--1"]}']
    fixed += [f'{{"type":"x-mitre-tactic","id":"t--{i}","name":"Tactic {i}","x_mitre_shortname":"ta{i}","external_references":[{{"source_name":"mitre-attack","external_id":"TA{i}"}}]}}' for i in range(3)]
    rest = spark.createDataFrame([(0, x) for x in fixed], "b bigint, o string")
    every = per.unionByName(brands).unionByName(rest)
    return every.groupBy("b").agg(F.concat(F.lit('{"type":"bundle","objects":['), F.array_join(F.collect_list("o"), ","), F.lit("]}")).alias("bundle"))


def _framework(spark, d):
    return attack.framework(_bundles(spark, d))


TECHNIQUE_SQL = """f AS (SELECT 'T' || (1000 + p_partkey) AS technique, p_name AS name, CASE p_partkey % 3 WHEN 0 THEN 'ta0,ta0' WHEN 1 THEN 'ta0,ta1' ELSE 'ta2,ta0' END AS tactics, p_brand AS platforms, CASE WHEN p_size = 7 THEN 'revoked' WHEN p_size = 9 THEN 'deprecated' ELSE 'active' END AS state,
  CASE WHEN p_size = 7 AND p_partkey % 2 = 0 THEN 'T1001' END AS replaced_by, CASE WHEN p_partkey % 4 = 1 AND p_partkey > 1 THEN 'T' || (999 + p_partkey) END AS parent FROM part)"""


def _path(spark, d):
    e = _edges(spark, d)
    return spark.createDataFrame([(a, b, graph.path_length(e, a, b)) for a, b in (("s1", "s2"), ("s3", "s30"))], "a string, b string, links int")


#: Nodes that walks and paths go on from: hubs end them.
OPEN_SQL = f"{EDGES_SQL}, g AS (SELECT node FROM b GROUP BY node HAVING count(DISTINCT other) <= {graph.HUB})"
PATH_SQL = f"WITH RECURSIVE {OPEN_SQL}, w(a, node, n) AS (SELECT s, s, 0 FROM (VALUES ('s1'), ('s3')) t(s) UNION SELECT w.a, b.other, n + 1 FROM w JOIN b ON b.node = w.node WHERE n < 4 AND (w.node = w.a OR w.node IN (FROM g))) SELECT x.a, x.b, min(n)::INT AS links FROM (VALUES ('s1', 's2'), ('s3', 's30')) x(a, b) LEFT JOIN w ON w.a = x.a AND w.node = x.b GROUP BY ALL"
WALK_SQL = f"""WITH {OPEN_SQL}, one AS (SELECT other, max(last_seen) AS seen FROM b WHERE node = 's5' GROUP BY 1 ORDER BY seen DESC, other LIMIT {graph.FRONTIER}),
  two AS (SELECT b.other, max(last_seen) AS seen FROM b WHERE node IN (SELECT other FROM one) AND node IN (FROM g) AND other <> 's5' AND other NOT IN (SELECT other FROM one) GROUP BY 1 ORDER BY seen DESC, 1 LIMIT {graph.FRONTIER})
  SELECT 's5' AS node, 0 AS level UNION ALL SELECT other, 1 FROM one UNION ALL SELECT other, 2 FROM two"""

QUERIES = {
    "graph_links": (lambda spark, d: _links(spark, d).select("src", "link", "dst", "hour", "events", F.col("first_seen.time").alias("first_time"), F.col("last_seen.id").alias("last_id")), f"{LINKS_SQL} SELECT src, link, dst, hour, events, first_seen.time AS first_time, last_seen.id AS last_id FROM l"),
    "graph_claims": (lambda spark, d: graph.claims(_claims(spark, d)), f"WITH {CLAIM_SQL} SELECT * FROM dd"),
    "graph_claims_total": (_total, f"WITH {CLAIM_SQL} SELECT * FROM t"),
    "graph_degree": (lambda spark, d: graph.degree(_edges(spark, d)), f"WITH {EDGES_SQL} SELECT node, count(DISTINCT other) AS degree FROM b GROUP BY 1"),
    "graph_edges": (lambda spark, d: graph.both_ways(_edges(spark, d)).join(_members(spark, d), F.col("other") == F.col("identifier"), "left").select("node", "other", "direction", "entity"), f"WITH {EDGES_SQL} SELECT node, other, direction, 'brand:' || p_brand AS entity FROM b LEFT JOIN part ON other = 'p' || p_partkey"),
    "graph_held": (lambda spark, d: _edges(spark, d).select(F.col("src").alias("node")).union(_members(spark, d).filter("identifier like 'p1%'").select("identifier")).distinct(), f"WITH {EDGES_SQL} SELECT src AS node FROM e UNION SELECT 'p' || p_partkey FROM part WHERE 'p' || p_partkey LIKE 'p1%'"),
    "graph_shared": (lambda spark, d: graph.shared(_with_forms(spark, d)), f"WITH {CLAIM_SQL} SELECT one AS id FROM t GROUP BY 1 HAVING count(DISTINCT other) > 3 UNION SELECT other FROM t GROUP BY 1 HAVING count(DISTINCT one) > 3"),
    "graph_entities": (_entities, f"WITH RECURSIVE {ENTITY_SQL} SELECT identifier, entity FROM ent"),
    "graph_entities_cannot_link": (_cannot, None),
    "identities": (_identities, f"{IDENTITY_SQL} SELECT * FROM r"),
    "identities_decided": (_decided, None),
    "identity_standing": (lambda spark, d: _identities(spark, d).groupBy("standing").agg(F.count("*").alias("identifiers"), F.countDistinct("entity").alias("entities")), f"{IDENTITY_SQL} SELECT standing, count(*) AS identifiers, count(DISTINCT entity) AS entities FROM r GROUP BY 1"),
    "observables_schema": (_observables, OBSERVABLES_SQL),
    "observed_links": (lambda spark, d: graph.links(observe.links_of(_seen(spark, d)), DAY).select("src", "link", "dst", "hour", "events", F.col("first_seen.id").alias("first_id")), f"""WITH {EVENTS_SQL}, x AS (SELECT id, time, 'host:name:' || host AS m, CASE id % 3 WHEN 0 THEN [{{'s': 'user:name:corp\\' || user_name, 'l': 'ran_on', 'd': 'host:name:' || host}}, {{'s': 'host:name:' || host, 'l': 'ran', 'd': 'file:hash:' || sha256(user_name)}}] WHEN 1 THEN [{{'s': 'host:name:' || host, 'l': 'connected_to', 'd': 'address:ip:' || src_ip}}] ELSE [] END AS ls FROM ev),
      y AS (SELECT id, time, unnest(ls) AS o FROM x) SELECT o.s AS src, o.l AS link, o.d AS dst, time // {DAY} AS hour, count(*) AS events, arg_min(id, time * 1000000 + id) AS first_id FROM y GROUP BY ALL"""),
    "neighbours_in_time": (lambda spark, d: graph.neighbours(_edges(spark, d), _members(spark, d), ["s1", "s2", "s3"], 50, 500, 900), f"WITH {EDGES_SQL} SELECT coalesce('brand:' || p_brand, other) AS neighbour, direction, link, sum(events)::BIGINT AS events, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM b LEFT JOIN part ON other = 'p' || p_partkey WHERE node IN ('s1', 's2', 's3') AND other NOT IN ('s1', 's2', 's3') AND last_seen >= 500 AND first_seen < 900 GROUP BY ALL ORDER BY last_seen DESC, neighbour, direction, link LIMIT 50"),
    "graph_entity": (lambda spark, d: _entities(spark, d).groupBy("entity").agg(F.count("*").alias("identifiers")), f"WITH RECURSIVE {ENTITY_SQL} SELECT entity, count(*) AS identifiers FROM ent GROUP BY 1"),
    "graph_aliases": (lambda spark, d: graph.aliases(_total(spark, d), _total(spark, d).select(F.col("other").alias("id")).filter("id like 'k1%'")), f"WITH {CLAIM_SQL} SELECT other AS alias, array_to_string(list_sort(list_distinct(list(one))), ',') AS entities FROM t WHERE other LIKE 'k1%' GROUP BY 1"),
    "resolution_summary": (lambda spark, d: _entities(spark, d).agg(F.countDistinct("entity").alias("entities"), F.count("*").alias("identifiers"), F.sum((F.col("entity") == F.col("identifier")).cast("bigint")).alias("names")), f"WITH RECURSIVE {ENTITY_SQL} SELECT count(DISTINCT entity) AS entities, count(*) AS identifiers, sum((entity = identifier)::INT)::BIGINT AS names FROM ent"),
    "neighbours": (lambda spark, d: graph.neighbours(_edges(spark, d), _members(spark, d), ["s1", "s2", "s3"], 50), f"WITH {EDGES_SQL} SELECT coalesce('brand:' || p_brand, other) AS neighbour, direction, link, sum(events)::BIGINT AS events, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM b LEFT JOIN part ON other = 'p' || p_partkey WHERE node IN ('s1', 's2', 's3') AND other NOT IN ('s1', 's2', 's3') GROUP BY ALL ORDER BY last_seen DESC, neighbour, direction, link LIMIT 50"),
    "neighbours_anti": (lambda spark, d: _edges(spark, d).select("dst").distinct().join(_members(spark, d).filter("entity like '%#1%'"), F.col("dst") == F.col("identifier"), "left_anti"), f"WITH {EDGES_SQL} SELECT DISTINCT dst FROM e WHERE dst NOT IN (SELECT 'p' || p_partkey FROM part WHERE p_brand LIKE '%#1%')"),
    "graph_walk": (lambda spark, d: graph.walk(_edges(spark, d), ["s5"], 2).select("node", "level"), WALK_SQL),
    "graph_path": (_path, PATH_SQL),
    "attack_load": (_attack, "SELECT 'attack-pattern--' || p_partkey AS stix_id, 'T' || (1000 + p_partkey) AS technique, p_name AS name FROM part WHERE p_size <> 7"),
    "attack_techniques": (lambda spark, d: _framework(spark, d).techniques.withColumns({c: F.array_join(c, ",") for c in ("tactics", "platforms")}), f"WITH {TECHNIQUE_SQL} SELECT * FROM f"),
    "attack_needs": (lambda spark, d: _framework(spark, d).needs, "SELECT DISTINCT 'T' || (1000 + a.p_partkey) AS technique, 'DC' || b.p_brand AS component FROM part a JOIN part b ON b.p_partkey IN (a.p_partkey, a.p_partkey + 1) WHERE a.p_partkey % 3 = 0 AND b.p_brand NOT LIKE '%5'"),
    "attack_tactics": (lambda spark, d: _framework(spark, d).tactics, "SELECT 'TA' || i AS tactic, 'Tactic ' || i AS name, 'ta' || i AS shortname, p::INT AS place FROM (VALUES (2, 0), (0, 1), (1, 2)) t(i, p)"),
    "attack_broken": (lambda spark, d: attack.broken_references(table(spark, d, "part").select(F.concat(F.lit("T"), (1000 + F.col("p_partkey") * 2).cast("string")).alias("technique")), _framework(spark, d).techniques), f"WITH {TECHNIQUE_SQL}, r AS (SELECT DISTINCT 'T' || (1000 + p_partkey * 2) AS technique FROM part) SELECT technique, coalesce(state, 'unknown') AS state, replaced_by FROM r LEFT JOIN f USING (technique) WHERE state IS NULL OR state <> 'active'"),
    "attack_coverage": (_verdicts, f"{COVER_SQL} SELECT * FROM v"),
    "attack_verdicts": (lambda spark, d: _verdicts(spark, d).groupBy("verdict").agg(F.count("*").alias("n")), f"{COVER_SQL} SELECT verdict, count(*) AS n FROM v GROUP BY 1"),
    "navigator_document": (lambda spark, d: graph.navigator_document(_verdicts(spark, d), "Parts", "parts", "1.0"), f"""{COVER_SQL} SELECT '{{"name":"Parts","domain":"parts","versions":{{"attack":"1.0","layer":"4.5"}},"techniques":[' || string_agg('{{"techniqueID":"' || technique || '","score":' || (CASE verdict WHEN 'detected' THEN 100 WHEN 'blind' THEN 50 WHEN 'collected' THEN 25 ELSE 0 END) || ',"comment":"' || verdict || '"}}', ',' ORDER BY technique) || ']}}' AS layer FROM v"""),
    "navigator_layer": (lambda spark, d: graph.navigator_layer(_verdicts(spark, d)), f"""{COVER_SQL} SELECT technique, '{{"techniqueID":"' || technique || '","score":' || (CASE verdict WHEN 'detected' THEN 100 WHEN 'blind' THEN 50 WHEN 'collected' THEN 25 ELSE 0 END) || ',"comment":"' || verdict || '"}}' AS entry FROM v"""),
}

