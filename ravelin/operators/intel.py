"""Indicators: lookup of observed values, networks, validity, allowlists,
findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.plans.normalize import let, path_values

#: Most allowlist entries or prefix lengths that a join may broadcast.
SMALL = 50_000


def observables(events: DataFrame, id_col: str, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """(id, kind, value, path): typed values of each event, distinct by (kind,
    value) with the first path. ``values`` maps a path to its kind and Column."""
    made = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(p).alias("path"), F.lit(k).alias("kind"), c.alias("value")) for i, (p, (k, c)) in enumerate(values.items())])
    rows = events.select(F.col(id_col).alias("id"), F.explode(made).alias("o")).select("id", "o.*").filter("value is not null")
    return rows.groupBy("id", "kind", "value").agg(F.min_by("path", "no").alias("path"))


#: Kinds of values by the last names of their path in the event model.
PLACES = {
    "ip": "ip",
    "hostname": "domain",
    "sni": "domain",
    "email_addr": "email",
    "url_string": "url",
    "file.name": "file_name",
    "file.path": "file_path",
    "user.name": "user",
    "reg_key.path": "registry_key",
    "reg_value.path": "registry_key",
    "ja3_hash.value": "ja3",
    "ja3s_hash.value": "ja3s",
    "fingerprints.value": "certificate_hash",
    "rdata": "ip",
}


def places_of(paths) -> dict[str, str]:
    """Of attributes' paths, those that hold observables, and their kinds."""
    out = {}
    for path in sorted(paths):
        names = [p for p in path.split(".") if not p.isdigit()]
        kind = PLACES.get(names[-1]) or PLACES.get(".".join(names[-2:]))
        if kind:
            out[".".join(names)] = kind
        elif names[-1] == "hashes":
            out[".".join(names)] = "hash"
    return out


def event_observables(events: DataFrame, places: dict[str, str], event: str = "event", id_col: str = "id") -> DataFrame:
    """(id, kind, value, path): the values of normalized events at the places
    that their schema types name, through arrays, distinct by kind and value
    with the first path. A hash's kind follows from its algorithm, or its length."""
    v = F.col("__v")
    # the condition, which always holds, keeps the optimizer from copying the parser into every use of its result
    rows = events.select(F.col(id_col).alias("id"), F.when(F.monotonically_increasing_id() >= 0, F.try_parse_json(event)).alias("__v"))
    found = []
    for no, (path, kind) in enumerate(places.items()):
        if kind == "hash":
            algorithm, value = path_values(v, f"{path}.algorithm"), path_values(v, f"{path}.value")
            pairs = F.arrays_zip(algorithm.alias("a"), value.alias("v"))
            named = lambda x: F.when(F.upper(x["a"]) == "IMPHASH", "imphash").otherwise(F.try_element_at(F.create_map(*[F.lit(y) for kv in {32: "md5", 40: "sha1", 64: "sha256"}.items() for y in kv]), F.length(x["v"])))
            found.append(F.transform(pairs, lambda x: F.struct(F.lit(no).alias("no"), F.lit(path).alias("path"), named(x).alias("kind"), F.lower(x["v"]).alias("value"))))  # noqa: B023 - built at once
        else:
            found.append(F.transform(path_values(v, path), lambda x: F.struct(F.lit(no).alias("no"), F.lit(path).alias("path"), F.lit(kind).alias("kind"), x.alias("value"))))  # noqa: B023
    each = rows.select("id", F.explode(F.concat(*found)).alias("o")).select("id", "o.*")
    typed = F.when(F.col("kind") == "domain", T.domain(F.col("value"))).when(F.col("kind") == "ip", F.when(T.ip_hex(F.col("value")).isNotNull(), F.lower("value"))).when(F.col("kind") == "url", T.url(F.col("value"))).otherwise(F.col("value"))
    good = each.withColumn("value", typed).filter("kind is not null and value is not null and value <> ''")
    return good.groupBy("id", "kind", "value").agg(F.min_by("path", "no").alias("path"))


def valid_at(at: Column) -> Column:
    """Half-open validity; an open end is no end."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_until").isNull() | (at < F.col("valid_until")))


def match_exact(observed: DataFrame, indicators: DataFrame) -> DataFrame:
    """Equi-join on (kind, value); the runtime filter prunes observed values."""
    return observed.join(indicators, ["kind", "value"])


def match_networks(observed: DataFrame, networks: DataFrame, lengths: list[int]) -> DataFrame:
    """Addresses in networks, as an equi-join for each prefix length in use:
    ``networks`` has (net, prefix, ...), ``observed`` an IPv4 ``number``. Longer
    prefixes come first by ``prefix``."""
    if len(lengths) > 33:
        raise ValueError("an IPv4 prefix has 0 to 32 bits")
    tries = F.array(*[F.struct(F.lit(p).alias("prefix"), T.mask(F.col("number"), p).alias("net")) for p in lengths])
    return observed.filter("number is not null").withColumn("t", F.explode(tries)).select(*observed.columns, "t.prefix", "t.net").join(networks, ["net", "prefix"])


def network(cidr: Column) -> tuple[Column, Column]:
    """(net, prefix) of ``address/bits`` of either family: hex digits and bits of
    128; null if it is no network."""
    address, bits = F.substring_index(cidr, "/", 1), F.regexp_extract(cidr, r"/(\d{1,3})$", 1).try_cast("int")
    prefix = F.when(address.contains(":"), F.when(bits <= 128, bits)).otherwise(F.when(bits <= 32, bits + 96))
    return F.when(prefix.isNotNull(), let(T.ip_hex(address), lambda a: T.hex_mask(a, prefix))), prefix


def match_addresses(observed: DataFrame, networks: DataFrame, lengths: list[int]) -> DataFrame:
    """Addresses of either family (``address``, as ``ip_hex`` writes them) in
    ``networks`` (net, prefix, ...; prefixes of 128 bits), as an equi-join for
    each prefix length in use."""
    if len(lengths) > 129 or any(not 0 <= p <= 128 for p in lengths):
        raise ValueError("a prefix has 0 to 128 bits")
    tries = F.array(*[F.struct(F.lit(p).alias("prefix"), T.hex_mask(F.col("address"), p).alias("net")) for p in lengths])
    # the condition, which always holds, keeps the optimizer from reading the address anew for each prefix
    once = observed.withColumn("address", F.when(F.monotonically_increasing_id() >= 0, F.col("address"))).filter("address is not null")
    return once.withColumn("t", F.explode(tries)).select(*observed.columns, "t.prefix", "t.net").join(networks, ["net", "prefix"])


def parents(domain: Column) -> Column:
    """The domain and its parents, nearest first, down to two labels."""
    labels = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def allowed(hits: DataFrame, allow: DataFrame) -> DataFrame:
    """``hits`` (with ``host``) and the ``allow`` entry that covers the host, if
    any: exact first, then the nearest ``*.parent``, which also covers the parent
    itself; of equals the first list wins. ``allow`` has (entry, list_no)."""
    tries = hits.select("host").distinct().select("host", F.posexplode(parents(F.col("host"))).alias("step", "parent"))
    keys = tries.select("host", "step", F.explode(F.array(F.col("parent"), F.concat(F.lit("*."), F.col("parent")))).alias("entry")).filter("step = 0 or entry like '*%'")
    found = keys.join(allow, "entry").withColumn("order", F.struct(F.col("entry").startswith("*").cast("int"), "step", "list_no"))
    best = found.groupBy("host").agg(F.min_by("entry", "order").alias("allowed_by"))
    return hits.join(best, "host", "left")


def summarize(hits: DataFrame, *keys: str) -> DataFrame:
    """One row a hit: the greatest confidence, the earliest ``added`` (unknown if
    any is), and the feeds in order."""
    return hits.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.when(F.count("*") == F.count("added"), F.min("added")).alias("known_since"), F.array_join(F.array_sort(F.collect_set("feed")), ",").alias("feeds"))


def findings(hits: DataFrame) -> DataFrame:
    """Findings from summarized hits with ``allowed_by``: the severity by the
    confidence band, an id from event and indicator, so that reruns collapse."""
    held = F.col("allowed_by").isNotNull()
    return hits.select(
        F.sha2(F.concat_ws("|", F.col("id").cast("string"), "kind", "value"), 256).alias("uid"),
        "id",
        "kind",
        "value",
        "confidence",
        F.when(held, 1).otherwise(T.band(F.col("confidence")) + 1).alias("severity_id"),
        (~held).alias("is_alert"),
        F.when(held, "Suppressed").otherwise("New").alias("status"),
    )


# Fixed values of the event model: types of indicators as intelligence and as observables.
OSINT_TYPES = {"ip": 1, "cidr": 1, "domain": 2, "md5": 4, "sha1": 4, "sha256": 4, "imphash": 4, "url": 5, "certificate_hash": 7, "certificate_subject": 7, "email": 9, "file_path": 11, "file_name": 11, "registry_key": 12}
OBSERVABLE_TYPES = {"domain": 1, "ip": 2, "user": 4, "email": 5, "url": 6, "file_name": 7, "md5": 8, "sha1": 8, "sha256": 8, "cidr": 12, "registry_key": 28, "file_path": 45}


def _typed(types: dict[str, int], kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in types.items() for x in kv]), kind), F.lit(99))


def finding_events(hits: DataFrame, events: DataFrame, created_ms: int) -> DataFrame:
    """Detection findings as events of their own, one for each event and
    indicator: (uid, id, time, class_uid, severity_id, is_alert, event). The time
    is the event's, whenever the indicator came; the uid follows from event and
    indicator, so that an event that is read twice gives one finding.

    ``hits`` has a row a feed (id, kind, value, path, feed, version, confidence,
    valid_from, valid_until, first_seen, last_seen, allowed_by); ``events`` (id,
    time, class_uid). ``osint`` has an entry a feed, by feed, and
    ``unmapped.assertions`` the same without loss. A hit that an allowlist
    covers is suppressed and no alert."""
    claim = F.struct("feed", "version", "confidence", "valid_from", "valid_until", "first_seen", "last_seen")
    per = hits.groupBy("id", "kind", "value").agg(F.min("path").alias("path"), F.max("confidence").alias("confidence"), F.min("allowed_by").alias("allowed_by"), F.array_sort(F.collect_set(claim)).alias("assertions"))
    per = per.join(events.select("id", F.col("time").alias("event_time"), F.col("class_uid").alias("event_class")), "id")
    held = F.col("allowed_by").isNotNull()
    severity = F.when(held, 1).otherwise(T.band(F.col("confidence")) + 1)
    uid = F.substring(F.sha2(F.concat_ws("|", F.col("id").cast("string"), "kind", "value"), 256), 1, 32)
    ms = lambda x: x * 1000
    osint = F.transform(
        "assertions",
        lambda a: F.struct(F.col("value").alias("value"), _typed(OSINT_TYPES, F.col("kind")).alias("type_id"), a["feed"].alias("vendor_name"), a["version"].alias("uid"), T.band(a["confidence"]).alias("confidence_id"), ms(a["first_seen"]).alias("created_time"), ms(a["last_seen"]).alias("modified_time"), ms(a["valid_until"]).alias("expiration_time")),
    )
    evidence = F.array(F.struct(F.struct(F.col("id").cast("string").alias("event_uid"), F.col("event_class").alias("class_uid"), F.col("event_time").alias("time"), F.col("path").alias("path")).alias("data")))
    body = F.struct(
        F.lit(2004).alias("class_uid"),
        F.lit(2).alias("category_uid"),
        F.lit(200401).alias("type_uid"),
        F.lit(1).alias("activity_id"),
        F.col("event_time").alias("time"),
        severity.alias("severity_id"),
        (~held).alias("is_alert"),
        F.when(held, 3).otherwise(1).alias("status_id"),
        F.when(held, "Suppressed").otherwise("New").alias("status"),
        F.col("allowed_by").alias("status_detail"),
        T.band(F.col("confidence")).alias("confidence_id"),
        F.col("confidence").alias("confidence_score"),
        F.struct(uid.alias("uid"), F.concat(F.lit("Indicator "), "value").alias("title"), F.lit(created_ms).cast("bigint").alias("created_time"), F.array_distinct(F.transform("assertions", lambda a: a["feed"])).alias("data_sources")).alias("finding_info"),
        F.array(F.struct(F.col("path").alias("name"), _typed(OBSERVABLE_TYPES, F.col("kind")).alias("type_id"), F.col("value").alias("value"))).alias("observables"),
        osint.alias("osint"),
        evidence.alias("evidences"),
        F.struct(F.col("assertions"), F.col("allowed_by").alias("allowed")).alias("unmapped"),
    )
    return per.select(uid.alias("uid"), "id", F.col("event_time").alias("time"), F.lit(2004).alias("class_uid"), severity.cast("int").alias("severity_id"), (~held).alias("is_alert"), F.to_json(body).alias("event"))


def feed_gate(rows: DataFrame, most: float = 0.10) -> DataFrame:
    """Publications (feed, rejected) with too many rejected rows are refused whole."""
    return rows.groupBy("feed").agg(F.count("*").alias("rows"), F.sum(F.col("rejected").cast("bigint")).alias("rejected")).withColumn("accepted", (F.col("rows") > 0) & (F.col("rejected") <= F.col("rows") * most))


# Context


def holding(found: DataFrame, at: Column) -> DataFrame:
    return found.filter(valid_at(at))


def with_ended(found: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """Records that hold; for a source of which none holds, its record that
    ended last before. Keys name the event's row."""
    marked = found.withColumn("holds", valid_at(at)).filter(F.col("holds") | (F.col("valid_until") <= at))
    any_holds = F.max(F.col("holds").cast("int")).over(Window.partitionBy(*keys, "source"))
    last = F.row_number().over(Window.partitionBy(*keys, "source").orderBy(F.desc("holds"), F.desc("valid_until"), "record"))
    return marked.withColumn("any_holds", any_holds).withColumn("last", last).filter(F.col("holds") | ((F.col("any_holds") == 0) & (F.col("last") == 1))).drop("any_holds", "last")


def narrowest(found: DataFrame, keys: list[str]) -> DataFrame:
    """Of ranges that hold an address, the narrowest; ``keys`` name the event's
    row, and the source and kind of records where each has its own."""
    return found.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("prefix"), "record"))).filter("rn = 1").drop("rn")


def cap(found: DataFrame, keys: list[str], order: list[str], most: int = 32) -> DataFrame:
    """At most ``most`` enrichments an event, in a fixed order."""
    return found.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rn") <= most).drop("rn")
