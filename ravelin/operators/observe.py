"""What normalized events show of the things they name: identifiers that stand
in one object are claimed to be one thing, and things are linked by what an
event of their class says one did to the other.

Identifiers are texts ``kind:form:value`` in lower case. A user's account that
is named barely is an account of the event's machine; an address beside a
machine is held by it, and never claimed to be it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.plans.normalize import IPV4, IPV6

# Fixed values of the event model: where users and machines stand, what a source writes for no value, the SID of nobody.
USERS = ("user", "actor.user", "process.user", "actor.process.user", "process.parent_process.user", "actor.process.parent_process.user", "module.file.owner", "file.owner")
HOSTS = ("device", "src_endpoint", "dst_endpoint", "evidences.0.src_endpoint", "evidences.0.dst_endpoint")
NOTHING = ("", "-", "?", "null", "(null)", "none", "(none)", "n/a", "unknown", "(unknown)")
NOBODY = "s-1-0-0"
IDS = "array<struct<rank:int,id:string>>"


#: Members of an object that identifiers are made of.
USER_MEMBERS = ("uid", "uid_alt", "email_addr", "name", "domain")
HOST_MEMBERS = ("uid", "hostname", "name", "domain", "mac", "ip")


def _at(path: str) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))


def _ranked(found: Column) -> Column:
    """Identifiers by rank, the strongest first, each once."""
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.struct(T.identity_rank(x).cast("int").alias("rank"), x.alias("id"))))).cast(IDS)


def _is_ip(x: Column) -> Column:
    return x.rlike(IPV4) | x.rlike(IPV6)


def _hosts(rows: DataFrame) -> DataFrame:
    """Of the machine or endpoint whose members are ``__h<i>_<member>``:
    ``__h<i>``, its identifiers, and ``__a<i>``, its address."""
    m = lambda i, name: F.col(f"__h{i}_{name}")
    each = range(len(HOSTS))
    rows = rows.withColumns({f"__h{i}_called": F.regexp_replace(F.coalesce(m(i, "hostname"), m(i, "name")), r"\.$", "") for i in each} | {f"__h{i}_hex": F.regexp_replace(m(i, "mac"), "[^0-9a-f]", "") for i in each})
    rows = rows.withColumns({f"__h{i}_numeric": _is_ip(m(i, "called")) for i in each})
    ids, addresses = {}, {}
    for i in each:
        name, domain, mac = m(i, "called"), m(i, "domain"), m(i, "hex")
        whole = F.when(domain.isNotNull() & (domain != "workgroup") & ~name.contains("."), F.concat(name, F.lit("."), domain)).otherwise(name)
        mac = F.when(F.length(mac) == 12, F.regexp_replace(mac, "(..)(?!$)", "$1:"))
        found = _ranked(F.array_compact(F.array(F.concat(F.lit("host:uid:"), m(i, "uid")), F.when(~m(i, "numeric"), F.concat(F.lit("host:name:"), whole)), F.concat(F.lit("host:mac:"), mac))))
        ids[f"__h{i}"] = F.when(F.col(f"__h{i}_object").isNotNull(), found).otherwise(F.array().cast(IDS))
        addresses[f"__a{i}"] = F.concat(F.lit("address:ip:"), F.coalesce(F.when(_is_ip(m(i, "ip")), m(i, "ip")), F.when(m(i, "numeric"), name)))
    return rows.withColumns(ids | addresses)


def _users(rows: DataFrame) -> DataFrame:
    """Of the user whose members are ``__u<i>_<member>``: ``__u<i>``, its
    identifiers, for an event of the machine ``__h0``."""
    m = lambda i, name: F.col(f"__u{i}_{name}")
    sid = lambda x: F.when(x.rlike(r"^s-1-\d+(-\d+)*$") & (x != NOBODY), F.concat(F.lit("user:sid:"), x))
    uid = lambda x: F.when(~x.startswith("s-1-") & ~x.rlike(r"^\d+$"), F.concat(F.lit("user:uid:"), x))
    each = range(len(USERS))
    there = lambda i, x: F.when(F.col(f"__u{i}_object").isNotNull(), x)
    made = {"__device": F.get(F.col("__h0"), F.lit(0))["id"]}
    for i in each:
        email, name, domain = m(i, "email_addr"), m(i, "name"), m(i, "domain")
        made[f"__u{i}_own"] = there(i, F.array_compact(F.array(*[f(m(i, n)) for n in ("uid", "uid_alt") for f in (sid, uid)], F.when(email.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.concat(F.lit("user:email:"), email)))))
        made[f"__u{i}_written"] = F.when(domain.isNotNull() & ~name.rlike(r"[\\@]"), F.concat(domain, F.lit("\\"), name)).otherwise(name)
    rows = rows.withColumns(made)
    device, made = F.col("__device"), {}
    for i in each:
        written = m(i, "written")
        made[f"__u{i}_here"] = there(i, F.coalesce(device.startswith("host:name:") & written.contains("\\") & (F.substring_index(written, "\\", 1) == F.substring_index(F.regexp_replace(device, "^host:name:", ""), ".", 1)), F.lit(False)))
        made[f"__u{i}_named"] = F.concat(F.lit("user:name:"), written)
    rows = rows.withColumns(made)
    made = {}
    for i in each:
        of_device, named = m(i, "here"), m(i, "named")
        alone = ~F.exists(m(i, "own"), T.identity_strong)
        local = F.when(of_device | (alone & ~T.identity_strong(named)), F.concat(F.lit("user:local:"), F.regexp_replace(device, "^host:[a-z]*:", ""), F.lit(":"), F.regexp_replace(m(i, "written"), r"^[^\\]*\\", "")))
        found = _ranked(F.concat(m(i, "own"), F.array_compact(F.array(local, F.when(~of_device, named)))))
        made[f"__u{i}"] = there(i, found).otherwise(F.array().cast(IDS))
    return rows.withColumns(made)


def _file(v: Column, path: str) -> Column:
    """A file by the longest hash that the event gives."""
    hashes = F.transform(F.coalesce(F.try_variant_get(v, f"$.{path}.hashes", "array<variant>"), F.array().cast("array<variant>")), lambda h: F.lower(F.try_variant_get(h, "$.value", "string")))
    good = F.filter(hashes, lambda h: h.rlike("^[0-9a-f]{32,}$"))
    longest = F.array_max(F.transform(good, lambda h: F.struct(F.length(h).alias("n"), h.alias("h"))))
    return F.concat(F.lit("file:hash:"), longest["h"])


def observe(events: DataFrame, event: str = "event", id_col: str = "id", time_col: str = "time", class_col: str = "class_uid") -> DataFrame:
    """(id, time, one, what, other, is_claim): each claim (``what`` names the
    object that made it) and link of each event, once."""
    v = F.col("__v")
    # conditions, which always hold, keep the optimizer from copying parsers into every use of their results
    rows = events.select(F.col(id_col).alias("id"), F.col(time_col).alias("time"), F.col(class_col).alias("class_uid"), F.when(F.monotonically_increasing_id() >= 0, F.try_parse_json(event)).alias("__v"))
    # each object is looked up once and each member read once, as columns of their own; objects that are not there cost nothing more
    objects = {f"__h{i}": (p, HOST_MEMBERS) for i, p in enumerate(HOSTS)} | {f"__u{i}": (p, USER_MEMBERS) for i, p in enumerate(USERS)}
    rows = rows.withColumns({f"{c}_object": F.try_variant_get(v, _at(p), "variant") for c, (p, _) in objects.items()})
    rows = rows.withColumns({f"{c}_{n}": F.lower(F.trim(F.try_variant_get(F.col(f"{c}_object"), f"$.{n}", "string"))) for c, (_, names) in objects.items() for n in names})
    # texts that say nothing are null
    rows = rows.withColumns({f"{c}_{n}": F.when(~F.col(f"{c}_{n}").isin(*NOTHING), F.col(f"{c}_{n}")) for c, (_, names) in objects.items() for n in names})
    rows = _users(_hosts(rows))
    first = lambda c: F.get(F.col(c), F.lit(0))["id"]
    shape = lambda one, what, other, claim=False: F.struct(one.alias("one"), F.lit(what).alias("what"), other.alias("other"), F.lit(claim).alias("is_claim"))
    found: list[Column] = []
    for c, rule in [(f"__u{i}", "user") for i in range(len(USERS))] + [(f"__h{i}", "host") for i in range(len(HOSTS))]:
        found.append(F.transform(F.slice(F.col(c), 2, 100), lambda x: shape(first(c), rule, x["id"], True)))  # noqa: B023 - built at once
    machine, uid = first("__h0"), F.col("class_uid")
    ends = {p: i for i, p in enumerate(HOSTS)}
    src, dst = ends["src_endpoint"], ends["dst_endpoint"]
    who = F.coalesce(first(f"__u{USERS.index('actor.user')}"), first(f"__u{USERS.index('process.user')}"))
    network = F.floor(uid % 100000 / 1000) == 4
    opener = F.coalesce(first(f"__h{src}"), F.col(f"__a{src}"), machine)
    writes = F.try_variant_get(v, "$.activity_id", "bigint").isin(1, 3)
    domain = lambda x: F.concat(F.lit("domain:name:"), T.domain(x))
    asked = domain(F.try_variant_get(v, "$.query.hostname", "string"))
    answers = F.coalesce(F.try_variant_get(v, "$.answers", "array<variant>"), F.array().cast("array<variant>"))
    addresses = F.filter(F.transform(answers, lambda a: F.coalesce(F.try_variant_get(a, "$.rdata", "string"), F.try_variant_get(a, "$", "string"))), lambda x: x.rlike(IPV4) | x.rlike(IPV6))
    links = [
        (uid == 3002, first(f"__u{USERS.index('user')}"), "logged_on_to", F.coalesce(first(f"__h{dst}"), machine)),
        (uid == 1007, who, "ran_on", machine),
        (uid == 1007, machine, "ran", _file(v, "process.file")),
        (uid == 1005, machine, "ran", _file(v, "module.file")),
        ((uid == 1001) & writes, machine, "wrote", _file(v, "file")),
        (network, opener, "connected_to", F.col(f"__a{dst}")),
        (uid == 4003, opener, "resolved", asked),
        *[(F.lit(True), first(f"__h{i}"), "held", F.col(f"__a{i}")) for i in range(len(HOSTS))],
    ]
    found.append(F.array(*[F.when(test, shape(a, what, b)) for test, a, what, b in links]))
    found.append(F.when(uid == 4003, F.transform(addresses, lambda x: shape(asked, "resolved_to", F.concat(F.lit("address:ip:"), F.lower(x))))))
    every = F.concat(*[F.coalesce(x, F.array().cast("array<struct<one:string,what:string,other:string,is_claim:boolean>>")) for x in found])
    good = F.filter(F.array_distinct(F.array_compact(every)), lambda x: x["one"].isNotNull() & x["other"].isNotNull() & (x["one"] != x["other"]))
    return rows.select("id", "time", F.explode(good).alias("x")).select("id", "time", "x.*")


def claims_of(seen: DataFrame) -> DataFrame:
    """Claims as ``graph.claims`` takes them."""
    return seen.filter("is_claim").select("one", "other", F.col("what").alias("rule"), "time")


def links_of(seen: DataFrame) -> DataFrame:
    """Links as ``graph.links`` takes them."""
    return seen.filter("not is_claim").select(F.col("one").alias("src"), F.col("what").alias("link"), F.col("other").alias("dst"), "time", "id")
