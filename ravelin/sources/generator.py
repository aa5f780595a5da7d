"""Telemetry of an organization that does not exist, for measuring: people and
their machines, events that few of them make most of (a Zipf law), records in
the formats of three products, and the truth of which identifiers are whose.

Everything follows from a seed and a row's number through hashes, so any
partitioning gives the same rows, and rows can be made again one by one.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPONENT = 1.1
#: The greatest number of ranks of a draw, as their limits are one array.
RANKS = 4096


def uniform(seed: int, what: str, *key: Column) -> Column:
    """A number in [0, 1) of 32 bits, from the seed, what it is for and a key."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(what), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / float(1 << 32)


@lru_cache(maxsize=8)
def zipf_limits(ranks: int, exponent: float = EXPONENT) -> tuple[float, ...]:
    """The share of all draws up to each rank but the last."""
    if not 0 < ranks <= RANKS:
        raise ValueError("a draw has 1 to 4096 ranks")
    weights = [1 / (k + 1) ** exponent for k in range(ranks)]
    total, upto, out = sum(weights), 0.0, []
    for w in weights[:-1]:
        upto += w
        out.append(upto / total)
    return tuple(out)


def zipf(u: Column, ranks: int, exponent: float = EXPONENT) -> Column:
    """The rank, from 0, that a uniform number draws."""
    return F.size(F.filter(F.array(*[F.lit(x) for x in zipf_limits(ranks, exponent)]) if ranks > 1 else F.array().cast("array<double>"), lambda x: x <= u))


def choice(u: Column, weights: dict[str, float]) -> Column:
    """A name by weight."""
    total, upto, out = sum(weights.values()), 0.0, None
    for name, w in weights.items():
        upto += w
        out = F.when(u < upto / total, name) if out is None else out.when(u < upto / total, name)
    return out.otherwise(next(reversed(weights)))


PRODUCTS = {"sysmon": 0.6, "entra": 0.15, "suricata": 0.25}


def identifiers(user: Column) -> dict[str, Column]:
    """The identifiers of a person and of the person's machine."""
    n = user.cast("string")
    return {
        "sid": F.concat(F.lit("S-1-5-21-7-"), n),
        "uid": F.concat(F.lit("oid-"), n),
        "email": F.concat(F.lit("user"), n, F.lit("@corp.example")),
        "name": F.concat(F.lit("CORP\\user"), n),
        "host": F.concat(F.lit("ws-"), n, F.lit(".corp.example")),
        "ip": F.concat(F.lit("10.1."), F.floor(user / 250).cast("string"), F.lit("."), (user % 250 + 1).cast("string")),
    }


def telemetry(rows: DataFrame, users: int, start_ms: int, per_second: float, seed: int = 1) -> DataFrame:
    """(id, time, user, product, record) for the numbers ``id`` of ``rows``: one
    record a number, evenly spaced, as its product writes it."""
    out = rows.select("id").withColumn("user", zipf(uniform(seed, "user", F.col("id")), users))
    out = out.withColumn("product", choice(uniform(seed, "product", F.col("id")), PRODUCTS)).withColumn("time", (F.lit(start_ms) + F.floor(F.col("id") * 1000 / per_second)).cast("bigint"))
    who = identifiers(F.col("user"))
    at = F.concat(F.date_format(F.timestamp_add("MILLISECOND", F.col("time"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    peer = F.concat(F.lit("203.0.113."), zipf(uniform(seed, "peer", F.col("id")), 200).cast("string"))
    system = F.struct(F.struct(F.struct(F.lit("Microsoft-Windows-Sysmon").alias("Name")).alias("#attributes")).alias("Provider"), F.lit(1).alias("EventID"), who["host"].alias("Computer"), F.struct(F.struct(at.alias("SystemTime")).alias("#attributes")).alias("TimeCreated"), F.col("id").alias("EventRecordID"))
    data = F.struct(who["name"].alias("User"), F.lit("C:\\Windows\\app.exe").alias("Image"), F.concat(F.lit("app -n "), F.col("id").cast("string")).alias("CommandLine"))
    sysmon = F.struct(F.struct(system.alias("System"), data.alias("EventData")).alias("Event"))
    entra = F.struct(at.alias("time"), F.lit("SignInLogs").alias("category"), F.lit("0").alias("resultType"), F.struct(who["uid"].alias("userId"), who["email"].alias("userPrincipalName"), who["ip"].alias("ipAddress")).alias("properties"))
    flow = F.struct(at.alias("timestamp"), F.lit("flow").alias("event_type"), who["ip"].alias("src_ip"), F.lit(50000).alias("src_port"), peer.alias("dest_ip"), F.lit(443).alias("dest_port"), F.lit("TCP").alias("proto"))
    record = F.when(F.col("product") == "sysmon", F.to_json(sysmon)).when(F.col("product") == "entra", F.to_json(entra)).otherwise(F.to_json(flow))
    return out.select("id", "time", "user", "product", record.alias("record"))


def truth(users: DataFrame) -> DataFrame:
    """(identifier, entity): which identifiers are whose, for the numbers ``user``
    of ``users``, as identity resolution spells and names them."""
    who = identifiers(F.col("user"))
    made = (("sid", "sid"), ("uid", "uid"), ("email", "email"), ("name", "email"), ("name", "name"))
    person = F.array(*[F.lower(F.concat(F.lit(f"user:{form}:"), who[k])) for form, k in made])
    own = users.select(F.explode(person).alias("identifier"), F.get(person, F.lit(0)).alias("entity"))
    host = F.lower(F.concat(F.lit("host:name:"), who["host"]))
    return own.unionByName(users.select(host.alias("identifier"), host.alias("entity")))
