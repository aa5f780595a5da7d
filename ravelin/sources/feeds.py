"""Readers of published lists: CSV feeds, STIX bundles, context exports."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.sources.decoding import csv_fields, split_csv

OBJECT = "array<struct<type:string,id:string,name:string,revoked:boolean,x_mitre_deprecated:boolean,pattern:string,pattern_type:string,valid_from:string,valid_until:string,confidence:int,source_ref:string,target_ref:string,relationship_type:string,external_references:array<struct<source_name:string,external_id:string>>>>"


def feed_csv(lines: DataFrame, columns: list[str], line_col: str = "line", comment: str = "#", delimiter: str = ",") -> DataFrame:
    """Rows of a feed's lines, trimmed; blank lines and comments are left out,
    and a row that repeats the column names is the header."""
    values = csv_fields(F.col(line_col), delimiter, trim=True)
    rows = lines.filter((F.trim(line_col) != "") & ~F.startswith(F.ltrim(F.col(line_col)), F.lit(comment))).withColumn("__v", values).filter("__v is not null")
    rows = rows.filter(~F.col("__v").eqNullSafe(F.array(*[F.lit(c) for c in columns])))
    keep = [c for c in lines.columns if c != line_col]
    return rows.select(*keep, *[F.nullif(F.get("__v", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)])


@dataclass
class Feed:
    """How rows of a list become indicators: the value's column; the kind, one
    for all, by a column's words, or by the length of a hash; confidence, one for
    all or a column; times; and for how many days an indicator holds."""

    name: str
    value: str
    kind: str | None = None
    kind_column: str | None = None
    kinds: dict[str, str] = field(default_factory=dict)
    hashes: bool = False
    confidence: int = 50
    confidence_column: str | None = None
    first_seen: str | None = None
    last_seen: str | None = None
    label: str | None = None
    valid_days: int | None = None

    def __post_init__(self) -> None:
        if sum((self.kind is not None, self.kind_column is not None, self.hashes)) != 1:
            raise ValueError("a feed says the kind in one way")


#: Length of a hash in hex digits: its kind.
HASHES = {32: "md5", 40: "sha1", 64: "sha256"}


def indicators(rows: DataFrame, feed: Feed, fetched: int) -> DataFrame:
    """(feed, kind, value, label, confidence, first_seen, last_seen, valid_from,
    valid_until, rejected) of a list's rows, times in seconds. Rows of a kind
    that is not listed are left out; a row without a value, with one that is
    none of its kind or with a bad time or confidence is rejected. What a list
    says last, or first, or the time of the fetch, begins the days that it holds."""
    cell = lambda name: F.nullif(F.trim(F.col(name)), F.lit("")) if name else F.lit(None).cast("string")
    raw = cell(feed.value)
    if feed.hashes:
        kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in HASHES.items() for x in kv]), F.length(raw)), F.lit("hash"))
    elif feed.kind_column:
        kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in feed.kinds.items() for x in kv]), cell(feed.kind_column))
    else:
        kind = F.lit(feed.kind)
    hashed = F.when(raw.rlike("^[0-9A-Fa-f]+$"), F.lower(raw))
    value = F.when(kind == "domain", T.domain(raw)).when(kind == "url", T.url(raw)).when(kind == "ip", F.when(T.ip_hex(raw).isNotNull(), F.lower(raw))).when(kind == "email", T.identifier("email", raw))
    for n, name in HASHES.items():
        value = value.when(kind == name, F.when(F.length(hashed) == n, hashed))
    value = value.when(kind == "hash", F.lit(None).cast("string")).otherwise(raw)
    times = {n: T.feed_time(cell(c)) for n, c in (("first_seen", feed.first_seen), ("last_seen", feed.last_seen))}
    bad = [cell(c).isNotNull() & times[n].isNull() for n, c in (("first_seen", feed.first_seen), ("last_seen", feed.last_seen)) if c]
    confidence = F.lit(feed.confidence)
    if feed.confidence_column:
        confidence = F.coalesce(cell(feed.confidence_column).try_cast("int"), F.when(cell(feed.confidence_column).isNull(), feed.confidence))
        bad.append(confidence.isNull() | (confidence < 0) | (confidence > 100))
    out = rows.select(F.lit(feed.name).alias("feed"), kind.alias("kind"), value.alias("value"), cell(feed.label).alias("label"), confidence.alias("confidence"), *[c.alias(n) for n, c in times.items()], reduce(lambda a, b: a | b, bad, value.isNull()).alias("rejected"))
    begin = F.coalesce("last_seen", "first_seen", F.lit(fetched).cast("bigint"))
    return out.filter("kind is not null").withColumn("valid_from", F.col("first_seen")).withColumn("valid_until", begin + feed.valid_days * 86_400 if feed.valid_days else F.lit(None).cast("bigint"))


def _objects(bundles: DataFrame, col: str) -> DataFrame:
    return bundles.select(F.explode(F.from_json(F.col(col), f"struct<objects:{OBJECT}>")["objects"]).alias("o")).select("o.*")


#: One comparison of an object path with a text; joined by OR only.
COMPARISON = r"([a-z0-9-]+):([A-Za-z0-9_.'\-]+)\s*=\s*'((?:[^'\\]|\\.)*)'"
KINDS = {"ipv4-addr:value": "ip", "ipv6-addr:value": "ip", "domain-name:value": "domain", "url:value": "url", "email-addr:value": "email", "file:hashes.MD5": "md5", "file:hashes.'SHA-1'": "sha1", "file:hashes.'SHA-256'": "sha256"}


def feed_stix(bundles: DataFrame, col: str = "bundle") -> DataFrame:
    """(kind, value, valid_from, valid_until, confidence) of the indicators whose
    patterns are equality comparisons joined by OR."""
    o = _objects(bundles, col).filter("type = 'indicator' and pattern_type = 'stix' and not coalesce(revoked, false)")
    o = o.filter(F.col("pattern").rlike(rf"^\s*\[\s*{COMPARISON}(\s+OR\s+{COMPARISON})*\s*\]\s*$"))
    path = F.transform(
        F.arrays_zip(F.regexp_extract_all("pattern", F.lit(COMPARISON), F.lit(1)).alias("t"), F.regexp_extract_all("pattern", F.lit(COMPARISON), F.lit(2)).alias("p"), F.regexp_extract_all("pattern", F.lit(COMPARISON), F.lit(3)).alias("v")),
        lambda x: F.struct(F.concat_ws(":", x["t"], x["p"]).alias("path"), F.regexp_replace(x["v"], r"\\(.)", "$1").alias("value")),
    )
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return o.select(F.explode(path).alias("x"), "valid_from", "valid_until", "confidence").select(F.try_element_at(kinds, F.col("x.path")).alias("kind"), F.col("x.value").alias("value"), "valid_from", "valid_until", "confidence").filter("kind is not null")


def attack_techniques(bundles: DataFrame, col: str = "bundle") -> DataFrame:
    """(stix_id, technique, name) of the current techniques."""
    o = _objects(bundles, col).filter("type = 'attack-pattern' and not coalesce(revoked, false) and not coalesce(x_mitre_deprecated, false)")
    ref = F.get(F.filter("external_references", lambda r: F.startswith(r["source_name"], F.lit("mitre-"))), F.lit(0))
    return o.select(F.col("id").alias("stix_id"), ref["external_id"].alias("technique"), "name")


def context_export(spark: SparkSession, path: str, columns: list[str], kind: str = "csv") -> DataFrame:
    """The rows of an export, CSV with a header or a JSON object a line, with the
    named columns as texts. A column that the CSV has not refuses the export."""
    if kind == "json":
        v = F.try_parse_json("value")
        return spark.read.text(path).filter(F.trim("value") != "").select(*[F.try_variant_get(v, f"$['{c}']", "string").alias(c) for c in columns])
    lines = spark.read.text(path)
    header = lines.filter((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("#"))).first()
    names = split_csv(header.value, trim=True, strict=False) if header else []
    if missing := [c for c in columns if c not in (names or [])]:
        raise ValueError(f"the export has no column {missing[0]}")
    return feed_csv(lines.withColumnRenamed("value", "line"), names).select(*columns)


def context_rows(rows: DataFrame, id_col: str, separator: str, criticality: Column | None = None) -> DataFrame:
    """Records of an export: an id cell may hold several ids; words or 1 to 4
    name a criticality; is_* cells are flags. One bad id rejects the row."""
    words = F.create_map(*[F.lit(x) for kv in {"low": 1, "medium": 2, "high": 3, "critical": 4}.items() for x in kv])
    ids = F.filter(F.transform(F.split(F.col(id_col), separator), lambda x: F.trim(x)), lambda x: x != "")
    out = rows.withColumn("ids", ids)
    if criticality is not None:
        word = F.lower(F.trim(criticality))
        out = out.withColumn("criticality", F.coalesce(F.try_element_at(words, word), F.when(word.rlike("^[1-4]$"), word.try_cast("int"))))
    return out.withColumn("rejected", (F.size("ids") == 0) | F.exists("ids", lambda x: x.rlike(r"\s")))


def flag(col: Column) -> Column:
    """true, yes, y, 1 or false, no, n, 0 in any case; else null."""
    v = F.lower(F.trim(col))
    return F.when(v.isin("true", "yes", "y", "1"), True).when(v.isin("false", "no", "n", "0"), False)
