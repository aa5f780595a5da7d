"""URL filters by hashed host-suffix and path-prefix expressions, in DataFrame
functions only.

A URL is expanded into expressions ``host suffix + path prefix``: the suffixes
of its host of as many labels as some rule has, with the prefixes of its path
of a length that some rule has; and into the words of its host, the parts
between dots and hyphens, each as the expression ``word:...``. Expressions meet
the list on the first 32 bits of their SHA-256 (the short prefix); the full
digests then confirm, so a shared prefix of unequal expressions never counts.
The longest confirmed rule wins; a rule of the caller's list outranks the
method's own host words, which block a host that has one of them as a whole
word (``casino-win.example``, not ``casinova.example``).

Scale: each distinct URL is expanded once (equal URLs collapse map-side) and
verdicts are joined back, so only URLs are shuffled, never pages. What a URL
expands to is bounded by the label counts and path lengths of the rules and by
its own words. The list is the caller's literal; it is broadcast only while its
size is under ``BROADCAST_RULES`` and met by a shuffled equi-join beyond that.

Defined results: null URLs and those without ``://`` have an empty host and
path, fit no rule and are allowed; equal rows give a row each; null ids stay;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import table

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: What the method adds where no rule fits: whole words of a host that mark a site of adult, gambling, drug, spam, tracking or hostile content.
BLOCKED_WORDS = ("adult", "porn", "sex", "xxx", "bet", "bets", "casino", "poker", "slots", "pills", "pharma", "viagra", "spam", "adserver", "ads", "track", "tracker", "tracking", "malware", "phishing", "warez")
PREFIX_HEX = 8
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules=RULES, words=BLOCKED_WORDS) -> DataFrame:
    """(rank, rule, verdict, digest, short): the rules, and the words below them."""
    made = [(1, h + p, v, h + p) for h, p, v in rules] + [(0, None, "block", f"word:{w}") for w in words]
    listed = spark.createDataFrame(made, "rank int, rule string, rule_verdict string, expression string")
    return listed.withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, PREFIX_HEX)).drop("expression")


def expressions(host: Column, path: Column, rules=RULES) -> Column:
    """All expressions of a URL that the list could have."""
    counts = sorted({h.count(".") + 1 for h, _, _ in rules})
    lengths = sorted({len(p) for _, p, _ in rules})
    labels = F.split(host, r"\.", -1)
    suffixes = F.array_compact(F.array(*[F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in counts])).cast("array<string>")
    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])).cast("array<string>")
    both = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.array_distinct(F.concat(both, F.transform(F.split(host, r"[.\-]", -1), lambda w: F.concat(F.lit("word:"), w))))


def judge(pages: DataFrame, rules=RULES, words=BLOCKED_WORDS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``."""
    spark = pages.sparkSession
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumn("u", F.coalesce("url", F.lit("")))
    urls = slim.select("u").distinct().select("u", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    seen = (
        urls.filter("host <> '' or path <> ''")
        .select("u", F.explode(expressions(F.col("host"), F.col("path"), rules)).alias("expression"))
        .select("u", F.sha2("expression", 256).alias("seen"))
        .withColumn("short", F.substring("seen", 1, PREFIX_HEX))
    )
    listed = rule_table(spark, rules, words)
    listed = F.broadcast(listed) if len(rules) + len(words) <= BROADCAST_RULES else listed
    fits = seen.join(listed, "short").filter("seen = digest")
    best = fits.groupBy("u").agg(F.max(F.struct("rank", F.coalesce(F.length("rule"), F.lit(0)).alias("n"), F.col("rule").alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best"))
    judged = urls.join(best, "u", "left").select("u", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
    return slim.join(judged, "u").select("page_id", "host", "path", "rule", "verdict")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def sql() -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    words = ", ".join(f"'{w}'" for w in BLOCKED_WORDS)
    return f"""
    WITH r(rh, rp, rv) AS (VALUES {values}),
    p AS (SELECT row_number() OVER () AS row_no, page_id, url,
      translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    f AS (SELECT row_no, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
      FROM p, r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY row_no)
    SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN list_has_any(regexp_split_to_array(host, '[.-]'), [{words}]) THEN 'block' ELSE 'allow' END) AS verdict
    FROM p LEFT JOIN f USING (row_no)"""
