"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every text is a historical version of some path. It is addressed by its
content (SHA-256); a ledger keeps, for each blob, which rules of which version
were ever tried on it and what they found. A run scans only those pairs of a
blob and a rule version that the ledger lacks, each blob once however many
paths hold it, appends them, and joins findings back to all paths. A change to
one rule scans that rule alone.

``scan`` takes history as increments: each one is read against the ledger that
the ones before it left. Without a ledger of the caller's, the query starts an
empty one in the shared folder and goes through its rows in ``INCREMENTS``.

Offsets come from built-in functions: ``split`` and ``regexp_extract_all`` of
one pattern see the same leftmost, non-overlapping matches, so a match starts
after all pieces and matches before it; running sums are taken in chunks, so
the work is linear in the matches. Patterns that few texts hold sit behind a
substring test that every match passes.

Scale: one exchange of texts, by content address, where equal texts collapse
map-side; paths travel as (path, address). A blob that more than a thousandth
of all paths hold (at most a thousand blobs can be) is joined in ``SALTS``
parts. Texts and spans of one row are the largest unit of memory.

Defined results: null and empty texts have no findings and the digest of the
empty string; equal rows and rows with a null id give a row each; an empty
table gives an empty result; other columns are ignored by ``scan`` and kept by
``redact``, whatever their names. Overlapping spans of several kinds are all
listed; ``redact`` replaces them as one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import free_name, materialize, table, work_path

_KEY = r"password|passwd|secret|token|api_?key"
#: (kind, version, pattern, group that carries the value, its least length, substrings of which a lower-cased text holds one, or none). The
#: first three are the base; a pattern whose matches would all be too short to count asks for the length itself where that finds the same.
RULES = (
    ("assign", 1, rf"""(?i:({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    ("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20, ("akia",)),
    ("hex", 1, r"[0-9a-f]{24,}", 0, 24, ()),
    ("private_key", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 0, ("private key-----",)),
    ("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, ("xox",)),
    ("google", 1, r"AIza[A-Za-z0-9_-]{35}", 0, 0, ("aiza",)),
    ("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, ("eyj",)),
)
BASE = ("assign", "access", "hex")

SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string>>"


#: What a ledger holds: a blob, the rules with their versions that were tried, and what they found.
LEDGER = f"blob string, rules array<string>, spans {SPAN}"
#: Parts in which the query goes through its rows.
INCREMENTS = 2
#: Parts in which paths of a very common blob meet its findings.
SALTS = 32


def rule_key(rule: tuple) -> str:
    """Names a rule and its version."""
    return f"{rule[0]}:{rule[1]}"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's other columns are
    computed anew for each element."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, add, levels: int = 2, chunk: int = 64) -> Column:
    """What comes before each of an array of numbers, put together by ``add``
    from 0. Lists are built a chunk at a time and the chunks' totals the same
    way, so that appending never copies a long list."""
    zero, none = F.lit(0), F.array().cast("array<int>")

    def flat(xs: Column) -> Column:
        return F.aggregate(xs, F.struct(zero.alias("sum"), none.alias("out")), lambda acc, x: F.struct(add(acc["sum"], x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")), lambda acc: acc["out"])

    def chunked(xs: Column) -> Column:
        return F.transform(F.sequence(zero, F.greatest(F.size(xs) - 1, zero), F.lit(chunk)), lambda at: F.slice(xs, at + 1, chunk))

    def joined(chunks: Column) -> Column:
        bases = running(F.transform(chunks, lambda xs: F.aggregate(xs, zero, add)), add, levels - 1, chunk)
        return F.flatten(F.zip_with(chunks, bases, lambda xs, base: F.transform(flat(xs), lambda x: add(base, x))))

    return _let(values, lambda xs: _let(chunked(xs), joined)) if levels else flat(values)


def _spans(text: Column, low: Column, no: int, rule: tuple) -> Column:
    """Spans (start, kind_no, end, kind) of one rule; code points, end exclusive."""
    kind, _, pattern, group, least, needs = rule
    lengths = lambda of: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(of)), F.length)

    def placed(n: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), 1, F.size(n))
        return _let(gaps, lambda g: F.arrays_zip(F.zip_with(running(F.zip_with(g, n, lambda a, b: a + b), lambda a, b: a + b), g, lambda at, a: at + a).alias("at"), n.alias("n"), (lengths(group) if group else n).alias("v")))

    spans = F.transform(F.filter(_let(lengths(0), placed), lambda x: x["v"] >= least), lambda x: F.struct(x["at"].alias("start"), F.lit(no).alias("kind_no"), (x["at"] + x["n"]).alias("end"), F.lit(kind).alias("kind")))
    may = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in needs]) if needs else text.rlike(pattern)
    return F.when(may, spans).otherwise(F.array().cast(SPAN))


def find_spans(text: Column, low: Column, rules=RULES, wanted: Column | None = None) -> Column:
    """All spans of a text, by start, then in the rules' order; of the rules
    that ``wanted``, an array of rule keys, names."""
    each = [_spans(text, low, i, r) for i, r in enumerate(rules)]
    if wanted is not None:
        each = [F.when(F.array_contains(wanted, rule_key(r)), x).otherwise(F.array().cast(SPAN)) for r, x in zip(rules, each, strict=True)]
    return F.array_sort(F.concat(*each))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with every span, overlapping ones as one, replaced."""
    reached = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))  # the end of all spans before
    pieces = F.zip_with(spans, reached, lambda s, at: F.when(s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), F.lit(mark))).otherwise(""))
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.lit(2**31 - 1)))).otherwise(text)


def _blob(text_col: str) -> Column:
    """The content address; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def scan_blobs(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES, text_col: str = "text", keep: bool = False) -> DataFrame:
    """New ledger entries (blob, rules, spans): of the blobs in ``docs``, the
    rules that ``ledger`` has not tried on them. With ``keep`` every blob comes,
    with what the ledger had found (``known``) and its text."""
    blobs = docs.groupBy(_blob(text_col).alias("blob")).agg(F.first(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    every, none, no_spans = F.array(*[F.lit(rule_key(r)) for r in rules]).cast("array<string>"), F.array().cast("array<string>"), F.array().cast(SPAN)
    wanted = None
    if ledger is None:
        blobs = blobs.withColumn("rules", every).withColumn("known", no_spans)
    else:
        tried = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("tried"))
        tried = tried.join(findings(ledger, rules).withColumnRenamed("spans", "known"), "blob") if keep else tried.withColumn("known", no_spans)
        blobs = blobs.join(tried, "blob", "left").withColumn("rules", F.array_except(every, F.coalesce("tried", none))).withColumn("known", F.coalesce("known", no_spans))
        blobs, wanted = blobs if keep else blobs.filter(F.size("rules") > 0), F.col("rules")
    found = blobs.withColumn("low", F.lower("text")).withColumn("spans", find_spans(F.col("text"), F.col("low"), rules, wanted))
    return found.select("blob", "rules", "spans", *["known", "text"][: 2 * keep])


def findings(ledger: DataFrame, rules=RULES) -> DataFrame:
    """(blob, spans): what the ledger knows of these rules in these versions.
    A pair that two runs wrote counts once."""
    mine = F.array(*[F.lit(rule_key(r)) for r in rules])
    number = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r[0]), F.lit(i))])
    kinds = F.transform(F.filter("rules", lambda k: F.array_contains(mine, k)), lambda k: F.substring_index(k, ":", 1))
    own = F.transform(F.filter("spans", lambda s: F.array_contains(kinds, s["kind"])), lambda s: F.struct(s["start"], F.try_element_at(number, s["kind"]).alias("kind_no"), s["end"], s["kind"]))
    return ledger.select("blob", own.alias("s")).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).cast(SPAN).alias("spans"))


def _report(joined: DataFrame) -> DataFrame:
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind_no"] < len(BASE))
    return joined.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
        F.col("blob"),
    )


def _increment(docs: DataFrame, parts: int, part: int) -> DataFrame:
    """Rows of one of ``parts`` increments of the history, by their content."""
    return docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) == part) if parts > 1 else docs


def _meet(paths: DataFrame, found: DataFrame) -> DataFrame:
    """Paths (doc_id, blob) with the spans of their blob. Blobs that more than a
    thousandth of the paths hold are joined in parts."""
    counts = paths.groupBy("blob").agg(F.count("*").alias("paths"))
    total = paths.count()
    hot = counts.filter(F.col("paths") > max(1000, total // 1000)).select("blob", F.lit(SALTS).alias("salts"))  # at most a thousand rows
    hot = F.broadcast(materialize(hot, "hot"))
    salted = paths.join(hot, "blob", "left").withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0))
    spread = found.join(hot, "blob", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("salts") - 1, F.lit(0)).cast("long"))))
    return salted.drop("salts").join(spread.drop("salts"), ["blob", "salt"])


def scan(docs: DataFrame, ledger_path: str | None = None, rules=RULES, id_col: str = "doc_id", text_col: str = "text", increments: int = 1) -> DataFrame:
    """Findings of every row of ``docs``, through the ledger at ``ledger_path``
    (a Parquet table, made when missing; without a path a new one in the shared
    folder, which ends with the application). What a run scans is appended to it before the result is joined."""
    spark = docs.sparkSession
    path = ledger_path or work_path(spark, "ledger")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    started = ledger_path is not None
    for part in range(increments):
        ledger = spark.read.schema(LEDGER).parquet(path) if started and _exists(spark, path) else None
        # the files of the ledger that is read are listed before new ones come
        scan_blobs(_increment(slim, increments, part), ledger, rules).write.mode("append").parquet(path)
        started = True
    paths = slim.select("doc_id", _blob("text").alias("blob"))
    return _report(_meet(paths, findings(spark.read.schema(LEDGER).parquet(path), rules)))


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def redact(docs: DataFrame, text_col: str = "text", rules=RULES, mark: str = "[SECRET]", ledger_path: str | None = None) -> DataFrame:
    """``docs`` with all spans of the text replaced, through a ledger as in
    ``scan``; the other columns stay, but for ``n_chars``, which is counted anew
    where it exists. Texts move once, and each blob is rewritten once."""
    spark = docs.sparkSession
    path = ledger_path or work_path(spark, "ledger")
    ledger = spark.read.schema(LEDGER).parquet(path) if ledger_path and _exists(spark, path) else None
    own = F.array_sort(F.concat("spans", "known"))
    blob, null, clean = free_name(docs, "blob"), free_name(docs, "null"), free_name(docs, "clean")
    entries = scan_blobs(docs, ledger, rules, text_col, keep=True).withColumn("every", own).select("blob", "rules", "spans", _redacted(F.col("text"), F.col("every"), mark).alias("clean"))
    entries = materialize(entries, "entries")
    entries.filter(F.size("rules") > 0).select("blob", "rules", "spans").write.mode("append").parquet(path)
    rest = docs.withColumn(blob, _blob(text_col)).withColumn(null, F.col(text_col).isNull()).drop(text_col)
    out = rest.join(entries.select(F.col("blob").alias(blob), F.col("clean").alias(clean)), blob).withColumn(text_col, F.when(~F.col(null), F.col(clean)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(null), F.col("n_chars")).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return out.select([F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), increments=INCREMENTS)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every document stays."""
    del spark, sf_dir
    return redact(docs)


def _sql_spans(kind: str, no: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{p}', 0)) + 1), lambda i: {{
        'start': coalesce(list_sum(list_transform((regexp_split_to_array(t, '{p}'))[1:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform((regexp_extract_all(t, '{p}', 0))[1:i - 1], lambda x: length(x))), 0)::BIGINT,
        'kind_no': {no}, 'len': length((regexp_extract_all(t, '{p}', 0))[i]), 'kind': '{kind}',
        'v': length((regexp_extract_all(t, '{p}', {group}))[i])}}), lambda y: y.v >= {least})"""


def sql() -> str:
    """The same result in DuckDB."""
    parts = [_sql_spans(k, i, p, g, least) for i, (k, _, p, g, least, _) in enumerate(RULES)]
    parts[0] = _sql_spans("assign", 0, rf"""(?i)({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6)
    joined = "array_to_string(list_transform({}, lambda y: y.kind || ':' || y.start || ':' || (y.start + y.len)), ',')"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    f AS (SELECT doc_id, t, list_sort(list_concat(list_concat(list_concat({parts[0]}, {parts[1]}), list_concat({parts[2]}, {parts[3]})), list_concat(list_concat({parts[4]}, {parts[5]}), list_concat({parts[6]}, {parts[7]})))) AS s FROM d)
    SELECT doc_id, len(list_filter(s, lambda x: x.kind = 'assign'))::BIGINT AS n_assign, len(list_filter(s, lambda x: x.kind = 'access'))::BIGINT AS n_access,
      len(list_filter(s, lambda x: x.kind = 'hex'))::BIGINT AS n_hex, sha256({joined.format("list_filter(s, lambda x: x.kind_no < 3)")}) AS base_sha256, {joined.format("s")} AS spans, sha256(t) AS blob FROM f"""
