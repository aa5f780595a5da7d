"""Mixing sources to target weights by Pareto order sampling.

Targets are filled like connected vessels: sources share the mix by weight, a
source stops at ``max_copies`` times its size, and what is above is shared
again among the others. A source that is to give f times its size gives
floor(f) whole copies of every document for certain. For the rest, a share
phi = f - floor(f), documents are ranked by random odds over inclusion odds:
u / (1 - u) divided by p / (1 - p). The inclusion odds are phi's, times the
document's size over the source's mean size to the power ``SIZE_POWER``; so
the sample's probabilities are unequal, a little higher for longer documents.
A factor that all odds of a source share does not change the ranking, so the
odds need no further calibration: the cut settles it. The sample is fixed in
size, and that size is counted in words, as targets are: the first ranks whose
sizes sum up to the rest of the target, as near as whole documents allow.

u comes from a hash of the seed, the id and the text, so reruns agree. Rows
alike in all three share a rank; where the cut falls among them, as many of
them are taken as come nearest to the target (which ones cannot be told).

Scale: texts are read once for their sizes; what follows are rows of (id,
source, size). No source is sorted in one task: the cut in a source's ranking
is found digit by digit. Sizes are summed by (source, next 12 bits of the
rank), which combines map-side and leaves at most 4096 rows a source; the digit
where the target falls is kept, and the next sum is of its rows alone, five
times. Sources' figures are a table of one row a source (all sources are
ordered in one task, for that their number is the bound); rows meet it by a
join that broadcasts it while it is small. Only rows of one rank at the cut,
which are alike, are numbered together. ``stage`` decides on the rows where
they stand: texts do not move.

Defined results: null texts have size 0; a source is compared by code point
and null is a source of its own, the last; documents of size 0 are never
sampled (taken 0); a source of size 0 has target 0; rows with a null id are
sampled by size and text; an empty table gives an empty result; other columns
are ignored by ``mix`` and kept by ``stage``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm.common import WORD, free_name, materialize, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2.0
SIZE_POWER = 0.5
SEED = 20_240_607
DIGIT_BITS = 12
DIGITS = 5


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, h): words and hash of each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("h"))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: float = MAX_COPIES) -> DataFrame:
    """(source, source_size, n_docs, target): a row a source.

    With sources in the order of (max_copies * size / weight), those that fill
    up first come first, so the water level follows from running sums: source i
    is full if its limit per weight is at most the level left when all before
    it are full.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").isNull(), F.expr("cast(source as binary)"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1).cast("int") % len(weights) + 1)
    per = per.withColumn("w", w).withColumn("limit", F.col("source_size") * float(max_copies))
    rank = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), F.expr("cast(source as binary)"))
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weight).withColumn("full", F.col("limit") / F.col("w") <= F.col("level"))
    # the level of the first source that does not fill up holds for all that come after it
    held = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("w"), "level"))).over(every)["level"]
    return per.select("source", "source_size", "n_docs", F.when(F.col("full"), F.col("limit")).otherwise(held * F.col("w")).alias("target"))


def _rank(phi, size, mean, doc_id, h, seed: int, size_power: float):
    """The place of a row in its source's ranking, a number of DIGITS digits:
    q / (1 + q) orders as q does, which lies in (0, inf)."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.coalesce(doc_id, F.lit(-1)), h, size), F.lit(2**52)) + 0.5) / float(2**52)
    odds = (phi / (1 - phi)) * F.pow(size / mean, F.lit(size_power))
    q = (u / (1 - u)) / odds
    return F.when((phi > 0) & (size > 0), F.floor(q / (1 + q) * float(2 ** (DIGIT_BITS * DIGITS) - 1)).cast("long"))


def cuts(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: float = MAX_COPIES, seed: int = SEED, size_power: float = SIZE_POWER) -> DataFrame:
    """A row a source: its figures, its whole copies, and where its ranking is
    cut (``cut``, the rank; ``below``, the words of lower ranks)."""
    per = materialize(targets(sized, weights, share, max_copies), "targets")
    plan = per.withColumn("f", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("whole", F.floor(F.col("f") + 1e-12))
    plan = plan.withColumn("phi", F.greatest(F.lit(0.0), F.col("f") - F.col("whole"))).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    plan = materialize(plan.withColumn("mean", F.col("source_size") / F.col("n_docs")).withColumn("key", _key(F.col("source"))), "plan")

    ranked = sized.withColumn("key", _key(F.col("source"))).join(plan.select("key", "phi", "mean"), "key").select("key", "size", _rank(F.col("phi"), F.col("size"), F.col("mean"), F.col("doc_id"), F.col("h"), seed, size_power).alias("rank"))
    ranked = materialize(ranked.filter("rank is not null"), "ranked")
    cut = plan.select("key", "rest", F.lit(0).cast("long").alias("cut"), F.lit(0.0).alias("below"))
    for d in range(DIGITS):
        shift = DIGIT_BITS * (DIGITS - 1 - d)
        # of later digits, only the rows behind the digits found so far
        rows = ranked if d == 0 else ranked.join(cut.select("key", "cut"), "key").filter(F.shiftright("rank", shift + DIGIT_BITS) == F.col("cut"))
        sums = rows.groupBy("key", F.shiftright("rank", shift).alias("head")).agg(F.sum("size").cast("double").alias("words"))
        here = sums.join(cut, "key").withColumn("upto", F.col("below") + F.sum("words").over(Window.partitionBy("key").orderBy("head")))
        # the digit within which the target falls: the first whose sum passes it; with none, the last one
        passed, at = F.col("upto") > F.col("rest"), F.struct("head", (F.col("upto") - F.col("words")).alias("below"))
        found = here.groupBy("key").agg(F.first("rest").alias("rest"), F.coalesce(F.min(F.when(passed, at)), F.max(at)).alias("at"))
        cut = materialize(found.select("key", "rest", F.col("at.head").alias("cut"), F.col("at.below").alias("below")), "cut")
    return materialize(plan.join(cut.drop("rest"), "key", "left"), "cuts")


def _key(source):
    """A source as a text that is never null."""
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def _copies(rows: DataFrame, cut: DataFrame, name: str, seed: int = SEED, size_power: float = SIZE_POWER) -> DataFrame:
    """``rows``, which have a struct ``name`` of (doc_id, size, h, key), with the
    struct's copy number and its source's figures in the column ``name`` + 1."""
    own, plan, copies = F.col(name), F.col(f"{name}2"), f"{name}1"
    cut = cut.select(F.col("key").alias(f"{name}3"), F.struct(*[c for c in cut.columns if c != "key"]).alias(f"{name}2"))
    ranked = rows.join(cut, own["key"] == F.col(f"{name}3")).withColumn(f"{name}4", _rank(plan["phi"], own["size"], plan["mean"], own["doc_id"], own["h"], seed, size_power))
    rank = F.col(f"{name}4")
    at_cut = F.coalesce(rank == plan["cut"], F.lit(False))
    sure = ranked.filter(~at_cut).withColumn(copies, plan["whole"] + F.coalesce((rank < plan["cut"]).cast("long"), F.lit(0)))
    # rows at the cut are alike: each is taken while that comes nearer to the target
    upto = F.sum(own["size"]).over(Window.partitionBy(own["key"]).orderBy(own["doc_id"], own["h"], own["size"]).rowsBetween(Window.unboundedPreceding, 0))
    tied = ranked.filter(at_cut).withColumn(copies, plan["whole"] + (plan["below"] + upto - own["size"] / 2 < plan["rest"]).cast("long"))
    return sure.unionByName(tied)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: float = MAX_COPIES, seed: int = SEED, size_power: float = SIZE_POWER, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``."""
    sized = materialize(sizes(docs, id_col, text_col, source_col), "sizes")
    cut = cuts(sized, weights, share, max_copies, seed, size_power)
    rows = sized.select(F.struct("doc_id", "size", "h", _key(F.col("source")).alias("key")).alias("m"))
    out = _copies(rows, cut, "m", seed, size_power)
    return out.select("m.doc_id", "m.size", F.col("m2.source_size").cast("long").alias("source_size"), F.col("m2.target").cast("double").alias("target"), (F.col("m.size") * F.col("m1")).cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, none or up to two times.
    Documents without words take nothing and go; ids repeat with the copies."""
    del spark, sf_dir
    name = free_name(docs, "mix")
    sized = materialize(sizes(docs), "sizes")
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("h"), _key(F.col("source").cast("string")).alias("key"))
    # the condition, which always holds, keeps the optimizer from counting words anew in every use of their number
    rows = docs.withColumn(name, F.when(F.monotonically_increasing_id() >= 0, own)).filter(F.col(name)["size"] > 0)
    out = _copies(rows, cuts(sized), name).filter(F.col(f"{name}1") > 0)
    return out.withColumn(f"{name}5", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{name}1")))).select([F.col(f"`{c}`") for c in docs.columns])
