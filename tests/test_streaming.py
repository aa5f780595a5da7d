"""Streams against the same transformations of tables, and generated telemetry
against its own truth."""

from pyspark.sql import functions as F

from ravelin.operators import graph, observe
from ravelin.plans import normalize as N
from ravelin.sources import definitions, generator
from ravelin.streaming import jobs


def rows(spark, n=300):
    return spark.range(n).select("id", (F.col("id") * 60_000 * (1 + F.col("id") % 7)).alias("time"), F.concat(F.lit("u"), (F.col("id") % 3).cast("string")).alias("user"))


def test_windows_and_sessions_of_streams_equal_those_of_tables(spark, tmp_path):
    table = rows(spark)
    late = table.agg(F.max("time")).first()[0] + 10 * 86_400_000  # moves the watermark past all windows
    jobs.publish(table.orderBy("time").coalesce(1), str(tmp_path / "in"))
    jobs.publish(spark.createDataFrame([(-1, late, "end")], table.schema), str(tmp_path / "in"))
    for k, make in enumerate((lambda t: jobs.correlate(t, ["user"], "30 minutes", 3, "10 minutes"), lambda t: jobs.sessions(t, ["user"], "20 minutes"))):
        stream = make(jobs.topic(spark, str(tmp_path / "in"), table.schema))
        out = str(tmp_path / f"out{k}")
        for _ in range(2):  # the last watermark counts in the next run
            stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"cp{k}")).trigger(availableNow=True).start().awaitTermination()
        want = {tuple(r) for r in make(table).collect()}
        assert want and {tuple(r) for r in spark.read.parquet(out).collect()} == want


def test_a_pause_of_the_gap_ends_a_session(spark):
    table = spark.createDataFrame([("a", 0), ("a", 1000), ("a", 1999), ("b", 0), ("b", 0), ("b", 999), ("c", None), ("c", 0), ("c", None), (None, 5)], "user string, time long")
    found = {tuple(r) for r in jobs.sessions(table, ["user"], "1 second").collect()}
    assert found == {("a", 0, 0, 1), ("a", 1000, 1999, 2), ("b", 0, 999, 3), ("c", 0, 0, 1), ("c", None, None, 2), (None, 5, 5, 1)}


def test_topics_on_disk_are_published_as_they_come(spark, tmp_path):
    table = rows(spark, 20)
    jobs.publish(table, str(tmp_path / "a"))
    jobs.publish(jobs.topic(spark, str(tmp_path / "a"), table.schema).filter("id % 2 = 0"), str(tmp_path / "b"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "b")).count() == 10


def test_skipped_ranges_are_matched_again(spark, tmp_path):
    stored = spark.range(100).select("id", (F.col("id") * 1000).alias("received"), (F.col("id") * 1000).alias("time"), F.lit(1).alias("class_uid")).withColumn("received_day", F.lit(0))
    find = lambda e: e.select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("uid"))
    ranges = spark.createDataFrame([(5000, 9000), (8000, 12000), (50_000, 51_000)], "lo long, hi long")
    assert jobs.rematch(stored, ranges, find, str(tmp_path / "f")) == 2
    assert {r.uid for r in spark.read.parquet(str(tmp_path / "f")).collect()} == {f"f{i}" for i in [*range(5, 12), 50]}


def test_large_files_are_refused_unread(spark, tmp_path):
    (tmp_path / "a.log").write_text("x" * 10)
    (tmp_path / "b.log").write_text("x" * 1000)
    good, bad = jobs.accepted(spark.read.format("binaryFile").load(str(tmp_path / "*.log")), 100)
    assert [r.length for r in good.collect()] == [10] and [(r.length, r.reason) for r in bad.collect()] == [(1000, "too large")]


def test_few_draw_most(spark):
    drawn = [r.n for r in spark.range(20_000).select(generator.zipf(generator.uniform(3, "x", F.col("id")), 50).alias("n")).collect()]
    weights = [1 / (k + 1) ** generator.EXPONENT for k in range(50)]
    for k in (0, 1, 5, 49):
        assert abs(drawn.count(k) / 20_000 - weights[k] / sum(weights)) < 0.012
    assert max(drawn) == 49 and {r.n for r in spark.range(5).select(generator.zipf(F.lit(0.3), 1).alias("n")).collect()} == {0}


def test_generated_people_are_resolved_as_they_are(spark):
    made = generator.telemetry(spark.range(1500), 25, 1_704_067_200_000, 10.0).cache()
    seen = None
    for product in generator.PRODUCTS:
        out = N.normalize(made.filter(F.col("product") == product), definitions.sources()[product][2])
        assert out.filter("stage is not null").isEmpty()
        part = observe.observe(out)
        seen = part if seen is None else seen.unionByName(part)
    total = graph.claims_total(graph.claims(observe.claims_of(seen)))
    found = {r.identifier: r.entity for r in graph.resolve_identities(total).filter("standing = 'member'").collect()}
    own = {r.identifier: r.entity for r in generator.truth(spark.range(25).select(F.col("id").alias("user"))).collect()}
    assert found and all(own[i] == own[e] for i, e in found.items())
    links = graph.links(observe.links_of(seen)).select("link").distinct().collect()
    assert {r.link for r in links} == {"ran_on", "connected_to"}
