"""Framing, decoding, definitions, searches and streams."""

import ipaddress
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.operators import graph, overview
from ravelin.operators.search import Filter, Schema, Search, SearchError, check, matching, run
from ravelin.plans import normalize as N
from ravelin.sources import decoding as D
from ravelin.sources import feeds


@pytest.mark.parametrize(
    ("line", "want"),
    [("a,b", ["a", "b"]), ("a,", ["a", ""]), ('"a,""b""",c', ['a,"b"', "c"]), ('"a"x,c', None), ('"a', None), ("", [""]), (" a ", [" a "])],
)
def test_csv(line, want):
    assert D.split_csv(line) == want


def test_csv_of_feeds_trims_and_forgives():
    assert D.split_csv(' a , "b" x,', trim=True, strict=False) == ["a", "b", ""]


def test_json_values_and_syslog_frames():
    assert D.json_values('{"a":1} 2\n[') == [('{"a":1}', None), ("2", None), (None, "[")]
    assert D.syslog_frames("5 hello<1>line\r\n99 short") == [("hello", None), ("<1>line", None), (None, "99 short")]
    assert D.syslog_frames("7 <1>1 \u00e93 abc") == [("<1>1 \u00e9", None), ("abc", None)]
    assert D.json_values(None) == D.syslog_frames("") == []


def test_audit_event():
    e = D.audit_event("node=n type=SYSCALL msg=audit(12.345:7): exe=2F62696E comm=\"x y\" odd\ntype=PATH msg=audit(12.345:7): item=1 name=(null)\ntype=EOE msg=audit(12.345:7): ")
    assert e == {"time": "12.345", "serial": "7", "node": "n", "SYSCALL": {"exe": "/bin", "comm": "x y", "words": "odd"}, "PATH.1": {"item": "1", "name": "(null)"}}


def test_syslog_headers(spark):
    now = 1_706_700_000_000
    rows = ["<34>1 2024-01-02T03:04:05Z h a 1 m [x y=\"]\"] hi", "<13>Dec 31 10:00:00 h su[9]: x", "<999>no", "<13>1 bad h a 1 m - x", "<13>just text"]
    got = [r.s for r in spark.createDataFrame([(x,) for x in rows], "l string").select(D.decode_syslog(F.col("l"), now).alias("s")).collect()]
    assert (got[0].facility, got[0].severity, got[0].time, got[0].message, got[0].error) == (4, 2, 1704164645000, "hi", None)
    assert (got[1].time, got[1].app, got[1].pid, got[1].message) == (1704016800000, "su", "9", "x")  # a year back
    assert got[2].error == "no priority" and got[3].error == "bad time" and got[4].message == "just text"


def test_addresses_of_both_families(spark):
    rng = random.Random(9)
    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "64:ff9b::10.0.0.1", "1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "ABCD::ef", "x", "1.2.3", None, ""]
    texts += [str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128))) for _ in range(100)]

    def want(t):
        try:
            a = ipaddress.ip_address(t)
        except ValueError:
            return None
        return f"{int(a):032x}" if a.version == 6 else f"{0xFFFF << 32 | int(a):032x}"

    masks = [0, 1, 7, 31, 96, 127, 128]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("h", T.ip_hex(F.col("t"))).select("t", "h", *[T.hex_mask(F.col("h"), p).alias(f"m{p}") for p in masks]).collect()
    for r in rows:
        assert r.h == want(r.t)
        if r.h:
            assert [r[f"m{p}"] for p in masks] == [f"{int(r.h, 16) >> (128 - p) << (128 - p):032x}" for p in masks]


def test_otlp_in_protobuf(spark):
    def number(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    def field(f, v):
        if isinstance(v, int):
            return number(f << 3) + number(v)
        return number(f << 3 | 2) + number(len(v)) + v

    fixed = lambda f, v: number(f << 3 | 1) + v.to_bytes(8, "little")
    text = lambda s: field(1, s.encode())
    pair = lambda k, v: field(1, k.encode()) + field(2, v)
    deep = field(5, field(1, text("a")) + field(1, field(3, (1 << 64) - 5)) + field(1, field(6, field(1, pair("k", field(2, 1))))))
    log = fixed(1, 1_704_067_200_000_000_001) + field(2, 9) + field(3, b"INFO") + field(5, text("hello é")) + field(6, pair("n", deep)) + field(9, bytes(range(16))) + field(99, b"later")
    late = fixed(11, 7) + field(5, text("two"))
    message = field(1, field(1, field(1, pair("host", text("h1")))) + field(2, field(1, field(1, b"scope") + field(2, b"1")) + field(2, log) + field(2, late)))
    found = D.otlp_message(message)
    record = found["resourceLogs"][0]["scopeLogs"][0]["logRecords"][0]
    assert record["attributes"] == [{"key": "n", "value": {"arrayValue": {"values": [{"stringValue": "a"}, {"intValue": "-5"}, {"kvlistValue": {"values": [{"key": "k", "value": {"boolValue": True}}]}}]}}}]
    rows = [(1, bytearray(message)), (2, bytearray(message[:-3])), (3, None), (4, bytearray(b""))]
    df = spark.createDataFrame(rows, "i int, b binary").select("i", D.otlp_json(F.col("b")).alias("value"))
    assert [r.value is None for r in df.orderBy("i").collect()] == [False, True, True, False]
    got = D.otlp_flatten(df).collect()
    assert [(r.i, r.time_ns, r.severity, r.body, r.trace_id) for r in got] == [(1, 1_704_067_200_000_000_001, 9, "hello é", bytes(range(16)).hex()), (1, 7, None, "two", None)]
    assert json.loads(got[0].resource)["attributes"][0]["key"] == "host" and json.loads(got[0].scope)["name"] == "scope"


def test_versions_of_a_table(spark, tmp_path):
    folder = str(tmp_path / "t")
    for v in range(1, 6):
        overview.publish_version(spark.range(v), folder, v)
    assert overview.read_version(spark, folder).count() == 5 and {p.name for p in (tmp_path / "t" / "rows").iterdir()} == {f"version={v}" for v in (3, 4, 5)}
    spark.range(99).write.parquet(f"{folder}/rows/version=9")  # not complete
    assert {r.version for r in overview.read_version(spark, folder).collect()} == {5}
    rows = spark.createDataFrame([(86_400_000 * d,) for d in range(40)], "t long")
    assert overview.retain_table(rows, "rollups", 86_400_000 * 39, "t").count() == 36 and overview.retain_table(rows, "reports", 86_400_000 * 39 + 5, "t").count() == 2


def test_exports_and_feeds(spark, tmp_path):
    (tmp_path / "a.csv").write_text('# list\n\nhostname, ip ,unit\n h1 , "10.0.0.1",x\nh2,,y\n')
    (tmp_path / "a.json").write_text('{"hostname":"h1","ip":"10.0.0.1"}\n\n{"hostname":"h2","n":3}\n')
    for kind in ("csv", "json"):
        got = feeds.context_export(spark, str(tmp_path / f"a.{kind}"), ["hostname", "ip"], kind).collect()
        assert sorted((r.hostname, r.ip) for r in got) == [("h1", "10.0.0.1"), ("h2", None)]
    with pytest.raises(ValueError):
        feeds.context_export(spark, str(tmp_path / "a.csv"), ["owner"])
    rows = spark.createDataFrame([("AB" * 16, "2024-01-01", "2024-02-01"), ("ab" * 20, None, None), ("zz", "x", None), (None, None, None), ("ab" * 32, "bad", None)], "h string, f string, l string")
    got = [(r.kind, r.value, r.rejected, r.valid_until) for r in feeds.indicators(rows, feeds.Feed("f", "h", hashes=True, first_seen="f", last_seen="l", valid_days=1), 1000).collect()]
    assert got == [("md5", "ab" * 16, False, 1706745600 + 86400), ("sha1", "ab" * 20, False, 87400), ("hash", None, True, 87400), ("hash", None, True, 87400), ("sha256", "ab" * 32, True, 87400)]
    with pytest.raises(ValueError):
        feeds.Feed("f", "v")


def test_sources_whose_parts_do_not_fit():
    good = N.load({"name": "x", "kinds": [{"name": "a", "class": 1, "fields": {"severity_id": {"constant": 1}, "u": "u"}}]})
    N.check_source("lines", "json", good, "records", {1: {"severity_id", "u"}})
    odd = N.load({"name": "x", "kinds": [{"name": "a", "class": 1, "fields": {"status_id": {"from": "s", "map": {"a": 7}}}}]})
    for args in (("syslog", "json", good), ("lines", "nothing", good), ("lines", "csv", good, "records"), ("lines", "json", odd), ("lines", "json", good, None, {1: {"u"}})):
        with pytest.raises(N.DefinitionError):
            N.check_source(*args)
    from ravelin.sources import definitions

    decodings = {"csv": ("lines", "csv"), "audit-events": ("audit-events", "auditd")}
    for how, member, d in definitions.sources().values():
        N.check_source(*decodings.get(how, (how, "json")), d, member)


def test_ipv6_pattern():
    rng, pattern = random.Random(2), re.compile(N.IPV6)
    for _ in range(20_000):
        t = "".join(rng.choice(["a", ":", "::", "ff12", "0", "1.2.3.4", "12345"]) for _ in range(rng.randint(1, 16)))
        try:
            ipaddress.IPv6Address(t)
            want = True
        except ValueError:
            want = False
        assert bool(pattern.match(t)) == want, t


@pytest.mark.parametrize(
    "fields",
    [{"class_uid": "a"}, {"a": "x", "a.b": "y"}, {"a": {"constant": None}}, {"a": {"from": "x", "as": "odd"}}],
)
def test_refused_definitions(fields):
    with pytest.raises(N.DefinitionError):
        N.load({"name": "n", "kinds": [{"name": "k", "class": 1, "fields": fields}]})


def test_unmapped_members_of_objects(spark):
    d = N.load({"name": "x", "unmapped": ["who", "."], "kinds": [{"name": "a", "when": {"t": "a"}, "class": 1007, "fields": {"u": "who.user", "ip": {"from": "net.ip", "as": "ip"}, "n": {"from": "deep.n", "as": "integer"}}}]})
    rows = [('{"t":"a","who":{"user":"x","group":"g","t":5},"net.ip":"bad","deep":{"n":"zz","o":[1]},"z":null}',), ('{"t":"a","net.ip":"1.2.3.4"}',)]
    got = [json.loads(r.unmapped) for r in N.normalize(spark.createDataFrame(rows, "record string"), d).collect()]
    assert got[0] == {"deep.n": "zz", "group": "g", "t": 5, "deep": {"n": "zz", "o": [1]}, "net.ip": "bad", "..t": "a", "who": {"group": "g", "t": 5, "user": "x"}}
    assert got[1] == {"t": "a"}


def test_normalization_keeps_what_it_cannot_use(spark):
    d = N.load({"name": "n", "kinds": [{"name": "k", "class": 1007, "when": {"t": 1}, "fields": {"x.y": {"from": "v", "as": "integer"}}}]})
    rows = [('{"t":1,"v":"0x10","w":"z"}',), ('{"t":"1","v":"2"}',), ("[1]",), ("{",), (None,), ('{"t":1,"v":"no"}',)]
    got = N.normalize(spark.createDataFrame(rows, "record string"), d).collect()
    assert (got[0].event, got[0].unmapped, got[0].issues) == ('{"x":{"y":16}}', '{"t":1,"w":"z"}', [])
    assert [r.stage for r in got[1:5]] == ["mapping", "decoding", "decoding", "decoding"]
    assert got[5].issues[0].reason == "no integer" and got[5].kind == "k"


@pytest.mark.parametrize(
    "search",
    [
        Search(0, 0),
        Search(0, 32 * 86_400_000),
        Search(0, 1, [], [Filter("nope", "equals", "x")]),
        Search(0, 1, [], [Filter("s", "gt", "x")]),
        Search(0, 1, [], [Filter("n", "equals", "x")]),
        Search(0, 1, [], [Filter("s", "in", [])]),
        Search(0, 1, [], [Filter("arr", "equals", 1)]),
        Search(0, 1, [], [Filter("s", "equals", "x" * 5000)]),
        Search(0, 1, [], [], 0),
    ],
)
def test_refused_searches(spark, search):
    with pytest.raises(SearchError):
        check(search, spark.createDataFrame([], "time long, s string, n long, arr array<int>"))


NESTED = N.load({"name": "x", "kinds": [{"name": "a", "when": {"t": "a"}, "class": 1007, "fields": {"u.name": "who", "u.n": {"from": "n", "as": "integer"}, "severity_id": {"from": "sev", "as": "integer"}, "both": "b", "list.0.x": "x", "big": {"from": "at", "as": "timestamp"}}}, {"name": "b", "when": {"t": "b"}, "class": 4001, "fields": {"both": {"from": "b", "as": "integer"}, "ok": {"from": "ok", "map": {"y": "1"}}}}]})
SCHEMA = Schema.of([NESTED])


@pytest.mark.parametrize(
    "search",
    [
        Search(0, 1, [9], [Filter("u.name", "equals", "x")]),
        Search(0, 1, [4001], [Filter("u.name", "equals", "x")]),
        Search(0, 1, [], [Filter("both", "exists")]),
        Search(0, 1, [], [Filter("nothing", "exists")]),
        Search(0, 1, [], [Filter("u", "equals", "x")]),
        Search(0, 1, [], [Filter("u.name", "gt", 3)]),
        Search(0, 1, [], [Filter("u.name", "exists", 3)]),
        Search(0, 1, [], [Filter("u..name", "exists")]),
        Search(0, 1, [], [Filter("list.0.x", "equals", "x")]),
        Search(0, 1, [], [Filter("severity_id", "equals", 7)]),
        Search(0, 1, [], [Filter("unmapped.x", "in", [1, "a"])]),
        Search(0, 1, [], [Filter("unmapped.x", "contains", 1)]),
        Search(0, 1, [], [Filter("unmapped.x", "equals", [1])]),
    ],
)
def test_searches_within_events_are_checked(spark, search):
    with pytest.raises(SearchError):
        check(search, spark.createDataFrame([], "time long, class_uid int, event string, unmapped string"), SCHEMA)


def test_searches_within_events(spark):
    rows = [
        (1, 10, 1007, '{"u":{"name":"Adam","n":5},"severity_id":3}', '{"x":1,"y":"1","z":{"w":true}}'),
        (2, 11, 1007, '{"u":{"n":7}}', '{"x":"1"}'),
        (3, 12, 4001, '{"both":4}', "{}"),
        (4, 13, 4001, None, None),
        (5, 14, 1007, '{"u":{},"big":1704164645000}', '{"x":1.5}'),
    ]
    events = spark.createDataFrame(rows, "id long, time long, class_uid int, event string, unmapped string")

    def ids(*filters, classes=()):
        return {r.id for r in matching(events, Search(1, 100, list(classes), list(filters)), SCHEMA).collect()}

    assert ids(Filter("u.name", "equals", "ADAM")) == {1} and ids(Filter("u.n", "gte", 5)) == {1, 2} and ids(Filter("u.name", "not_equals", "adam")) == {2, 3, 4, 5}
    assert ids(Filter("u", "exists")) == {1, 2} and ids(Filter("u", "missing")) == {3, 4, 5} and ids(Filter("unmapped", "exists")) == {1, 2, 5}
    assert ids(Filter("unmapped.x", "equals", 1)) == {1} and ids(Filter("unmapped.x", "equals", "1")) == {2} and ids(Filter("unmapped.x", "gt", 1.2)) == {5}
    assert ids(Filter("unmapped.z.w", "equals", True)) == {1} and ids(Filter("unmapped.z", "exists")) == {1} and ids(Filter("both", "equals", 4), classes=[4001]) == {3}
    assert ids(Filter("big", "gt", 1_704_164_644_999)) == {5} and ids(Filter("severity_id", "in", [3, 4])) == {1}
    seen, search = [], Search(1, 100, limit=2)
    while search:
        page_, search = run(events, search, SCHEMA)
        seen += [r.id for r in page_]
    assert seen == [5, 4, 3, 2, 1]
    slow = events.filter(F.expr("java_method('java.lang.Thread', 'sleep', cast(3000 as long)) is null"))
    with pytest.raises(SearchError):
        run(slow, Search(1, 100), SCHEMA, seconds=0.3)


def test_cannot_link_pairs_stay_apart(spark):
    total = spark.createDataFrame([("a", "x", 5), ("b", "x", 3), ("b", "y", 9), ("c", "z", 1)], "one string, other string, events long")
    apart = spark.createDataFrame([("a", "b")], "a string, b string")
    free = {r.identifier: r.entity for r in graph.resolve(total).collect()}
    held = {r.identifier: r.entity for r in graph.resolve(total, None, apart).collect()}
    assert free["a"] == free["b"] and held["a"] != held["b"] and held["x"] == held["a"] and held["y"] == held["b"] and held["c"] == held["z"]


def test_stream_rollup_equals_batch(spark, tmp_path):
    from ravelin.streaming import jobs

    rows = [(i, 1000 * i, 1000 * i + 5, "s" + str(i % 3), 2004) for i in range(50)]
    events = spark.createDataFrame(rows, "id long, time long, received long, source string, class_uid int")
    for k in range(3):
        events.filter(F.col("id") % 3 == k).unionByName(events.filter("id = 7")).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.store(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    stored = jobs.read_stored(out)
    assert stored.count() == 50
    a = {tuple(r) for r in overview.hourly(stored.select(events.columns)).collect()}
    assert a == {tuple(r) for r in overview.hourly(events).collect()}
