"""Claims and links that events show."""

import json

from ravelin.operators import graph, observe

EVENTS = [
    (3002, {"device": {"hostname": "WS-7.corp.example", "ip": "10.0.0.7", "mac": "00-1A-2B-3C-4D-5E"}, "user": {"uid": "S-1-5-21-1-2", "name": "adam", "domain": "CORP", "email_addr": "Adam@corp.example"}, "dst_endpoint": {"hostname": "dc.corp.example"}}),
    (1007, {"device": {"hostname": "ws-7"}, "process": {"user": {"name": "admin", "uid": "1000"}, "file": {"hashes": [{"value": "A" * 32}, {"value": "b" * 64}]}}}),
    (1007, {"device": {"hostname": "ws-7.corp.example"}, "actor": {"user": {"name": "WS-7\\adam", "uid": "S-1-0-0"}}}),
    (4003, {"device": {"hostname": "?"}, "src_endpoint": {"ip": "10.0.0.9"}, "dst_endpoint": {"ip": "10.0.0.1", "hostname": "10.0.0.1"}, "query": {"hostname": "Example.COM."}, "answers": [{"rdata": "1.2.3.4"}, {"rdata": "other"}]}),
    (1001, {"activity_id": 1, "device": {"uid": "i-1", "hostname": "h", "domain": "x.y"}, "file": {"hashes": [{"value": "c" * 40}]}}),
    (1001, {"activity_id": 4, "device": {"uid": "i-1"}, "file": {"hashes": [{"value": "c" * 40}]}}),
]


def test_what_events_show(spark):
    rows = [(i, 1000 * i, uid, json.dumps(e)) for i, (uid, e) in enumerate(EVENTS)] + [(9, 0, 1007, None), (10, 0, None, "{}")]
    seen = observe.observe(spark.createDataFrame(rows, "id long, time long, class_uid int, event string"))
    got = {(r.id, r.one, r.what, r.other) for r in seen.collect()}
    ws, adam = "host:name:ws-7.corp.example", "user:sid:s-1-5-21-1-2"
    assert got == {
        (0, adam, "user", "user:email:adam@corp.example"),
        (0, adam, "user", "user:name:corp\\adam"),
        (0, ws, "host", "host:mac:00:1a:2b:3c:4d:5e"),
        (0, ws, "held", "address:ip:10.0.0.7"),
        (0, adam, "logged_on_to", "host:name:dc.corp.example"),
        (1, "user:local:ws-7:admin", "user", "user:name:admin"),
        (1, "user:local:ws-7:admin", "ran_on", "host:name:ws-7"),
        (1, "host:name:ws-7", "ran", "file:hash:" + "b" * 64),
        (2, "user:local:ws-7.corp.example:adam", "ran_on", ws),
        (3, "address:ip:10.0.0.9", "connected_to", "address:ip:10.0.0.1"),
        (3, "address:ip:10.0.0.9", "resolved", "domain:name:example.com"),
        (3, "domain:name:example.com", "resolved_to", "address:ip:1.2.3.4"),
        (4, "host:uid:i-1", "host", "host:name:h.x.y"),
        (4, "host:uid:i-1", "wrote", "file:hash:" + "c" * 40),
    }
    assert graph.claims(observe.claims_of(seen)).count() == 5 and graph.links(observe.links_of(seen)).filter("link = 'ran'").count() == 1


def test_each_member_is_read_once(spark):
    seen = observe.observe(spark.createDataFrame([(0, 0, 1007, "{}")], "id long, time long, class_uid int, event string"))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    assert seen._jdf.queryExecution().explainString(mode).count("variant_get(") < 200  # 2,556 when each use read anew


def test_members_without_an_object_say_nothing(spark):
    events = [{"user": "adam", "device": None}, {"user": {"name": "corp\\adam"}, "device": ["ws"]}, {"user": {"name": 7}, "device": {"hostname": "-", "ip": "fe80::1"}}, ["x"]]
    rows = [(i, 0, 3002, json.dumps(e)) for i, e in enumerate(events)]
    assert observe.observe(spark.createDataFrame(rows, "id long, time long, class_uid int, event string")).count() == 0
