"""Rules that name fields as products do, over normalized events."""

import json

import pytest
from pyspark.sql import functions as F

from ravelin.plans import mappings as M
from ravelin.plans import sigma
from ravelin.sources import definitions as S

SHIPPED = M.shipped()


def rule(logsource, detection):
    return sigma.load({"title": "t", "logsource": logsource, "detection": detection})


def test_mappings_read_what_definitions_write():
    security = M.select({"product": "windows", "service": "security"}, SHIPPED)
    assert security.fields["TargetUserName"] == ["user.name", "group.name", "unmapped.TargetUserName"]
    assert security.fields["IpAddress"] == ["src_endpoint.ip", "unmapped.IpAddress"] and security.fields["EventID"] == ["metadata.event_code"]
    assert M.select({"product": "zeek", "service": "conn"}, SHIPPED).fields["id.orig_h"] == ["src_endpoint.ip", "unmapped.id.orig_h"]
    assert M.select({"product": "windows", "category": "process_creation"}, SHIPPED).fields["Hashes"] == ["unmapped.Hashes"]
    with pytest.raises(sigma.RuleError):
        M.select({"product": "windows", "category": "nothing"}, SHIPPED)


def test_rules_over_several_sources(spark):
    provider = lambda name: {"Provider": {"#attributes": {"Name": name}}}
    raw = {
        "windows-security": [{"Event": {"System": provider("Microsoft-Windows-Security-Auditing") | {"Channel": "Security", "EventID": 4625, "Computer": "h"}, "EventData": {"TargetUserName": "adam", "IpAddress": "-", "LogonType": "3", "FailureReason": "%%2313"}}}],
        "m365": [{"Operation": "UserLoggedIn", "UserId": "u", "CreationTime": "2024-01-02T03:04:05", "ExtendedProperties": [{"Name": "RequestType", "Value": "OAuth2:Token"}, {"Name": "x", "Value": "y"}]}],
        "zeek": [{"_path": "http", "method": "GET", "uri": "/a", "id.orig_h": "10.0.0.1", "tags": "odd", "ts": "2024-01-02T03:04:05Z"}],
        "okta": [{"eventType": "user.session.start", "outcome": {"result": "FAILURE"}, "securityContext": {"isProxy": True}, "target": [{"id": "1"}, {"id": "2"}]}],
    }
    events = None
    for source, records in raw.items():
        out = S.events_of(spark.createDataFrame([("\n".join(map(json.dumps, records)),)], "value string"), source).withColumn("source", F.lit(source))
        events = out if events is None else events.unionByName(out)
    windows, zeek = {"product": "windows", "service": "security"}, {"product": "zeek", "service": "http"}
    rules = [
        rule(windows, {"s": {"EventID": 4625, "LogonType": 3}, "f": {"IpAddress": "-"}, "condition": "s and f"}),
        rule(windows, {"k": ["%%2313"], "condition": "k"}),
        rule({"product": "m365", "service": "audit"}, {"s": {"RequestType|startswith": "oauth2", "Operation": "userloggedin"}, "condition": "s"}),
        rule(zeek, {"s": {"c-uri|endswith": "/a", "id.orig_h|cidr": "10.0.0.0/8", "tags": "odd"}, "condition": "s"}),
        rule({"product": "okta", "service": "okta"}, {"s": {"outcome.result": "FAILURE", "securityContext.isProxy": True, "target.id": 2}, "condition": "s"}),
        rule(zeek, {"s": {"method": "POST"}, "condition": "not s"}),
    ]
    found = {r.source: r.rules for r in M.match(events, rules, SHIPPED).collect()}
    assert found == {"windows-security": [0, 1], "m365": [2], "zeek": [3, 5], "okta": [4]}
    with pytest.raises(sigma.RuleError):
        M.match(events, [rule(windows, {"s": {"NoSuchField": 1}, "condition": "s"})], SHIPPED)
