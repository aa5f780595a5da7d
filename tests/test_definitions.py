"""Each named source from raw text to events."""

import json

import pytest

from ravelin.sources import definitions as S

RAW = {
    "sysmon": (json.dumps({"Event": {"System": {"Provider": {"#attributes": {"Name": "Microsoft-Windows-Sysmon"}}, "TimeCreated": {"#attributes": {"SystemTime": "2024-01-02T03:04:05.678Z"}}, "EventID": 1, "Computer": "h", "EventRecordID": 7}, "EventData": {"Image": "C:\\a.exe", "CommandLine": "a -x", "ProcessId": "0x1f", "Hashes": "MD5=AB,SHA256=CD", "Odd": "kept"}}}) + " {cut", 1007, {"process.pid": 31, "process.cmd_line": "a -x", "time": 1704164645678, "device.hostname": "h"}),
    "sysmon-flat": (json.dumps({"EventID": 3, "Computer": "h", "DestinationIp": "::1", "DestinationPort": "443"}), 4001, {"dst_endpoint.ip": "::1", "dst_endpoint.port": 443}),
    "windows-security": (json.dumps({"Event": {"System": {"Provider": {"#attributes": {"Name": "Microsoft-Windows-Security-Auditing"}}, "EventID": 4625, "Computer": "h"}, "EventData": {"TargetUserName": "u", "IpAddress": "-", "LogonType": "3"}}}), 3002, {"user.name": "u", "logon_type_id": 3, "status_id": 2, "metadata.event_code": "4625", "severity_id": 1}),
    "zeek": ('{"_path":"conn","ts":"2024-01-02T03:04:05.250Z","uid":"C1","id.orig_h":"10.0.0.1","id.orig_p":5,"id.resp_h":"10.0.0.2","id.resp_p":53,"proto":"udp"}\nnot json\n', 4001, {"src_endpoint.ip": "10.0.0.1", "dst_endpoint.port": 53, "time": 1704164645250}),
    "suricata": ('{"event_type":"alert","timestamp":"2024-01-02T03:04:05.000000+0000","src_ip":"1.2.3.4","alert":{"signature":"s","signature_id":9,"severity":2}}', 2004, {"finding_info.title": "s", "severity_id": 3, "time": 1704164645000}),
    "auditd": ('type=SYSCALL msg=audit(1704164645.678:7): arch=c000003e syscall=59 pid=12 exe="/bin/ls" comm="ls"\ntype=PROCTITLE msg=audit(1704164645.678:7): proctitle=6C73002D6C\nno key', 1007, {"process.pid": 12, "process.cmd_line": "ls -l", "time": 1704164645678}),
    "falco": ('{"uuid":"u","rule":"r","priority":"Warning","source":"syscall","time":"2024-01-02T03:04:05Z","output_fields":{"proc.cmdline":"sh","user.name":"root"}}', 2004, {"severity_id": 3, "finding_info.title": "r"}),
    "pcapdroid": (",".join(S.PCAP_COLUMNS) + "\n6,10.0.0.1,5,10.0.0.2,443,1,App,pkg,TLS,x,y,10,20,1,1,2024-01-02T03:04:05Z,2024-01-02T03:04:06Z,", 4001, {"dst_endpoint.ip": "10.0.0.2", "traffic.bytes_in": 20}),
    "okta": ('[{"eventType":"user.session.start","uuid":"u","actor":{"id":"a"},"client":{"ipAddress":"1.2.3.4"}},{"eventType":"x","version":"0"}]', 3002, {"actor.user.uid": "a", "src_endpoint.ip": "1.2.3.4"}),
    "m365": ('{"Operation":"UserLoginFailed","UserId":"u","CreationTime":"2024-01-02T03:04:05"}', 3002, {"actor.user.name": "u", "time": 1704164645000}),
    "entra": ('{"records":[{"category":"SignInLogs","time":"2024-01-02T03:04:05Z","properties":{"userId":"u"},"resultType":"0"}]}', 3002, {"user.uid": "u", "status_code": "0", "status_id": 1}),
    "cloudtrail": ('{"Records":[{"eventName":"ConsoleLogin","eventTime":"2024-01-02T03:04:05Z","sourceIPAddress":"1.2.3.4","userIdentity":{"userName":"u"}}]}', 3002, {"actor.user.name": "u", "time": 1704164645000}),
}


@pytest.mark.parametrize("source", sorted(RAW))
def test_source(spark, source):
    raw, uid, want = RAW[source]
    out = S.events_of(spark.createDataFrame([(raw,)], "value string"), source).collect()
    first = next(r for r in out if r.class_uid == uid)
    event = json.loads(first.event)
    for path, value in want.items():
        at = event
        for p in path.split("."):
            at = at[p]
        assert at == value, path
    assert len(first.record_id) == 32
    dead = [r.stage for r in out if r.stage]
    assert dead == {"sysmon": ["framing"], "zeek": ["decoding"], "auditd": ["framing"]}.get(source, [])
