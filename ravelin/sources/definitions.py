"""Definitions of common log sources, from the public formats of their
products to the event model. ``sources`` names how raw data are framed and
decoded and what becomes of a record; ``events_of`` runs the whole way.

Fields are written a line each: target, source path, coercion. Kinds that
differ in an event number, a method or an outcome alone are made by rule.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.plans import normalize as N
from ravelin.sources import decoding as D


def _fields(text: str, under: str = "") -> dict:
    """Lines of ``target source [coercion]``, all sources below ``under``; ``=``
    begins a constant, a whole number where it is one."""
    out = {}
    for line in text.strip().splitlines():
        target, source, *how = line.split()
        if source.startswith("="):
            out[target] = {"constant": int(source[1:]) if source[1:].isdigit() else source[1:]}
        else:
            out[target] = {"from": under + source, "as": how[0]} if how else under + source
    return out


def _map(source: str, values: dict, otherwise=None, kind: str = "integer") -> dict:
    return {"from": source, "map": values, "as": kind} | ({} if otherwise is None else {"otherwise": otherwise})


def _kind(name: str, class_uid: int, activity: int, when: dict, *fields: dict) -> dict:
    made: dict = {"activity_id": {"constant": activity}}
    for f in fields:
        made |= f
    return {"name": name, "class": class_uid, "when": when, "fields": made}


def _product(name: str, vendor: str, severity: bool = True) -> dict:
    """What all events of a product say about it; severity 1 is informational."""
    return {"metadata.version": {"constant": "1.5.0"}, "metadata.product.name": {"constant": name}, "metadata.product.vendor_name": {"constant": vendor}} | ({"severity_id": {"constant": 1}} if severity else {})


# Classes and activities of the event model, event numbers and member names of the products.

HTTP_ACTIVITIES = {"GET": 3, "POST": 6, "PUT": 7, "HEAD": 4, "DELETE": 2, "CONNECT": 1, "OPTIONS": 5, "TRACE": 8}
WINDOWS = {"device.os.type_id": {"constant": 100}, "device.os.name": {"constant": "Windows"}}
_SYS, _DATA = "Event.System.", "Event.EventData."
_LOG = """
time TimeCreated.#attributes.SystemTime timestamp
metadata.log_name Channel
metadata.uid EventRecordID string
device.hostname Computer
"""


def _sysmon(flat: bool) -> list[dict]:
    """Sysmon events by number; nested as rendered XML or with all fields on top."""
    sys_, data = ("", "") if flat else (_SYS, _DATA)
    common = _product("Sysmon", "Microsoft") | WINDOWS
    common |= _fields(_LOG.replace("TimeCreated.#attributes.SystemTime timestamp", "UtcTime utc-timestamp")) if flat else _fields(_LOG, _SYS)
    actor = _fields("actor.process.file.path Image\nactor.process.pid ProcessId integer\nactor.process.uid ProcessGuid\nactor.user.name User", data)
    start = """
        process.file.path Image
        process.file.hashes Hashes fingerprints
        process.cmd_line CommandLine
        process.pid ProcessId integer
        process.uid ProcessGuid
        process.working_directory CurrentDirectory
        process.integrity IntegrityLevel
        process.user.name User
        process.session.uid LogonId
        process.file.product.name Product
        process.file.company_name Company
        process.file.desc Description
        process.file.version FileVersion
        process.parent_process.file.path ParentImage
        process.parent_process.cmd_line ParentCommandLine
        process.parent_process.pid ParentProcessId integer
        process.parent_process.uid ParentProcessGuid
        process.parent_process.user.name ParentUser
    """
    connection = """
        src_endpoint.ip SourceIp ip
        src_endpoint.hostname SourceHostname
        src_endpoint.port SourcePort integer
        dst_endpoint.ip DestinationIp ip
        dst_endpoint.hostname DestinationHostname
        dst_endpoint.port DestinationPort integer
        connection_info.protocol_name Protocol
    """
    module = """
        module.file.path ImageLoaded
        module.file.hashes Hashes fingerprints
        module.file.product.name Product
        module.file.company_name Company
        module.file.desc Description
        module.file.version FileVersion
    """
    when = lambda n: {f"{sys_}EventID": n} | ({} if flat else {f"{_SYS}Provider.#attributes.Name": "Microsoft-Windows-Sysmon"})
    return [
        _kind("process_creation", 1007, 1, when(1), common, _fields(start, data)),
        _kind("network_connection", 4001, 1, when(3), common, actor, _fields(connection, data)),
        _kind("image_load", 1005, 1, when(7), common, actor, _fields(module, data)),
        _kind("file_create", 1001, 1, when(11), common, actor, _fields("file.path TargetFilename", data)),
        _kind("registry_set", 201002, 2, when(13), common, actor, _fields("reg_value.path TargetObject", data)),
    ]


#: Number of a Security event: name, class, activity. Groups of three kinds are made by rule.
SECURITY = {
    4720: ("account_created", 3001, 1),
    4722: ("account_enabled", 3001, 2),
    4723: ("password_changed", 3001, 3),
    4724: ("password_reset", 3001, 4),
    4725: ("account_disabled", 3001, 5),
    4726: ("account_deleted", 3001, 6),
    4741: ("computer_account_created", 3001, 1),
    4743: ("computer_account_deleted", 3001, 6),
    4738: ("account_changed", 3001, 99),
    4742: ("computer_account_changed", 3001, 99),
    4740: ("account_locked", 3001, 9),
    4698: ("scheduled_task_created", 1006, 1),
    4699: ("scheduled_task_deleted", 1006, 3),
    4700: ("scheduled_task_enabled", 1006, 4),
    4701: ("scheduled_task_disabled", 1006, 5),
    4702: ("scheduled_task_updated", 1006, 2),
    4656: ("object_handle_requested", 201003, 1),
    4663: ("object_accessed", 201003, 1),
    4662: ("directory_object_operation", 201003, 1),
    4661: ("sam_handle_requested", 201003, 1),
    4657: ("registry_value_modified", 201003, 1),
}
#: The first event number of each kind of group, and what later numbers do: name, activity.
GROUPS = {"global": 4727, "local": 4731, "universal": 4754}
GROUP_STEPS = {0: ("group_created", 6), 1: ("group_member_added", 3), 2: ("group_member_removed", 4), 3: ("group_deleted", 5)}
#: Windows numbers logon types as the event model does, but for 0.
LOGON_TYPES = {"0": 1} | {str(n): n for n in (2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13)}


def _windows() -> list[dict]:
    f = lambda text: _fields(text, _DATA)
    common = _product("Windows Security Auditing", "Microsoft") | WINDOWS | _fields(_LOG, _SYS) | {"metadata.event_code": {"from": f"{_SYS}EventID", "as": "string"}}
    subject = f("actor.user.name SubjectUserName\nactor.user.domain SubjectDomainName\nactor.user.uid SubjectUserSid")
    target = f("user.name TargetUserName\nuser.domain TargetDomainName\nuser.uid TargetUserSid")
    process = f("actor.process.file.path ProcessName\nactor.process.pid ProcessId integer")
    source = f("src_endpoint.ip IpAddress ip\nsrc_endpoint.port IpPort integer")
    logon_type = {"logon_type_id": _map(f"{_DATA}LogonType", LOGON_TYPES, 99)}
    how = f("logon_process.name LogonProcessName\nauth_protocol AuthenticationPackageName\nsrc_endpoint.hostname WorkstationName") | logon_type
    result = f("status_code Status") | {"status_id": _map(f"{_DATA}Status", {"0x0": 1}, 2)}
    kerberos = result | source | f("user.name TargetUserName\nuser.domain TargetDomainName\nuser.uid TargetSid\nservice.name ServiceName\nservice.uid ServiceSid")
    account = subject | f("user.name TargetUserName\nuser.domain TargetDomainName\nuser.uid TargetSid")
    group = subject | f("group.name TargetUserName\ngroup.domain TargetDomainName\ngroup.uid TargetSid")
    member = f("user.name MemberName\nuser.uid MemberSid")
    handle = subject | process | f("win_resource.name ObjectName\nwin_resource.type ObjectType\nwin_resource.uid HandleId")
    created = f(
        """
        process.file.path NewProcessName
        process.cmd_line CommandLine
        process.pid NewProcessId integer
        process.user.name SubjectUserName
        process.user.domain SubjectDomainName
        process.user.uid SubjectUserSid
        process.session.uid SubjectLogonId
        process.parent_process.file.path ParentProcessName
        process.parent_process.pid ProcessId integer
        """
    )
    service = subject | f("win_service.name ServiceName\nwin_service.cmd_line ServiceFileName\nwin_service.service_start_name ServiceAccount")
    share = subject | source | f("share ShareName")
    status = lambda n: {"status_id": {"constant": n}}
    when = lambda n: {f"{_SYS}Provider.#attributes.Name": "Microsoft-Windows-Security-Auditing", f"{_SYS}EventID": n}
    kinds = [
        _kind("logon", 3002, 1, when(4624), common, target, subject, process, source, how, f("session.uid TargetLogonId"), status(1)),
        _kind("logon_failure", 3002, 1, when(4625), common, target, subject, process, source, how, f("status_code Status\nstatus_detail SubStatus"), status(2)),
        _kind("explicit_credentials", 3002, 1, when(4648), common, subject, process, source, f("user.name TargetUserName\nuser.domain TargetDomainName\ndst_endpoint.hostname TargetServerName")),
        _kind("logoff", 3002, 2, when(4634), common, target, logon_type, f("session.uid TargetLogonId")),
        _kind("user_logoff", 3002, 2, when(4647), common, target, f("session.uid TargetLogonId")),
        _kind("credential_validation", 3002, 1, when(4776), common, result, f("user.name TargetUserName\nauth_protocol PackageName\nsrc_endpoint.hostname Workstation")),
        *[_kind(name, 3002, activity, when(n), common, kerberos) for n, name, activity in ((4768, "kerberos_ticket", 3), (4769, "kerberos_service_ticket", 4), (4771, "kerberos_pre_authentication_failure", 6))],
        _kind("process_creation", 1007, 1, when(4688), common, created),
        _kind("right_assigned", 3001, 7, when(4704), common, subject, f("user.uid TargetSid\npolicy.name PrivilegeList")),
        _kind("service_installed", 201004, 1, when(4697), common, service),
        _kind("share_accessed", 4006, 99, when(5140), common, share),
        _kind("share_file_checked", 4006, 99, when(5145), common, share, f("file.path RelativeTargetName")),
        _kind("directory_object_modified", 3004, 3, when(5136), common, subject, f("entity.name ObjectDN\nentity.uid ObjectGUID\nentity.type ObjectClass")),
        {"unmapped": ["Event.UserData.LogFileCleared"]} | _kind("log_cleared", 1008, 1, {f"{_SYS}Provider.#attributes.Name": "Microsoft-Windows-Eventlog", f"{_SYS}EventID": 1102}, common, _fields("actor.user.name SubjectUserName\nactor.user.domain SubjectDomainName\nactor.user.uid SubjectUserSid", "Event.UserData.LogFileCleared.")),
    ]
    by_class = {3001: account, 1006: subject | f("job.name TaskName"), 201003: handle}
    kinds += [_kind(name, uid, activity, when(n), common, by_class[uid]) for n, (name, uid, activity) in SECURITY.items()]
    kinds += [_kind(f"{of}_{name}", 3006, activity, when(first + step), common, group, *([member] if "member" in name else [])) for step, (name, activity) in GROUP_STEPS.items() for of, first in GROUPS.items()]
    return kinds


def _zeek() -> list[dict]:
    common = _product("Zeek", "Zeek") | _fields("time ts timestamp\nmetadata.log_name _path\nmetadata.correlation_uid uid")
    ends = _fields("src_endpoint.ip id.orig_h ip\nsrc_endpoint.port id.orig_p integer\ndst_endpoint.ip id.resp_h ip\ndst_endpoint.port id.resp_p integer")
    link = ends | _fields("connection_info.uid uid")
    conn = _fields(
        """
        connection_info.protocol_name proto
        connection_info.community_uid community_id
        app_name service
        traffic.bytes_out orig_bytes integer
        traffic.bytes_in resp_bytes integer
        traffic.packets_out orig_pkts integer
        traffic.packets_in resp_pkts integer
        """
    )
    dns = _fields(
        """
        query.packet_uid trans_id integer
        query.hostname query
        query.type qtype_name
        query.class qclass_name
        rcode rcode_name
        rcode_id rcode integer
        """
    )
    http = _fields(
        """
        http_request.http_method method
        http_request.url.hostname host
        http_request.url.path uri
        http_request.referrer referrer
        http_request.version version
        http_request.user_agent user_agent
        http_request.length request_body_len integer
        http_response.length response_body_len integer
        http_response.code status_code integer
        http_response.message status_msg
        """
    )
    certificate = _fields(
        """
        tls.certificate.serial_number certificate.serial
        tls.certificate.subject certificate.subject
        tls.certificate.issuer certificate.issuer
        tls.certificate.version certificate.version
        tls.certificate.created_time certificate.not_valid_before timestamp
        tls.certificate.expiration_time certificate.not_valid_after timestamp
        """
    )
    file = _fields("share path\nfile.name name\nfile.size size integer")
    kinds = [
        _kind("conn", 4001, 6, {"_path": "conn"}, common, link, conn),
        _kind("dns", 4003, 6, {"_path": "dns"}, common, link, dns, _fields("connection_info.protocol_name proto")),
        *[_kind(f"http_{m.lower()}", 4002, n, {"_path": "http", "method": m}, common, link, http) for m, n in HTTP_ACTIVITIES.items()],
        _kind("http_other", 4002, 99, {"_path": "http"}, common, link, http),
        _kind("ssl", 4001, 6, {"_path": "ssl"}, common, link, _fields("tls.version version\ntls.cipher cipher\ntls.sni server_name")),
        _kind("x509", 4001, 99, {"_path": "x509"}, common, certificate),
        _kind("smb_file_open", 4006, 2, {"_path": "smb_files", "action": "SMB::FILE_OPEN"}, common, link, file),
        _kind("smb_file_other", 4006, 99, {"_path": "smb_files"}, common, link, file),
        _kind("dce_rpc", 4006, 99, {"_path": "dce_rpc"}, common, link, _fields("dce_rpc.command operation")),
    ]
    client = ends | _fields("user.name client\nservice.name service")
    for name, request, activity in (("kerberos_ticket", "AS", 3), ("kerberos_service_ticket", "TGS", 4)):
        when = {"_path": "kerberos", "request_type": request}
        kinds += [
            _kind(name, 3002, activity, when | {"success": True}, common, client, {"status_id": {"constant": 1}}),
            _kind(f"{name}_refused", 3002, activity, when | {"success": False}, common, client, {"status_id": {"constant": 2}}, _fields("status_detail error_msg")),
            _kind(f"{name}_unanswered", 3002, activity, when, common, client),
        ]
    return [*kinds, _kind("rdp", 4005, 99, {"_path": "rdp"}, common, link), _kind("ssh", 4007, 99, {"_path": "ssh"}, common, link)]


def _suricata() -> list[dict]:
    common = _product("Suricata", "OISF", severity=False) | _fields("time timestamp timestamp\nmetadata.log_name event_type\nmetadata.correlation_uid flow_id string")
    ends = _fields(
        """
        src_endpoint.ip src_ip ip
        src_endpoint.port src_port integer
        dst_endpoint.ip dest_ip ip
        dst_endpoint.port dest_port integer
        connection_info.protocol_name proto
        connection_info.community_uid community_id
        """
    )
    alert = _fields(
        """
        message alert.signature
        finding_info.title alert.signature
        finding_info.analytic.uid alert.signature_id string
        finding_info.analytic.name alert.signature
        finding_info.analytic.category alert.category
        finding_info.analytic.version alert.rev string
        finding_info.analytic.type_id =1
        action alert.action
        """
    ) | {"is_alert": {"constant": True}, "severity_id": _map("alert.severity", {"1": 4, "2": 3, "3": 2, "4": 1}, 99), "action_id": _map("alert.action", {"allowed": 1, "blocked": 2}, 99)}
    query = _fields("query.hostname dns.rrname\nquery.type dns.rrtype\nquery.packet_uid dns.id integer")
    answer = _fields("rcode dns.rcode") | {"rcode_id": _map("dns.rcode", {"NOERROR": 0, "FORMERR": 1, "SERVFAIL": 2, "NXDOMAIN": 3, "NOTIMP": 4, "REFUSED": 5}, 99)}
    http = _fields(
        """
        http_request.http_method http.http_method
        http_request.url.hostname http.hostname
        http_request.url.path http.url
        http_request.user_agent http.http_user_agent
        http_request.referrer http.http_refer
        http_request.version http.protocol
        http_response.code http.status integer
        http_response.length http.length integer
        http_response.content_type http.http_content_type
        """
    )
    tls = _fields(
        """
        tls.version tls.version
        tls.sni tls.sni
        tls.certificate.subject tls.subject
        tls.certificate.issuer tls.issuerdn
        tls.certificate.serial_number tls.serial
        tls.certificate.created_time tls.notbefore utc-timestamp
        tls.certificate.expiration_time tls.notafter utc-timestamp
        tls.certificate.fingerprints.0.value tls.fingerprint
        tls.certificate.fingerprints.0.algorithm_id =2
        tls.ja3_hash.value tls.ja3.hash
        tls.ja3_hash.algorithm_id =1
        """
    )
    flow = _fields(
        """
        app_name app_proto
        start_time flow.start timestamp
        end_time flow.end timestamp
        traffic.packets_out flow.pkts_toserver integer
        traffic.packets_in flow.pkts_toclient integer
        traffic.bytes_out flow.bytes_toserver integer
        traffic.bytes_in flow.bytes_toclient integer
        """
    )
    file = _fields("file.name fileinfo.filename\nfile.size fileinfo.size integer\nfile.hashes.0.value fileinfo.sha256\nfile.hashes.0.algorithm_id =3")
    smb = _fields("command smb.command\ndialect smb.dialect\nshare smb.share\nfile.name smb.filename")
    methods = [m for m in HTTP_ACTIVITIES if m != "TRACE"]
    usual = (common, {"severity_id": {"constant": 1}}, ends)
    return [
        _kind("alert", 2004, 1, {"event_type": "alert"}, common, alert, {f"evidences.0.{t}": s for t, s in ends.items()}),
        _kind("dns_query", 4003, 1, {"event_type": "dns", "dns.type": "query"}, *usual, query),
        _kind("dns_answer", 4003, 2, {"event_type": "dns", "dns.type": "answer"}, *usual, query, answer),
        *[_kind(f"http_{m.lower()}", 4002, HTTP_ACTIVITIES[m], {"event_type": "http", "http.http_method": m}, *usual, http) for m in methods],
        _kind("http_other", 4002, 99, {"event_type": "http"}, *usual, http),
        _kind("tls", 4001, 6, {"event_type": "tls"}, *usual, tls),
        _kind("flow", 4001, 6, {"event_type": "flow"}, *usual, flow),
        _kind("http_file", 4002, 99, {"event_type": "fileinfo", "app_proto": "http"}, *usual, file),
        _kind("smb_file", 4006, 99, {"event_type": "fileinfo", "app_proto": "smb"}, *usual, file, _fields("share smb.share")),
        _kind("smb", 4006, 99, {"event_type": "smb"}, *usual, smb),
        _kind("ssh", 4007, 99, {"event_type": "ssh"}, *usual, _fields("protocol_ver ssh.server.proto_version")),
        _kind("anomaly", 4001, 99, {"event_type": "anomaly"}, *usual, _fields("message anomaly.event")),
        _kind("drop", 4001, 5, {"event_type": "drop"}, *usual, {"action_id": {"constant": 2}}),
    ]


#: Event type of an account change: kind, activity.
OKTA_ACCOUNTS = {
    "user.lifecycle.create": ("account_created", 1),
    "user.lifecycle.activate": ("account_activated", 2),
    "user.lifecycle.reactivate": ("account_reactivated", 2),
    "user.lifecycle.deactivate": ("account_deactivated", 5),
    "user.lifecycle.suspend": ("account_suspended", 5),
    "user.lifecycle.delete.initiated": ("account_deleted", 6),
    "user.account.update_password": ("password_changed", 3),
    "user.account.reset_password": ("password_reset", 4),
    "user.account.unlock_by_admin": ("account_unlocked", 12),
    "user.mfa.factor.activate": ("factor_activated", 10),
    "user.mfa.factor.deactivate": ("factor_deactivated", 11),
    "user.mfa.factor.reset_all": ("factors_reset", 11),
}


def _okta() -> list[dict]:
    common = _product("Okta", "Okta", severity=False) | _fields(
        """
        time published timestamp
        metadata.uid uuid
        metadata.event_code eventType
        metadata.correlation_uid transaction.id
        message displayMessage
        severity severity
        status outcome.result
        status_detail outcome.reason
        actor.user.uid actor.id
        actor.user.name actor.alternateId
        actor.user.full_name actor.displayName
        actor.user.type actor.type
        actor.session.uid authenticationContext.externalSessionId
        src_endpoint.ip client.ipAddress ip
        src_endpoint.location.city client.geographicalContext.city
        src_endpoint.location.region client.geographicalContext.state
        src_endpoint.location.country client.geographicalContext.country
        http_request.user_agent client.userAgent.rawUserAgent
        """
    )
    common |= {"severity_id": _map("severity", {"DEBUG": 1, "INFO": 1, "WARN": 3, "ERROR": 4}, 99), "status_id": _map("outcome.result", {"SUCCESS": 1, "ALLOW": 1, "FAILURE": 2, "DENY": 2}, 99)}
    own = _fields("user.uid actor.id\nuser.name actor.alternateId")
    proof = _fields("auth_protocol authenticationContext.credentialType")
    other = _fields("user.uid target.0.id\nuser.name target.0.alternateId\nuser.full_name target.0.displayName")
    group = _fields("group.uid target.1.id\ngroup.name target.1.displayName")
    when = lambda x: {"eventType": x}
    return [
        _kind("sign_in", 3002, 1, when("user.session.start"), common, own, proof),
        _kind("sign_in_with_factor", 3002, 1, when("user.authentication.auth_via_mfa"), common, own, proof, {"is_mfa": {"constant": True}}),
        _kind("single_sign_on", 3002, 1, when("user.authentication.sso"), common, own, _fields("service.name target.0.displayName\nservice.uid target.0.id")),
        _kind("sign_out", 3002, 2, when("user.session.end"), common, own, proof),
        *[_kind(name, 3001, activity, when(x), common, other) for x, (name, activity) in OKTA_ACCOUNTS.items()],
        _kind("account_locked", 3001, 9, when("user.account.lock"), common, own, _fields("user.full_name actor.displayName")),
        *[_kind(f"group_member_{x}", 3006, n, when(f"group.user_membership.{y}"), common, other, group) for x, y, n in (("added", "add", 3), ("removed", "remove", 4))],
        *[_kind(f"privilege_{x}", 3005, n, when(f"user.account.privilege.{y}"), common, other) for x, y, n in (("granted", "grant", 1), ("revoked", "revoke", 2))],
        _kind("other", 6003, 99, {"version": "0"}, common, _fields("api.operation eventType\napi.request.uid debugContext.debugData.requestId")),
    ]


#: Operation of an account, group or role change: kind, class, activity.
M365_CHANGES = {
    "Add user.": ("account_created", 3001, 1),
    "Change user password.": ("password_changed", 3001, 3),
    "Reset user password.": ("password_reset", 3001, 4),
    "Disable Strong Authentication.": ("strong_authentication_disabled", 3001, 11),
    "Delete user.": ("account_deleted", 3001, 6),
    "Add member to group.": ("group_member_added", 3006, 3),
    "Remove member from group.": ("group_member_removed", 3006, 4),
    "Add member to role.": ("role_member_added", 3005, 1),
    "Remove member from role.": ("role_member_removed", 3005, 2),
}


def _m365() -> list[dict]:
    common = _product("Microsoft 365", "Microsoft", severity=False) | _fields(
        """
        time CreationTime utc-timestamp
        metadata.product.feature.name Workload
        metadata.uid Id
        metadata.event_code Operation
        metadata.tenant_uid OrganizationId
        status_code ResultStatus
        actor.user.name UserId
        """
    )
    good, bad = ("Succeeded", "Success", "True", "true"), ("Failed", "False", "false")
    common |= {"status": _map("ResultStatus", dict.fromkeys(good, "Success") | dict.fromkeys(bad, "Failure"), "Other", "string"), "status_id": _map("ResultStatus", dict.fromkeys(good, 1) | dict.fromkeys(bad, 2), 99), "actor.user.type_id": _map("UserType", {"0": 1, "2": 2, "3": 2, "4": 3, "8": 3}, 99)}
    plain = {"severity_id": {"constant": 1}}
    sign_in = plain | _fields("user.name UserId\nuser.uid UserKey\nsrc_endpoint.ip ClientIP ip\nservice.uid ObjectId\nactor.app_uid ApplicationId\nstatus_detail LogonError")
    alert = _fields("api.operation Operation\nmessage Name\nseverity Severity") | {"severity_id": _map("Severity", {"Informational": 1, "Low": 2, "Medium": 3, "High": 4}, 99)}
    return [
        _kind("sign_in", 3002, 1, {"Operation": "UserLoggedIn"}, common, sign_in),
        _kind("sign_in_failed", 3002, 1, {"Operation": "UserLoginFailed"}, common, sign_in),
        *[_kind(name, uid, activity, {"Operation": x}, common, plain, _fields("user.name ObjectId")) for x, (name, uid, activity) in M365_CHANGES.items()],
        _kind("alert", 6003, 99, {"Operation": "AlertTriggered"}, common, alert),
        _kind("other", 6003, 99, {"Version": 1}, common, plain, _fields("api.operation Operation")),
    ]


def _cloudtrail() -> list[dict]:
    common = _product("AWS CloudTrail", "AWS") | _fields(
        """
        time eventTime timestamp
        metadata.uid eventID
        metadata.log_name eventCategory
        metadata.event_code eventType
        cloud.provider =AWS
        cloud.region awsRegion
        cloud.account.uid recipientAccountId
        actor.user.type userIdentity.type
        actor.user.uid userIdentity.principalId
        actor.user.uid_alt userIdentity.arn
        actor.user.name userIdentity.userName
        actor.user.account.uid userIdentity.accountId
        actor.user.credential_uid userIdentity.accessKeyId
        actor.session.issuer userIdentity.sessionContext.sessionIssuer.arn
        actor.invoked_by userIdentity.invokedBy
        http_request.user_agent userAgent
        """
    )
    call = _fields(
        """
        api.operation eventName
        api.service.name eventSource
        api.request.uid requestID
        api.response.error errorCode
        api.response.message errorMessage
        """
    )
    address, service = _fields("src_endpoint.ip sourceIPAddress ip"), _fields("src_endpoint.domain sourceIPAddress")
    login = address | _fields("status responseElements.ConsoleLogin\nstatus_detail errorMessage\nservice.name eventSource") | {"status_id": _map("responseElements.ConsoleLogin", {"Success": 1, "Failure": 2}, 99)}
    return [
        _kind("console_login", 3002, 1, {"eventName": "ConsoleLogin"}, common, login),
        _kind("service_read", 6003, 2, {"userIdentity.type": "AWSService", "readOnly": True}, common, call, service),
        _kind("service_write", 6003, 99, {"userIdentity.type": "AWSService", "readOnly": False}, common, call, service),
        _kind("service_event", 6003, 99, {"eventType": "AwsServiceEvent"}, common, call, service),
        _kind("read", 6003, 2, {"readOnly": True}, common, call, address),
        _kind("write", 6003, 99, {"readOnly": False}, common, call, address),
    ]


def _entra() -> list[dict]:
    common = _product("Microsoft Entra ID", "Microsoft") | _fields(
        """
        time time timestamp
        metadata.log_name category
        metadata.uid properties.id
        metadata.correlation_uid correlationId
        cloud.provider =Azure
        cloud.account.uid tenantId
        status_code resultType string
        status_detail properties.status.failureReason
        src_endpoint.ip properties.ipAddress
        src_endpoint.location.city properties.location.city
        src_endpoint.location.region properties.location.state
        src_endpoint.location.country properties.location.countryOrRegion
        service.name properties.resourceDisplayName
        service.uid properties.resourceId
        risk_level properties.riskLevelDuringSignIn
        actor.app_name properties.appDisplayName
        actor.app_uid properties.appId
        """
    )
    common |= {"status_id": _map("resultType", {"0": 1}, 2), "risk_level_id": _map("properties.riskLevelDuringSignIn", {"none": 0, "low": 1, "medium": 2, "high": 3}, 99)}
    user = _fields(
        """
        user.name userPrincipalName
        user.uid userId
        user.display_name userDisplayName
        http_request.user_agent userAgent
        device.uid deviceDetail.deviceId
        device.name deviceDetail.displayName
        device.os.name deviceDetail.operatingSystem
        """,
        "properties.",
    )
    return [
        *[_kind(name, 3002, 1, {"category": x}, common, user) for name, x in (("user", "SignInLogs"), ("non_interactive", "NonInteractiveUserSignInLogs"))],
        _kind("service_principal", 3002, 1, {"category": "ServicePrincipalSignInLogs"}, common, _fields("user.name servicePrincipalName\nuser.uid servicePrincipalId", "properties.")),
    ]


def _auditd() -> list[dict]:
    common = _product("auditd", "Linux Audit") | _fields("time time unix-seconds\nmetadata.sequence serial integer\ndevice.hostname node\ndevice.os.type_id =200\ndevice.os.name =Linux")
    start = _fields(
        """
        process.pid SYSCALL.pid integer
        process.name SYSCALL.comm
        process.file.path SYSCALL.exe
        process.cmd_line PROCTITLE.proctitle
        process.working_directory CWD.cwd
        process.user.uid SYSCALL.uid
        process.user.name SYSCALL.UID
        process.session.uid SYSCALL.ses
        process.parent_process.pid SYSCALL.ppid integer
        actor.user.uid SYSCALL.auid
        actor.user.name SYSCALL.AUID
        """
    ) | {"status_id": _map("SYSCALL.success", {"yes": 1, "no": 2})}
    login = _fields(
        """
        user.name USER_LOGIN.msg.acct
        user.uid USER_LOGIN.msg.id
        src_endpoint.ip USER_LOGIN.msg.addr
        src_endpoint.hostname USER_LOGIN.msg.hostname
        logon_process.file.path USER_LOGIN.msg.exe
        logon_process.pid USER_LOGIN.pid integer
        session.uid USER_LOGIN.ses
        status USER_LOGIN.msg.res
        """
    ) | {"status_id": _map("USER_LOGIN.msg.res", {"success": 1, "failed": 2})}
    calls = {"execve_x86_64": ("c000003e", "59"), "execve_aarch64": ("c00000b7", "221")}  # machine and number of the call
    return [
        *[{"unmapped": ["EXECVE", "SYSCALL"]} | _kind(name, 1007, 1, {"SYSCALL.arch": arch, "SYSCALL.syscall": n}, common, start) for name, (arch, n) in calls.items()],
        *[{"unmapped": ["USER_LOGIN"]} | _kind(f"login_{name}", 3002, 1, {"USER_LOGIN.msg.res": x}, common, login) for name, x in (("success", "success"), ("failure", "failed"))],
    ]


def _falco() -> list[dict]:
    common = _product("Falco", "The Falco Project", severity=False) | _fields(
        """
        time time timestamp
        metadata.log_name source
        metadata.uid uuid
        device.hostname hostname
        message output
        severity priority
        finding_info.uid uuid
        finding_info.title rule
        finding_info.types tags
        finding_info.analytic.name rule
        finding_info.analytic.type_id =1
        """
    )
    common |= {"is_alert": {"constant": True}, "severity_id": _map("priority", {"Emergency": 6, "Alert": 5, "Critical": 5, "Error": 4, "Warning": 3, "Notice": 2, "Informational": 1, "Info": 1, "Debug": 1}, 99)}
    call = _fields(
        """
        actor.user.name user.name
        actor.user.uid user.uid string
        actor.process.name proc.name
        actor.process.cmd_line proc.cmdline
        actor.process.pid proc.pid integer
        actor.process.file.path proc.exepath
        actor.process.working_directory proc.cwd
        actor.process.parent_process.name proc.pname
        actor.process.parent_process.pid proc.ppid integer
        actor.process.container.uid container.id
        actor.process.container.name container.name
        actor.process.container.image.name container.image.repository
        actor.process.container.image.tag container.image.tag
        """,
        "output_fields.",
    )
    return [_kind("syscall", 2004, 1, {"source": "syscall"}, common, call), _kind("k8s_audit", 2004, 1, {"source": "k8s_audit"}, common, _fields("actor.user.name ka.user.name", "output_fields."))]


def _pcapdroid() -> list[dict]:
    common = _product("PCAPdroid", "Emanuele Faranda") | _fields(
        """
        time FirstSeen timestamp
        start_time FirstSeen timestamp
        end_time LastSeen timestamp
        src_endpoint.ip SrcIP ip
        src_endpoint.port SrcPort integer
        dst_endpoint.ip DstIp ip
        dst_endpoint.port DstPort integer
        connection_info.protocol_num IPProto integer
        app_name Proto
        actor.app_name App
        actor.app_uid PackageName
        traffic.bytes_out BytesSent integer
        traffic.bytes_in BytesRcvd integer
        traffic.packets_out PktsSent integer
        traffic.packets_in PktsRcvd integer
        """
    )
    info = {"DNS": (4003, 6, "query.hostname"), "HTTP": (4002, 99, "http_request.url.hostname"), "HTTPS": (4001, 6, "dst_endpoint.hostname"), "TLS": (4001, 6, "dst_endpoint.hostname"), "QUIC": (4001, 6, "dst_endpoint.hostname")}
    kinds = [_kind(p.lower(), uid, activity, {"Proto": p}, common, {target: "Info"}) for p, (uid, activity, target) in info.items()]
    return kinds + [_kind(name, 4001, 6, {"IPProto": n}, common) for name, n in (("tcp", "6"), ("udp", "17"), ("icmp", "1"), ("icmp6", "58"))]


#: The columns of a packet capture export.
PCAP_COLUMNS = "IPProto,SrcIP,SrcPort,DstIp,DstPort,UID,App,PackageName,Proto,Status,Info,BytesSent,BytesRcvd,PktsSent,PktsRcvd,FirstSeen,LastSeen,Malicious".split(",")


@lru_cache(maxsize=1)
def sources() -> dict[str, tuple[str, str | None, N.Definition]]:
    """name -> (framing, member that batches hold records in, definition)."""
    made = {
        "sysmon": ("json-values", None, _sysmon(False), ["Event.EventData"]),
        "sysmon-flat": ("lines", None, _sysmon(True), ["."]),
        "windows-security": ("json-values", None, _windows(), ["Event.EventData"]),
        "zeek": ("lines", None, _zeek(), ["."]),
        "suricata": ("lines", None, _suricata(), ["."]),
        "auditd": ("audit-events", None, _auditd(), ["."]),
        "falco": ("lines", None, _falco(), ["output_fields"]),
        "pcapdroid": ("csv", None, _pcapdroid(), ["."]),
        "okta": ("json-values", ".", _okta(), ["."]),
        "m365": ("json-values", ".", _m365(), ["."]),
        "entra": ("lines", "records", _entra(), ["properties"]),
        "cloudtrail": ("json-values", "Records", _cloudtrail(), ["."]),
    }
    nil = {"windows-security": ["-"]}
    return {name: (how, member, N.load({"name": name, "version": 1, "nil": nil.get(name, []), "unmapped": rest, "kinds": kinds})) for name, (how, member, kinds, rest) in made.items()}


def events_of(raw: DataFrame, source: str, col: str = "value") -> DataFrame:
    """Raw data (one row a file or message) of a named source as outcomes, with
    ``record_id``; framing failures are dead letters of their own stage."""
    how, member, definition = sources()[source]
    if how == "json-values":
        framed = D.frame_json_values(raw, col)
    elif how == "audit-events":
        lines = raw.withColumn("__file", F.xxhash64(col))
        framed = D.frame_audit(D.frame_lines(lines, col).select("__file", "pos", "line"), "__file").select("pos", D.decode_auditd(F.col("record")).alias("record"), "dead")
    elif how == "csv":
        rows = D.decode_csv(D.frame_lines(raw, col).select("pos", "line"), PCAP_COLUMNS)
        framed = rows.select("pos", F.when(F.col("error").isNull(), F.to_json(F.struct(*PCAP_COLUMNS))).alias("record"), F.when(F.col("error").isNotNull(), F.col("line")).alias("dead"))
    else:
        framed = D.frame_lines(raw, col).select("pos", F.col("line").alias("record"), F.lit(None).cast("string").alias("dead"))
    good = framed.filter("dead is null").select("record")
    if member:
        good = good.select(F.explode(D.unwrap(F.col("record"), None if member == "." else member)).alias("record"))
    out = N.normalize(good, definition).withColumn("record_id", N.record_id(F.lit(source), F.col("record")))
    dead = framed.filter("dead is not null").select(F.col("dead").alias("record"), F.lit("framing").alias("stage"), F.lit("cannot be framed").alias("error"))
    return out.unionByName(dead, allowMissingColumns=True)
