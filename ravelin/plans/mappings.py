"""Field mappings of detection rules per product, and rules over normalized
events.

A rule names fields as the product does. What a definition of the source
writes a member of a record to is therefore where a rule reads it: mappings
follow from the definitions, every target of a member in any kind, and then its
place among the members that no field took. Members that no definition reads
but that rules ask for are named here; any other field refuses to load.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.plans import sigma
from ravelin.plans.normalize import Definition, path_values, source_path
from ravelin.sources.definitions import sources


@dataclass
class Mapping:
    """The log source that it is for, what an event must hold, and for each
    field the paths where it may stand. ``lists`` names paths through arrays."""

    logsource: dict[str, str]
    holds: dict[str, object]
    fields: dict[str, list[str]]
    lists: frozenset = field(default_factory=frozenset)


def follow(definition: Definition, logsource: dict, holds: dict, under: str = "", kinds=None, kept=(), other=None) -> Mapping:
    """The mapping that a definition implies for members below ``under`` (a path
    with its final dot). ``kept`` are members that no kind reads; ``other`` are
    fields that have another name than their member."""
    found: dict[str, list[str]] = {}
    for k in definition.kinds:
        if kinds is not None and k.name not in kinds:
            continue
        for f in k.fields:
            if f.source and f.source.startswith(under):
                paths = found.setdefault(f.source[len(under) :], [])
                # a text that becomes something else is read where it is kept as written
                if f.coerce != "fingerprints" and not f.translate and f.target not in paths:
                    paths.append(f.target)
    for name in dict.fromkeys((*found, *kept)):
        found.setdefault(name, []).append(f"unmapped.{name}")
    return Mapping(logsource, holds, found | {k: [v] if isinstance(v, str) else list(v) for k, v in (other or {}).items()})


# Members of the products' records that rules read as written.

_PE = ("OriginalFileName",)
_SIGNED = ("OriginalFileName", "Signed", "Signature", "SignatureStatus")
_CONNECTION = ("Initiated", "SourceIsIpv6", "DestinationIsIpv6")
_SECURITY = """
FailureReason TicketEncryptionType TicketOptions PreAuthType ElevatedToken ImpersonationLevel RestrictedAdminMode VirtualAccount KeyLength LmPackageName LogonGuid
TransmittedServices TokenElevationType MandatoryLabel SamAccountName DisplayName UserPrincipalName UserAccountControl TaskContent TaskContentNew ServiceType ServiceStartType
ObjectServer AccessMask AccessList AccessReason TransactionId ResourceAttributes RestrictedSidCount ShareLocalPath DSName DSType AttributeLDAPDisplayName AttributeSyntaxOID
AttributeValue OperationType OpCorrelationID AppCorrelationID DnsHostName ServicePrincipalNames Properties AdditionalInfo AdditionalInfo2 ObjectValueName OldValue NewValue
OldValueType NewValueType AllowedToDelegateTo OldUacValue NewUacValue PasswordLastSet AccountExpires PrimaryGroupId HomeDirectory HomePath ScriptPath ProfilePath
UserWorkstations UserParameters SidHistory LogonHours ComputerAccountChange TargetInfo TargetLogonGuid
""".split()
_TRAIL = """
eventVersion readOnly managementEvent sharedEventID requestParameters requestParameters.attribute requestParameters.bucketName requestParameters.containerDefinitions.command
requestParameters.enable requestParameters.layers requestParameters.userName requestParameters.roleName requestParameters.policyArn responseElements
responseElements.accessKey.userName responseElements.publiclyAccessible responseElements.pendingModifiedValues.masterUserPassword additionalEventData additionalEventData.MFAUsed
resources userIdentity.sessionContext.sessionIssuer.type userIdentity.sessionContext.sessionIssuer.userName userIdentity.sessionContext.sessionIssuer.principalId
userIdentity.sessionContext.attributes.mfaAuthenticated
""".split()
_OKTA = """
legacyEventType version target.id target.type target.alternateId target.displayName client.userAgent.os client.userAgent.browser client.zone client.device
authenticationContext.credentialType authenticationContext.credentialProvider authenticationContext.authenticationProvider securityContext.isProxy securityContext.asOrg
securityContext.isp securityContext.domain debugContext.debugData.requestId debugContext.debugData.requestUri debugContext.debugData.url debugContext.debugData.behaviors
debugContext.debugData.risk debugContext.debugData.threatSuspected debugContext.debugData.logOnlySecurityData debugContext.debugData.privilegeGranted transaction.type
""".split()
_AUDIT = "RecordType ErrorNumber Directionality DeliveryAction Verdict Category".split()
#: What a log of the network monitor keeps beside what its kinds read.
_ZEEK = {
    "conn": "duration conn_state history local_orig local_resp",
    "dns": "qtype answers TTLs rejected AA TC RD RA Z",
    "http": "trans_depth tags resp_mime_types orig_mime_types client_header_names server_header_names",
    "ssl": "curve resumed established cert_chain_fps",
    "x509": "fingerprint",
    "smb_files": "action fuid",
    "dce_rpc": "endpoint named_pipe rtt",
    "kerberos": "request_type success cipher forwardable renewable",
    "rdp": "cookie result security_protocol client_name client_build",
    "ssh": "version auth_success auth_attempts direction client server",
}


def shipped() -> list[Mapping]:
    """The mappings of five products."""
    own = {name: s[2] for name, s in sources().items()}
    data, windows = "Event.EventData.", {"device.os.type_id": 100}
    # programs write a process where the event model allows it, and rules look in all these places
    parent = {f"Parent{n}": [f"process.parent_process.{p}", f"actor.process.{p}"] for n, p in (("CommandLine", "cmd_line"), ("ProcessId", "pid"), ("ProcessGuid", "uid"), ("User", "user.name"))}
    parent |= {"Image": ["process.file.path", "process.path"], "ParentImage": [f"{x}.{p}" for x in ("process.parent_process", "actor.process") for p in ("file.path", "path")]}
    acting = {"Image": ["actor.process.file.path", "actor.process.path"], "CommandLine": "actor.process.cmd_line", "User": ["actor.user.name", "actor.process.user.name"], "IntegrityLevel": "actor.process.integrity"}
    acting |= {"ParentImage": [f"actor.process.parent_process.{p}" for p in ("file.path", "path")], "ParentCommandLine": "actor.process.parent_process.cmd_line"}

    def category(name: str, kind: str, uid: int, activity: int | None, kept=(), other=acting) -> Mapping:
        holds = {"class_uid": uid} | ({} if activity is None else {"activity_id": activity}) | windows
        return follow(own["sysmon"], {"category": name, "product": "windows"}, holds, data, [kind], kept, other)

    security = {"EventID": "metadata.event_code", "Channel": "metadata.log_name", "Computer": "device.hostname", "LogonType": ["logon_type_id", "unmapped.LogonType"]}
    audit = {f"{n}": [f"unmapped.{n}.{m}" for m in ms] for n, ms in (("ExtendedProperties", ("Name", "Value")), ("ModifiedProperties", ("Name", "NewValue")), ("Parameters", ("Name", "Value")), ("OperationProperties", ("Name", "Value")))}
    audit |= {"RequestType": "unmapped.ExtendedProperties.Value", "UserType": "unmapped.UserType"}
    m365 = {"metadata.product.name": "Microsoft 365"}
    alert = {"eventSource": ["metadata.product.feature.name"], "eventName": ["message"], "status": ["status"]}
    out = [
        category("process_creation", "process_creation", 1007, 1, (*_PE, "Hashes", "LogonGuid", "TerminalSessionId"), parent),
        category("file_event", "file_create", 1001, 1, ("CreationUtcTime",)),
        category("image_load", "image_load", 1005, 1, _SIGNED),
        category("network_connection", "network_connection", 4001, None, _CONNECTION),
        category("registry_set", "registry_set", 201002, 2, ("Details", "EventType")),
        follow(own["windows-security"], {"product": "windows", "service": "security"}, {"metadata.log_name": "Security"} | windows, data, None, _SECURITY, security),
        follow(own["cloudtrail"], {"product": "aws", "service": "cloudtrail"}, {"metadata.product.name": "AWS CloudTrail"}, "", None, _TRAIL),
        follow(own["okta"], {"product": "okta", "service": "okta"}, {"metadata.product.name": "Okta"}, "", None, _OKTA),
        follow(own["m365"], {"product": "m365", "service": "audit"}, m365, "", None, _AUDIT, audit),
        Mapping({"product": "m365", "service": "exchange"}, m365, {"eventSource": ["metadata.product.feature.name"], "eventName": ["metadata.event_code"], "status": ["status"], "Parameters": audit["Parameters"]}),
        *[Mapping({"product": "m365", "service": s}, m365 | {"metadata.event_code": "AlertTriggered"}, alert) for s in ("threat_management", "threat_detection")],
    ]
    for log, kept in _ZEEK.items():
        kinds = [k.name for k in own["zeek"].kinds if k.when["_path"] == log]
        proxy = {"c-uri": "http_request.url.path", "c-useragent": "http_request.user_agent"} if log == "http" else None
        out.append(follow(own["zeek"], {"product": "zeek", "service": log}, {"metadata.product.name": "Zeek", "metadata.log_name": log}, "", kinds, kept.split(), proxy))
    lists = frozenset(p for ps in audit.values() for p in ([ps] if isinstance(ps, str) else ps) if p.count(".") > 1) | {f"unmapped.target.{m}" for m in ("id", "type", "alternateId", "displayName")}
    for m in out:
        m.lists = lists & {p for ps in m.fields.values() for p in ps}
    return out


# Rules over events


def select(logsource: dict, mappings: list[Mapping]) -> Mapping:
    """The mapping whose log source says most and agrees; ties are an error."""
    return next(m for m in mappings if m.logsource == sigma.select_mapping(logsource, [{"logsource": m.logsource} for m in mappings])["logsource"])


def match(events: DataFrame, rules: list[sigma.Rule], mappings: list[Mapping], name: str = "rules", event: str = "event", unmapped: str = "unmapped") -> DataFrame:
    """``events``, normalized (``class_uid``, the event and what it left as JSON
    texts), with the numbers of the rules that match. A rule that no mapping
    fits, or that names a field without a path, is an error."""
    chosen = [select(r.logsource, mappings) for r in rules]
    columns: dict[str, str] = {}
    listed: set[str] = set()

    def column(path: str, m: Mapping) -> str:
        c = columns.setdefault(path, f"__f{len(columns)}")
        if path in m.lists:
            listed.add(c)
        return c

    bound = []
    for rule, m in zip(rules, chosen, strict=True):
        asked = {p.field for p in _predicates(rule)} | {v for p in _predicates(rule) if "fieldref" in p.modifiers for v in p.values}
        paths = {n: [column(p, m) for p in m.fields[n]] for n in asked if n in m.fields}
        words = [column(p, m) for n in m.fields for p in m.fields[n]] if None in asked else []
        bound.append((rule, sigma.Fields(paths, list(dict.fromkeys(words)), frozenset(listed)), {p: column(p, m) for p in m.holds if p != "class_uid"}, m))
    v, w = F.col("__event"), F.col("__unmapped")
    # the condition, which always holds, keeps the optimizer from copying the parser into every use of its result
    parsed = events.withColumns({"__event": F.when(F.monotonically_increasing_id() >= 0, F.try_parse_json(event)), "__unmapped": F.when(F.monotonically_increasing_id() >= 0, F.try_parse_json(unmapped))})
    read = {}
    for path, c in columns.items():
        record, rest = (w, path.removeprefix("unmapped.")) if path.startswith("unmapped.") else (v, path)
        read[c] = path_values(record, rest) if c in listed else source_path(record, rest)
    rows = parsed.withColumns(read)
    gates: dict[str, Column] = {}
    out = []
    for rule, fields, held, m in bound:
        gate = None
        tests = [F.col(c) == str(m.holds[p]) for p, c in held.items()] + ([F.col("class_uid") == m.holds["class_uid"]] if "class_uid" in m.holds else [])
        for t in tests:
            gate = t if gate is None else gate & t
        out.append((rule, sigma.Fields(fields.columns, fields.keywords, frozenset(listed)), None if gate is None else gates.setdefault(str(sorted(m.holds.items())), gate)))
    return sigma.match_all(rows, out, name).drop("__event", "__unmapped", *read)


def _predicates(rule: sigma.Rule):
    def walk(search):
        how, parts = search
        for p in parts:
            if how == "or":
                yield from walk(p)
            else:
                yield p

    for search in rule.searches.values():
        yield from walk(search)
