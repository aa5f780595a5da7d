"""Source definitions compiled to projections: decoded JSON records become
events of one nested model, with issues, unmapped rest and dead letters.

A definition is a mapping: ``kinds`` is an ordered list, each with ``when``
(path -> exact value), ``class`` and ``fields`` (target -> how). The first kind
whose conditions all hold takes the record; none is a mapping dead letter.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions import text as T

COERCIONS = ("string", "integer", "timestamp", "utc-timestamp", "unix-seconds", "ip", "fingerprints")
#: Targets that a definition may not write: they are derived.
RESERVED = ("class_uid", "category_uid", "type_uid", "unmapped", "observables")


class DefinitionError(ValueError):
    """A definition that cannot be compiled."""


@dataclass
class Field:
    """One target: a source path, or a constant; then translation and coercion."""

    target: str
    source: str | None = None
    constant: object = None
    translate: dict = field(default_factory=dict)
    otherwise: object = None
    coerce: str = "string"


@dataclass
class Kind:
    name: str
    class_uid: int
    fields: list[Field]
    when: dict = field(default_factory=dict)
    #: Objects of the source whose members that no field took are kept; "." is the record itself.
    unmapped: list[str] = field(default_factory=lambda: ["."])


@dataclass
class Definition:
    name: str
    version: int
    kinds: list[Kind]
    nil: list[str] = field(default_factory=list)


def load(source: dict) -> Definition:
    kinds = []
    for k in source["kinds"]:
        fields = [Field(t, **({"source": how} if isinstance(how, str) else {"source": how.get("from"), "constant": how.get("constant"), "translate": how.get("map", {}), "otherwise": how.get("otherwise"), "coerce": how.get("as", "string")})) for t, how in k["fields"].items()]
        kinds.append(Kind(k["name"], int(k["class"]), fields, k.get("when", {}), list(k.get("unmapped", source.get("unmapped", ["."])))))
    made = Definition(source["name"], int(source.get("version", 1)), kinds, list(source.get("nil", [])))
    check(made)
    return made


def check(d: Definition) -> None:
    """Refuse what could not mean anything: no kinds, reserved or overlapping
    targets, unknown coercions, a field with neither source nor constant."""
    if not d.kinds:
        raise DefinitionError("a definition has kinds")
    for k in d.kinds:
        seen: list[str] = []
        for f in k.fields:
            if f.target.split(".")[0] in RESERVED:
                raise DefinitionError(f"{f.target} is derived")
            if any(f.target == s or f.target.startswith(s + ".") or s.startswith(f.target + ".") for s in seen):
                raise DefinitionError(f"{f.target} overlaps another target")
            if (f.source is None) == (f.constant is None):
                raise DefinitionError(f"{f.target} needs a source or a constant")
            if f.coerce not in COERCIONS:
                raise DefinitionError(f"{f.coerce} is no coercion")
            seen.append(f.target)


#: How raw data may be framed for each way to decode a record.
FRAMINGS = {"json": ("lines", "json-values"), "csv": ("lines",), "auditd": ("audit-events",), "syslog": ("lines", "syslog"), "syslog-json": ("lines", "syslog")}
#: Constants that an enumeration of the event model allows.
ENUMS = {"severity_id": (0, 1, 2, 3, 4, 5, 6, 99), "status_id": (0, 1, 2, 99)}


def check_source(framing: str, decoding: str, definition: Definition, unwrap: str | None = None, attributes: dict[int, set[str]] | None = None) -> None:
    """Refuse a source whose parts do not fit each other: a framing that gives no
    records for the decoding, batches of what is not JSON, constants beyond an
    enumeration, and, with the ``attributes`` of each class, targets that the
    event model does not have."""
    if framing not in FRAMINGS.get(decoding, ()):
        raise DefinitionError(f"{framing} gives no records for {decoding}")
    if unwrap is not None and decoding != "json":
        raise DefinitionError("only JSON comes in batches")
    for k in definition.kinds:
        for f in k.fields:
            allowed = ENUMS.get(f.target)
            values = [f.constant] if f.source is None else [*f.translate.values(), *([] if f.otherwise is None else [f.otherwise])]
            if allowed and (bad := [v for v in values if int(v) not in allowed]):
                raise DefinitionError(f"{bad[0]} is not defined for {f.target}")
            if attributes is not None and f.target not in attributes.get(k.class_uid, ()):
                raise DefinitionError(f"class {k.class_uid} has no {f.target}")


def source_path(record: Column, path: str, kind: str = "string") -> Column:
    """The one value at a path of a VARIANT: nested members, array indexes, or
    members whose names hold dots."""
    parts = path.split(".")

    def spell(groups: list[str]) -> str:
        return "$" + "".join(f"[{g}]" if g.isdigit() else "['" + g.replace("'", "\\'") + "']" for g in groups)

    ways = []
    for bits in range(1 << (len(parts) - 1)):  # every way to join neighbouring segments
        groups = [parts[0]]
        for i, p in enumerate(parts[1:]):
            if bits >> i & 1:
                groups[-1] += "." + p
            else:
                groups.append(p)
        ways.append(F.try_variant_get(record, spell(groups), kind))
    return F.coalesce(*ways)


def path_values(record: Column, path: str) -> Column:
    """The texts at a path of a VARIANT, through all arrays on the way."""

    def members(x: Column) -> Column:
        return F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))

    found = members(record)
    for part in path.split("."):
        name = "$['" + part.replace("'", "\\'") + "']"
        found = F.flatten(F.transform(found, lambda x: members(F.try_variant_get(x, name, "variant"))))  # noqa: B023 - built at once
    return F.array_compact(F.transform(found, lambda x: F.try_variant_get(x, "$", "string")))


def coerce(text: Column, how: str) -> Column:
    """The typed value of a text; null if it has none."""
    if how == "string":
        return text
    t = F.trim(text)
    if how == "integer":
        hexed = F.conv(F.when(t.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.substring(t, 3, 16)), 16, 10).try_cast("bigint")
        return F.coalesce(F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint")), hexed)
    if how == "timestamp":
        colon = F.regexp_replace(t, r"([+-]\d\d)(\d\d)$", "$1:$2")  # some products leave it out
        return F.when(colon.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.unix_millis(F.try_to_timestamp(F.upper(colon))))
    if how == "utc-timestamp":
        civil = T.epoch_ms(F.when(t.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?$"), t).try_cast("timestamp_ntz"))
        return F.coalesce(coerce(text, "timestamp"), civil)
    if how == "unix-seconds":
        whole = F.regexp_extract(t, r"^(\d{1,12})(?:\.(\d+))?$", 1)
        part = F.substring(F.rpad(F.regexp_extract(t, r"^(\d{1,12})(?:\.(\d+))?$", 2), 3, "0"), 1, 3)
        return F.when(whole != "", whole.try_cast("bigint") * 1000 + part.try_cast("bigint"))
    if how == "ip":
        return F.when(t.rlike(IPV4) | t.rlike(IPV6), t)
    raise DefinitionError(f"{how} gives no scalar")


_V4 = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def _v6() -> str:
    """The shapes of an IPv6 address: eight groups, or fewer around one gap; an
    IPv4 address at the end stands for two groups."""
    h = "[0-9a-fA-F]{1,4}"
    ways = [f"(?:{h}:){{7}}{h}", f"(?:{h}:){{6}}{_V4}"]
    for left in range(8):
        head = f"(?:{h}(?::{h}){{{left - 1}}})?" if left == 1 else f"{h}(?::{h}){{{left - 1}}}" if left else ""
        if left <= 6:
            ways.append(f"{head}::(?:{h}(?::{h}){{0,{6 - left}}})?")
        if left <= 5:
            ways.append(f"{head}::(?:{h}:){{0,{5 - left}}}{_V4}")
    ways.append(f"{h}(?::{h}){{6}}::")
    return "^(?:" + "|".join(ways) + ")$"


IPV4, IPV6 = f"^{_V4}$", _v6()


def fingerprints(col: Column) -> Column:
    """``SHA256=…,MD5=…`` as (algorithm, value) pairs; parts without ``=`` go."""
    parts = F.filter(F.transform(F.split(col, ","), lambda x: F.trim(x)), lambda x: x.contains("="))
    return F.transform(parts, lambda x: F.struct(F.upper(F.substring_index(x, "=", 1)).alias("algorithm"), F.regexp_replace(x, "^[^=]*=", "").alias("value")))


def _value(raw: Column, f: Field) -> tuple[Column, Column]:
    """(value as text or number, reason of failure) from the source's text."""
    if f.source is None:
        return F.lit(f.constant), F.lit(None).cast("string")
    text, reason = raw, F.lit(None).cast("string")
    if f.translate:
        table = F.create_map(*[F.lit(str(x)) for kv in f.translate.items() for x in kv])
        text = F.try_element_at(table, raw)
        if f.otherwise is not None:
            text = F.when(raw.isNotNull(), F.coalesce(text, F.lit(str(f.otherwise))))
        reason = F.when(raw.isNotNull() & text.isNull(), "not listed")
    if f.coerce == "fingerprints":
        return fingerprints(text), reason
    value = coerce(text, f.coerce)
    reason = F.coalesce(reason, F.when(text.isNotNull() & value.isNull(), f"no {f.coerce}"))
    return value, reason


def _nest(pairs: list[tuple[str, Column]]) -> Column:
    """A struct from dotted targets; numeric segments are array places."""
    groups: dict[str, list] = {}
    for path, col in pairs:
        head, _, rest = path.partition(".")
        groups.setdefault(head, []).append((rest, col))
    made = {k: v[0][1] if v[0][0] == "" else _nest(v) for k, v in groups.items()}
    if all(k.isdigit() for k in made):
        return F.array(*[made[k] for k in sorted(made, key=int)])
    return F.struct(*[c.alias(k) for k, c in made.items()])


MEMBERS = "map<string,variant>"


def _same(f: Field) -> tuple:
    """Fields that are alike in this have the same value."""
    return f.source, tuple(map(str, f.translate.items())), f.otherwise, f.coerce


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's other columns are
    computed anew for each element."""
    return F.transform(F.array(value), body)[0]


def _rest(v: Column, kind: Kind, took: list[tuple[str, Column, Column]]) -> Column:
    """Members that no field took, as one map: of each listed object by their
    own names, qualified by the object where an earlier one gave the name. A
    value that did not convert was not taken; outside of the listed objects it
    is kept by its whole path. ``took`` has (source, value, reason of failure)."""

    def inside(path: str, obj: str) -> str | None:
        return path if obj == "." else path[len(obj) + 1 :] if path.startswith(obj + ".") else None

    def direct(path: str) -> Column:
        """Is it a member of the record itself, dots and all?"""
        return F.lit("." in kind.unmapped) & F.try_variant_get(v, "$['" + path.replace("'", "\\'") + "']", "variant").isNotNull()

    lost = [F.when(why.isNotNull() & ~direct(p), F.struct(F.lit(p), source_path(v, p, "variant"))) for p, _, why in took if not any(inside(p, o) for o in kind.unmapped if o != ".")]
    none = F.expr(f"cast(map() as {MEMBERS})")
    kept = F.map_from_entries(F.array_compact(F.array(*lost))) if lost else none
    for obj in kind.unmapped:
        members = F.coalesce(F.try_variant_get(v, "$", MEMBERS) if obj == "." else source_path(v, obj, MEMBERS), none)
        taken = F.array_compact(F.array(*[F.when(x.isNotNull() & why.isNull(), n) for p, x, why in took if (n := inside(p, obj))])).cast("array<string>")

        def joined(k: Column, obj=obj, members=members, taken=taken) -> Column:
            own = let(taken, lambda t: F.map_filter(members, lambda n, x: ~F.array_contains(t, n) & ~F.is_variant_null(x)))
            own = F.transform_keys(own, lambda n, _: F.when(F.map_contains_key(k, n), F.concat(F.lit(f"{obj}."), n)).otherwise(n))
            return F.map_concat(k, F.map_filter(own, lambda n, _: ~F.map_contains_key(k, n)))

        kept = let(kept, lambda k: joined(k))  # noqa: PLW0108, B023 - a lambda has one parameter here
    return kept


def normalize(records: DataFrame, definition: Definition, col: str = "record") -> DataFrame:
    """Records as outcomes: ``kind``, ``class_uid``, ``event`` (JSON text),
    ``issues`` and ``unmapped`` members; ``stage`` and ``error`` for dead ones."""
    # the condition, which always holds, keeps the optimizer from copying the parser into every use of its result
    parsed = records.withColumn("__v", F.when(F.monotonically_increasing_id() >= 0, F.try_parse_json(col)))
    v = F.col("__v")
    is_object = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    # each path is read once and each value made once: as columns of their own, which the optimizer does not repeat
    paths = {p: f"__p{i}" for i, p in enumerate(sorted({f.source for k in definition.kinds for f in k.fields if f.source}))}
    asked = {p: f"__w{i}" for i, p in enumerate(sorted({p for k in definition.kinds for p in k.when}))}
    rows = parsed.withColumns({"__o": is_object} | {c: source_path(v, p, "variant") for p, c in asked.items()} | {c: F.when(~x.isin(*definition.nil), x) if definition.nil else x for p, c in paths.items() for x in [source_path(v, p)]})
    matched = F.lit(None).cast("int")
    for i, k in reversed(list(enumerate(definition.kinds))):
        test = F.lit(True)
        for path, want in k.when.items():
            kind = "boolean" if isinstance(want, bool) else "bigint" if isinstance(want, int) else "string"
            found = F.col(asked[path])
            test &= F.coalesce((F.schema_of_variant(found) == kind.upper()) & (F.try_variant_get(found, "$", kind) == want), F.lit(False))
        matched = F.when(test, i).otherwise(matched)
    made: dict[str, Column] = {"__k": F.when(F.col("__o"), matched)}
    values: dict[tuple, str] = {}
    for f in (f for k in definition.kinds for f in k.fields if f.source):
        if _same(f) not in values:
            n = values[_same(f)] = f"__v{len(values)}"
            made[n], made[f"{n}w"] = _value(F.col(paths[f.source]), f)
    rows = rows.withColumns(made)
    event, issues, uid, name, rest = (F.lit(None).cast(t) for t in ("string", "array<struct<target:string,source:string,reason:string>>", "int", "string", "string"))
    for i, k in enumerate(definition.kinds):
        own = F.to_json(_nest([(f.target, F.col(values[_same(f)]) if f.source else F.lit(f.constant)) for f in k.fields]))
        reasons = F.array(*[F.struct(F.lit(f.target).alias("target"), F.lit(f.source).alias("source"), F.col(f"{values[_same(f)]}w").alias("reason")) for f in k.fields if f.source])
        here = F.col("__k") == i
        event, issues = F.when(here, own).otherwise(event), F.when(here, F.filter(reasons, lambda x: x["reason"].isNotNull())).otherwise(issues)
        uid, name = F.when(here, k.class_uid).otherwise(uid), F.when(here, k.name).otherwise(name)
        # fingerprints keep their text as well, where rules read it
        took = [(f.source, F.col(paths[f.source]), F.col(f"{values[_same(f)]}w")) for f in k.fields if f.source and f.coerce != "fingerprints"]
        rest = F.when(here, F.to_json(_rest(v, k, took))).otherwise(rest)
    is_object = F.col("__o")
    return rows.select(
        *records.columns,
        name.alias("kind"),
        uid.alias("class_uid"),
        event.alias("event"),
        issues.alias("issues"),
        rest.alias("unmapped"),
        F.when(v.isNull() | ~is_object, "decoding").when(F.col("__k").isNull(), "mapping").alias("stage"),
        F.when(v.isNull(), "not JSON").when(~is_object, "not an object").when(F.col("__k").isNull(), "no kind fits").alias("error"),
    )


def record_id(source: Column, raw: Column) -> Column:
    """A stable 128-bit identity of a record within its source."""
    return F.substring(F.sha2(F.concat(F.length(source).cast("string"), F.lit(":"), source, raw), 256), 1, 32)


def validate(time: Column, class_uid: Column, activity: Column, type_uid: Column, category: Column, start: Column, end: Column, version: Column | None = None) -> Column:
    """Are an event's own numbers in agreement, and does it name the version of
    its schema, where that is given?"""
    good = F.lit(True) if version is None else version.rlike(r"^\d+\.\d+\.\d+")
    good &= (time > 0) & (type_uid == class_uid * 100 + activity) & (category == F.floor(class_uid % 100000 / 1000)) & (start.isNull() | end.isNull() | (start <= end))
    return F.coalesce(good, F.lit(False))


def to_json(d: Definition) -> str:
    return json.dumps({"name": d.name, "version": d.version, "kinds": [k.name for k in d.kinds]})
