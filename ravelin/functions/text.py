"""String, hash, address and time functions as Column expressions."""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """Simple case folding, one character to one: the case fold where it is one
    character, else the lower case where that is one, else none."""
    source, target = [], []
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x1F000)]):
        to = next((x for x in (c.casefold(), c.lower()) if len(x) == 1), c)
        if to != c:
            source.append(c)
            target.append(to)
    return "".join(source), "".join(target)


def fold_text(text: str) -> str:
    return text.translate(str.maketrans(*fold_table()))


def fold(col: Column, ascii_only: bool = False) -> Column:
    """Case-folded text. ``ascii_only`` is for columns known to hold ASCII."""
    return F.lower(col) if ascii_only else F.translate(col, *fold_table())


def domain(col: Column) -> Column:
    """A domain in one spelling: lower case, ``[.]`` undone, no final dot; null
    if it cannot be one."""
    d = F.regexp_replace(F.lower(F.replace(F.trim(col), F.lit("[.]"), F.lit("."))), r"\.$", "")
    label = r"[a-z0-9_]([a-z0-9_-]{0,61}[a-z0-9_])?"
    return F.when((F.length(d) <= 253) & d.rlike(rf"^{label}(\.{label})+$") & ~d.rlike(r"^[0-9.]+$"), d)


def url(col: Column) -> Column:
    """A URL in one spelling: scheme and host lower case, ``hxxp`` undone, the
    scheme's default port and the fragment dropped."""
    u = F.regexp_replace(F.replace(F.trim(col), F.lit("[.]"), F.lit(".")), r"^[hH][xX][xX][pP]", "http")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rest = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host, rest))


def url_host(col: Column) -> Column:
    """The host of a URL without user and port, lower case; null without one."""
    h = F.regexp_extract(col, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.when(h != "", F.lower(h))


def url_build(scheme: Column, host: Column, port: Column, path: Column) -> Column:
    """A URL from its parts; a port that is the scheme's own is left out."""
    own = F.when(scheme == "http", 80).when(scheme == "https", 443)
    with_port = F.when(port.isNotNull() & (F.coalesce(own, F.lit(-1)) != port), F.concat(F.lit(":"), port.cast("string"))).otherwise("")
    slash = F.when(path.startswith("/") | (path == ""), path).otherwise(F.concat(F.lit("/"), path))
    return F.concat(scheme, F.lit("://"), host, with_port, F.coalesce(slash, F.lit("")))


#: Lengths of hexadecimal digests by kind: fixed values.
HASHES = {"md5": 32, "sha1": 40, "sha256": 64, "sha512": 128}


def hash_kind(col: Column) -> Column:
    """The kind of a digest by its length; null if it is none."""
    out = F.lit(None).cast("string")
    for kind, n in HASHES.items():
        out = F.when(F.length(F.trim(col)) == n, kind).otherwise(out)
    return F.when(F.trim(col).rlike("^[0-9a-fA-F]+$"), out)


def ip_port(col: Column) -> Column:
    """An address whose port is stripped: ``1.2.3.4:80``, ``[::1]:80``."""
    v4 = F.regexp_extract(F.trim(col), r"^(\d{1,3}(?:\.\d{1,3}){3})(?::\d+)?$", 1)
    v6 = F.regexp_extract(F.trim(col), r"^\[([0-9a-fA-F:.]+)\](?::\d+)?$", 1)
    return F.when(v4 != "", v4).when(v6 != "", F.lower(v6))


def ipv4_number(col: Column) -> Column:
    """A dotted IPv4 address as a number; null if it is none. Zero-padded parts
    are no address."""
    parts = F.split(col, r"\.")
    good = col.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")
    value = sum((F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint") * (1 << (24 - 8 * i)) for i in range(1, 4)), F.try_element_at(parts, F.lit(1)).try_cast("bigint") * (1 << 24))
    return F.when(good, value)


def ipv4_text(number: Column) -> Column:
    return F.concat_ws(".", *[(F.shiftright(number, 24 - 8 * i).bitwiseAND(255)).cast("string") for i in range(4)])


def mask(number: Column, prefix) -> Column:
    """The network of an IPv4 number."""
    p = F.lit(prefix) if isinstance(prefix, int) else prefix
    size = F.pow(F.lit(2), 32 - p).cast("bigint")
    return F.floor(number / size).cast("bigint") * size


def ip_hex(col: Column) -> Column:
    """An address of either family as 32 hex digits, IPv4 ones (and those mapped
    into IPv6) behind ``::ffff``; null if it is none."""
    from ravelin.plans.normalize import IPV4, IPV6

    v = F.lower(F.trim(col))
    four = F.when(v.rlike(IPV4), F.concat(F.lit("0" * 20 + "ffff"), F.lpad(F.lower(F.hex(ipv4_number(v))), 8, "0")))
    # an IPv4 address at the end stands for two groups
    tail = F.lpad(F.lower(F.hex(ipv4_number(F.regexp_extract(v, r":([0-9.]+)$", 1)))), 8, "0")
    six = F.when(v.contains("."), F.concat(F.regexp_replace(v, r"[0-9.]+$", ""), F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4))).otherwise(v)
    side = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))
    left, right = side(F.substring_index(six, "::", 1)), side(F.when(six.contains("::"), F.substring_index(six, "::", -1)).otherwise(""))
    groups = F.concat(left, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right)), right)
    whole = F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")
    return F.coalesce(four, F.when(v.rlike(IPV6), whole))


def hex_mask(address: Column, prefix) -> Column:
    """The network of an address in 32 hex digits; ``prefix`` is a number or a Column."""
    p = F.lit(prefix) if isinstance(prefix, int) else prefix
    whole, step = F.floor(p / 4).cast("int"), F.pow(F.lit(2), 4 - p % 4).cast("bigint")
    digit = F.conv(F.substring(address, whole + 1, F.lit(1)), 16, 10).try_cast("bigint")
    part = F.when(p % 4 > 0, F.lower(F.hex(F.floor(digit / step).cast("bigint") * step))).otherwise("")
    return F.rpad(F.concat(F.substring(address, F.lit(1), whole), part), 32, "0")


def asn(col: Column) -> Column:
    """``AS64500`` or ``64500`` as a number; null out of range."""
    n = F.regexp_extract(F.upper(F.trim(col)), r"^(?:AS)?(\d{1,10})$", 1).try_cast("bigint")
    return F.when(n <= 4294967295, n)


def technique(col: Column) -> Column:
    """The technique id of a rule tag such as ``attack.t1059.001``."""
    t = F.regexp_extract(F.lower(col), r"^attack\.(t\d{4}(?:\.\d{3})?)$", 1)
    return F.when(t != "", F.upper(t))


def identifier(kind: str, col: Column) -> Column:
    """One spelling of an identifier; placeholders are null."""
    v = F.trim(col)
    v = F.when(~F.lower(v).isin("", "-", "n/a", "none", "null", "unknown", "undefined"), v)
    if kind == "mac":
        hex_ = F.regexp_replace(F.lower(v), "[^0-9a-f]", "")
        return F.when(F.length(hex_) == 12, F.regexp_replace(hex_, "(..)(?!$)", "$1:"))
    if kind == "sid":
        return F.when(F.upper(v).rlike(r"^S-1-\d+(-\d+)*$"), F.upper(v))
    if kind == "email":
        return F.when(v.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lower(v))
    return F.lower(F.regexp_replace(v, r"\.$", ""))


def strength(form: Column, value: Column) -> Column:
    """Is an identifier strong enough to name an entity by itself?"""
    return (
        F.when(form == "sid", value.startswith("S-1-5-21-") | value.startswith("S-1-12-1-"))
        .when(form == "email", F.lit(True))
        .when(form == "name", value.contains("\\") | value.contains("@"))
        .when(form == "host", value.contains("."))
        .when(form == "uid", ~value.rlike(r"^\d+$"))
        .otherwise(F.lit(False))
    )


#: Domains that every machine has: a name below one is no one's own.
AUTHORITIES = ("nt authority", "nt service", "builtin", "window manager", "font driver host", "iis apppool", "workgroup", ".")


def identity_strong(identity: Column) -> Column:
    """Does an identifier ``kind:form:value`` name one thing without doubt?"""
    kind, form, value = F.substring_index(identity, ":", 1), F.split_part(identity, F.lit(":"), F.lit(2)), F.regexp_replace(identity, r"^[^:]*:[^:]*:", "")
    domain, name = F.substring_index(value, "\\", 1), F.regexp_replace(value, r"^[^\\]*\\", "")
    return (
        F.when((kind == "user") & (form == "sid"), value.startswith("s-1-5-21-") | value.startswith("s-1-12-1-"))
        .when((kind == "user") & (form == "name") & value.contains("\\"), (name != "") & ~domain.isin(*AUTHORITIES))
        .when((kind == "user") & (form == "name"), value.rlike("^[^@]+@.+$"))
        .when((kind == "host") & (form == "name"), value.contains("."))
        .when((kind == "host") & (form == "mac"), F.lit(False))
        .otherwise(F.lit(True))
    )


def identity_rank(identity: Column) -> Column:
    """Where an identifier stands among those of one thing, the lowest first."""
    form = F.split_part(identity, F.lit(":"), F.lit(2))
    order = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in ("sid", "uid", "email", "name", "local", "mac")]), form), F.lit(0))
    return F.when(identity_strong(identity), 0).otherwise(10) + F.when(order > 0, order - 1).otherwise(6).cast("int")


def band(confidence: Column) -> Column:
    """Confidence bands: 3 from 90, 2 from 50, else 1."""
    return F.when(confidence >= 90, 3).when(confidence >= 50, 2).otherwise(1)


def feed_time(col: Column) -> Column:
    """Seconds since 1970 from whole seconds, RFC 3339, or a civil date (and
    time) in UTC; null if it is none of them."""
    v = F.trim(col)
    number = F.when(v.rlike(r"^\d{1,12}$"), v.try_cast("bigint"))
    zoned = F.when(v.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.unix_seconds(F.try_to_timestamp(F.upper(v))))
    civil = F.when(v.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d)?)?( UTC)?$"), epoch_ms(F.regexp_replace(v, " UTC$", "").try_cast("timestamp_ntz")) / 1000)
    return F.coalesce(number, zoned, F.floor(civil)).cast("bigint")


def epoch_ms(ntz: Column) -> Column:
    """Milliseconds since 1970 of a time without zone, in any session zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ntz)


def bucket(ms: Column, step: int) -> Column:
    """The start of the bucket, by floor division."""
    return F.floor(ms / step).cast("bigint") * step


# Constants made on the driver for rule modifiers


def base64_of(data: bytes) -> str:
    return base64.b64encode(data).decode()


def base64_offsets(data: bytes) -> list[str]:
    """The three texts that a value can look like inside of a longer encoded
    one: shifted by 0, 1, 2 bytes, without the characters its neighbours touch."""
    out = []
    for shift in range(3):
        text = base64.b64encode(b" " * shift + data).decode()
        start = (0, 2, 3)[shift]
        cut = (0, 3, 2)[(len(data) + shift) % 3]
        out.append(text[start : len(text) - cut])
    return out


#: What may stand for a dash before an option: fixed values.
DASHES = ("-", "/", "\u2013", "\u2014", "\u2015")


def windash(value: str, most: int = 625) -> list[str]:
    """The value with every option dash in each of its spellings."""
    spots = [i for i, c in enumerate(value) if c in "-/" and (i == 0 or not (value[i - 1].isalnum() or value[i - 1] == "_")) and i + 1 < len(value) and (value[i + 1].isalnum() or value[i + 1] == "_")]
    out = [value]
    for i in spots:
        out = [v[:i] + d + v[i + 1 :] for v in out for d in DASHES]
        if len(out) > most:
            raise ValueError("too many spellings")
    return list(dict.fromkeys(out))


def wide(value: str, order: str = "le") -> bytes:
    return value.encode(f"utf-16-{order}")
