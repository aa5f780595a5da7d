"""Detection rules: parsed, bound to fields, and compiled to one boolean
Column each; rule sets go through the index of ``rule_index``, so thousands of
rules cost one scan and about as much as the values that they hit.

Logic has two values: a missing field makes a test false and its negation
true, so every leaf is coalesced before any ``not``.

``matches_event`` evaluates the same rules on Python dicts; tests hold the
compiled rules against it.
"""

from __future__ import annotations

import fnmatch
import ipaddress
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.plans import rule_index


class RuleError(ValueError):
    """A rule that cannot be loaded."""


# Syntax


@dataclass
class Predicate:
    field: str | None
    values: list
    modifiers: list[str]


@dataclass
class Rule:
    title: str
    logsource: dict
    searches: dict[str, object]
    condition: str
    tags: list[str] = field(default_factory=list)


MODIFIERS = frozenset("contains startswith endswith all re i m s cidr exists lt lte gt gte fieldref cased base64 base64offset utf16 utf16le utf16be wide windash expand".split())


def load(source: str | dict) -> Rule:
    """A rule from a mapping or a YAML document (with a YAML library installed)."""
    if isinstance(source, str):
        source = _yaml(source)
    detection = source.get("detection")
    if not isinstance(detection, dict) or "condition" not in detection:
        raise RuleError("a rule has a detection with a condition")
    searches = {k: _search(v) for k, v in detection.items() if k not in ("condition", "timeframe")}
    condition = detection["condition"]
    if isinstance(condition, list):
        condition = " or ".join(f"({c})" for c in condition)
    rule = Rule(source.get("title", ""), source.get("logsource", {}), searches, str(condition), list(source.get("tags") or []))
    parse(rule.condition, rule.searches)
    return rule


def _yaml(text: str) -> dict:
    import yaml

    class Loader(yaml.SafeLoader):
        """Refuses keys that repeat."""

    def mapping(loader, node):
        out = {}
        for k, v in node.value:
            key = loader.construct_object(k, deep=True)
            if key in out:
                raise RuleError(f"{key} repeats")
            out[key] = loader.construct_object(v, deep=True)
        return out

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return yaml.load(text, Loader)  # noqa: S506


def _search(value):
    """A map is an AND of predicates, a list of maps an OR of them, and a list
    of scalars are keywords."""
    if isinstance(value, dict):
        return ("and", [_predicate(k, v) for k, v in value.items()])
    if isinstance(value, list) and value and all(isinstance(x, dict) for x in value):
        return ("or", [_search(x) for x in value])
    values = value if isinstance(value, list) else [value]
    if not values or any(isinstance(x, (dict, list)) for x in values):
        raise RuleError("a search is a map, a list of maps, or keywords")
    return ("and", [Predicate(None, values, [])])


def _predicate(key: str, value) -> Predicate:
    name, *modifiers = str(key).split("|")
    if unknown := [m for m in modifiers if m not in MODIFIERS]:
        raise RuleError(f"unknown modifier {unknown[0]}")
    if "expand" in modifiers:
        raise RuleError("placeholders are not filled in here")
    if any(m.startswith("utf16") or m == "wide" for m in modifiers) and not any(m.startswith("base64") for m in modifiers):
        raise RuleError("a wide text must be encoded next")
    if "base64offset" in modifiers and "contains" not in modifiers:
        raise RuleError("base64offset needs contains")
    return Predicate(name or None, value if isinstance(value, list) else [value], modifiers)


_LEX = re.compile(r"\s*(?:([()])|([^\s()]+))")


def parse(condition: str, searches: dict):
    """The tree of a condition: or < and < not; ``1 of`` and ``all of`` take
    ``them`` or a name with wildcards, without names that begin with ``_``."""
    if "|" in condition:
        raise RuleError("aggregations are not supported")
    tokens = [a or b for a, b in _LEX.findall(condition)]
    at = 0

    def peek():
        return tokens[at].lower() if at < len(tokens) else None

    def take():
        nonlocal at
        if at >= len(tokens):
            raise RuleError("the condition ends early")
        at += 1
        return tokens[at - 1]

    def either():
        parts = [both()]
        while peek() == "or":
            take()
            parts.append(both())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def both():
        parts = [negated()]
        while peek() == "and":
            take()
            parts.append(negated())
        return parts[0] if len(parts) == 1 else ("and", parts)

    def negated():
        if peek() == "not":
            take()
            return ("not", negated())
        if peek() == "(":
            take()
            inner = either()
            if take() != ")":
                raise RuleError("a bracket stays open")
            return inner
        if peek() in ("1", "any", "all") and at + 1 < len(tokens) and tokens[at + 1].lower() == "of":
            how = take().lower()
            take()
            target = take()
            names = [n for n in searches if not n.startswith("_")] if target.lower() == "them" else [n for n in searches if fnmatch.fnmatchcase(n, target)]
            if not names:
                raise RuleError(f"{target} names no search")
            return ("and" if how == "all" else "or", [("search", n) for n in names])
        name = take()
        if name not in searches:
            raise RuleError(f"no search is named {name}")
        return ("search", name)

    tree = either()
    if at != len(tokens):
        raise RuleError(f"unexpected {tokens[at]}")
    return tree


# Patterns


def pattern(value: str) -> list[str | None]:
    """Literal pieces, with ``*`` as None and ``?`` as an empty piece's marker
    "\\0"; a backslash makes ``*``, ``?`` and itself literal."""
    out: list[str | None] = []
    text, i = "", 0
    while i < len(value):
        c = value[i]
        if c == "\\" and i + 1 < len(value) and value[i + 1] in "*?\\":
            text += value[i + 1]
            i += 2
            continue
        if c in "*?":
            if text:
                out.append(text)
                text = ""
            if c == "?":
                out.append("\0")
            elif not out or out[-1] is not None:
                out.append(None)
        else:
            text += c
        i += 1
    if text:
        out.append(text)
    return out


def _java(parts: list[str | None]) -> str:
    return "(?s)^" + "".join(".*" if p is None else "." if p == "\0" else "\\Q" + p.replace("\\E", "\\E\\\\E\\Q") + "\\E" for p in parts) + "$"


def _python(parts: list[str | None]) -> re.Pattern:
    return re.compile("(?s)" + "".join(".*" if p is None else "." if p == "\0" else re.escape(p) for p in parts))


_REFUSED = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<|[*+?}]\+")


def check_regex(source: str) -> str:
    """Look-around, back references and possessive repeats are refused, as the
    rules ask for an engine that runs in linear time."""
    if _REFUSED.search(source):
        raise RuleError("the expression needs look-around, back references or possessive repeats")
    try:
        re.compile(source)
    except re.error as e:
        raise RuleError(str(e)) from e
    return source


# Values: each becomes (kind, argument) tests, which both evaluators read


def tests(p: Predicate) -> list[tuple]:
    m, out = p.modifiers, []
    cased = "cased" in m
    for value in p.values:
        if "exists" in m:
            out.append(("exists", bool(value)))
        elif value is None:
            out.append(("null", None))
        elif "fieldref" in m:
            out.append(("fieldref", str(value)))
        elif "cidr" in m:
            out.append(("cidr", ipaddress.ip_network(str(value), strict=False)))
        elif op := next((x for x in ("lte", "lt", "gte", "gt") if x in m), None):
            out.append((op, float(value)))
        elif "re" in m:
            flags = "".join(f for f in "ims" if f in m)
            out.append(("re", check_regex(str(value)), flags))
        elif isinstance(value, bool):
            out.append(("bool", value))
        elif isinstance(value, (int, float)) and not any(x in m for x in ("contains", "startswith", "endswith")):
            out.append(("number", value))
        else:
            text, encoded = str(value), False
            options = T.windash(text) if "windash" in m else [text]
            raw = [o.encode() for o in options]
            for x in m:
                if x in ("utf16", "utf16le", "wide", "utf16be"):
                    raw = [T.wide(o, "be" if x == "utf16be" else "le") for o in options]
                elif x == "base64":
                    options, encoded = [T.base64_of(r) for r in raw], True
                elif x == "base64offset":
                    options, encoded = [o for r in raw for o in T.base64_offsets(r)], True
            shapes = []
            for o in options:
                parts = [o] if encoded else pattern(o)
                if "contains" in m:
                    parts = [None, *parts, None]
                elif "startswith" in m:
                    parts = [*parts, None]
                elif "endswith" in m:
                    parts = [None, *parts]
                while any(a is None and b is None for a, b in zip(parts, parts[1:], strict=False)):
                    parts = [x for i, x in enumerate(parts) if not (x is None and i and parts[i - 1] is None)]
                shapes.append(("text", parts, cased or encoded))
            out.append(("any", shapes) if len(shapes) > 1 else shapes[0])
    return out


# Compilation to Columns


@dataclass
class Fields:
    """Which columns a field name may stand for, and all texts for keywords.
    ``arrays`` names columns that hold arrays: their elements are pooled."""

    columns: dict[str, list[str]]
    keywords: list[str] = field(default_factory=list)
    arrays: frozenset = frozenset()
    ascii_only: bool = False

    def of(self, name: str) -> list[str]:
        if name not in self.columns:
            raise RuleError(f"{name} is mapped to nothing")
        return self.columns[name]


def _some(fields: Fields, name: str, test: Callable[[Column], Column]) -> Column:
    """Does some value of the column pass?"""
    col = F.col(name)
    if name in fields.arrays:
        return F.coalesce(F.exists(col, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))
    return F.coalesce(test(col), F.lit(False))


def _text_test(col: Column, parts: list[str | None], cased: bool, ascii_only: bool) -> Column:
    col = col.cast("string")
    if not cased:
        col = T.fold(col, ascii_only)
        parts = [p if p is None or p == "\0" else T.fold_text(p) for p in parts]
    plain = [p for p in parts if p is not None]
    if len(plain) <= 1 and "\0" not in plain:
        lit = F.lit(plain[0] if plain else "")
        head, tail = bool(parts) and parts[0] is None, bool(parts) and parts[-1] is None
        if not plain:
            return col.isNotNull() if parts else col == ""
        return F.contains(col, lit) if head and tail else F.startswith(col, lit) if tail else F.endswith(col, lit) if head else col == lit
    whole = col.rlike(_java(parts))
    longest = max((p for p in plain if p != "\0"), key=len, default="")
    # a cheap substring test before the expression
    return F.contains(col, F.lit(longest)) & whole if longest else whole


def _leaf(test: tuple, fields: Fields, name: str | None) -> Column:
    kind = test[0]
    names = fields.of(name) if name is not None else fields.keywords
    if kind == "any":
        return reduce(lambda a, b: a | b, [_leaf(t, fields, name) for t in test[1]])
    if kind in ("exists", "null"):
        held = reduce(lambda a, b: a | b, [_some(fields, n, lambda c: c.isNotNull()) for n in names])
        return held if kind == "exists" and test[1] else ~held
    if kind == "fieldref":
        pairs = [F.coalesce(T.fold(F.col(a).cast("string")) == T.fold(F.col(b).cast("string")), F.lit(False)) for a in names for b in fields.of(test[1])]
        return reduce(lambda a, b: a | b, pairs)

    def one(c: Column) -> Column:
        if kind == "text":
            return _text_test(c, [None, *test[1], None] if name is None else test[1], test[2], fields.ascii_only)
        if kind == "re":
            return c.cast("string").rlike(f"(?U{test[2]}){test[1]}")
        if kind == "bool":
            return F.lower(c.cast("string")) == ("true" if test[1] else "false")
        if kind == "cidr":
            net = test[1]
            if net.version == 6:
                text = c.cast("string")
                return text.contains(":") & (T.hex_mask(T.ip_hex(text), net.prefixlen) == f"{int(net.network_address):032x}")
            n = T.ipv4_number(c.cast("string"))
            return (n >= int(net.network_address)) & (n <= int(net.broadcast_address))
        n = F.trim(c.cast("string")).try_cast("double")
        n = F.when(~F.isnan(n), n)
        return {"number": n == float(test[1]) if kind == "number" else None, "lt": n < test[1], "lte": n <= test[1], "gt": n > test[1], "gte": n >= test[1]}[kind]

    return reduce(lambda a, b: a | b, [_some(fields, n, one) for n in names])


def _search_column(search, fields: Fields) -> Column:
    how, parts = search
    if how == "or":
        return reduce(lambda a, b: a | b, [_search_column(p, fields) for p in parts])
    out = []
    for p in parts:
        leaves = [_leaf(t, fields, p.field) for t in tests(p)]
        out.append(reduce((lambda a, b: a & b) if "all" in p.modifiers else (lambda a, b: a | b), leaves) if leaves else F.lit("all" in p.modifiers))
    return reduce(lambda a, b: a & b, out, F.lit(True))


def _tree_column(tree, rule: Rule, fields: Fields) -> Column:
    kind, arg = tree
    if kind == "search":
        return _search_column(rule.searches[arg], fields)
    if kind == "not":
        return ~_tree_column(arg, rule, fields)
    return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), [_tree_column(x, rule, fields) for x in arg])


def compile_rule(rule: Rule, fields: Fields, gate: Column | None = None) -> Column:
    """The rule as a boolean Column that is never null."""
    body = _tree_column(parse(rule.condition, rule.searches), rule, fields)
    return body if gate is None else F.coalesce(gate, F.lit(False)) & body


def _indexed(test: tuple, rule_fields: Fields, name: str | None, b: rule_index.Builder) -> tuple:
    """A test of a field as a tree of atoms."""
    kind = test[0]
    names = rule_fields.of(name) if name is not None else rule_fields.keywords
    if kind == "any":
        return ("or", [_indexed(t, rule_fields, name, b) for t in test[1]])
    if kind in ("exists", "null"):
        held = ("or", [b.test(rule_fields, n, ("held",)) for n in names])
        return held if kind == "exists" and test[1] else ("not", held)
    if kind == "fieldref":
        return ("or", [b.flag((name, x, y), T.fold(F.col(x).cast("string")) == T.fold(F.col(y).cast("string"))) for x in names for y in rule_fields.of(test[1])])
    if kind == "text":
        parts = [None, *test[1], None] if name is None else test[1]
        test = ("text", tuple(x for i, x in enumerate(parts) if not (x is None and i and parts[i - 1] is None)), test[2])
    elif kind in rule_index.NUMBER_TESTS:
        test = (kind, float(test[1]))
    return ("or", [b.test(rule_fields, n, test) for n in names])


def _indexed_search(search, rule_fields: Fields, b: rule_index.Builder) -> tuple:
    how, parts = search
    if how == "or":
        return ("or", [_indexed_search(p, rule_fields, b) for p in parts])
    return ("and", [("and" if "all" in p.modifiers else "or", [_indexed(t, rule_fields, p.field, b) for t in tests(p)]) for p in parts])


def match_all(events: DataFrame, rules: list[tuple[Rule, Fields, Column | int | None]], name: str = "rules", class_col: str = "class_uid") -> DataFrame:
    """``events`` with ``rules``: the numbers of the rules that match, in order.
    A gate is the class that a rule is for, or a Column; rules of a class are
    tried on its events only."""
    b = rule_index.Builder(dict(events.dtypes))

    def walk(tree, rule, own):
        kind, arg = tree
        if kind == "search":
            return _indexed_search(rule.searches[arg], own, b)
        return ("not", walk(arg, rule, own)) if kind == "not" else (kind, [walk(x, rule, own) for x in arg])

    for rule, own, gate in rules:
        tree = walk(parse(rule.condition, rule.searches), rule, own)
        if gate is not None:
            tree = ("and", [b.gate(class_col, gate) if isinstance(gate, int) else b.flag(str(gate), gate, True), tree])
        b.matcher.trees.append(tree)
    return rule_index.matched(events, b, name)


# Mappings


def select_mapping(logsource: dict, mappings: list[dict]) -> dict:
    """The mapping whose log source says most and agrees; ties are an error."""
    fits = [m for m in mappings if all(logsource.get(k) == v for k, v in m["logsource"].items())]
    if not fits:
        raise RuleError("no mapping fits the log source")
    most = max(len(m["logsource"]) for m in fits)
    best = [m for m in fits if len(m["logsource"]) == most]
    if len(best) > 1:
        raise RuleError("two mappings fit alike")
    return best[0]


# Reference evaluator on dicts


def _pool(event: dict, names: list[str]) -> list:
    out = []
    for name in names:
        here = [event]
        for part in name.split("."):
            here = [v for e in here for v in ([e.get(part)] if isinstance(e, dict) else [])]
            here = [x for v in here for x in (v if isinstance(v, list) else [v])]
        out += [v for v in here if v is not None and not isinstance(v, dict)]
    return out


def _shown(v) -> str:
    return ("true" if v else "false") if isinstance(v, bool) else str(v)


def _number(v) -> float | None:
    try:
        return None if isinstance(v, bool) else float(str(v).strip())
    except ValueError:
        return None


def _passes(test: tuple, event: dict, fields: Fields, name: str | None) -> bool:
    kind = test[0]
    pool = _pool(event, fields.of(name) if name is not None else fields.keywords)
    if kind == "any":
        return any(_passes(t, event, fields, name) for t in test[1])
    if kind == "exists":
        return bool(pool) == test[1]
    if kind == "null":
        return not pool
    if kind == "fieldref":
        other = {T.fold_text(_shown(v)) for v in _pool(event, fields.of(test[1]))}
        return any(T.fold_text(_shown(v)) in other for v in pool)
    if kind == "text":
        parts = [None, *test[1], None] if name is None else test[1]
        if not test[2]:
            parts = [p if p is None or p == "\0" else T.fold_text(p) for p in parts]
        seen = [v for v in pool if isinstance(v, str)] if name is None else pool
        return any(_python(parts).fullmatch(_shown(v) if test[2] else T.fold_text(_shown(v))) for v in seen)
    if kind == "re":
        flags = sum({"i": re.I, "m": re.M, "s": re.S}[f] for f in test[2])
        return any(re.search(test[1], _shown(v), flags) for v in pool)
    if kind == "bool":
        return any(_shown(v).lower() == _shown(test[1]) for v in pool)
    if kind == "cidr":
        for v in pool:
            try:
                if isinstance(v, str) and ipaddress.ip_address(v) in test[1]:
                    return True
            except (ValueError, TypeError):
                continue
        return False
    n = [x for x in map(_number, pool) if x is not None]
    check = {"number": lambda x: x == float(test[1]), "lt": lambda x: x < test[1], "lte": lambda x: x <= test[1], "gt": lambda x: x > test[1], "gte": lambda x: x >= test[1]}[kind]
    return any(map(check, n))


def matches_event(rule: Rule, event: dict, fields: Fields) -> bool:
    def search(s) -> bool:
        how, parts = s
        if how == "or":
            return any(map(search, parts))
        return all((all if "all" in p.modifiers else any)([_passes(t, event, fields, p.field) for t in tests(p)]) for p in parts)

    def tree(t) -> bool:
        kind, arg = t
        return search(rule.searches[arg]) if kind == "search" else not tree(arg) if kind == "not" else (all if kind == "and" else any)(map(tree, arg))

    return tree(parse(rule.condition, rule.searches))
