"""Typed event search: checked against a schema, compiled to one predicate,
paged by key.

A path names a column of the events, or, with a ``Schema``, an attribute of the
classes that the search is for: it is read from the event's JSON text with the
type that the classes agree on. Below ``unmapped`` paths are free: a value is
compared with texts if it is a text, with numbers if it is a number.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.plans.normalize import Definition, source_path

MAX_SPAN_MS = 31 * 86_400_000
MAX_FILTERS, MAX_VALUES, MAX_TEXT, MAX_PAGE, PAGE = 32, 1000, 4096, 1000, 100

TEXT_OPS = frozenset(["equals", "not_equals", "contains", "starts_with", "ends_with", "in", "exists", "missing"])
NUMBER_OPS = frozenset(["equals", "not_equals", "gt", "gte", "lt", "lte", "in", "exists", "missing"])
FLAG_OPS = frozenset(["equals", "not_equals", "exists", "missing"])


class SearchError(ValueError):
    """A search that cannot be run."""


@dataclass
class Filter:
    path: str
    op: str
    value: object = None


@dataclass
class Search:
    from_ms: int
    to_ms: int
    classes: list[int] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    limit: int = PAGE
    after: tuple[int, int] | None = None


#: Values that an enumeration of the event model defines.
ENUMS = {"severity_id": frozenset([0, 1, 2, 3, 4, 5, 6, 99]), "status_id": frozenset([0, 1, 2, 99])}


@dataclass
class Schema:
    """The attributes of each class: path -> string, bigint, time, double,
    boolean, object or array."""

    classes: dict[int, dict[str, str]]

    @staticmethod
    def of(definitions: list[Definition]) -> Schema:
        """What definitions write: every target, and the objects around it."""
        found: dict[int, dict[str, str]] = {}
        for k in (k for d in definitions for k in d.kinds):
            own = found.setdefault(k.class_uid, {"class_uid": "bigint"})
            for f in k.fields:
                parts = f.target.split(".")
                listed = next((i for i, p in enumerate(parts) if p.isdigit()), None)
                if f.source is None:
                    kind = "boolean" if isinstance(f.constant, bool) else "bigint" if isinstance(f.constant, int) else "string"
                else:
                    kind = {"string": "string", "ip": "string", "integer": "bigint", "fingerprints": "array"}.get(f.coerce, "time")
                for i in range(1, len(parts)):
                    own.setdefault(".".join(parts[:i]), "array" if listed is not None and i >= listed else "object")
                own[f.target] = "array" if listed is not None else kind
        return Schema(found)

    def resolve(self, path: str, classes: list[int]) -> str:
        """The one type of a path in the classes, or in all that have it."""
        for c in classes:
            if c not in self.classes:
                raise SearchError(f"{c} is no class")
            if path not in self.classes[c]:
                raise SearchError(f"{path} is no attribute of class {c}")
        kinds = {own[path] for c, own in self.classes.items() if path in own and (not classes or c in classes)}
        if not kinds:
            raise SearchError(f"no class has {path}")
        if len(kinds) > 1:
            raise SearchError(f"classes do not agree on {path}")
        return kinds.pop()


def _target(f: Filter, events: DataFrame, schema: Schema | None, classes: list[int]) -> str:
    """What a path holds: a column's type, an attribute's, or ``any``."""
    if any(not part or any(c in "`\\" or ord(c) < 32 for c in part) for part in f.path.split(".")):
        raise SearchError(f"{f.path!r} is no path")
    kind = dict(events.dtypes).get(f.path)
    if kind is not None and f.path != "unmapped":
        return kind
    if schema is None:
        raise SearchError(f"{f.path} is no attribute")
    if f.path.startswith("unmapped."):
        return "any"
    return "object" if f.path == "unmapped" else schema.resolve(f.path, classes)


def _scalar(v, kind: str) -> str | None:
    """The type that a value compares as; None if it does not fit."""
    own = "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "bigint" if isinstance(v, int) else "double" if isinstance(v, float) else None
    if kind == "any" or own is None:
        return own
    if kind == "string" or kind == "boolean":
        return own if own == kind else None
    if kind in ("double", "float") or kind.startswith("decimal"):
        return kind if own in ("bigint", "double") else None
    return kind if own == "bigint" else None


def check(search: Search, events: DataFrame, schema: Schema | None = None) -> list[tuple[str, str]]:
    """Refuse a search that is out of bounds or compares what cannot be. What
    each filter's path holds, and what its values compare as."""
    if not 0 < search.to_ms - search.from_ms <= MAX_SPAN_MS:
        raise SearchError("the range is empty or over 31 days")
    if len(search.filters) > MAX_FILTERS:
        raise SearchError("too many filters")
    if not 0 < search.limit <= MAX_PAGE:
        raise SearchError("the page size is out of range")
    out = []
    for f in search.filters:
        kind = _target(f, events, schema, search.classes)
        if kind.startswith(("array", "map")):
            raise SearchError(f"{f.path} lies within an array")
        if f.op in ("exists", "missing"):
            if f.value is not None:
                raise SearchError(f"{f.op} takes no value")
            out.append((kind, kind))
            continue
        if kind == "object":
            raise SearchError(f"{f.op} does not apply to {f.path}")
        if (f.op == "in") != isinstance(f.value, (list, tuple)):
            raise SearchError("in takes a list of values, and only in does")
        values = f.value if f.op == "in" else [f.value]
        if f.op == "in" and not 0 < len(values) <= MAX_VALUES:
            raise SearchError("in takes 1 to 1000 values")
        kinds = {_scalar(v, kind) for v in values}
        if None in kinds:
            raise SearchError(f"{f.value!r} is no value of {f.path}")
        if len(kinds) > 1:
            raise SearchError("the values of in are of one type")
        as_ = kinds.pop()
        ops = TEXT_OPS if as_ == "string" else FLAG_OPS if as_ == "boolean" else NUMBER_OPS
        if f.op not in ops:
            raise SearchError(f"{f.op} does not apply to {f.path}")
        for v in values:
            if isinstance(v, str) and len(v.encode()) > MAX_TEXT:
                raise SearchError("a text is too long")
            if (allowed := ENUMS.get(f.path)) and v not in allowed:
                raise SearchError(f"{v} is not a defined value of {f.path}")
        out.append((kind, as_))
    return out


def _value(f: Filter, kind: str, as_: str, columns: list[str]) -> Column:
    """The value at a filter's path, null where it is absent or of another type."""
    if f.path in columns and not (f.path == "unmapped" and kind == "object"):
        return F.col(f.path)
    free = f.path.startswith("unmapped.")
    record = F.col("__unmapped" if free or f.path == "unmapped" else "__event")
    found = record if f.path == "unmapped" else source_path(record, f.path.removeprefix("unmapped."), "variant")
    found = F.when(~F.is_variant_null(found), found)
    if kind == "object":  # one that holds no value is not there
        return F.when(F.schema_of_variant(found).rlike("STRING|BIGINT|DOUBLE|DECIMAL|BOOLEAN"), found)
    if f.op in ("exists", "missing"):
        return found
    if kind == "any":  # a text is no number and a number no text
        shape = F.schema_of_variant(found)
        same = {"string": shape == "STRING", "boolean": shape == "BOOLEAN", "bigint": shape == "BIGINT", "double": (shape == "BIGINT") | (shape == "DOUBLE") | F.startswith(shape, F.lit("DECIMAL"))}[as_]
        found = F.when(same, found)
    return F.try_variant_get(found, "$", "bigint" if as_ == "time" else as_)


def _condition(f: Filter, kind: str, as_: str, columns: list[str]) -> Column:
    col = _value(f, kind, as_, columns)
    if f.op == "exists":
        return col.isNotNull()
    if f.op == "missing":
        return col.isNull()
    text = as_ == "string"
    left = F.lower(col) if text else col
    lit = (lambda v: F.lower(F.lit(v))) if text else F.lit
    if f.op == "in":
        return F.coalesce(left.isin(*[v.lower() if text else v for v in f.value]), F.lit(False))
    v = lit(f.value)
    test = {
        "equals": lambda: left == v,
        "not_equals": lambda: left == v,
        "contains": lambda: F.contains(left, v),
        "starts_with": lambda: F.startswith(left, v),
        "ends_with": lambda: F.endswith(left, v),
        "gt": lambda: left > v,
        "gte": lambda: left >= v,
        "lt": lambda: left < v,
        "lte": lambda: left <= v,
    }[f.op]()
    held = F.coalesce(test, F.lit(False))
    return ~held if f.op == "not_equals" else held


def matching(events: DataFrame, search: Search, schema: Schema | None = None) -> DataFrame:
    """All events of a search; comparisons of time and class reach the scan.
    Events are parsed after these, and only if a path lies within them."""
    checked = check(search, events, schema)
    parts = [F.col("time") >= search.from_ms, F.col("time") < search.to_ms]
    if search.classes:
        parts.append(F.col("class_uid").isin(*search.classes))
    own = [_condition(f, k, a, events.columns) for f, (k, a) in zip(search.filters, checked, strict=True) if f.path in events.columns and f.path != "unmapped"]
    found = events.filter(reduce(lambda a, b: a & b, parts + own))
    inner = [_condition(f, k, a, events.columns) for f, (k, a) in zip(search.filters, checked, strict=True) if f.path not in events.columns or f.path == "unmapped"]
    if not inner:
        return found
    # the condition, which always holds, keeps the optimizer from copying the parser into every use of its result
    parsed = found.withColumns({f"__{c}": F.when(F.monotonically_increasing_id() >= 0, F.try_parse_json(c)) for c in ("event", "unmapped") if c in events.columns})
    return parsed.filter(reduce(lambda a, b: a & b, inner)).drop("__event", "__unmapped")


def page(events: DataFrame, search: Search, schema: Schema | None = None) -> DataFrame:
    """One page, newest first; the next one starts after its last (time, id)."""
    found = matching(events, search, schema)
    if search.after:
        found = found.filter((F.col("time") < search.after[0]) | ((F.col("time") == search.after[0]) & (F.col("id") < search.after[1])))
    return found.orderBy(F.desc("time"), F.desc("id")).limit(search.limit)


def run(events: DataFrame, search: Search, schema: Schema | None = None, seconds: float = 30.0) -> tuple[list, Search | None]:
    """The rows of a page and the search for the next one, None after the last.
    A search that takes longer than ``seconds`` is cancelled and refused."""
    sc = events.sparkSession.sparkContext
    group, late = f"search-{threading.get_ident()}-{id(search)}", threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    clock = threading.Timer(seconds, stop)
    sc.setJobGroup(group, "search", interruptOnCancel=True)
    clock.start()
    try:
        rows = page(events, search, schema).collect()
    except Exception as e:
        if late.is_set():
            raise SearchError("the search takes too long") from e
        raise
    finally:
        clock.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    if late.is_set():
        raise SearchError("the search takes too long")
    return rows, replace(search, after=(rows[-1]["time"], rows[-1]["id"])) if len(rows) == search.limit else None


def findings_queue(events: DataFrame, limit: int = PAGE, after: tuple[int, int, int] | None = None) -> DataFrame:
    """Findings by severity, then time, then id, all falling; keyed by all three."""
    found = events.filter("class_uid = 2004")
    if after:
        s, t, i = after
        found = found.filter((F.col("severity_id") < s) | ((F.col("severity_id") == s) & ((F.col("time") < t) | ((F.col("time") == t) & (F.col("id") < i)))))
    return found.orderBy(F.desc("severity_id"), F.desc("time"), F.desc("id")).limit(limit)
