"""Many rules over one scan, without evaluating every rule on every event.

Rules are taken apart into atoms: one test of one column. An atom is judged per
*distinct* value of its column within a batch, never per event: texts go once
through an automaton of all literals of the rule set, numbers through one
binary search among all thresholds, and what is found is remembered. The atoms
that hold of a value are its signature, and equal rows of signatures match the
same rules, so rules are tried once for each distinct row of signatures; and
then only those that it announces: every rule names atoms of which one must
hold (an equality, a literal, its class), the rarest ones that the first batch
shows. Costs grow with the distinct values and with the hits, not with events
times rules.

Values reach the worker as one struct column in Arrow batches. Tests that
compare columns, and gates given as Columns, are judged in the JVM.

Nulls: a null value makes every test of it false, so that only its negation and
the null test hold. NaN compares as no number.
"""

from __future__ import annotations

import ipaddress
import re
import uuid
from collections import OrderedDict, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions import text as T

#: Values and rows of signatures that a worker remembers.
REMEMBERED = 200_000
NUMBER_TESTS = frozenset(["number", "lt", "lte", "gt", "gte"])


# Trees of atoms


def _fixed(parts) -> list[str]:
    return [p for p in parts if p is not None and p != "\0"]


def _weight(test: tuple) -> float:
    """How rare an atom is likely to be where no event has shown it."""
    if test[0] == "text":
        longest = max(map(len, _fixed(test[1])), default=0)
        return longest + 4 * (None not in test[1])
    return {"cidr": 3.0, "number": 2.0, "re": 1.5, "held": 0.1}.get(test[0], 0.5)


@dataclass
class Matcher:
    """What travels to the workers: no Columns in it."""

    #: (place of the input, test) of each atom.
    atoms: list[tuple[int, tuple]] = field(default_factory=list)
    #: How each input is read: text, number, flag, or a list of one of these.
    forms: list[str] = field(default_factory=list)
    trees: list[tuple] = field(default_factory=list)
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def prepare(self) -> Matcher:
        own: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
        for i, (place, test) in enumerate(self.atoms):
            own[place].append((i, test))
        self.judges = [_Judge(form, own[place]) for place, form in enumerate(self.forms)]
        self.planned = False
        return self

    def plan(self, seen: list[np.ndarray], own: list[list[frozenset]]) -> None:
        """Choose what announces each rule, by how often its atoms hold in the
        first batch: that says nothing about what matches, only what is tried."""
        n = max(1, len(seen[0]))
        often = np.zeros(len(self.atoms))
        for at, signatures in zip(seen, own, strict=True):
            for k, times in enumerate(np.bincount(at, minlength=len(signatures)).tolist()):
                if times:
                    often[list(signatures[k])] += times
        cost = {i: (share, -_weight(self.atoms[i][1])) for i, share in enumerate((often / n).tolist())}

        def announced(tree) -> tuple[tuple[float, float], frozenset] | None:
            """Atoms of which one holds wherever the tree does, if there are any."""
            kind, arg = tree
            if kind == "atom":
                return cost[arg], frozenset([arg])
            if kind == "and":
                return min((x for x in map(announced, arg) if x), key=lambda x: x[0], default=None)
            if kind == "or":
                every = [announced(t) for t in arg]
                if all(every):
                    return (sum(x[0][0] for x in every), max((x[0][1] for x in every), default=0.0)), frozenset().union(*(x[1] for x in every))
            return None

        def source(tree) -> str:
            """The tree as an expression over a row of signatures."""
            kind, arg = tree
            if kind == "atom":
                return f"{arg} in r[{self.atoms[arg][0]}]"
            if kind == "not":
                return f"(not {source(arg)})"
            if not arg:
                return str(kind == "and")
            # the atoms that decide soonest come first
            order = sorted(arg, key=lambda t: (announced(t) or ((1.0, 0.0),))[0], reverse=kind == "or")
            return "(" + f" {kind} ".join(map(source, order)) + ")"

        self.index: dict[int, list[int]] = defaultdict(list)
        self.always: list[int] = []
        for no, tree in enumerate(self.trees):
            found = announced(tree)
            if found is None:
                self.always.append(no)
            for atom in found[1] if found else ():
                self.index[atom].append(no)
        self.passes = [eval(f"lambda r: {source(t)}") for t in self.trees]  # noqa: S307 - made of numbers only
        leading = {self.atoms[a][0] for a in self.index}
        self.leading = sorted(leading)
        self.announces: dict[frozenset, tuple[int, ...]] = {}
        self.planned = True

    def tried(self, signature: frozenset) -> tuple[int, ...]:
        found = self.announces.get(signature)
        if found is None:
            if len(self.announces) >= REMEMBERED:
                self.announces.clear()
            found = self.announces[signature] = tuple({no for a in signature if a in self.index for no in self.index[a]})
        return found

    def match(self, values: pa.StructArray) -> pa.Array:
        if not len(values):
            return pa.array([], pa.list_(pa.int32()))
        code = np.zeros(len(values), np.int64)
        seen, own = [], []
        for place, judge in enumerate(self.judges):
            at, signatures = judge.signatures(values.field(place))
            code = np.unique(code * len(signatures) + at, return_inverse=True)[1].reshape(-1)
            seen.append(at)
            own.append(signatures)
        if not self.planned:
            self.plan(seen, own)
        _, first, back = np.unique(code, return_index=True, return_inverse=True)
        announced = [[self.tried(x) for x in own[p]] if p in self.leading else None for p in range(len(own))]
        places, passes, always = self.leading, self.passes, self.always
        rows = []
        for at in np.stack([x[first] for x in seen], axis=1).tolist():
            r = [signatures[k] for signatures, k in zip(own, at, strict=True)]
            tried = set(always)
            for p in places:
                tried.update(announced[p][at[p]])
            rows.append([no for no in sorted(tried) if passes[no](r)])
        return pa.array(rows, pa.list_(pa.int32())).take(pa.array(back.reshape(-1)))


class _Judge:
    """All atoms of one input."""

    def __init__(self, form: str, atoms: list[tuple[int, tuple]]):
        self.form, self.listed = form.removeprefix("list:"), form.startswith("list:")
        self.held = frozenset(i for i, t in atoms if t[0] == "held")
        self.known: dict = {}
        if self.form == "number":
            self.numbers = atoms = [(i, t) for i, t in atoms if t[0] in NUMBER_TESTS]
            self.steps = np.unique(np.array([float(t[1]) for _, t in atoms], np.float64))
            self.by_step: dict[int, frozenset] = {}
        elif self.form == "text":
            self._texts(atoms)

    def _texts(self, atoms) -> None:
        import ahocorasick

        #: By case: literals in the automaton, whole values, and tests that no literal announces.
        self.equal = ({}, {})
        self.checks = ([], [])
        needles: tuple[dict, dict] = ({}, {})
        for i, test in atoms:
            kind = test[0]
            if kind == "text":
                parts, cased = list(test[1]), int(test[2])
                if not cased:
                    parts = [p if p is None or p == "\0" else T.fold_text(p) for p in parts]
                plain = _fixed(parts)
                if None not in parts and "\0" not in parts:
                    self.equal[cased].setdefault("".join(plain), []).append(i)
                elif not plain:
                    self.checks[cased].append((i, _whole(parts)))
                else:
                    simple = len(plain) == 1 and "\0" not in parts
                    how = ("in" if parts[0] is None and parts[-1] is None else "head" if parts[-1] is None else "tail") if simple else _whole(parts)
                    needles[cased].setdefault(max(plain, key=len), []).append((i, how))
            elif kind == "re":
                flags = sum({"i": re.I, "m": re.M, "s": re.S}[f] for f in test[2])
                self.checks[1].append((i, re.compile(test[1], flags).search))
            elif kind == "bool":
                self.checks[1].append((i, lambda v, want="true" if test[1] else "false": v.lower() == want))
        self.networks = [(i, t[1]) for i, t in atoms if t[0] == "cidr"]
        self.automata = []
        for found in needles:
            automaton = ahocorasick.Automaton() if found else None
            for needle, uses in found.items():
                automaton.add_word(needle, (len(needle), uses))
            if automaton is not None:
                automaton.make_automaton()
            self.automata.append(automaton)

    def of_text(self, value: str) -> frozenset:
        found = self.known.get(value)
        if found is not None:
            return found
        true = set(self.held)
        folded = value.lower() if value.isascii() else T.fold_text(value)
        for cased, text in ((0, folded), (1, value)):
            true.update(self.equal[cased].get(text, ()))
            for i, passes in self.checks[cased]:
                if passes(text):
                    true.add(i)
            if self.automata[cased] is not None:
                last = len(text) - 1
                for end, (n, uses) in self.automata[cased].iter(text):
                    for i, how in uses:
                        if i not in true and (how == "in" or (end + 1 == n if how == "head" else end == last if how == "tail" else how(text))):
                            true.add(i)
        if self.networks:
            try:
                address = ipaddress.ip_address(value)
                true.update(i for i, net in self.networks if address.version == net.version and address in net)
            except ValueError:
                pass
        found = frozenset(true)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[value] = found
        return found

    def of_step(self, step: int) -> frozenset:
        """Of all numbers in one gap between thresholds (even) or on one (odd)."""
        if step not in self.by_step:
            at, on = divmod(step, 2)
            low = self.steps[at - 1] if at else -np.inf

            def passes(kind: str, x: float) -> bool:
                if on:
                    v = self.steps[at]
                    return {"number": v == x, "lt": v < x, "lte": v <= x, "gt": v > x, "gte": v >= x}[kind]
                return kind in ("gt", "gte") and x <= low or kind in ("lt", "lte") and x > low

            self.by_step[step] = self.held | {i for i, t in self.numbers if passes(t[0], float(t[1]))}
        return self.by_step[step]

    def _scalars(self, values: pa.Array) -> tuple[np.ndarray, list[frozenset]]:
        if self.form == "number":
            v = values.to_numpy(zero_copy_only=False).astype(np.float64)
            null = np.asarray(values.is_null())
            at = np.searchsorted(self.steps, v, side="left")
            on = (self.steps[np.minimum(at, len(self.steps) - 1)] == v) if len(self.steps) else np.zeros(len(v), bool)
            step, back = np.unique(np.where(null, -1, np.where(np.isnan(v), -2, 2 * at + on)), return_inverse=True)
            return back.reshape(-1), [self.of_step(s) if s >= 0 else self.held if s == -2 else frozenset() for s in step.tolist()]
        if self.form == "flag":
            return np.asarray(values.fill_null(False)).astype(np.int64), [frozenset(), self.held]
        coded = values.dictionary_encode()
        own = [frozenset() if v is None else self.of_text(v) for v in coded.dictionary.to_pylist()]
        return coded.indices.fill_null(len(own)).to_numpy(zero_copy_only=False).astype(np.int64), [*own, frozenset()]

    def signatures(self, values: pa.Array) -> tuple[np.ndarray, list[frozenset]]:
        """(place, signatures): the signature of each row, by its place."""
        if not self.listed:
            return self._scalars(values)
        seen, own = self._scalars(values.flatten())
        sizes = np.asarray(values.value_lengths().fill_null(0))
        ends = np.cumsum(sizes)
        rows: OrderedDict[frozenset, int] = OrderedDict()
        out = np.empty(len(values), np.int64)
        for k, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
            out[k] = rows.setdefault(frozenset().union(*(own[x] for x in seen[a:b])), len(rows))
        return out, list(rows) or [frozenset()]


def _whole(parts):
    return re.compile("(?s)" + "".join(".*" if p is None else "." if p == "\0" else re.escape(p) for p in parts)).fullmatch


# Building


class Builder:
    """Rules to atoms, and the inputs that these read."""

    def __init__(self, types: dict[str, str]):
        self.types, self.matcher = types, Matcher()
        self.inputs: list[Column] = []
        self.places: dict = {}
        self.known: dict = {}

    def _input(self, key, form: str, make) -> int:
        if key not in self.places:
            self.places[key] = len(self.inputs)
            self.inputs.append(make())
            self.matcher.forms.append(form)
        return self.places[key]

    def _atom(self, place: int, test: tuple) -> tuple:
        key = (place, test)
        if key not in self.known:
            self.known[key] = len(self.matcher.atoms)
            self.matcher.atoms.append(key)
        return ("atom", self.known[key])

    def flag(self, key, column: Column, gate: bool = False) -> tuple:
        """A test that the JVM judges."""
        place = self._input(("flag", key), "flag", lambda: F.coalesce(column, F.lit(False)))
        self.matcher.forms[place] = "flag"
        return self._atom(place, ("held", gate))

    def test(self, fields, column: str, test: tuple) -> tuple:
        listed = column in fields.arrays
        number = test[0] in NUMBER_TESTS
        native = self.types.get(column) in ("tinyint", "smallint", "int", "bigint", "float", "double")
        if test[0] == "held":  # a text that is no number is there all the same
            number = native and not listed
        to_number = (lambda c: F.trim(c.cast("string")).try_cast("double")) if number else (lambda c: c.cast("string"))
        if number and native:
            to_number = lambda c: c.cast("double")
        form = "number" if number else "text"
        make = (lambda: F.transform(F.col(column), to_number)) if listed else (lambda: to_number(F.col(column)))
        return self._atom(self._input((form, column), f"list:{form}" if listed else form, make), test)

    def gate(self, column: str, uid: int) -> tuple:
        place = self._input(("number", column), "number", lambda: F.col(column).cast("double"))
        return self._atom(place, ("number", float(uid)))

    def udf(self):
        sent = self.matcher

        @F.arrow_udf("array<int>")
        def rules(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = _ready(sent)
            for values in batches:
                yield own.match(values)

        return rules(F.struct(*[c.alias(f"i{k}") for k, c in enumerate(self.inputs)]))


_READY: OrderedDict[str, Matcher] = OrderedDict()


def _ready(sent: Matcher) -> Matcher:
    """The matcher with its automata, made once a worker."""
    if sent.token not in _READY:
        while len(_READY) >= 4:
            _READY.popitem(last=False)
        _READY[sent.token] = sent.prepare()
    return _READY[sent.token]


def matched(events: DataFrame, builder: Builder, name: str) -> DataFrame:
    if not builder.matcher.trees:
        return events.withColumn(name, F.array().cast("array<int>"))
    if not builder.inputs:
        builder.inputs.append(F.lit(True))
        builder.matcher.forms.append("flag")
    return events.withColumn(name, builder.udf())
