"""Compiled rules against the reference evaluator, and refusals."""

import random

import pytest
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.plans import sigma as S

FIELDS = S.Fields({"a": ["a"], "b": ["b"], "n": ["n"], "ab": ["a", "b"], "list": ["list"], "ip": ["ip"], "flag": ["flag"]}, ["a", "b"], frozenset(["list"]))
LETTERS = ["a", "b", "A", "ß", "*", "?", "\\"]


def make(rng):
    def text():
        return "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 4)))

    def predicate():
        kind = rng.randint(0, 11)
        if kind < 4:
            return rng.choice(["a", "b", "ab", "list"]) + rng.choice(["", "|contains", "|startswith", "|endswith", "|cased", "|contains|all"]), [text() for _ in range(rng.randint(1, 2))]
        if kind == 4:
            return "n|" + rng.choice(["lt", "lte", "gt", "gte"]), rng.randint(-2, 3)
        if kind == 5:
            return rng.choice(["a", "n"]) + "|exists", rng.choice([True, False])
        if kind == 6:
            return rng.choice(["a", "b", "n"]), None
        if kind == 7:
            return rng.choice(["a", "b", "list"]) + rng.choice(["|re", "|re|i"]), rng.choice(["a+b", "^[ab]*$", "ß|B"])
        if kind == 8:
            return "a|fieldref", "b"
        if kind == 9:
            return "ip|cidr", [rng.choice(["10.0.0.0/8", "10.1.0.0/16", "2001:db8::/32"]) for _ in range(2)]
        if kind == 10:
            return "flag", rng.choice([True, False])
        return "n", rng.randint(-2, 3)

    detection = {f"s{i}": dict(predicate() for _ in range(rng.randint(1, 2))) for i in range(2)}
    detection["k"] = [text() or "a"]
    detection["condition"] = rng.choice(["s0", "s0 and not s1", "1 of s*", "all of them", "not (s0 or k)", "k and s1 or s0"])
    return {"title": "t", "logsource": {}, "detection": detection}


def test_no_rules_and_no_events(spark):
    df = spark.createDataFrame([("x", None)], "a string, n long")
    assert [r.rules for r in S.match_all(df, []).collect()] == [[]]
    rule = S.load({"detection": {"s": {"a": "x"}, "condition": "s"}})
    assert [r.rules for r in S.match_all(df.limit(0), [(rule, FIELDS, None)]).collect()] == []
    assert [r.rules for r in S.match_all(df, [(rule, FIELDS, None)]).collect()] == [[0]]


def test_values_that_are_no_numbers_are_there(spark):
    rows = [(0, "abc", float("nan"), ["x", None]), (1, "7", 7.0, ["7"]), (2, None, None, []), (3, " 8 ", -1.0, None)]
    df = spark.createDataFrame(rows, "i int, t string, d double, l array<string>")
    fields = S.Fields({"t": ["t"], "d": ["d"], "l": ["l"]}, [], frozenset(["l"]))
    detections = [{f"{c}|gte": 5} for c in "tdl"] + [{f"{c}|exists": True} for c in "tdl"] + [{c: None} for c in "tdl"] + [{"t": 7}, {"d|lt": 0}]
    rules = [S.load({"detection": {"s": d, "condition": "s"}}) for d in detections]
    found = {r.i: r.rules for r in S.match_all(df, [(r, fields, None) for r in rules]).collect()}
    single = {r.i: [k for k, x in enumerate(list(r)[1:]) if x] for r in df.select("i", *[S.compile_rule(r, fields).alias(f"r{k}") for k, r in enumerate(rules)]).collect()}
    assert found == single == {0: [3, 4, 5], 1: [0, 1, 2, 3, 4, 5, 9], 2: [6, 7, 8], 3: [0, 3, 4, 8, 10]}


def test_compiled_rules_agree_with_the_reference(spark):
    rng = random.Random(5)
    word = lambda: None if rng.random() < 0.2 else "".join(rng.choice(["a", "b", "A", "ß", "*"]) for _ in range(rng.randint(0, 4)))
    events = [{"i": i, "a": word(), "b": word(), "n": rng.choice([None, -1, 0, 2]), "list": rng.choice([None, [], ["a"], ["b", "Ab"]]), "ip": rng.choice([None, "10.1.2.3", "10.2.0.0", "2001:db8::1", "x"]), "flag": rng.choice([None, True, False]), "class_uid": rng.choice([None, 1, 2])} for i in range(80)]
    df = spark.createDataFrame([tuple(e.values()) for e in events], "i int, a string, b string, n long, list array<string>, ip string, flag boolean, class_uid int")
    rules = [S.load(make(rng)) for _ in range(160)]
    found = {r.i: list(r.rules) for r in S.match_all(df, [(r, FIELDS, None) for r in rules]).collect()}
    classes = [(None, 1, 2)[k % 3] for k in range(len(rules))]
    gated = {r.i: list(r.own) for r in S.match_all(df, [(r, FIELDS, F.col("class_uid") == c if c == 2 else c) for r, c in zip(rules, classes, strict=True)], "own").collect()}
    single = {r.i: list(r) for r in df.select("i", *[S.compile_rule(r, FIELDS).alias(f"r{k}") for k, r in enumerate(rules)]).collect()}
    for e in events:
        want = [k for k, r in enumerate(rules) if S.matches_event(r, e, FIELDS)]
        assert found[e["i"]] == want
        assert gated[e["i"]] == [k for k in want if classes[k] is None or classes[k] == e["class_uid"]]
        assert [k for k, x in enumerate(single[e["i"]][1:]) if x] == want


@pytest.mark.parametrize(
    "detection",
    [
        {"s": {"a": 1}},
        {"s": {"a": 1}, "condition": "s |count() > 3"},
        {"s": {"a": 1}, "condition": "t"},
        {"s": {"a": 1}, "condition": "(s"},
        {"s": {"a": 1}, "condition": "1 of x*"},
        {"s": {"a|odd": 1}, "condition": "s"},
        {"s": {"a|expand": "%x%"}, "condition": "s"},
        {"s": {"a|base64offset": "x"}, "condition": "s"},
        {"s": {"a|wide": "x"}, "condition": "s"},
    ],
)
def test_refused(detection):
    with pytest.raises(S.RuleError):
        S.load({"detection": detection})


@pytest.mark.parametrize("expression", [r"(?=a)", r"(?<!a)b", r"(a)\1", "a++", "("])
def test_refused_expressions(expression):
    with pytest.raises(S.RuleError):
        S.check_regex(expression)


def test_an_unmapped_field_refuses_the_rule(spark):
    with pytest.raises(S.RuleError):
        S.compile_rule(S.load({"detection": {"s": {"zzz": 1}, "condition": "s"}}), FIELDS)


def test_mapping_selection():
    maps = [{"logsource": {"product": "x"}}, {"logsource": {"product": "x", "service": "y"}}]
    assert S.select_mapping({"product": "x", "service": "y"}, maps) is maps[1]
    with pytest.raises(S.RuleError):
        S.select_mapping({"product": "z"}, maps)


def test_modifier_constants():
    import base64

    for pad in range(3):
        encoded = base64.b64encode(b"x" * pad + b"secret" + b"yy").decode()
        assert any(t in encoded for t in T.base64_offsets(b"secret"))
    assert set(T.windash("-a")) == {d + "a" for d in T.DASHES}
    assert T.fold_text("ẞÄ") == "ßä" and T.fold_text("İ") == "İ"


def test_yaml_rules_refuse_repeated_keys():
    pytest.importorskip("yaml")
    assert S.load("detection:\n  s:\n    a|contains: x\n  condition: s\n").searches
    with pytest.raises(S.RuleError):
        S.load("detection:\n  s: [x]\n  s: [y]\n  condition: s\n")
