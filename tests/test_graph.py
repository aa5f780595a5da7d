"""Identity resolution, decisions, paths and walks by brute force."""

import collections
import os
import random

import pytest

from ravelin.functions import text as T
from ravelin.operators import graph

STRONG = {"user:sid:s-1-5-21-1": 0, "user:sid:s-1-5-18": 10, "user:uid:6f": 1, "user:email:a@b.c": 2, "user:name:corp\\adam": 3, "user:name:adam@corp": 3, "user:name:adam": 13, "user:name:nt authority\\system": 13, "user:name:.\\admin": 13, "host:uid:i-0": 1, "host:name:ws.corp": 3, "host:name:ws": 13, "host:mac:00:1a:2b": 15, "address:ip:10.0.0.1": 6, "user:local:ws:adam": 4, "file:hash:ff": 6}


def test_strength_and_rank(spark):
    got = {r.i: (r.s, r.r) for r in spark.createDataFrame([(i,) for i in STRONG], "i string").selectExpr("i").select("i", T.identity_strong(graph.F.col("i")).alias("s"), T.identity_rank(graph.F.col("i")).alias("r")).collect()}
    assert got == {i: (r < 10, r) for i, r in STRONG.items()}


FORMS = ("user:uid:u{}", "user:email:e{}@x.y", "user:sid:s-1-5-21-{}", "user:name:n{}", "user:name:corp\\c{}")


def strong(i):
    return ":name:" not in i or "\\" in i or "@" in i


def rank(i):
    return {"uid": 1, "email": 2, "sid": 0, "name": 3}[i.split(":")[1]] + 10 * (not strong(i))


def brute(evidence, same, different, over):
    partners = collections.defaultdict(set)
    for one, other, *_ in evidence:
        for a, b in ((one, other), (other, one)):
            if strong(b) and a != b:
                partners[a, b.split(":")[1]].add(b)
    shared = {a for (a, _), ps in partners.items() if len(ps) > over}
    joins = lambda i: strong(i) and i not in shared
    edges = [(0, 0, a, b, "said", 0, 0, 0) for a, b in sorted(same)]
    edges += sorted((1, -n, a, b, rule, n, f, t) for a, b, rule, n, f, t in evidence if a != b and joins(a) and joins(b))
    group = {i: i for _, _, a, b, *_ in edges for i in (a, b)}
    members = {i: {i} for i in group}
    brought = {}
    for _, _, a, b, rule, n, f, t in edges:
        x, y = group[a], group[b]
        if x == y or any((p in members[x] and q in members[y]) or (q in members[x] and p in members[y]) for p, q in different):
            continue
        for i in members[y]:
            group[i] = x
        members[x] |= members.pop(y)
        for i, j in ((a, b), (b, a)):
            brought.setdefault(i, (j, rule, n, f, t))
    out = set()
    for ms in members.values():
        if len(ms) > 1:
            name = min(ms, key=lambda i: (rank(i), i))
            out |= {(i, name, "member", *((None, "", 0, 0, 0) if i == name else brought[i])) for i in ms}
    out |= {(i, i, "shared", None, "", 0, 0, 0) for i in shared}
    named = {i: min(ms, key=lambda x: (rank(x), x)) for ms in members.values() for i in ms}
    alias = collections.defaultdict(list)
    for a, b, rule, n, f, t in evidence:
        for weak, other in ((a, b), (b, a)):
            if a != b and not strong(weak) and joins(other):
                alias[weak, named.get(other, other)].append((other, rule, n, f, t))
    for (weak, entity), cs in alias.items():
        out.add((weak, entity, "alias", min(cs)[0], min(cs)[1], sum(c[2] for c in cs), min(c[3] for c in cs), max(c[4] for c in cs)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_identities_by_brute_force(spark, seed):
    rng = random.Random(seed)
    some = lambda: rng.choice(FORMS).format(rng.randint(0, 25))
    evidence = {}
    for _ in range(70):
        a, b = some(), some()
        evidence[a, b, rng.choice(["r", "q"])] = (rng.randint(1, 9), rng.randint(0, 50), rng.randint(50, 99))
    rows = [(*k, *v) for k, v in evidence.items()]
    same = {tuple(sorted((f"user:uid:u{i}", f"user:email:e{i}@x.y"))) for i in range(2)} if seed > 1 else set()
    different = {(f"user:uid:u{i}", f"user:sid:s-1-5-21-{j}") for i in range(0, 26, 2) for j in range(0, 26, 3)} if seed > 1 else set()
    df = spark.createDataFrame(rows, "one string, other string, rule string, events long, first_seen long, last_seen long")
    pair = "a string, b string"
    got = graph.resolve_identities(df, spark.createDataFrame(sorted(same), pair) if same else None, spark.createDataFrame(sorted(different), pair) if different else None)
    assert {tuple(r) for r in got.collect()} == brute(rows, same, different, graph.SHARED)


def test_decisions_file():
    same, different = graph.decisions('{"same": [["user:uid:b", "user:uid:a"]], "different": [{"identifiers": ["host:name:x", "host:name:y"], "by": "eva"}]}')
    assert same == [("user:uid:a", "user:uid:b", "")] and different == [("host:name:x", "host:name:y", "eva")]
    for bad in ('{"same": [["a"]]}', '{"same": [["user:uid:a", "user:uid:a"]]}', '{"same": [["user:uid:a", "user:uid:b"]], "different": [["user:uid:b", "user:uid:a"]]}'):
        with pytest.raises(ValueError):
            graph.decisions(bad)


def test_paths_are_ways_through_the_graph(spark):
    rng = random.Random(3)
    rows = {(f"n{rng.randint(0, 30)}", f"n{rng.randint(0, 30)}") for _ in range(40)}
    rows |= {("h", f"n{i}") for i in range(12)}  # a hub, with the limit below
    df = spark.createDataFrame([(a, b, "x", 1, 0, 0) for a, b in sorted(rows)], "src string, dst string, link string, events long, first_seen long, last_seen long")
    near = collections.defaultdict(set)
    for a, b in rows:
        near[a].add(b)
        near[b].add(a)
    for a, b in (("n0", "n17"), ("n3", "n29"), ("h", "n20"), ("n1", "n1"), ("n2", "n30")):
        steps, front, seen = 0, {a}, {a}
        while front and b not in seen and steps < 4:
            front = {y for x in front if len(near[x] - {x}) <= 8 or x in (a, b) for y in near[x]} - seen
            seen |= front
            steps += 1
        path = graph.shortest_path(df, a, b, 4, 8)
        assert (len(path) - 1 if path else None) == (steps if b in seen else None)
        if path:
            assert path[0] == a and path[-1] == b and all(y in near[x] for x, y in zip(path, path[1:], strict=False))
            assert all(len(near[x] - {x}) <= 8 for x in path[1:-1])


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_decided_identities_of_all_orders(spark):
    from ravelin.queries import every, graphs

    rows = [(r.one, r.other, r.rule, r.events, r.first_seen, r.last_seen) for r in graphs._evidence(spark, SF).collect()]
    same = {("user:uid:c1", "user:uid:c30"), ("user:uid:c2", "user:uid:c31")}
    different = {(f"user:uid:c{i}", f"user:uid:c{i + 1}") for i in range(0, 60, 2)}
    assert {tuple(r) for r in every()["identities_decided"][0](spark, SF).collect()} == brute(rows, same, different, graph.SHARED)
