"""The queries over whole tables, where they have no SQL, by brute force on the
smallest tables."""

import os
from collections import defaultdict

import pytest

from ravelin.operators import graph
from ravelin.queries import every, graphs

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def run(spark, name):
    return every()[name][0](spark, SF).collect()


@pytest.fixture(scope="module")
def near(spark):
    """Each node's neighbours and when they were last seen, from all lines."""
    found = defaultdict(dict)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_orderkey").collect():
        for a, b in ((f"s{r[0]}", f"p{r[1]}"), (f"p{r[1]}", f"s{r[0]}")):
            found[a][b] = max(found[a].get(b, -1), r[2])
    return found


def test_edges_are_of_all_lines(spark, near):
    assert {r.node: r.degree for r in run(spark, "graph_degree")} == {x: len(n) for x, n in near.items()}


def test_walk_and_paths(spark, near):
    level, here = {"s5": 0}, ["s5"]
    for n in (1, 2):
        seen = {}
        for x in here:
            if len(near[x]) <= graph.HUB or x == "s5":
                for y, at in near[x].items():
                    if y not in level:
                        seen[y] = max(seen.get(y, -1), at)
        here = sorted(seen, key=lambda y: (-seen[y], y))[: graph.FRONTIER]
        level |= dict.fromkeys(here, n)
    assert {(r.node, r.level) for r in run(spark, "graph_walk")} == set(level.items())
    for r in run(spark, "graph_path"):
        reached, steps, front = {r.a}, None, {r.a}
        for n in range(1, 5):
            front = {y for x in front if len(near[x]) <= graph.HUB or x == r.a for y in near[x]} - reached
            reached |= front
            if r.b in front and steps is None:
                steps = n
        assert r.links == steps


def test_entities_are_of_all_claims(spark):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in graphs._total(spark, SF).collect():
        a, b = root(r.one), root(r.other)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for x in parent}
    assert {r.identifier: r.entity for r in run(spark, "graph_entities")} == want
    (total,) = run(spark, "resolution_summary")
    assert (total.entities, total.identifiers, total.names) == (len(set(want.values())), len(want), len(set(want.values())))
    assert sum(r.identifiers for r in run(spark, "graph_entity")) == len(want)
    assert {r.identifier: r.entity for r in run(spark, "graph_entities_cannot_link")} == greedy(graphs._total(spark, SF).collect(), (("c0", "c1"), ("c6", "c7"), ("c12", "c13")))


def greedy(claims, apart):
    """Claims joined from the most seen to the least, but never the two of a pair."""
    group = {x: {x} for r in claims for x in (r.one, r.other)}
    for r in sorted(claims, key=lambda r: (-r.events, r.one, r.other)):
        a, b = group[r.one], group[r.other]
        if a is not b and not any(p in a and q in b or p in b and q in a for p, q in apart):
            a |= b
            for x in b:
                group[x] = a
    return {x: min(g) for x, g in group.items()}


def test_every_event_is_framed_and_asks(spark):
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert sum(r.records for r in run(spark, "frame_audit")) == n
    assert len({r.id for r in run(spark, "enrich_groups")}) > 0.9 * n
