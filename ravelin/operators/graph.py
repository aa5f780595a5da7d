"""Entity graph: links and claims, totals, neighbours, resolution, bounded
walks and shortest paths.

Edges are plain frames (src, link, dst, hour, events, first_seen, last_seen).
Walks and paths are loops over a fixed number of levels; the frontier of a
level is bounded by a parameter, and hubs are not expanded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.operators.lineage import cut

HUB = 100
FRONTIER = 200
ROWS = 5000
SHARED = 3


def links(rows: DataFrame, hour_ms: int = 3_600_000) -> DataFrame:
    """(src, link, dst, hour) with counts and first and last place; a link to
    itself is none. ``rows`` has src, link, dst, time, id."""
    place = F.struct("time", "id")
    return rows.filter("src <> dst").groupBy("src", "link", "dst", F.floor(F.col("time") / hour_ms).cast("bigint").alias("hour")).agg(F.count("*").alias("events"), F.min(place).alias("first_seen"), F.max(place).alias("last_seen"))


def claims(rows: DataFrame, day_ms: int = 86_400_000) -> DataFrame:
    """(one, other, rule, day) with the count and the first and last time."""
    return rows.filter("one <> other").groupBy("one", "other", "rule", F.floor(F.col("time") / day_ms).cast("bigint").alias("day")).agg(F.count("*").alias("events"), F.min("time").alias("first_seen"), F.max("time").alias("last_seen"))


def claims_total(daily: DataFrame) -> DataFrame:
    return daily.groupBy("one", "other", "rule").agg(F.sum("events").alias("events"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge seen from both of its ends."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "link", F.lit("out").alias("direction"), "events", "first_seen", "last_seen")
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "link", F.lit("in").alias("direction"), "events", "first_seen", "last_seen")
    return out.unionByName(back)


def degree(edges: DataFrame) -> DataFrame:
    """Exact number of distinct neighbours."""
    return both_ways(edges).groupBy("node").agg(F.countDistinct("other").alias("degree"))


def neighbours(edges: DataFrame, members: DataFrame, nodes: list[str], limit: int = FRONTIER, seen_from=None, seen_to=None) -> DataFrame:
    """Neighbours of named nodes, by the entity that holds them where one does:
    summed over time, the last seen first. With a time range, links seen in it:
    not last seen before ``seen_from`` nor first seen from ``seen_to`` on."""
    if seen_from is not None:
        edges = edges.filter(F.col("last_seen") >= seen_from)
    if seen_to is not None:
        edges = edges.filter(F.col("first_seen") < seen_to)
    near = both_ways(edges).filter(F.col("node").isin(nodes) & ~F.col("other").isin(nodes)).join(members, F.col("other") == F.col("identifier"), "left")
    per = near.groupBy(F.coalesce("entity", "other").alias("neighbour"), "direction", "link").agg(F.sum("events").alias("events"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return per.orderBy(F.desc("last_seen"), "neighbour", "direction", "link").limit(limit)


def shared(total: DataFrame, most: int = SHARED) -> DataFrame:
    """Identifiers with more distinct strong partners of one form than a person
    has; they join nothing. Claims carry form_one and form_other."""
    each = total.select(F.col("one").alias("id"), F.col("other").alias("partner"), F.col("form_other").alias("form")).unionByName(total.select(F.col("other").alias("id"), F.col("one").alias("partner"), F.col("form_one").alias("form")))
    return each.groupBy("id", "form").agg(F.countDistinct("partner").alias("partners")).filter(F.col("partners") > most).select("id").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, entity): the smallest node that links reach, by alternating star
    contraction; each round's edges are checkpointed in the shared folder."""
    now = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    seen = None
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(least, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        least = big.groupBy("b").agg(F.min("a").alias("m"))
        small = big.join(least, "b")
        now = cut(small.select(F.least("a", "m").alias("a"), F.greatest("a", "m").alias("b")).unionByName(small.select(F.col("m").alias("a"), "b")).filter("a <> b").distinct())
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64(F.lit(1), "b", "a"))).first()
        if mark == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("entity"))
        seen = mark
    raise RuntimeError("components did not settle")


def _greedy(edges, apart):
    """Join the ends of edges in order, but never the two sides of a pair that
    is apart: (root of each node, edges that were refused). Each root keeps the
    roots that it may not meet, and the smaller side moves."""
    parent: dict = {}
    held: dict = {}
    size: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in apart:
        held.setdefault(root(a), set()).add(root(b))
        held.setdefault(root(b), set()).add(root(a))
    refused = 0
    for a, b in edges:
        x, y = root(a), root(b)
        if x == y:
            continue
        if y in held.get(x, ()):
            refused += 1
            continue
        if size.get(x, 1) < size.get(y, 1):
            x, y = y, x
        parent[y] = x
        size[x] = size.get(x, 1) + size.get(y, 1)
        for z in held.pop(y, ()):
            held[z].discard(y)
            held[z].add(x)
            held.setdefault(x, set()).add(z)
    return {n: root(n) for n in list(parent)}, refused


def resolve(total: DataFrame, decided: DataFrame | None = None, different: DataFrame | None = None) -> DataFrame:
    """(identifier, entity) by greedy joining in order of ``same`` decisions,
    then claims by falling count; an entity is named by its least identifier.
    Without cannot-link pairs, order does not matter and components say it all;
    with them, only components that hold such a pair are joined step by step,
    each in a task of its own."""
    edges = total.select(F.col("one").alias("a"), F.col("other").alias("b"))
    if decided is not None:
        edges = edges.unionByName(decided.select("a", "b"))
    found = components(edges)
    nodes = found.unionByName(found.select(F.col("entity").alias("node"), "entity").distinct()).distinct()
    if different is None:
        return nodes.select(F.col("node").alias("identifier"), "entity")
    d = different.join(nodes.select(F.col("node").alias("a"), F.col("entity").alias("ea")), "a").join(nodes.select(F.col("node").alias("b"), F.col("entity").alias("eb")), "b").filter("ea = eb")
    tense = d.select(F.col("ea").alias("entity")).distinct()
    calm = nodes.join(tense, "entity", "left_anti").select(F.col("node").alias("identifier"), "entity")
    weighted = total.select(F.col("one").alias("a"), F.col("other").alias("b"), F.col("events").cast("double").alias("w"), F.lit("claim").alias("kind"))
    if decided is not None:
        weighted = weighted.unionByName(decided.select("a", "b", F.lit(float("inf")).alias("w"), F.lit("same").alias("kind")))
    weighted = weighted.unionByName(d.select("a", "b", F.lit(0.0).alias("w"), F.lit("different").alias("kind")))
    hard = weighted.join(nodes.select(F.col("node").alias("a"), "entity"), "a").join(tense, "entity", "left_semi")

    def greedy(pdf):
        import pandas as pd

        apart = pdf.loc[pdf.kind == "different", ["a", "b"]].itertuples(index=False, name=None)
        order = pdf[pdf.kind != "different"].assign(first=lambda t: t.kind != "same").sort_values(["first", "w", "a", "b"], ascending=[True, False, True, True])
        of, _ = _greedy(order[["a", "b"]].itertuples(index=False, name=None), apart)
        names: dict = {}
        for n, r in of.items():
            names[r] = min(names.get(r, n), n)
        return pd.DataFrame({"identifier": list(of), "entity": [names[r] for r in of.values()]})

    kind = dict(nodes.dtypes)["node"]
    return calm.unionByName(hard.groupBy("entity").applyInPandas(greedy, f"identifier {kind}, entity {kind}"))


RESOLVED = "identifier string, entity string, standing string, with string, rule string, events bigint, first_seen bigint, last_seen bigint"


def resolve_identities(evidence: DataFrame, same: DataFrame | None = None, different: DataFrame | None = None, shared_over: int = SHARED) -> DataFrame:
    """Which identifiers (texts ``kind:form:value``) are one entity: a row an
    identifier and entity (``RESOLVED``), with the standing ``member``,
    ``alias`` or ``shared``.

    Two strong identifiers in one claim are one entity; nothing else joins but
    ``same`` decisions (a, b). An identifier claimed with more than
    ``shared_over`` strong ones of one form is shared and joins nothing; a weak
    one is an alias of each entity it was claimed with. A claim that would join
    the sides of a ``different`` pair is not followed: decisions come first, then
    claims by falling count. An entity is named by its strongest identifier,
    which has no ``with``; another member has the claim that brought it in, the
    first followed that names it. Entities of one identifier are left out."""
    claims = evidence.filter("one <> other").select("one", "other", "rule", "events", "first_seen", "last_seen")
    form = lambda c: F.split_part(c, F.lit(":"), F.lit(2))
    strong = lambda c: T.identity_strong(F.col(c))
    each = claims.select(F.col("one").alias("id"), F.col("other").alias("partner")).unionByName(claims.select(F.col("other").alias("id"), F.col("one").alias("partner"))).filter(strong("partner"))
    spread = cut(each.groupBy("id", form(F.col("partner")).alias("form")).agg(F.countDistinct("partner").alias("n")).filter(F.col("n") > shared_over).select("id").distinct())
    good = claims.filter(strong("one") & strong("other"))
    for c in ("one", "other"):
        good = good.join(spread.select(F.col("id").alias(c)), c, "left_anti")
    good = good.withColumn("said", F.lit(False))
    if same is not None:
        good = good.unionByName(same.select(F.col("a").alias("one"), F.col("b").alias("other"), F.lit("said").alias("rule"), *[F.lit(0).cast("bigint").alias(c) for c in ("events", "first_seen", "last_seen")], F.lit(True).alias("said")))
    good = cut(good)
    plain = components(good.select(F.col("one").alias("a"), F.col("other").alias("b")))
    nodes = cut(plain.unionByName(plain.select(F.col("entity").alias("node"), "entity").distinct()).distinct())
    # of each identifier, the claim that comes first
    order = F.struct((~F.col("said")).alias("claim"), (-F.col("events")).alias("rank"), "one", "other", "rule")
    row = F.struct(order.alias("order"), "one", "other", "rule", "events", "first_seen", "last_seen")

    def first_claims(edges: DataFrame) -> DataFrame:
        ends = edges.select(F.col("one").alias("identifier"), row.alias("r")).unionByName(edges.select(F.col("other").alias("identifier"), row.alias("r")))
        return ends.groupBy("identifier").agg(F.min("r").alias("r"))

    of = nodes.select(F.col("node").alias("identifier"), F.col("entity").alias("group"))
    followed = good
    if different is not None:
        d = different.join(of.select(F.col("identifier").alias("a"), F.col("group").alias("ga")), "a").join(of.select(F.col("identifier").alias("b"), F.col("group").alias("gb")), "b").filter("ga = gb")
        tense = cut(d.select(F.col("ga").alias("group")).distinct())
        inside = good.join(of.select(F.col("identifier").alias("one"), "group"), "one")
        pairs = d.select(F.col("a").alias("one"), F.col("b").alias("other"), F.lit(None).cast("string").alias("rule"), *[F.lit(0).cast("bigint").alias(c) for c in ("events", "first_seen", "last_seen")], F.lit(False).alias("said"), F.col("ga").alias("group"))
        hard = inside.join(tense, "group", "left_semi").unionByName(pairs)

        def step(pdf):
            import pandas as pd

            apart = pdf.loc[pdf.rule.isna(), ["one", "other"]].itertuples(index=False, name=None)
            order_ = pdf[pdf.rule.notna()].assign(claim=lambda t: ~t.said, rank=lambda t: -t.events).sort_values(["claim", "rank", "one", "other", "rule"])
            roots, _ = _greedy(order_[["one", "other"]].itertuples(index=False, name=None), apart)
            names: dict = {}
            for n, r in roots.items():
                names[r] = min(names.get(r, n), n)
            return pd.DataFrame({"identifier": list(roots), "part": [names[r] for r in roots.values()]})

        parts = cut(hard.groupBy("group").applyInPandas(step, "identifier string, part string"))
        calm = of.join(tense, "group", "left_anti")
        of = cut(calm.select("identifier", "group").unionByName(parts.select("identifier", F.col("part").alias("group"))))
        # a claim between two parts was not followed
        followed = good.join(of.select(F.col("identifier").alias("one"), F.col("group").alias("g1")), "one").join(of.select(F.col("identifier").alias("other"), F.col("group").alias("g2")), "other").filter("g1 = g2").drop("g1", "g2")
    sized = of.join(of.groupBy("group").agg(F.count("*").alias("n"), F.min(F.struct(T.identity_rank(F.col("identifier")).alias("rank"), "identifier"))["identifier"].alias("entity")), "group")
    own = F.col("identifier") == F.col("entity")
    members = sized.filter("n > 1").join(first_claims(followed), "identifier").select(
        "identifier",
        "entity",
        F.lit("member").alias("standing"),
        F.when(~own, F.when(F.col("r.one") == F.col("identifier"), F.col("r.other")).otherwise(F.col("r.one"))).alias("with"),
        F.when(own, "").otherwise(F.col("r.rule")).alias("rule"),
        *[F.when(own, 0).otherwise(F.col(f"r.{c}")).cast("bigint").alias(c) for c in ("events", "first_seen", "last_seen")],
    )
    nothing = [F.lit(0).cast("bigint").alias(c) for c in ("events", "first_seen", "last_seen")]
    shared_rows = spread.select(F.col("id").alias("identifier"), F.col("id").alias("entity"), F.lit("shared").alias("standing"), F.lit(None).cast("string").alias("with"), F.lit("").alias("rule"), *nothing)
    both = claims.select(F.col("one").alias("weak"), F.col("other").alias("strong"), "rule", "events", "first_seen", "last_seen").unionByName(claims.select(F.col("other").alias("weak"), F.col("one").alias("strong"), "rule", "events", "first_seen", "last_seen"))
    tied = both.filter(~strong("weak") & strong("strong")).join(spread.select(F.col("id").alias("strong")), "strong", "left_anti").join(sized.select(F.col("identifier").alias("strong"), "entity"), "strong", "left").withColumn("entity", F.coalesce("entity", "strong"))
    first = F.min(F.struct("strong", "rule", "events"))  # of several claims the first by its identifier
    alias_rows = tied.groupBy("weak", "entity").agg(first.alias("f"), F.sum("events").cast("bigint").alias("events"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")).select(F.col("weak").alias("identifier"), "entity", F.lit("alias").alias("standing"), F.col("f.strong").alias("with"), F.col("f.rule").alias("rule"), "events", "first_seen", "last_seen")
    return members.unionByName(shared_rows).unionByName(alias_rows)


def decisions(text: str) -> tuple[list[tuple], list[tuple]]:
    """(same, different) pairs of a decisions file: JSON or YAML with lists
    ``same`` and ``different`` of pairs of identifiers, and who decided (``by``)."""
    import json

    try:
        read = json.loads(text)
    except ValueError:
        import yaml

        read = yaml.safe_load(text)
    out: list[list[tuple]] = []
    for kind in ("same", "different"):
        rows = []
        for x in (read or {}).get(kind) or []:
            pair, by = (x["identifiers"], x.get("by", "")) if isinstance(x, dict) else (x, "")
            if len(pair) != 2 or pair[0] == pair[1] or any(str(p).count(":") < 2 for p in pair):
                raise ValueError(f"{x!r} is no pair of identifiers")
            rows.append((*sorted(map(str, pair)), str(by)))
        out.append(rows)
    if both := {r[:2] for r in out[0]} & {r[:2] for r in out[1]}:
        raise ValueError(f"{sorted(both)[0]} are the same and different")
    return out[0], out[1]


def _front(nodes: DataFrame, edges: DataFrame, named: list, hub: int) -> DataFrame:
    """Edges of the nodes that may be expanded: named ones and no hubs."""
    each = both_ways(edges)
    size = each.join(nodes, "node", "left_semi").groupBy("node").agg(F.countDistinct("other").alias("degree"))
    open_ = size.filter((F.col("degree") <= hub) | F.col("node").isin(named)).select("node")
    return each.join(open_, "node", "left_semi")


def walk(edges: DataFrame, start: list, levels: int = 2, hub: int = HUB, frontier: int = FRONTIER, rows: int = ROWS) -> DataFrame:
    """Nodes within ``levels`` links and their level; hubs end a walk. The next
    frontier is the most recently seen, at most ``frontier`` nodes: this limit
    is the feature, and ``complete`` says whether it cut anything."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    reached = spark.createDataFrame([(x, 0) for x in start], f"node {kind}, level int")
    here, complete = reached.select("node"), True
    for level in range(1, levels + 1):
        near = _front(here, edges, start, hub).groupBy("other").agg(F.max("last_seen").alias("last_seen")).join(reached.select(F.col("node").alias("other")), "other", "left_anti")
        top = cut(near.orderBy(F.desc("last_seen"), "other").limit(frontier + 1))
        n = top.count()
        complete &= n <= frontier
        here = top.orderBy(F.desc("last_seen"), "other").limit(frontier).select(F.col("other").alias("node"))
        reached = reached.unionByName(here.withColumn("level", F.lit(level))).limit(rows)
        if not n:
            break
    return reached.withColumn("complete", F.lit(complete))


def shortest_path(edges: DataFrame, a, b, most: int = 4, hub: int = HUB) -> list | None:
    """The nodes of a shortest path of at most ``most`` links, from both ends,
    the smaller side first; None if there is none. A hub is no place to meet
    unless it is an end. Of several ways the least node goes at each step; what
    comes to the driver is one row a step."""
    kind = dict(edges.dtypes)["src"]
    spark = edges.sparkSession
    if a == b:
        return [a]
    levels = [[spark.createDataFrame([(x, None)], f"node {kind}, via {kind}")] for x in (a, b)]
    seen, sizes = [x[0].select("node") for x in levels], [1, 1]
    hubs = degree(edges).filter((F.col("degree") > hub) & ~F.col("node").isin([a, b])).select("node")
    for _ in range(most):
        k = 0 if sizes[0] <= sizes[1] else 1
        near = _front(levels[k][-1].select("node"), edges, [a, b], hub).join(seen[k].select(F.col("node").alias("other")), "other", "left_anti")
        step = cut(near.groupBy(F.col("other").alias("node")).agg(F.min("node").alias("via")))
        levels[k].append(step)
        met = step.join(seen[1 - k], "node", "left_semi").join(hubs, "node", "left_anti").agg(F.min("node")).first()[0]
        if met is not None:
            sides = []
            for level in levels:
                own, at = [], met
                for frame in reversed(level):
                    row = frame.filter(F.col("node") == at).first()
                    if row is not None:
                        own.append(at)
                        at = row.via
                sides.append(own)
            return [*reversed(sides[0]), *sides[1][1:]]
        sizes[k] = step.count()
        if not sizes[k]:
            return None
        seen[k] = seen[k].unionByName(step.select("node"))
    return None


def path_length(edges: DataFrame, a, b, most: int = 4, hub: int = HUB) -> int | None:
    """Links of the shortest path of at most ``most``."""
    found = shortest_path(edges, a, b, most, hub)
    return None if found is None else len(found) - 1


def aliases(total: DataFrame, weak: DataFrame) -> DataFrame:
    """Weak identifiers and the strong ones that claims tie them to."""
    return total.join(weak, F.col("other") == F.col("id"), "left_semi").groupBy(F.col("other").alias("alias")).agg(F.array_join(F.array_sort(F.collect_set(F.col("one").cast("string"))), ",").alias("entities"))


# Coverage


def coverage(needs: DataFrame, available: DataFrame, rules: DataFrame) -> DataFrame:
    """A verdict on each technique: detected by a rule on a collected component,
    blind if only uncollected ones have rules, collected if a needed component
    is there, else uncovered. ``needs`` (technique, component), ``rules``
    (technique, component), ``available`` (component)."""
    have = available.select("component", F.lit(1).alias("have"))
    ruled = rules.join(have, "component", "left").groupBy("technique").agg(F.max(F.coalesce("have", F.lit(0))).alias("ruled"))
    per = needs.join(have, "component", "left").groupBy("technique").agg(F.max(F.coalesce("have", F.lit(0))).alias("held"), F.count("*").alias("components"))
    verdict = F.when(F.col("ruled") == 1, "detected").when(F.col("ruled") == 0, "blind").when(F.col("held") == 1, "collected").otherwise("uncovered")
    return per.join(ruled, "technique", "left").select("technique", "components", verdict.alias("verdict"))


def navigator_layer(verdicts: DataFrame) -> DataFrame:
    """A layer of scores as one JSON text for each verdict."""
    score = F.when(F.col("verdict") == "detected", 100).when(F.col("verdict") == "blind", 50).when(F.col("verdict") == "collected", 25).otherwise(0)
    return verdicts.select("technique", F.to_json(F.struct(F.col("technique").alias("techniqueID"), score.alias("score"), F.col("verdict").alias("comment"))).alias("entry"))


def navigator_document(verdicts: DataFrame, name: str, domain: str, version: str) -> DataFrame:
    """The whole layer as one JSON text, techniques in order: one row, as large
    as the framework."""
    score = F.when(F.col("verdict") == "detected", 100).when(F.col("verdict") == "blind", 50).when(F.col("verdict") == "collected", 25).otherwise(0)
    entry = F.struct(F.col("technique").alias("techniqueID"), score.alias("score"), F.col("verdict").alias("comment"))
    made = verdicts.agg(F.array_sort(F.collect_list(entry)).alias("techniques"))
    versions = F.struct(F.lit(version).alias("attack"), F.lit("4.5").alias("layer"))
    return made.select(F.to_json(F.struct(F.lit(name).alias("name"), F.lit(domain).alias("domain"), versions.alias("versions"), "techniques")).alias("layer"))
