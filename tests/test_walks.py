import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from edgeloom.errors import InvalidOptions
from edgeloom.functions.patterns import glob, regex
from edgeloom.operators import rules, strong, traversal
from edgeloom.operators.graph import nodes

EDGE = "source string, target string, external boolean, kinds int, classes int, availabilities int"


def graph_of(spark, pairs):
    return spark.createDataFrame([(a, b, a.startswith("!") or b.startswith("!"), 1, 1, 1) for a, b in pairs], EDGE)


def counted(monkeypatch, *modules):
    """How many checkpoints these modules write from now on."""
    calls = Counter()
    for module in modules:
        original = module.cut

        def cut(df, original=original):
            calls["cut"] += 1
            return original(df)

        monkeypatch.setattr(module, "cut", cut)
    return calls


def strong_by_closure(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    reach = {}
    for x in {x for p in pairs for x in p}:
        seen, open_ = set(), [x]
        while open_:
            for y in after.get(open_.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    open_.append(y)
        reach[x] = seen
    both = {x: {y for y in reach[x] if x in reach[y]} | {x} for x in reach}
    return {x: min(s) for x, s in both.items() if len(s) > 1}


def shuffled(n, seed):
    names = [f"{k:06}" for k in range(n)]
    random.Random(seed).shuffle(names)
    return names


@pytest.mark.parametrize("kind", ["chain", "ring"])
def test_long_chains_take_few_rounds(spark, monkeypatch, kind):
    calls, names = counted(monkeypatch, strong), shuffled(10_000, 1)
    pairs = list(zip(names, names[1:], strict=False)) + ([(names[-1], names[0])] if kind == "ring" else [])
    found = traversal.strong_components(graph_of(spark, pairs)).collect()
    assert calls["cut"] < 40
    assert len(found) == (10_000 if kind == "ring" else 0) and {r.component for r in found} <= {"000000"}


def tangle(seed):
    """Rings, chains between them, chains that leave a node and come back, ladders both ways and a random part."""
    r, out = random.Random(seed), set()
    names = iter(shuffled(2000, seed))
    take = lambda k: [next(names) for _ in range(k)]
    rings = [take(r.choice((2, 3, 9))) for _ in range(5)]
    for ring in rings:
        out |= set(zip(ring, ring[1:] + ring[:1], strict=True))
    for a, b in zip(rings, rings[1:], strict=False):
        path = [r.choice(a), *take(r.choice((1, 12))), r.choice(b)]
        out |= set(zip(path, path[1:], strict=False))
    loop = [rings[0][0], *take(11)]
    out |= set(zip(loop, loop[1:] + loop[:1], strict=True))
    lone = take(1)
    for _ in range(2):
        petal = lone + take(5)
        out |= set(zip(petal, petal[1:] + petal[:1], strict=True))
    rail, other = take(9), take(9)
    for k in range(8):
        out |= {(rail[k], rail[k + 1]), (rail[k], other[k + 1]), (other[k], rail[k + 1]), (other[k], other[k + 1])}
    both = take(8)
    out |= {p for k in range(7) for p in ((both[k], both[k + 1]), (both[k + 1], both[k]))}
    some = take(40)
    out |= {(r.choice(some), r.choice(some)) for _ in range(60)}
    tree = take(30)
    out |= {(tree[k // 2], tree[k]) for k in range(1, 30)}
    return sorted(out)


@pytest.mark.parametrize("seed", [1])
def test_strong_components_of_tangles(spark, seed):
    pairs = tangle(seed)
    found = {r.label: r.component for r in traversal.strong_components(graph_of(spark, pairs)).collect()}
    assert found == strong_by_closure(pairs)


def parts_in_a_row(parts, size, seed):
    """Strong parts of several steps, an edge from each to the next."""
    r, out = random.Random(seed), set()
    names = shuffled(parts * size, seed)
    for k in range(parts):
        part = names[k * size : (k + 1) * size]
        out |= set(zip(part, part[1:] + part[:1], strict=True)) | {(r.choice(part), r.choice(part)) for _ in range(3 * size)}
        if k:
            out.add((names[k * size - 1], part[0]))
    return sorted(p for p in out if p[0] != p[1])


def test_parts_in_a_row_are_gathered(spark, monkeypatch):
    """Failed before: colours passed from part to part, so that each split took all edges of the parts that were left."""
    coloured, plain = [], strong._colours
    monkeypatch.setattr(strong, "_colours", lambda edges: coloured.append(edges.count()) or plain(edges))
    for name, value in {"GATHERED": 500, "SPREAD": 8}.items():
        monkeypatch.setattr(strong, name, value, raising=False)
    pairs = parts_in_a_row(8, 60, 1)
    found = {r.label: r.component for r in traversal.strong_components(graph_of(spark, pairs)).collect()}
    assert found == strong_by_closure(pairs)
    assert sum(coloured) < len(pairs)


@pytest.mark.parametrize("reach", [1, 8])
def test_gathering_decides_nothing_uncertain(spark, monkeypatch, reach):
    for name, value in {"GATHERED": 20, "SPREAD": 3, "REACH": reach, "SMALL": 8 * reach}.items():
        monkeypatch.setattr(strong, name, value)
    pairs = tangle(2)
    found = {r.label: r.component for r in traversal.strong_components(graph_of(spark, pairs)).collect()}
    assert found == strong_by_closure(pairs)


def test_contracted_chains(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (3, 5), (7, 8), (8, 7), (9, 10), (10, 9), (9, 11)], "s long, t long")
    rest, chains, rings = strong.contract_chains(edges)
    assert sorted(map(tuple, rest.collect())) == [(0, 3), (3, 4), (3, 5), (9, 11)]
    assert sorted(map(tuple, chains.select("x", "a", "b").collect())) == [(1, 0, 3), (2, 0, 3), (10, 9, 9)]
    assert sorted(map(tuple, rings.collect())) == [(7, 7), (8, 7)]
    assert strong.contract_chains(edges, 6) is None


def test_labels_that_share_a_hash(spark, monkeypatch):
    pairs = tangle(4)
    monkeypatch.setattr(strong.F, "xxhash64", lambda c, plain=F.xxhash64: plain(c) % 64 if c in ("source", "target") else plain(c))
    found = {r.label: r.component for r in traversal.strong_components(graph_of(spark, pairs)).collect()}
    assert found == strong_by_closure(pairs)


# Walks


def test_a_closure_over_a_long_path_takes_few_rounds(spark, monkeypatch):
    names = shuffled(10_000, 2)
    edges = graph_of(spark, list(zip(names, names[1:], strict=False)))
    calls = counted(monkeypatch, traversal)
    found = traversal.select_nodes(edges, traversal.Options((traversal.Query("reachable", (glob(names[100]),)),)))
    assert found.count() == 9_900 and calls["cut"] < 60
    found = traversal.select_nodes(edges, traversal.Options((traversal.Query("dependents", (glob(names[100]),)),)))
    assert {r.label for r in found.collect()} == set(names[:101])


def reached(pairs, seeds, way, depth):
    steps = {"reachable": list(pairs), "dependents": [(b, a) for a, b in pairs], "focus": [*pairs, *((b, a) for a, b in pairs)]}[way]
    known = set(seeds)
    for _ in range(depth):
        more = known | {b for a, b in steps if a in known}
        if more == known:
            break
        known = more
    return known


@pytest.mark.parametrize(("plain", "growth"), [(12, 4), (0, 1), (1, 1000)])
def test_many_queries_are_one_walk(spark, monkeypatch, plain, growth):
    """Whatever the share of single steps and strides, each query's bit is on what that query alone reaches."""
    monkeypatch.setattr(traversal, "PLAIN", plain)
    monkeypatch.setattr(traversal, "GROWTH", growth)
    pairs = [p for p in tangle(7) if p[0] != p[1]]
    names = sorted({x for p in pairs for x in p})
    r = random.Random(plain)
    queries, want = [], {x: 0 for x in names}
    for k, way in enumerate(("reachable", "dependents", "focus", "focus", "reachable", "dependents", "focus")):
        seeds, depth = r.sample(names, 2), r.choice((0, 1, 4, 20))
        queries.append(traversal.Query(way, (glob(seeds[0]), glob(seeds[1])), depth))
        for x in reached(pairs, seeds, way, depth if way == "focus" else 10**6):
            want[x] |= 1 << k
    found = traversal.query_masks(graph_of(spark, pairs), tuple(queries))
    assert {x.label: x.mask for x in found.collect()} == {x: m for x, m in want.items() if m}


def test_five_queries_cost_one_walk(spark, monkeypatch):
    pairs = [p for p in tangle(8) if p[0] != p[1]]
    edges, names = graph_of(spark, pairs), sorted({x for p in pairs for x in p})
    calls = counted(monkeypatch, traversal)
    cost = []
    for n in (1, 5):
        calls.clear()
        traversal.select_nodes(edges, traversal.Options(tuple(traversal.Query("focus", (glob(names[k]),), 3) for k in range(n))))
        cost.append(calls["cut"])
    assert cost[0] == cost[1]


def test_more_queries_than_a_mask_holds(spark):
    edges = graph_of(spark, [(f"{k:03}", f"{k + 1:03}") for k in range(80)])
    queries = tuple(traversal.Query("focus", (glob(f"{k:03}"),), 0) for k in range(0, 80))
    assert traversal.select_nodes(edges, traversal.Options(queries)).count() == 80
    with pytest.raises(InvalidOptions):
        traversal.query_masks(edges, queries)


def test_external_nodes_are_walked_on_request_only(spark):
    edges = graph_of(spark, [("a", "!x"), ("a", "b"), ("a", "a")])
    query = (traversal.Query("reachable", (glob("a"),)),)
    assert [sorted(r.label for r in traversal.select_nodes(edges, traversal.Options(query, external=e)).collect()) for e in (False, True)] == [["a", "b"], ["!x", "a", "b"]]


# Cycles


def cycles_of(pairs):
    out, after = set(), {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)

    def go(path):
        for x in after.get(path[-1], ()):
            if x == path[0] and len(path) > 1:
                out.add(tuple(path))
            elif x > path[0] and x not in path:
                go([*path, x])

    for start in after:
        go([start])
    return out


@pytest.mark.parametrize(("seed", "shares"), [(1, 1), (2, 5)])
def test_cycles_by_start_node(spark, monkeypatch, seed, shares):
    monkeypatch.setattr(traversal, "SHARES", shares)
    monkeypatch.setattr(traversal, "BATCH", 3)
    r = random.Random(seed)
    pairs = sorted({(f"n{r.randrange(70):02}", f"n{r.randrange(70):02}") for _ in range(105)} | {("n01", "x"), ("x", "n01")})
    want = cycles_of([p for p in pairs if p[0] != p[1]])
    found = traversal.elementary_cycles(graph_of(spark, pairs)).collect()
    assert len(found) == len(want) > 5 and {tuple(x.nodes) for x in found} == want


def test_a_large_component_gives_a_witness(spark):
    n = 100_000
    ring = spark.range(n).selectExpr("id AS s", f"(id + 1) % {n} AS t").union(spark.range(n).selectExpr("id", f"(3 * id + 7) % {n}"))
    name = lambda c: F.lpad(F.col(c).cast("string"), 6, "0")
    edges = ring.select(name("s").alias("source"), name("t").alias("target"), F.lit(False).alias("external"))
    small = spark.createDataFrame([("a", "b", False), ("b", "a", False), ("b", "c", False)], "source string, target string, external boolean")
    found = {r.path.split(" -> ")[0]: r.path.split(" -> ") for r in traversal.cycles(edges.union(small), beyond="witness").collect()}
    assert set(found) == {"000000", "a"} and found["a"] == ["a", "b", "a"]
    path = [int(x) for x in found["000000"]]
    assert path[-1] == 0 and len(set(path)) == len(path) - 1 and all(b in ((a + 1) % n, (3 * a + 7) % n) for a, b in zip(path, path[1:], strict=False))


def test_a_large_ring_is_one_cycle(spark):
    names = shuffled(21_000, 4)
    found = traversal.elementary_cycles(graph_of(spark, list(zip(names, names[1:] + names[:1], strict=True)))).collect()
    assert len(found) == 1 and len(found[0].nodes) == 21_000 and found[0].nodes[0] == "000000"


def test_witnesses_by_joins(spark, monkeypatch):
    pairs = [p for p in tangle(9) if p[0] != p[1]]
    edges = graph_of(spark, pairs)
    packed = {r.component: r.nodes for r in traversal.witness_cycles(edges).collect()}
    monkeypatch.setattr(traversal, "PACKED", 3)
    joined = {r.component: r.nodes for r in traversal.witness_cycles(edges).collect()}
    assert set(packed) == set(joined) == set(strong_by_closure(pairs).values())
    for c, nodes_ in joined.items():
        assert nodes_[0] == c and len(nodes_) == len(packed[c]) == len(set(nodes_))
        assert all(p in pairs for p in zip(nodes_, nodes_[1:] + nodes_[:1], strict=True))
    assert traversal.witness_cycles(edges.limit(0)).count() == 0


def test_the_rule_answers_for_many_cycles(spark):
    full = [(a, b) for a in "abcdefgh" for b in "abcdefgh"]
    edges = graph_of(spark, full)
    assert [r.path for r in rules.have_no_cycles(edges, limit=100).collect()] == ["a -> b -> a"]
    assert rules.have_no_cycles(edges).count() == len(cycles_of([p for p in full if p[0] != p[1]])) == 16_064
    assert rules.have_no_cycles(edges, [[regex("[a-c]")]], limit=5).count() == 5
