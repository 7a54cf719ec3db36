"""Strong components in rounds that grow with the logarithm of the longest path, not with its length.

Nodes get numbers in an order of their own. Then, until no edge is left: nodes without a way in or
a way out go; chains, runs of nodes with one way in and one way out, shrink to a single edge by pointer
jumping; and what is left is split by two colours of each node, the smallest node that reaches it and the
smallest that it reaches. Where both are the same node, that is the node's component; edges between
nodes of different colours lie on no cycle. A colour is itself a node that reaches (or is reached), so
each round also takes the colour of the colour, which doubles how far a colour has come.

Colours pass from component to component, so that components in a row take many splits of all edges. A large graph
is gathered around seeds first, which makes most nodes of its large components one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.components import SMALL
from edgeloom.operators.components import settled as cut
from edgeloom.operators.graph import per_edge
from edgeloom.operators.ordering import numbered

_FORWARD, _BACKWARD = 0, 1
#: Edges beyond which nodes are gathered around seeds, nodes for each seed, and steps that a seed reaches.
GATHERED, SPREAD, REACH = 1 << 16, 1 << 9, 8


def number_nodes(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((label, x), (s, t)): nodes of edges(source, target) with a number each, and the distinct pairs of numbers without self-edges.

    A number is the label's 64-bit hash, which has nothing to do with the graph: a colour that meets nothing smaller for a long
    way would come on a step a round. If two labels share one, positions are hashed instead, one to one.
    """
    hashed = lambda c: F.xxhash64(c)
    plain = cut(per_edge(edges).select("source", "target", hashed("source").alias("s"), hashed("target").alias("t")).distinct())
    nodes = cut(plain.select(F.col("source").alias("label"), F.col("s").alias("x")).union(plain.select("target", "t")).distinct())
    if nodes.groupBy("x").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return nodes, plain.select("s", "t")
    nodes = cut(numbered(nodes.select("label"), "label", name="id").select("label", hashed("id").alias("x")))
    from_, to = nodes.select(F.col("label").alias("source"), F.col("x").alias("s")), nodes.select(F.col("label").alias("target"), F.col("x").alias("t"))
    return nodes, cut(plain.select("source", "target").join(from_, "source").join(to, "target").select("s", "t"))


def trim(edges: DataFrame) -> DataFrame:
    """edges(s, t) that have an edge before and one after them."""
    before, after = edges.select(F.col("t").alias("s")).distinct(), edges.select(F.col("s").alias("t")).distinct()
    return edges.join(before, "s", "left_semi").join(after, "t", "left_semi")


def contract_chains(edges: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(edges, chains, rings): chains shrunk to one edge each; None if fewer than least nodes have one way in and one way out.

    chains(x, a, b) are the nodes between a and b, rings(x, low) those of rings that touch nothing else,
    with their smallest node. An edge from a node to itself stays out of edges, chains tells of it. A pointer doubles its length each round, so there are as many
    rounds as the longest chain's length has bits.
    """
    ends = edges.select(F.col("s").alias("x"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("t", F.lit(0), F.lit(1)))
    unary = ends.groupBy("x").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).where("o = 1 AND i = 1").select("x")
    unary = cut(unary)
    if unary.count() < least:
        return None
    ahead = unary.join(edges, F.col("x") == F.col("s")).select("x", F.lit(_FORWARD).alias("way"), F.col("t").alias("to"))
    behind = unary.join(edges, F.col("x") == F.col("t")).select("x", F.lit(_BACKWARD).alias("way"), F.col("s").alias("to"))
    inner = unary.select(F.col("x").alias("to"), F.lit(True).alias("open"))
    jumps = cut(ahead.union(behind).join(inner, "to", "left").select("x", "way", "to", F.col("x").alias("low"), F.coalesce("open", F.lit(False)).alias("open")))
    state = None
    while True:
        now = jumps.where("open").agg(F.count("*").alias("n"), F.sum(F.col("low").cast("decimal(20,0)")).alias("low")).first()
        if not now.n or now == state:  # the rest are rings, and each knows its smallest node
            break
        state = now
        onward = jumps.select(F.col("x").alias("to"), "way", F.col("to").alias("to_"), F.col("low").alias("low_"), F.col("open").alias("open_"))
        moved = jumps.where("open").join(onward, ["to", "way"]).select("x", "way", F.col("to_").alias("to"), F.least("low", "low_").alias("low"), F.col("open_").alias("open"))
        jumps = cut(jumps.where("NOT open").select("x", "way", "to", "low", "open").union(moved))
    side = lambda way, name: F.max(F.when(F.col("way") == way, F.col("to"))).alias(name)
    chains = cut(jumps.where("NOT open").groupBy("x").agg(side(_BACKWARD, "a"), side(_FORWARD, "b")))
    rings = jumps.where(f"open AND way = {_FORWARD}").select("x", "low")
    gone = unary.select(F.col("x").alias("s"))
    rest = edges.join(gone, "s", "left_anti").join(gone.select(F.col("s").alias("t")), "t", "left_anti").select("s", "t")
    return cut(rest.union(chains.where("a != b").select("a", "b")).distinct()), chains, cut(rings)


def _few(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= SMALL else rows


def _steps(edges: DataFrame) -> DataFrame:
    """(at, to, way): edges(s, t) in both directions."""
    return cut(edges.select(F.col("s").alias("at"), F.col("t").alias("to"), F.lit(_FORWARD).alias("way")).union(edges.select("t", "s", F.lit(_BACKWARD))))


def _both_ways() -> Column:
    return F.explode(F.array(F.lit(_FORWARD), F.lit(_BACKWARD))).alias("way")


def _sides(rows: DataFrame) -> DataFrame:
    """(x, f, b): c of rows(x, way, c) forward and backward."""
    side = lambda way, name: F.min(F.when(F.col("way") == way, F.col("c"))).alias(name)
    return rows.groupBy("x").agg(side(_FORWARD, "f"), side(_BACKWARD, "b"))


def gather(edges: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    """(edges, members): edges(s, t) with strongly connected groups made one node; members(x, c) are the groups' nodes and c, one of them.

    One node in SPREAD is a seed. Each node takes the seed that reaches it first and the one that it reaches first, so
    that a round joins only what the last one reached. A node between seeds f and b shows a way from f to b; seeds on a
    cycle of such ways are in one component, and so are the nodes between them. Nodes that no seed tells of stay as they are.
    """
    steps = _steps(edges)
    seeds = steps.select(F.col("at").alias("x")).distinct().where(F.pmod(F.hash("x", F.lit(salt)), F.lit(SPREAD)) == 0)
    reached = latest = cut(seeds.select("x", _both_ways(), F.col("x").alias("c")))
    for _ in range(REACH):
        n = latest.count()
        if not n:
            break
        sent = steps.join(_few(latest.select(F.col("x").alias("at"), "way", "c"), n), ["at", "way"]).groupBy(F.col("to").alias("x"), "way").agg(F.min("c").alias("c"))
        latest = cut(sent.join(reached, ["x", "way"], "left_anti"))
        reached = reached.union(latest)
    between = cut(_sides(reached).where("f IS NOT NULL AND b IS NOT NULL"))
    known = cut(components_of(cut(between.where("f != b").select(F.col("f").alias("s"), F.col("b").alias("t")).distinct()), salt + 1))
    n = known.count()
    of = lambda end: _few(known.select(F.col("x").alias(end), F.col("c").alias(f"of_{end}")), n)
    members = between.join(of("f"), "f", "left").join(of("b"), "b", "left").select("x", F.coalesce("of_f", "f").alias("c"), F.coalesce("of_b", "b").alias("other"))
    members = cut(members.where("c = other").select("x", "c"))
    n = members.count()
    now = lambda end: _few(members.select(F.col("x").alias(end), F.col("c").alias(f"c_{end}")), n)
    rest = edges.join(now("s"), "s", "left").join(now("t"), "t", "left").select(F.coalesce("c_s", "s").alias("s"), F.coalesce("c_t", "t").alias("t"))
    return cut(rest.where("s != t").distinct()), members


def _colours(edges: DataFrame) -> DataFrame:
    """(x, f, b): the smallest node that reaches x, and the smallest that x reaches, x itself included."""
    steps = _steps(edges)
    colour = cut(steps.select(F.col("at").alias("x"), _both_ways()).distinct().withColumn("c", F.col("x")))
    n = colour.count()
    while True:
        beyond = _few(colour.select(F.col("x").alias("c"), "way", F.col("c").alias("further")), n)
        kept = colour.join(beyond, ["c", "way"], "left").select("x", "way", F.least("c", "further").alias("c"), F.col("c").alias("own"))
        sent = steps.join(_few(colour.select(F.col("x").alias("at"), "way", "c"), n), ["at", "way"]).select("to", "way", "c", F.lit(None).cast("long"))
        now = cut(kept.union(sent).groupBy("x", "way").agg(F.min("c").alias("c"), F.max("own").alias("own")))
        settled = now.where("c < own").isEmpty()
        colour = now.select("x", "way", "c")
        if settled:
            return cut(_sides(colour))


def _split(edges: DataFrame, found: list[DataFrame]) -> DataFrame:
    """One round of colouring: components go to found, edges within one pair of colours stay."""
    colour = _colours(edges)
    found.append(colour.where("f = b").select("x", F.col("f").alias("c")))
    open_ = colour.where("f != b")
    from_, to = open_.select(F.col("x").alias("s"), "f", "b"), open_.select(F.col("x").alias("t"), "f", "b")
    return cut(edges.join(from_, "s").join(to, ["t", "f", "b"]).select("s", "t"))


def components_of(edges: DataFrame, salt: int = 0) -> DataFrame:
    """(x, c): every node of edges(s, t) that lies on a cycle, with a node of its strong component that stands for it."""
    levels, found, rings, gathered = [], [], [], []
    left = edges.count()
    while left > GATHERED:
        before = left
        edges, members = gather(edges, salt + len(gathered))
        gathered.append(members)
        left = edges.count()
        if left > before // 2:  # seeds get on no longer
            break
    while left:
        before = left
        edges = cut(trim(edges))
        contracted = contract_chains(edges, max(1, before // 8))
        if contracted:
            edges, chains, own = contracted
            levels.append(chains)
            rings.append(own.select("x", F.col("low").alias("c")))
        left = edges.count()
        if left > before // 2:  # trimming and chains alone get on no longer
            edges = _split(edges, found)
            left = edges.count()
    known = reduce(DataFrame.union, [*found, *rings], edges.select(F.col("s").alias("x"), F.col("t").alias("c")).limit(0))
    for chains in reversed(levels):
        known = cut(known)
        own = chains.where("a = b").select(F.col("a").alias("x")).distinct().join(known, "x", "left_anti").select("x", F.col("x").alias("c"))
        known = cut(known.union(own))
        at = lambda end, name: known.select(F.col("x").alias(end), F.col("c").alias(name))  # noqa: B023, E731
        inside = chains.join(at("a", "c"), "a").join(at("b", "other"), "b").where("c = other").select("x", "c")
        known = known.union(inside)
    for members in reversed(gathered):
        known = cut(known)
        further = known.select(F.col("x").alias("c"), F.col("c").alias("further"))
        inside = members.join(further, "c", "left").select("x", F.coalesce("further", "c").alias("c"))
        known = inside.union(known.join(members, "x", "left_anti"))
    known = cut(known)
    large = known.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c")
    return known.join(large, "c", "left_semi").select("x", "c")


def strong_components(edges: DataFrame) -> DataFrame:
    """(label, component): each node of edges(source, target) on a cycle, with the smallest label of its strong component.

    Self-edges count for nothing. Jobs run when this is called: one for each bit of the longest chain,
    and for what no chain covers one for each doubling of a colour's reach, anew for each split. An edge
    table without cycles, or empty, gives no rows.
    """
    nodes, pairs = number_nodes(edges)
    rows = cut(components_of(pairs).join(nodes, "x").select("label", "c"))
    return rows.join(rows.groupBy("c").agg(F.min("label").alias("component")), "c").select("label", "component")
