"""Selections over the graph: focus, closures, unions, snapshots and cycles."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.errors import InvalidOptions
from edgeloom.functions.patterns import Filter, any_of
from edgeloom.operators.components import kept
from edgeloom.operators.components import settled as cut
from edgeloom.operators.graph import EVIDENCE, aggregate_edges, nodes, per_edge
from edgeloom.operators.ordering import ORDERS, numbered
from edgeloom.operators.strong import strong_components as strong_components


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    """(at, to) pairs to walk along: forward, backward or both."""
    plain = per_edge(edges)
    out = plain.select(F.col("source").alias("at"), F.col("target").alias("to"))
    back = plain.select(F.col("target").alias("at"), F.col("source").alias("to"))
    return {"forward": out, "backward": back, "both": out.union(back)}[direction].distinct()


def reach(edges: DataFrame, seeds: DataFrame, direction: str, depth: int | None = None) -> DataFrame:
    """(label, distance) of what seeds(label) reach within depth steps, themselves at 0.

    Semi-naive: each round joins the last frontier only and drops what is known; frontiers are
    checkpointed apart, and gathered into one table every so often, so that a long walk neither keeps
    a long lineage nor rewrites all that it knows in each round. Jobs run when this is called.
    """
    steps = cut(_steps(edges, direction))
    frontier = cut(seeds.select("label").distinct().withColumn("distance", F.lit(0)))
    known, k = [frontier], 0
    while depth is None or k < depth:
        k += 1
        found = frontier.join(steps, frontier["label"] == steps["at"]).select(F.col("to").alias("label")).distinct()
        for rows in known:
            found = found.join(rows, "label", "left_anti")
        frontier = cut(found.withColumn("distance", F.lit(k)))
        if frontier.isEmpty():
            break
        known.append(frontier)
        if len(known) > 8:
            known = [cut(reduce(DataFrame.union, known))]
    return reduce(DataFrame.union, known)


@dataclass(frozen=True)
class Query:
    """focus (with a depth), reachable or dependents from the nodes that filters select."""

    kind: str
    filters: tuple[Filter, ...]
    depth: int = 1


@dataclass(frozen=True)
class Options:
    queries: tuple[Query, ...] = ()
    external: bool = False
    self_edges: bool = False
    collapse: Column | None = field(default=None)
    title: str = "Project dependency graph"


#: Rounds of one step each before a walk without a depth goes on in strides that double.
PLAIN = 12
#: A table of strides may have so many times the rows of the steps.
GROWTH = 4


def _fresh(sent: DataFrame, known: list[DataFrame]) -> DataFrame:
    """(label, mask): the bits of sent(label, mask) that known does not have yet."""
    zero = F.lit(0).cast("long")
    rows = sent.select("label", F.col("mask").alias("got"), zero.alias("had"))
    for k in known:
        rows = rows.union(k.select("label", zero, "mask"))
    merged = rows.groupBy("label").agg(F.bit_or("got").bitwiseAND(F.bitwise_not(F.bit_or("had"))).alias("mask"))
    return cut(merged.where("mask != 0"))


def _gathered(known: list[DataFrame]) -> list[DataFrame]:
    if len(known) <= 8:
        return known
    return [cut(reduce(DataFrame.union, known).groupBy("label").agg(F.bit_or("mask").alias("mask")))]


def _stepped(at: DataFrame, steps: DataFrame) -> DataFrame:
    mask = F.col("mask").bitwiseAND(F.col("through"))
    moved = at.join(steps.withColumnRenamed("mask", "through"), F.col("label") == F.col("at")).select(F.col("to").alias("label"), mask.alias("mask"))
    return moved.where("mask != 0")


def _in_strides(steps: DataFrame, known: list[DataFrame]) -> list[DataFrame]:
    """known with all that steps(at, to, mask) lead to, in strides of 1, 2, 4, ... steps.

    A stride of twice the length is two strides one after the other. Any path is a sum of such strides, each
    length at most once from the longest down, so each is walked once. If the strides get too many to
    double again, the longest ones are walked until nothing new comes, and the shorter ones once.
    Steps to what is known already are left out from the start.
    """
    at = reduce(DataFrame.union, known).groupBy(F.col("label").alias("to")).agg(F.bit_or("mask").alias("had"))
    left = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long"))))
    strides = [cut(steps.join(at, "to", "left").select("at", "to", left.alias("mask")).where("mask != 0"))]
    n = strides[0].count()
    whole = n == 0
    while not whole:
        first, second = (strides[-1].select(F.col("at").alias(a), F.col("to").alias(b), F.col("mask").alias(m)) for a, b, m in (("at", "via", "m1"), ("via", "to", "m2")))
        both = first.join(second, "via").where("at != to").select("at", "to", F.col("m1").bitwiseAND(F.col("m2")).alias("mask")).where("mask != 0")
        double = cut(both.groupBy("at", "to").agg(F.bit_or("mask").alias("mask")))
        rows = double.count()
        if rows > GROWTH * n:
            break
        whole = not rows or 1 << len(strides) > n  # no path has more steps than there are
        if rows:
            strides.append(double)
    for k in reversed(range(len(strides))):
        while True:
            fresh = _fresh(_stepped(reduce(DataFrame.union, known), strides[k]), known)
            if fresh.isEmpty():
                break
            known = _gathered([*known, fresh])
            if whole or k < len(strides) - 1:
                break
    return known


def walk(steps: DataFrame, seeds: DataFrame, depths: tuple[int | None, ...]) -> DataFrame:
    """(label, mask): what each of several walks reaches, a bit a walk, all of them walked at once.

    steps(at, to, mask) has the bits of the walks that may take a step, seeds(label, mask) of those that start
    at a node; depths are the walks' lengths, None for no end. Each round takes one join and one
    aggregation, however many walks there are. Walks without an end go on in strides that double after
    PLAIN rounds, so a path takes as many rounds more as its length has bits. Jobs run when this is called.
    """
    steps = cut(steps)
    endless = sum(1 << i for i, d in enumerate(depths) if d is None)
    frontier = cut(seeds.groupBy("label").agg(F.bit_or("mask").alias("mask")).where("mask != 0"))
    known, k = [frontier], 0
    while True:
        alive = sum(1 << i for i, d in enumerate(depths) if (k < PLAIN if d is None else k < d))
        if not alive:
            break
        moved = _stepped(frontier, steps).select("label", F.col("mask").bitwiseAND(F.lit(alive).cast("long")).alias("mask")).where("mask != 0")
        frontier = _fresh(moved, known)
        if frontier.isEmpty():
            endless = endless if k >= PLAIN else 0  # walks without an end stand still from PLAIN on
            break
        known, k = _gathered([*known, frontier]), k + 1
    if endless:
        bits = F.col("mask").bitwiseAND(F.lit(endless).cast("long"))
        known = _in_strides(steps.select("at", "to", bits.alias("mask")).where("mask != 0"), known)
    return reduce(DataFrame.union, known).groupBy("label").agg(F.bit_or("mask").alias("mask"))


#: Walks that one mask holds.
WALKS = 60
_WAYS = {"focus": (True, True), "reachable": (True, False), "dependents": (False, True)}


def query_masks(edges: DataFrame, queries: tuple[Query, ...], external: bool = False) -> DataFrame:
    """(label, mask): the nodes that any query selects, with a bit for each query that does (at most WALKS)."""
    if any(q.depth < 0 for q in queries):
        raise InvalidOptions("depth starts at 0")
    if len(queries) > WALKS:
        raise InvalidOptions(f"at most {WALKS} queries are walked at once")
    edges = kept((edges if external else edges.where("NOT external")).select("source", "target", "external"))  # normalized once for the steps and the nodes
    seen = per_edge(edges)
    ahead, back = (sum(1 << i for i, q in enumerate(queries) if _WAYS[q.kind][way]) for way in (0, 1))
    bits = lambda n: F.lit(n).cast("long").alias("mask")
    steps = seen.select(F.col("source").alias("at"), F.col("target").alias("to"), bits(ahead)).union(seen.select("target", "source", bits(back)))
    steps = steps.where("mask != 0").groupBy("at", "to").agg(F.bit_or("mask").alias("mask"))
    chosen = reduce(Column.bitwiseOR, [F.when(any_of(q.filters, F.col("label")), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, q in enumerate(queries)])
    return walk(steps, nodes(edges, external).select("label", chosen.alias("mask")), tuple(q.depth if q.kind == "focus" else None for q in queries))


def select_nodes(edges: DataFrame, options: Options) -> DataFrame:
    """(label) of the union of all queries, walked at once; without a query, all nodes. Exclusions hold for seeds only."""
    if not options.queries:
        return nodes(edges, options.external)
    parts = [query_masks(edges, options.queries[k : k + WALKS], options.external).select("label") for k in range(0, len(options.queries), WALKS)]
    return parts[0] if len(parts) == 1 else reduce(DataFrame.union, parts).distinct()


def snapshot(edges: DataFrame, options: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, summary) of a report.

    nodes(id, label) are numbered n0, n1, ... in order of label, by range. Counts are taken before
    collapsing drops edges within a label.
    """
    edges = kept(edges.select(*EVIDENCE))  # normalized once for the nodes, the edges and the counts
    chosen = select_nodes(edges, options)
    inside = edges if options.external else edges.where("NOT external")
    if options.queries:  # without any, every end is chosen
        inside = inside.join(chosen.select(F.col("label").alias("source")), "source", "left_semi").join(chosen.select(F.col("label").alias("target")), "target", "left_semi")
    if not options.self_edges:
        inside = per_edge(inside)
    labels = chosen.select("label") if options.collapse is None else chosen.select(options.collapse.alias("label")).distinct()
    ids = numbered(labels, "label", name="n").select(F.concat(F.lit("n"), "n").alias("id"), "label")
    ends = inside
    if options.collapse is not None:  # a column over label: each end in turn stands under that name
        rest = [c for c in EVIDENCE if c not in ("source", "target")]
        ends = inside.select(F.col("source").alias("label"), "target", *rest).select(options.collapse.alias("source"), F.col("target").alias("label"), *rest).select("source", options.collapse.alias("target"), *rest)
    merged = aggregate_edges(ends if options.self_edges else per_edge(ends))
    counts = inside.select(F.lit(0).alias("node_count"), F.lit(0).alias("edge_count"), F.lit(1).alias("raw_edge_count"), F.col("external").cast("int").alias("external_edge_count"))
    counts = counts.union(labels.select(F.lit(1), F.lit(0), F.lit(0), F.lit(0))).union(merged.select(F.lit(0), F.lit(1), F.lit(0), F.lit(0)))
    summary = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.columns])
    return ids, merged, summary


#: Cycles that are listed of one strong component, and edges up to which a component is searched in tasks that each hold it.
LIMIT, PACKED = 20_000, 1_000_000
#: Tasks that share the start nodes of a component, and cycles handed on at once.
SHARES, BATCH = 32, 500


class _Packed:
    """The edges of one component, its nodes numbered in order of label."""

    def __init__(self, sources, targets):
        self.labels = sorted(set(sources))  # in a strong component, every node is a source
        number = {x: k for k, x in enumerate(self.labels)}
        self.after: list[list[int]] = [[] for _ in self.labels]
        self.before: list[list[int]] = [[] for _ in self.labels]
        for a, b in ((number[x], number[y]) for x, y in zip(sources, targets, strict=True)):
            self.after[a].append(b)
            self.before[b].append(a)
        for row in self.after:
            row.sort()

    def from_(self, start: int):
        """Each elementary cycle whose smallest node is start, in lexicographic order."""
        back, open_ = {start}, [start]  # nodes from start on that lead back to it; no other can be on such a cycle
        while open_:
            for x in self.before[open_.pop()]:
                if x > start and x not in back:
                    back.add(x)
                    open_.append(x)
        path, on, trail, found = [start], {start}, [iter([x for x in self.after[start] if x in back])], [False]
        blocked: dict[int, set[int]] = {}
        shut: set[int] = set()
        while path:
            here = path[-1]
            for x in trail[-1]:
                if x == start:
                    yield list(path)
                    found[-1] = True
                elif x not in on and x not in shut:
                    path.append(x)
                    on.add(x)
                    shut.add(x)
                    trail.append(iter([y for y in self.after[x] if y in back]))
                    found.append(False)
                    break
            else:
                path.pop()
                trail.pop()
                on.discard(here)
                if found.pop():
                    free = [here]
                    while free:
                        y = free.pop()
                        if y in shut:
                            shut.discard(y)
                            free.extend(blocked.pop(y, ()))
                    if found:
                        found[-1] = True
                else:
                    for y in self.after[here]:
                        if y in back:
                            blocked.setdefault(y, set()).add(here)

    def shortest(self) -> list[int]:
        """A shortest cycle through the smallest node: the first that a search by levels, in order, comes back on."""
        came, level = {0: 0}, [0]
        while level:
            following = []
            for x in level:
                for y in self.after[x]:
                    if y == 0:
                        out = [x]
                        while out[-1]:
                            out.append(came[out[-1]])
                        return out[::-1]
                    if y not in came:
                        came[y] = x
                        following.append(y)
            level = following
        raise ValueError("no cycle leads through the smallest node")


def _inside(edges: DataFrame) -> DataFrame:
    """(component, source, target): the distinct edges within strong components; all others are on no cycle."""
    pairs = cut(per_edge(edges).select("source", "target").distinct())
    found = cut(strong_components(pairs))
    rows = pairs.join(found.select(F.col("label").alias("source"), "component"), "source")
    rows = rows.join(found.select(F.col("label").alias("target"), F.col("component").alias("other")), "target").where("component = other")
    return cut(rows.select("component", "source", "target"))


def _packed(inside: DataFrame, sizes: DataFrame) -> DataFrame:
    """(component, sources, targets): one row for each component of sizes(component), all of which have at most PACKED edges."""
    rows = inside.join(sizes.select("component"), "component", "left_semi").groupBy("component").agg(F.collect_list(F.struct("source", "target")).alias("e"))
    return rows.select("component", F.col("e.source").alias("sources"), F.col("e.target").alias("targets"))


def _searched(packed: DataFrame, make, schema: str, most: int | None = None) -> DataFrame:
    """make(component, graph, share, shares) as rows, for every share (of most at most) of each component's start nodes."""
    shares = F.least(F.lit(most or SHARES), F.greatest(F.lit(1), F.floor(F.size("sources") / 64))).cast("int")
    tasks = packed.select("component", "sources", "targets", shares.alias("shares")).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                out = []
                for x in make(row.component, _Packed(row.sources, row.targets), row.share, row.shares):
                    out.append(x)
                    if len(out) >= BATCH:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=names)

    return tasks.repartition("component", "share").mapInPandas(run, schema)


def _counted(inside: DataFrame, limit: int) -> DataFrame:
    """(component, n_edges, n_cycles): exact up to limit; null beyond it, or where a component is too large to be searched.

    A strong component has at least edges - nodes + 1 elementary cycles, so many need no search. The rest are
    counted by start node, and a task stops once it has found more than limit.
    """
    sizes = cut(inside.groupBy("component").agg(F.count("*").alias("n_edges"), F.countDistinct("source").alias("n_nodes")))
    open_ = sizes.where((F.col("n_edges") - F.col("n_nodes") + 1 <= limit) & (F.col("n_edges") <= PACKED))

    def count(component, graph, share, shares):
        n = 0
        for start in range(share, len(graph.labels), shares):
            for _ in graph.from_(start):
                n += 1
                if n > limit:
                    break
            if n > limit:
                break
        yield component, n

    counts = _searched(_packed(inside, open_), count, "component string, n long").groupBy("component").agg(F.sum("n").alias("n"))
    return cut(sizes.join(counts, "component", "left").select("component", "n_edges", F.when(F.col("n") <= limit, F.col("n")).alias("n_cycles")))


def elementary_cycles(edges: DataFrame, limit: int = LIMIT, beyond: str = "error") -> DataFrame:
    """(nodes): every elementary cycle once, as its nodes from the smallest on.

    Strong components are found by Spark; edges between them are on no cycle. A component's start nodes are
    shared out over tasks, each of which holds the component's edges (at most PACKED) and hands on
    cycles as it finds them. Their number can grow exponentially, so cycles are counted first: a
    component with more than limit of them, or with more than PACKED edges and not provably more, is an error
    that names it, or with beyond="witness" gives one cycle as witness_cycles does. Jobs run when this
    is called.
    """
    inside = _inside(edges)
    counts = _counted(inside, limit)
    over = counts.where("n_cycles IS NULL")
    if beyond == "error":
        one = over.orderBy("component").first()
        if one:
            raise InvalidOptions(f"strong component {one['component']} with {one['n_edges']} edges has more than {limit} elementary cycles, or is too large to be searched for them; a witness can be asked for instead")

    def listed(component, graph, share, shares):
        for start in range(share, len(graph.labels), shares):
            for cycle in graph.from_(start):
                yield ([graph.labels[x] for x in cycle],)

    found = _searched(_packed(inside, counts.where("n_cycles IS NOT NULL")), listed, "nodes array<string>")
    return found if beyond == "error" else found.union(_witnesses(inside, over).select("nodes"))


def witness_cycles(edges: DataFrame) -> DataFrame:
    """(component, nodes): for each strong component, of any size, one of the shortest cycles through its smallest node.

    No rows means that there are no cycles. Components of at most PACKED edges are searched in a task each, larger
    ones by Spark joins, a round for each node of the cycle. Jobs run when this is called.
    """
    inside = _inside(edges)
    return _witnesses(inside, inside.groupBy("component").agg(F.count("*").alias("n_edges")))


def _witnesses(inside: DataFrame, sizes: DataFrame) -> DataFrame:
    small, large = sizes.where(F.col("n_edges") <= PACKED), sizes.where(F.col("n_edges") > PACKED)

    def shortest(component, graph, share, shares):
        yield component, [graph.labels[x] for x in graph.shortest()]

    found = _searched(_packed(inside, small), shortest, "component string, nodes array<string>", most=1)
    return found if large.isEmpty() else found.union(_witnesses_by_joins(inside.join(large.select("component"), "component", "left_semi")))


def _witnesses_by_joins(inside: DataFrame) -> DataFrame:
    """The same by levels: a node keeps the smallest predecessor of its level, and paths are read back from where they closed."""
    inside = cut(inside)
    frontier = cut(inside.select("component", F.col("component").alias("label")).distinct().withColumn("came", F.lit(None).cast("string")))
    known, closed = [frontier], []
    while not frontier.isEmpty():
        sent = frontier.select("component", F.col("label").alias("source")).join(inside, ["component", "source"]).groupBy("component", F.col("target").alias("label")).agg(F.min("source").alias("came"))
        sent = cut(sent)
        back = sent.where("label = component").select("component", F.array("came").alias("nodes"))
        closed.append(back)
        for rows in [*known, back]:
            keys = ["component"] if rows is back else ["component", "label"]
            sent = sent.join(rows.select(*keys), keys, "left_anti")
        frontier = cut(sent)
        known.append(frontier)
        if len(known) > 8:
            known = [cut(reduce(DataFrame.union, known))]
    came = cut(reduce(DataFrame.union, known).where("came IS NOT NULL"))
    paths, done = cut(reduce(DataFrame.union, closed)), []
    while not paths.isEmpty():
        done.append(paths.where("nodes[0] = component"))
        step = paths.where("nodes[0] != component").withColumn("label", F.col("nodes")[0]).join(came, ["component", "label"])
        paths = cut(step.select("component", F.concat(F.array("came"), "nodes").alias("nodes")))
    return reduce(DataFrame.union, done)


def cycles(edges: DataFrame, limit: int = LIMIT, beyond: str = "error") -> DataFrame:
    """(length, path): every elementary cycle once, closed, from its smallest node on."""
    nodes_ = F.col("nodes")
    return elementary_cycles(edges, limit, beyond).select(F.size(nodes_).cast("long").alias("length"), F.concat_ws(" -> ", nodes_, F.array(nodes_[0])).alias("path"))


def cycle_edges(found: DataFrame, projected: DataFrame) -> DataFrame:
    """(cycle, step, source_label, target_label, ...): each cycle's projected edges, in order.

    found has nodes; cycles are numbered from 0 in the order of their nodes. An edge that projected
    lacks fails the job.
    """
    order = numbered(found.select("nodes"), *ORDERS["cycles"], name="cycle")
    nodes_ = F.col("nodes")
    steps = order.select("cycle", F.posexplode("nodes").alias("step", "source_label"), "nodes")
    steps = steps.select("cycle", "step", "source_label", F.coalesce(F.get(nodes_, F.col("step") + 1), nodes_[0]).alias("target_label"))
    rows = steps.join(projected.withColumn("__there", F.lit(True)), ["source_label", "target_label"], "left")
    there = F.coalesce("__there", F.raise_error(F.concat(F.lit("no edge "), "source_label", F.lit(" -> "), "target_label")).cast("boolean"))
    return rows.where(there).drop("__there")
