"""Prefix trie of conversations from mergeable partial tries, and sums over its subtrees.

A node is a sequence of first turns. It is known by 128 bits, the sum of its turns' digests each mixed with its
place, so that every prefix of a conversation comes from running sums and none is stored. Each partition
combines its rows into a partial trie, a table of nodes with their members counted and the ids of the
conversations that end there; partial tries are merged in rounds of MERGED neighbours. Since
conversations are range-sorted, a partition's ids lie before the next one's, so merged lists are lists
one after the other, and long ones stay in blocks.

The least member of a node is also that of its first child along it, so the nodes fall into one path for
each conversation that is the least somewhere. Sums over subtrees go from path to path, all of a path in one
step, and then along each path as running sums.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeloom.llm import textkernels as K
from edgeloom.llm.common import cut
from edgeloom.llm.ranges import PART, borders, range_sorted, running

FAMILY, HEADS = 5, 9
#: Partial tries that a round merges into one; rows that a partition combines at a time; bytes of ids in a block.
MERGED, COMBINED, BLOCK = 16, 500_000, 1 << 16


def hashed_heads(conv_id: Column) -> Column:
    """How many turns a conversation takes over from its family's first: 0..8."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def turn_digests(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text digest as d1 and d2, size): narrow rows in place of texts; null roles and texts are empty.

    The digest covers role and text, told apart by the role's length; size is the text's in UTF-8 bytes.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    half = lambda k: F.conv(F.substring(digest, k, 15), 16, 10).cast("long")  # noqa: E731  60 bits each
    return conversations.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), half(1).alias("d1"), half(17).alias("d2"), F.octet_length(text).cast("long").alias("size")).where("conv IS NOT NULL")


def rebuild(digests: DataFrame) -> DataFrame:
    """(conv, at, d1, d2, size) of the rebuilt conversations, at giving their turns' order; each also has a row at 0 for the root.

    Conversation c gets the first h turns of c - c % 5, then its own after its first h. Ids take the
    remainder of their sign; h is hashed_heads. Turns are ordered by turn, nulls first, ties by digest.
    """
    own = running(range_sorted(digests, "conv", "turn", "d1", "d2"), "conv", {"nth": F.lit(1)}).drop(PART, "turn")
    own = cut(own.withColumns({"base": F.col("conv") - F.col("conv") % FAMILY, "h": hashed_heads(F.col("conv"))}))
    ids = cut(own.groupBy("conv").agg(F.first("base").alias("base"), F.first("h").alias("h")))
    heads = own.where((F.col("conv") == F.col("base")) & (F.col("nth") < HEADS)).select("base", "nth", "d1", "d2", "size")
    taken = ids.where("conv != base").join(heads, "base").where("nth <= h").select("conv", F.col("nth").alias("at"), "d1", "d2", "size")
    rest = own.where("conv = base OR nth > h").select("conv", (F.col("nth") + HEADS).alias("at"), "d1", "d2", "size")
    zero = F.lit(0).cast("long")
    return taken.unionByName(rest).unionByName(ids.select("conv", zero.alias("at"), zero.alias("d1"), zero.alias("d2"), zero.alias("size")))


def _with_keys(rows: DataFrame) -> DataFrame:
    """Range-sorted (conv, at, d1, d2, size) with depth, the node's key (k1, k2) and the turn's own part of it (m1, m2)."""
    deep = running(range_sorted(rows, "conv", "at"), "conv", {"depth": F.lit(1)}).withColumn("depth", F.col("depth") - 1)
    columns = deep.columns

    def run(batches):
        for batch in batches:
            depth = batch.column(columns.index("depth")).to_numpy().astype(np.uint64)
            out = []
            for k, name in enumerate(("d1", "d2")):
                digest = batch.column(columns.index(name)).to_numpy().astype(np.uint64)
                mixed = K.mix(K.mix(depth + np.uint64(0x5851F42D4C957F2D * (k + 1) & 0xFFFFFFFFFFFFFFFF)) + digest)
                out.append(pa.array(np.where(depth == 0, np.uint64(0), mixed).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*columns, "m1", "m2"])

    fields = ", ".join(f"{c} {t}" for c, t in deep.dtypes)
    return running(deep.mapInArrow(run, f"{fields}, m1 long, m2 long"), "conv", {"k1": F.col("m1"), "k2": F.col("m2")})


_NODES = "k1 long, k2 long, p1 long, p2 long, depth long, size long, part long, seq long, n long, least long, ends string"
_NAMES = [c.split()[0] for c in _NODES.split(", ")]


def partial_tries(keyed: DataFrame) -> DataFrame:
    """One table of nodes for each partition (or COMBINED rows of one): members counted, the least of them, the ids that end there.

    A node has one row, and further ones (n 0) for each block of ids beyond the first.
    """
    following, after = {}, None
    for b in reversed(borders(keyed, "conv")):
        following[b["part"]], after = after, b["first"]
    names = ("conv", "depth", "k1", "k2", "m1", "m2", "size")

    def run(batches):
        part, held, n, seq = None, [], 0, 0

        def combine(columns, ends):
            nonlocal seq
            conv, depth, k1, k2, m1, m2, size = columns
            order = np.lexsort((conv, k2, k1))
            same = (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1])
            starts = np.flatnonzero(np.concatenate(([True], ~same)))
            stops = np.append(starts[1:], len(order))
            top = order[starts]
            ending = np.flatnonzero(ends[order])
            lo, hi = np.searchsorted(ending, starts), np.searchsorted(ending, stops)
            ids, out = conv[order[ending]], [[] for _ in _NAMES]
            parent = ((k1 - m1)[top], (k2 - m2)[top])
            fixed = [x.tolist() for x in (k1[top], k2[top], *parent, depth[top], size[top])]
            for i, (a, b, members) in enumerate(zip(lo.tolist(), hi.tolist(), (stops - starts).tolist(), strict=True)):
                least = int(conv[top[i]])
                pieces = [",".join(map(str, ids[c : min(c + BLOCK // 8, b)].tolist())) for c in range(a, b, BLOCK // 8)] or [None]
                for k, piece in enumerate(pieces):
                    row = (*(f[i] for f in fixed), part, seq + k, 0 if k else members, least, piece)
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            seq += len(order) // (BLOCK // 8) + 1
            table = pa.RecordBatch.from_arrays([pa.array(c, pa.string() if name == "ends" else pa.int64()) for c, name in zip(out, _NAMES, strict=True)], names=_NAMES)
            for a in range(0, table.num_rows, 20_000):
                yield table.slice(a, 20_000)

        def taken(last: bool):
            """The held rows, but for the very last one, which waits to see what follows it."""
            nonlocal held, n
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            ends = np.append(columns[0][1:] != columns[0][:-1], not last or following[part] != columns[0][-1])
            if not last:
                held, n = [[c[-1:] for c in columns]], 1
                columns, ends = [c[:-1] for c in columns], ends[:-1]
            return columns, ends

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(len(names))[0].as_py()
            held.append([batch.column(k).to_numpy() for k in range(len(names))])
            n += batch.num_rows
            if n > COMBINED:
                yield from combine(*taken(False))
        if n:
            yield from combine(*taken(True))

    return keyed.select(*names, PART).mapInArrow(run, _NODES)


def merge_round(tries: DataFrame, span: int) -> DataFrame:
    """Partial tries of the same span of partitions merged: members added, the least taken, lists one after the other.

    A node whose lists in a span are more than a block together keeps its rows, in order, so none grows without bound.
    """
    sized = tries.withColumn("span", F.floor(F.col("part") / span)).withColumn("total", F.sum(F.coalesce(F.length("ends"), F.lit(0))).over(W.partitionBy("k1", "k2", "span")))
    short = sized.where(F.col("total") <= BLOCK).groupBy("k1", "k2", "span").agg(
        *[F.min(c).alias(c) for c in ("p1", "p2", "depth", "size", "part")], F.min("seq").alias("seq"), F.sum("n").alias("n"), F.min("least").alias("least"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("ends").isNotNull(), F.struct("part", "seq", "ends")))), lambda x: x["ends"]), ",").alias("ends"),
    )
    short = short.withColumn("ends", F.nullif("ends", F.lit("")))
    return short.select(*_NAMES).union(sized.where(F.col("total") > BLOCK).select(*_NAMES))


def merged_nodes(tries: DataFrame) -> DataFrame:
    """(k1, k2, p1, p2, depth, size, n, least, ends_sha256): one row a node, from partial tries merged in rounds.

    A node's blocks of ids meet in order at the end, one at a time, as SHA-256 takes them.
    """
    tries, span = cut(tries), MERGED
    parts = (tries.agg(F.max("part")).first()[0] or 0) + 1
    while span // MERGED < parts:
        tries = cut(merge_round(tries, span))
        span *= MERGED
    fixed = ("k1", "k2", "p1", "p2", "depth", "size")

    def run(batches):
        current, n, least, digest, empty = None, 0, 0, None, True
        out = [[] for _ in range(len(fixed) + 3)]

        def close():
            for column, x in zip(out, (*current, n, least, digest.hexdigest()), strict=True):
                column.append(x)

        def table():
            kinds = [pa.int64()] * (len(fixed) + 2) + [pa.string()]
            found = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[*fixed, "n", "least", "ends_sha256"])
            for c in out:
                c.clear()
            return found

        for batch in batches:
            for *node, members, smallest, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != current:
                    if current is not None:
                        close()
                    current, n, least, digest, empty = node, 0, smallest, hashlib.sha256(), True
                n, least = n + members, min(least, smallest)
                if ends:
                    digest.update((ends if empty else "," + ends).encode())
                    empty = False
            if out[0]:
                yield table()
        if current is not None:
            close()
            yield table()

    dealt = tries.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "part", "seq").select(*fixed, "n", "least", "ends")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in fixed) + ", n long, least long, ends_sha256 string")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """nodes with n_children, parent_least, n_leaves and saved of their subtrees.

    Bottom-up by paths: each path's own sums go to the node that it hangs from, and on from path to path until
    the root's, one step a level of paths; what has come to each node is then summed along its path
    from the bottom. Levels are at most the turns of the longest conversation, and few where ids come
    in no special order.
    """
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    known = nodes.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    known = cut(known.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n") - 1) * F.col("size")}))
    paths = known.groupBy("least").agg(F.min(F.struct("depth", "p1", "p2")).alias("top"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    hanging = paths.where("top.depth > 0").select("least", F.col("top.p1").alias("k1"), F.col("top.p2").alias("k2"), "leaves", "saved")
    hosts = cut(hanging.join(known.select("k1", "k2", F.col("least").alias("host"), F.col("depth").alias("at")), ["k1", "k2"]).select("least", "host", "at", "leaves", "saved"))
    sums = F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    arrived, now = [hosts.select("least", (F.col("at") + 1).alias("depth"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), "host")], hosts
    while True:
        got = cut(now.groupBy(F.col("host").alias("least"), F.col("at").alias("depth")).agg(*sums))
        if got.isEmpty():
            break
        arrived.append(got.withColumn("host", F.lit(None).cast("long")))
        if len(arrived) > 8:
            arrived = [cut(_union(arrived))]
        now = got.groupBy("least").agg(*sums).join(hosts.select("least", "host", "at"), "least")
    more = _union(arrived).groupBy("least", "depth").agg(F.sum("leaves").alias("leaves_in"), F.sum("saved").alias("saved_in"), F.max("host").alias("host"))
    rows = known.join(more, ["least", "depth"], "left").withColumns({"leaves": F.col("leaves") + F.coalesce("leaves_in", F.lit(0)), "saved": F.col("saved") + F.coalesce("saved_in", F.lit(0))})
    rows = rows.select("least", "depth", "n", "n_children", "ends_sha256", "host", "leaves", "saved")
    found = running(range_sorted(rows, F.col("least"), F.col("depth").desc()), "least", {"n_leaves": F.col("leaves"), "saved_tokens": F.col("saved")})
    return found.withColumn("parent_least", F.when(F.col("depth") > 0, F.coalesce("host", "least")))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes of the rebuilt conversations' prefix trie, as the rows that this module's functions describe.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256). Null roles and
    texts are empty, a null turn comes first, turns that share a place are ordered by digest and rows
    that repeat are turns of their own. Rows without an id belong to no conversation. Long texts leave
    only their digest. An empty table has no root and gives no rows; other columns are ignored.
    Sorted ranges, not keys, deal out turns, so one conversation may hold most of them; a node that most
    conversations share is one row a partition.
    """
    tries = partial_tries(_with_keys(rebuild(turn_digests(conversations, id_col, turn_col, role_col, text_col))))
    found = subtree_sums(cut(merged_nodes(tries)))
    return found.select(F.col("least").alias(id_col), "depth", F.col("parent_least").alias(f"parent_{id_col}"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "ends_sha256")
