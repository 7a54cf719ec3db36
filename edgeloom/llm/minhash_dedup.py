"""MinHash near-dedup by an inverted join over signature coordinates.

A document's set holds its distinct five-word shingles. Each set gets a signature of ``coords``
minima. Documents are posted under every (coordinate, value) pair; the pair's posting count is its
global frequency. Two sets that reach the wanted similarity agree in about ``coords * similarity``
coordinates, so ``matches`` of them are required of a candidate (64 and 24 at 0.75: a binomial tail
of 5e-11 is all that this can lose). That makes it an overlap join with three exact cuts:

- skip: coordinates that nobody shares are dropped, and with them each document that has fewer than
  ``matches`` shared ones;
- prefix: ordered by ascending frequency, two documents with ``matches`` common coordinates share one
  among their first ``shared - matches + 1``, so only those are posted for merging. A shorter prefix
  would lose pairs: a rare passage that a document shares with others stands before its group's
  coordinates;
- skip merging: a first merge pairs each document with the one list leader it meets most often, a
  second one with the document it collides with most within its block of a long list; lists whose
  members these links join into one component are skipped. In the rest, the documents outside of the
  list's largest component are compared with all its documents, block against block, each pair in the
  first list that it shares. A long list is cut by set size too: sets that link differ by at most
  ``100 / percent`` in size, so a block meets only blocks of its own and the two neighbouring classes
  of sizes, and in a cell only pairs whose sizes allow a link. Comparing counts the collisions of each pair over ``long_coords``
  coordinates of one byte and retains the pairs with ``long_matches`` or more, so that documents that
  share half of their text don't pass (256 and 145 at 0.75: a tail of 5e-11). A block comparison
  passes on a spanning forest of what it finds, never its pairs.

Links are confirmed on the full shingle sets: those of the first two merges pair by pair, then in each
family of candidates what is outside of its largest component against all, block against block, all
intersections of two blocks being one product of their document x shingle matrices. Again only a
spanning forest of the confirmed links is returned. Equal sets are one class from the start. So
neither copies nor near copies become pairs.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm import textkernels as K
from edgeloom.llm.common import components, cut, small_batches

COORDS, MATCHES, SHINGLE, PERCENT = 64, 24, 5, 75
LONG_COORDS, LONG_MATCHES = 256, 145
#: Members of a posting list that meet in one task at a time.
BLOCK = 256
#: Lists of more blocks than this are cut by classes of set sizes; a document of one then meets three classes.
FEW_BLOCKS = 4
#: Members of a family whose full sets meet in one task at a time.
FAMILY_BLOCK = 128
#: Lists of a document, the most frequent ones posted, in which the second merge looks for its nearest document.
NEAREST_LISTS = 3


def _factors(coords: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, coords + 1, dtype=K.U64)
    return K.mix(i * K.U64(0xD1B54A32D192ED03)) | K.U64(1), K.mix(i * K.U64(0x8CB92BA72F3D8DD7))


def _shingles(data, words: K.Words, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    hashes = K.word_hashes(K.LOWER[data], words.start, words.end)
    windows = K.window_hashes(hashes, size)
    out = []
    for lo, hi in zip(words.doc[:-1], words.doc[1:], strict=True):
        if hi - lo >= size:
            out.append(np.unique(windows[lo : hi - size + 1]))
        elif hi > lo:
            out.append(K.window_hashes(hashes[lo:hi], int(hi - lo), seed=7))
        else:
            out.append(np.zeros(0, K.U64))
    return out


def _signature(sets: np.ndarray, factors) -> np.ndarray:
    a, b = factors
    least = None
    for i in range(0, len(sets), 4096):
        part = ((sets[i : i + 4096, None] * a + b) >> K.U64(33)).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least.astype(np.int64) | (np.arange(len(a), dtype=np.int64) << 31)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, coords: int = COORDS, size: int = SHINGLE) -> DataFrame:
    """(doc, n, h1, h2, sig): set size, 128-bit hash of the set, one value per coordinate.

    A value holds its coordinate in its upper bits. Without words n is 0 and sig null.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        factors = _factors(coords)
        for batch in batches:
            for lo, hi in K.slices(batch.num_rows, K.text_bytes(batch.column(1))[1]):
                data, offs = K.text_bytes(batch.column(1).slice(lo, hi - lo))
                sets = _shingles(data, K.find_words(data, offs, K.SPACE_SEPARATED), size)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([int(K.mix(s).sum().view(np.int64)) for s in sets], pa.int64()),
                        pa.array([int(K.mix(s ^ K.U64(0x5851F42D4C957F2D)).sum().view(np.int64)) for s in sets], pa.int64()),
                        pa.array([_signature(s, factors) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc", "n", "h1", "h2", "sig"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc long, n long, h1 long, h2 long, sig array<long>")


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, packed): texts compressed, so that the one shuffle of texts is a small one."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            packed = [None if not t.is_valid else pa.compress(t.as_buffer(), codec="zstd", asbytes=True) for t in texts]
            sizes = [0 if not t.is_valid else len(t.as_buffer()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(sizes, pa.int64())], names=["doc", "packed", "size"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc long, packed binary, size long")


def _confirm(pairs: DataFrame, packed: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""

    def run(batches):
        for batch in batches:
            known: dict[tuple, np.ndarray] = {}

            def shingles(doc, blob, n, known=known):
                if (found := known.get((doc, n, blob[-8:]))) is None:
                    data = np.frombuffer(pa.decompress(blob, decompressed_size=n, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
                    found = known[(doc, n, blob[-8:])] = _shingles(data, K.find_words(data, np.array([0, n]), K.SPACE_SEPARATED), size)[0]
                    while len(known) > 64:
                        known.pop(next(iter(known)))
                return found

            a, b, pa_, pb, na, nb = (batch.column(i).to_pylist() for i in range(6))
            keep = []
            for row in zip(a, b, pa_, pb, na, nb, strict=True):
                x, y = shingles(row[0], row[2], row[4]), shingles(row[1], row[3], row[5])
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = packed.select(F.col("doc").alias("a"), F.col("packed").alias("pa"), F.col("size").alias("na"))
    right = packed.select(F.col("doc").alias("b"), F.col("packed").alias("pb"), F.col("size").alias("nb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb", "na", "nb")
    return both.where("pa IS NOT NULL AND pb IS NOT NULL").mapInArrow(run, "a long, b long")


def _long_signatures(packed: DataFrame, size: int, coords: int) -> DataFrame:
    """(doc, n, long): set size, and one byte of each of so many minima."""

    def run(batches):
        a, b = _factors(coords + COORDS)
        factors = a[COORDS:], b[COORDS:]
        for batch in batches:
            out, counts = [], []
            for blob, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = np.frombuffer(pa.decompress(blob, decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
                sets = _shingles(data, K.find_words(data, np.array([0, n]), K.SPACE_SEPARATED), size)[0]
                counts.append(len(sets))
                out.append(_signature(sets, factors).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(out, pa.binary())], names=["doc", "n", "long"])

    return packed.where("packed IS NOT NULL").select("doc", "packed", "size").mapInArrow(run, "doc long, n long, long binary")


def _size_class(percent: int) -> Column:
    """Sets of n elements that link are in the same class or in neighbouring ones."""
    return F.floor(F.ln("n") / (max(log(100 / percent), 0.05) * (1 + 1e-6))).cast("long")


def _sizes_allow(one: np.ndarray, two: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can reach the similarity at all."""
    return 100 * np.minimum(one, two) >= percent * np.maximum(one, two)


def _cells(rows: DataFrame, key: str, columns: list[str], block: int, size_class: Column | None = None) -> DataFrame:
    """(i, j, members): of each key, the rows outside of its largest component against all, block against block.

    So no task gets a whole key, and the more of a key is joined already, the fewer cells it has. Keys of
    more than ``FEW_BLOCKS`` blocks are cut by size_class too, and a block meets those of its class and its two
    neighbours only. What gathers rows does so under one column, so that no stage is dealt by the key alone.
    """
    rows = rows.withColumn("cls", F.lit(0).cast("long") if size_class is None else size_class)
    parts = rows.groupBy(key, "comp", "cls").agg(F.count("*").alias("n_rows"))
    tops = parts.groupBy(key, "comp").agg(F.sum("n_rows").alias("n_comp")).groupBy(key).agg(F.max(F.struct("n_comp", "comp")).alias("top"), F.sum("n_comp").alias("n_members"))
    tops = tops.where("n_members > top.n_comp").select(key, F.col("top.comp").alias("top"), (F.col("n_members") <= FEW_BLOCKS * block).alias("few"))
    used = F.when(F.col("few"), 0).otherwise(F.col("cls")).alias("cls")
    inside = F.col("comp") == F.col("top")
    sizes = parts.join(tops, key).groupBy(F.struct(key, "top", "few", used).alias("at")).agg(
        F.ceil(F.sum(F.when(inside, 0).otherwise(F.col("n_rows"))) / block).alias("rest"), F.ceil(F.sum(F.when(inside, F.col("n_rows")).otherwise(0)) / block).alias("others")
    )
    blocks = F.map_from_entries(F.collect_list(F.struct("cls", F.struct("rest", "others")))).alias("blocks")
    counts = cut(sizes.select("at.*", "rest", "others").groupBy(key, "top", "few").agg(blocks))

    number = lambda cls, k: F.shiftleft(cls, 32) + k
    own = F.try_element_at("blocks", F.col("cls"))
    place = lambda n: F.pmod(F.xxhash64("doc"), F.greatest(F.lit(1), n))
    dealt = rows.join(counts, key).withColumn("cls", used)
    dealt = dealt.withColumn("block", number(F.col("cls"), F.when(inside, own["rest"] + place(own["others"])).otherwise(place(own["rest"]))))

    def met(cls):
        there = F.try_element_at("blocks", cls)
        n = F.coalesce(there["rest"] + F.when(inside, 0).otherwise(there["others"]), F.lit(0))
        return F.transform(F.filter(F.sequence(F.lit(0).cast("long"), n), lambda k: k < n), lambda k: number(cls, k))

    dealt = dealt.withColumn("other", F.explode(F.flatten(F.array(*[met(F.col("cls") + step) for step in (-1, 0, 1)]))))
    cells = dealt.groupBy(F.struct(key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).alias("cell"))
    return cells.agg(F.collect_list(F.struct("doc", "comp", "block", *columns)).alias("members")).select("cell.i", "cell.j", "members")


def _nearest(lists: DataFrame, block: int, matches: int, percent: int) -> DataFrame:
    """(a, b): each document of lists(key, doc, comp, long, n) with the smaller one of another component that it collides with most in its block."""

    def run(batches):
        for batch in batches:
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row in batch.column(0):
                doc, comp = (np.asarray(row.values.field(f)) for f in (0, 1))
                sig = np.frombuffer(b"".join(row.values.field(2).to_pylist()), np.uint8).reshape(len(doc), -1)
                order = np.argsort(doc, kind="stable")
                doc, comp, sig, n = doc[order], comp[order], sig[order], np.asarray(row.values.field(3))[order]
                for k in range(1, len(doc)):
                    met = np.where((comp[:k] != comp[k]) & _sizes_allow(n[:k], n[k], percent), (sig[:k] == sig[k]).sum(axis=1), 0)
                    if met[best := int(np.argmax(met))] >= matches:
                        left.append(doc[best : best + 1])
                        right.append(doc[k : k + 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    counts = cut(lists.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "blocks"))
    dealt = lists.join(counts, "key").groupBy("key", F.pmod(F.xxhash64("doc", "key"), F.col("blocks")).alias("block"))
    return dealt.agg(F.collect_list(F.struct("doc", "comp", "long", "n")).alias("members")).select("members").mapInArrow(run, "a long, b long").distinct()


def _forest(doc: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links p-q between positions: each linked document and the smallest one it is connected to."""
    label, old = doc.copy(), None
    while old is None or (label != old).any():
        old = label.copy()
        np.minimum.at(label, p, old[q])
        np.minimum.at(label, q, old[p])
    on = np.unique(np.concatenate([p, q]))
    on = on[label[on] != doc[on]]
    return label[on], doc[on]


def _connect(cells: DataFrame, find) -> DataFrame:
    """(a, b): a spanning forest of the links that find(members, first, second) sees in each cell."""

    def run(batches):
        for batch in batches:
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row in range(batch.num_rows):
                i, j = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                members = batch.column(2)[row].values
                doc, comp, block = (np.asarray(members.field(f)) for f in (0, 1, 2))
                one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
                near = comp[one][:, None] != comp[two]
                if i == j:
                    near &= doc[one][:, None] < doc[two]
                if near.any():
                    near &= find(members, one, two)
                    p, q = np.nonzero(near)
                    a, b = _forest(doc, one[p], two[q])
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def _alike(matches: int, percent: int):
    """Pairs with enough collisions, each in the first list (the rarest first) that it shares: there are no common lists before."""

    def find(members, one, two):
        sig = np.frombuffer(b"".join(members.field(3).to_pylist()), np.uint8).reshape(len(members), -1)
        other = sig[two]
        n = np.asarray(members.field(5))
        near = np.zeros((len(one), len(two)), bool)
        for row, k in enumerate(one):
            fits = np.flatnonzero(_sizes_allow(n[two], n[k], percent))
            near[row, fits] = (other[fits] == sig[k]).sum(axis=1) >= matches
        lists = members.field(4)
        column, count = np.unique(np.asarray(lists.flatten()), return_inverse=True, return_counts=True)[1:]
        owner, shared = np.repeat(np.arange(len(members)), np.diff(np.asarray(lists.offsets))), count[column] > 1
        if near.any() and shared.any():
            owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
            for low in range(0, int(column.max()) + 1, 8192):
                part = (column >= low) & (column < low + 8192)
                dense = np.zeros((len(members), 8192), np.float32)
                dense[owner[part], column[part] - low] = 1
                near &= dense[one] @ dense[two].T == 0
        return near

    return find


def _similar(size: int, percent: int):
    """Exact: sizes of all intersections as products of document x shingle matrices, some columns at a time."""

    def find(members, one, two):
        sets = []
        for blob, n in zip(members.field(3).to_pylist(), members.field(4).to_pylist(), strict=True):
            data = np.frombuffer(pa.decompress(blob, decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
            sets.append(_shingles(data, K.find_words(data, np.array([0, n]), K.SPACE_SEPARATED), size)[0])
        sizes = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[column] > 1
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((len(one), len(two)))
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
            a, b = np.searchsorted(column, (low, low + 8192))
            dense = np.zeros((len(sets), 8192), np.float32)
            dense[owner[a:b], column[a:b] - low] = 1
            both += dense[one] @ dense[two].T
        return (both > 0) & (100 * both >= percent * (sizes[one][:, None] + sizes[two] - both))

    return find


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    percent: int = PERCENT,
    size: int = SHINGLE,
    coords: int = COORDS,
    matches: int = MATCHES,
    long_coords: int = LONG_COORDS,
    long_matches: int = LONG_MATCHES,
) -> DataFrame:
    """One row per document id: (id, n_shingles, component_id, kept).

    Documents link when 100 * |A & B| >= percent * |A | B| over their shingle sets; component_id is
    the smallest id reachable over links, kept says whether that is the document itself. A document
    with fewer words than a shingle has its whole word sequence as its one shingle; an empty, blank
    or null text has no set and links with nothing. Rows that repeat an id are one document, linked
    if any of its texts is, with n_shingles of the largest. A null id links with nothing, gives one
    row and is kept. Ties in id order cannot occur; other columns are ignored.
    """
    rows = cut(signatures(docs, id_col, text_col, coords=coords, size=size))
    some = rows.where("n > 0 AND doc IS NOT NULL")
    classes = cut(some.groupBy("n", "h1", "h2").agg(F.min_by(F.struct("doc", "sig"), "doc").alias("r")).select("n", "h1", "h2", "r.doc", "r.sig"))

    posted = classes.select("doc", F.explode("sig").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("freq"), F.min("doc").alias("leader")).where("freq > 1")
    found = posted.join(shared, "key").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("freq", "key", "leader"))).alias("entries"))
    active = found.where(F.size("entries") >= matches).select(
        "doc", F.expr(f"slice(entries, 1, size(entries) - {matches} + 1)").alias("prefix")
    )
    active = cut(active)

    packed = cut(_packed(docs, id_col, text_col).join(active.select("doc"), "doc"))
    leaders = active.select("doc", F.explode("prefix.leader").alias("leader")).where("doc > leader")
    met = leaders.groupBy("doc", "leader").agg(F.count("*").alias("met"))
    first = met.groupBy("doc").agg(F.max(F.struct("met", -F.col("leader"))).alias("best"))
    first = first.select((-F.col("best")["col2"]).alias("a"), F.col("doc").alias("b"))
    links = cut(_confirm(first, packed, size, percent))

    posted, lists = _mixed(active, links)
    signed = cut(_long_signatures(packed.join(lists.select("doc").distinct(), "doc"), size, long_coords))
    few = posted.select("doc", "comp", F.explode(F.slice(F.reverse("key"), 1, NEAREST_LISTS)).alias("key")).join(signed, "doc")
    links = cut(links.union(_confirm(_nearest(few, BLOCK, long_matches, percent), packed, size, percent)))

    posted, lists = _mixed(active, links)
    cells = _cells(lists.join(signed, "doc"), "key", ["long", "before", "n"], BLOCK, _size_class(percent))
    families = cut(components(_connect(cells, _alike(long_matches, percent))))
    members = families.join(posted.select("doc", "comp"), F.col("node") == F.col("doc")).join(packed.where("packed IS NOT NULL"), "doc")
    members = members.select(F.col("component").alias("family"), "doc", "comp", "packed", "size")
    more = cut(_connect(_cells(members, "family", ["packed", "size"], FAMILY_BLOCK), _similar(size, percent)))

    same = some.join(classes.select("n", "h1", "h2", F.col("doc").alias("first")), ["n", "h1", "h2"])
    member = same.select("doc", "first")
    final = components(links.union(more).union(_repeats(member)))
    out = member.join(final, member["first"] == final["node"], "left").select("doc", F.coalesce("component", "first").alias("component"))
    out = out.groupBy("doc").agg(F.min("component").alias("component"))
    sizes = rows.groupBy("doc").agg(F.max("n").alias("n"))
    return sizes.join(out, "doc", "left").select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc").alias("component_id"),
        (F.col("doc").isNull() | F.coalesce(F.col("component") == F.col("doc"), F.lit(True))).alias("kept"),
    )


def _mixed(active: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """posted(doc, comp, key array) under the components of links; lists(key, doc, comp, before) of the keys with several components.

    before has the document's keys that precede the list's.
    """
    joined = cut(components(links))
    posted = cut(active.join(joined, active.doc == joined.node, "left").select("doc", F.coalesce("component", "doc").alias("comp"), F.col("prefix.key").alias("key")))
    lists = posted.select("doc", "comp", F.posexplode("key").alias("at", "key"), F.col("key").alias("keys"))
    lists = lists.select("doc", "comp", "key", F.slice("keys", F.lit(1), F.col("at")).alias("before"))
    mixed = cut(lists.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"))
    return posted, cut(lists.join(mixed, "key"))


def _repeats(member: DataFrame) -> DataFrame:
    """Links between the classes that the texts of one repeated id fall into, and to the id itself."""
    by_id = member.groupBy("doc").agg(F.min("first").alias("lo"), F.max("first").alias("hi"))
    return by_id.where("lo < hi").select(F.col("lo").alias("a"), F.col("hi").alias("b"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stand for their group: the smallest id of each component; null ids stay."""
    gone = near_duplicates(docs, id_col, text_col, **options).where("NOT kept").select(F.col(id_col).alias("__gone"))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
