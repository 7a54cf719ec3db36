"""Token-ID output: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

Every id is replaced by its rank by corpus frequency, so that common ids take one byte. A file is a
run of blocks, each followed by a line feed:

    b"ELT1", uint32 documents, uint32 ids, uint32 data bytes,
    int64 document id each (-2**63: null), uint32 count of ids each,
    control bytes (two bits an id, its length - 1, four ids a byte), data bytes (little-endian ranks)

Decoding looks each control byte up in a table of four lengths. Files are written by Spark's own
writer, one folder part=N for each range of document ids, in ascending order, beside the table of
ranks (one row for each id in use, so bounded by the vocabulary), and read back by Spark.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm import textkernels as K
from edgeloom.llm.common import cut, partitions_for, remove_folder, shared_folder, small_batches, unique_name

END_ID = 2
PART_BYTES = 16 << 20
BLOCK_IDS = 1 << 20
CACHED_PIECES = 800_000
_MAGIC = b"ELT1"
_NULL_ID = -(2**63)
_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)

# Where a text may be cut without any token crossing the cut: at white space, and between letters,
# digits and other ASCII signs. Letters are those of ASCII and the Latin ones of two bytes that the
# tokenizer is found to take like them. All other bytes from 0x80 on (they may combine), the apostrophe
# (contractions) and < and | (names of special tokens) stay with both neighbours.
_SPACE, _LETTER, _DIGIT, _SIGN, _GLUE = range(5)
_LATIN = range(0xC0, 0x250)


def _kind(b: int) -> int:
    if b == 0x20 or 0x09 <= b <= 0x0D:
        return _SPACE
    if b >= 0x80 or chr(b) in "'<|":
        return _GLUE
    return _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SIGN


_KIND = np.array([_kind(b) for b in range(256)], np.uint8)


def _pieces(data: np.ndarray, offs: np.ndarray, latin: np.ndarray) -> tuple[K.Words, np.ndarray]:
    """Pieces that can be encoded each for itself; whether a piece holds bytes that stay glued.

    latin tells, by the lead byte less 0xC0 and the six bits of the second, which letters of two bytes
    count as letters.
    """
    n = len(data)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return K.Words(zero, zero, np.zeros(len(offs), np.int64)), np.zeros(0, bool)
    kind = _KIND[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    lead = lead[latin[data[lead] - 0xC0, data[lead + 1] & 0x3F]]
    kind[lead] = kind[lead + 1] = _LETTER
    before, here = kind[:-1], kind[1:]
    new = np.ones(n, bool)
    new[1:] = (before != here) & (before != _GLUE) & (here != _GLUE) | (before == _SPACE) | ((here == _DIGIT) & (before == _DIGIT))
    new[offs[(offs > 0) & (offs < n)]] = True
    new &= kind != _SPACE
    start = np.flatnonzero(new)
    stop = new.copy()
    stop |= kind == _SPACE
    stop[offs[(offs > 0) & (offs < n)]] = True
    cuts = np.append(np.flatnonzero(stop), n)
    end = cuts[np.searchsorted(cuts, start, side="right")]
    glue = np.concatenate(([0], np.cumsum(kind == _GLUE, dtype=np.int32)))
    return K.Words(start, end, np.searchsorted(start, offs)), glue[end] > glue[start]


class _Table:
    """Slots by 64-bit key, in open addressing: a place, then the ones behind it."""

    def __init__(self, most: int):
        bits = max(8, int(2 * most).bit_length())
        self.keys, self.slots, self.mask = np.zeros(1 << bits, K.U64), np.full(1 << bits, -1, np.int32), K.U64((1 << bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for an absent one."""
        out, open_, at = np.full(len(keys), -1, np.int32), np.arange(len(keys)), keys & self.mask
        while len(open_):
            slots, same = self.slots[at], self.keys[at] == keys[open_]
            found = same & (slots >= 0)
            out[open_[found]] = slots[found]
            on = ~same & (slots >= 0)
            open_, at = open_[on], (at[on] + K.U64(1)) & self.mask
        return out

    def add(self, keys: np.ndarray, slots: np.ndarray) -> None:
        """Enter different keys, none of which is there."""
        open_, at = np.arange(len(keys)), keys & self.mask
        while len(open_):
            free = self.slots[at] < 0
            self.slots[at[free]] = slots[open_[free]]  # of several for one place, the last stays
            entered = free & (self.slots[at] == slots[open_])
            self.keys[at[entered]] = keys[open_[entered]]
            open_, at = open_[~entered], (at[~entered] + K.U64(1)) & self.mask


class Encoder:
    """A tokenizer of the tokenizers library with the ids of recent pieces kept, at most so many."""

    def __init__(self, path: str, cached: int = CACHED_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism here
        from tokenizers import Tokenizer

        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.latin = self._latin_letters() if suffix else np.zeros((16, 64), bool)
        self.splits = bool(suffix) and self._cuts_hold()
        self.clear()

    def _latin_letters(self) -> np.ndarray:
        """The letters of two bytes that stand in a word like those of ASCII: not cut there, but before and behind a sign."""
        out = np.zeros((16, 64), bool)
        for code in (c for c in _LATIN if chr(c).isalpha()):
            c = chr(code)
            ids = self._ids([f"a{c}b", f"{c}", f"{c},", f",{c}", ",", f"1{c}", f"{c}1", "1"])
            one = all(self.ends[x].sum() == 1 and self.ends[x[-1]] for x in (ids[0], ids[1]) if x) and ids[0] and ids[1]
            if one and ids[2] == ids[1] + ids[4] and ids[3] == ids[4] + ids[1] and ids[5] == ids[7] + ids[1] and ids[6] == ids[1] + ids[7]:
                out[(0xC0 | code >> 6) - 0xC0, code & 0x3F] = True
        return out

    def _cuts_hold(self) -> bool:
        """Whether this tokenizer drops white space and cuts where _pieces does, tried at each ASCII sign."""
        signs = [chr(b) for b in range(0x21, 0x7F) if _KIND[b] == _SIGN]
        probe = "Ab, cd!! 12x e3.\n(f) gh " + " ".join(f"a{c}B {c}1{c}2{c}{c}z {d}{c}" for c, d in zip(signs, signs[1:] + signs[:1], strict=True))
        data = np.frombuffer(probe.encode(), np.uint8)
        words, _ = _pieces(data, np.array([0, len(data)]), self.latin)
        parts = [probe[a:b].lower() for a, b in zip(words.start, words.end, strict=True)]
        return self._ids([probe])[0] == [i for x in self._ids(parts) for i in x]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def clear(self) -> None:
        """A slot holds a piece: its ids and, to compare, its length, its bytes and whether it is glued."""
        self.table, self.slots = _Table(self.cached), 0
        self.size, self.at = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.length, self.byte, self.glued = np.zeros(1024, np.int32), np.zeros(1024, np.int64), np.zeros(1024, bool)
        self.bytes, self.filled = np.zeros(1 << 16, np.uint8), 0

    def _add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, content: np.ndarray, glued: np.ndarray) -> None:
        k, n = self.slots, len(keys)
        while k + n > len(self.size):
            for name in ("size", "at", "length", "byte", "glued"):
                setattr(self, name, np.resize(getattr(self, name), 2 * len(getattr(self, name))))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while self.filled + len(content) > len(self.bytes):
            self.bytes = np.resize(self.bytes, 2 * len(self.bytes))
        self.flat[self.used : self.used + len(ids)] = ids
        self.bytes[self.filled : self.filled + len(content)] = content
        self.size[k : k + n], self.length[k : k + n], self.glued[k : k + n] = sizes, lengths, glued
        self.at[k : k + n] = self.used + np.cumsum(sizes) - sizes
        self.byte[k : k + n] = self.filled + np.cumsum(lengths) - lengths
        self.table.add(keys, np.arange(k, k + n, dtype=np.int32))
        self.slots, self.used, self.filled = k + n, self.used + len(ids), self.filled + len(content)

    def _learn(self, keys: np.ndarray, lengths: np.ndarray, content: np.ndarray, glued: np.ndarray) -> None:
        """Encode new pieces: plain ones many at once, told apart by the ids that end a word."""
        cuts = np.concatenate(([0], np.cumsum(lengths)))
        raw = content.tobytes()
        pieces = [raw[a:b].decode() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

        def add(some, sizes, ids):
            self._add(keys[some], sizes, ids, lengths[some], content[_spans(cuts[:-1][some], lengths[some])], glued[some])

        def each(some):
            if some:
                ids = self._ids([pieces[i] for i in some])
                add(some, np.array([len(x) for x in ids]), np.array([i for x in ids for i in x], np.uint32))

        plain = np.flatnonzero(~glued).tolist()
        for a in range(0, len(plain), 4096):
            some = plain[a : a + 4096]
            ids = np.array([i for x in self._ids([" ".join([pieces[i] for i in some[b : b + 512]]) for b in range(0, len(some), 512)]) for i in x], np.uint32)
            sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(sizes) == len(some):
                add(some, sizes, ids)
            else:
                each(some)
        each(np.flatnonzero(glued).tolist())

    def _whole(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = self._ids([data[a:b].tobytes().decode() for a, b in zip(offs[:-1], offs[1:], strict=True)])
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count of each text): the library's ids of whole texts.

        Pieces are looked up by hash, then compared with the piece that was encoded: by length and
        kind, and byte by byte over 8 bytes, up to which equal hashes of one length and kind are
        equal bytes (one block is mixed, and mixing is one to one). If any piece differs, the texts
        are encoded whole.
        """
        if not self.splits:
            return self._whole(data, offs)
        words, glued = _pieces(data, offs, self.latin)
        lower = K.LOWER[data]
        keys = K.word_hashes(lower, words.start, words.end)
        keys[glued] = K.word_hashes(data, words.start[glued], words.end[glued], seed=1)
        code, unique = pd.factorize(keys)
        if self.slots + len(unique) > self.cached:
            self.clear()
        lengths = words.end - words.start

        def content(some):
            """The bytes of some pieces, one after the other: lower-cased unless glued."""
            at = _spans(words.start[some], lengths[some])
            out, raw = lower[at], np.repeat(glued[some], lengths[some])
            out[raw] = data[at[raw]]
            return out

        slots = self.table.find(unique)
        fresh = np.flatnonzero(slots < 0)
        if len(fresh):
            place = np.zeros(len(unique), np.int64)
            place[code] = np.arange(len(code))
            place = place[fresh]
            self._learn(unique[fresh], lengths[place], content(place), glued[place])
            slots[fresh] = self.table.find(unique[fresh])
        slot = slots[code]
        if (self.length[slot] != lengths).any() or (self.glued[slot] != glued).any():
            return self._whole(data, offs)
        long = np.flatnonzero(lengths > 8)
        if (self.bytes[_spans(self.byte[slot[long]], lengths[long])] != content(long)).any():
            return self._whole(data, offs)
        size = self.size[slot].astype(np.int64)
        return self.flat[_spans(self.at[slot], size)], np.diff(np.concatenate(([0], np.cumsum(size)))[words.doc])


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start[i] .. start[i] + size[i] - 1 of all i, one after the other."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)


_encoders: dict[str, Encoder] = {}


def tokenize(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = END_ID) -> DataFrame:
    """(doc, n, ids): the ids of each text and the end id, packed; a null text counts as empty.

    One row for each row of docs, null and repeated ids included; long texts are encoded whole. An
    empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession, 500)

    def run(batches):
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        encoder = _encoders[tokenizer]
        for batch in batches:
            data, offs = K.text_bytes(batch.column(1))
            for lo, hi in K.slices(batch.num_rows, offs, 1 << 19):
                ids, sizes = encoder.encode(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                out = np.full(len(ids) + len(sizes), end_id, np.uint32)
                out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
                cuts = np.concatenate(([0], np.cumsum(sizes + 1)))
                packed = [_pack(out[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes + 1, pa.int64()), pa.array(packed, pa.binary())], names=["doc", "n", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc long, n long, ids binary")


def _pack(ids: np.ndarray) -> bytes:
    width = np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32
    return bytes([width().nbytes]) + pa.compress(ids.astype(width).tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob[1:], decompressed_size=n * blob[0], codec="zstd", asbytes=True), np.uint16 if blob[0] == 2 else np.uint32)


def _count(batches):
    """How often each id occurs in a batch: all its documents counted at once."""
    for batch in batches:
        parts = [_unpack(blob, n).astype(np.int64) for blob, n in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)]
        total = np.bincount(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks behind control and data bytes."""
    size = _LENGTHS[control].ravel()[:n].astype(np.int64)
    at = np.cumsum(size) - size
    out = np.zeros(n, np.uint32)
    for k in range(4):
        has = np.flatnonzero(size > k)
        out[has] |= data[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _block(docs: list, sizes: list[int], ids: np.ndarray) -> bytes:
    control, data = encode_ranks(ids)
    head = _MAGIC + np.array([len(docs), len(ids), len(data)], "<u4").tobytes()
    return head + np.array([_NULL_ID if d is None else d for d in docs], "<i8").tobytes() + np.array(sizes, "<u4").tobytes() + control + data


def _blocks(content: bytes):
    """(document ids, counts, control bytes, data bytes) of each block of a file."""
    at = 0
    while at < len(content):
        if content[at : at + 4] != _MAGIC:
            raise ValueError(f"no block starts at byte {at}")
        docs, ids, size = (int(x) for x in np.frombuffer(content, "<u4", 3, at + 4))
        at += 16
        parts = []
        for dtype, n in (("<i8", docs), ("<u4", docs), (np.uint8, -(-ids // 4)), (np.uint8, size)):
            parts.append(np.frombuffer(content, dtype, n, at))
            at += parts[-1].nbytes
        yield parts
        at += 1


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = END_ID, part_bytes: int = PART_BYTES) -> None:
    """Tokenize docs and write their ids under path, in ascending order of document id (nulls first).

    A document is a row: rows that repeat an id (or have none) are written one after the other,
    ordered by a hash of their token ids, so that they may take several files. Null and empty texts
    give the end id alone, long ones stay whole. An empty table writes an empty folder. Other columns
    are ignored.
    """
    tokens = cut(tokenize(docs, tokenizer, id_col, text_col, end_id=end_id))
    spark = docs.sparkSession
    counts = tokens.select("n", "ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranks = sorted(counts.collect(), key=lambda r: (-r.n, r.id))  # one row for each id of the vocabulary at most
    table = np.array([r.id for r in ranks], np.int64)
    spark.createDataFrame([(k, int(i)) for k, i in enumerate(table)], "rank int, id long").coalesce(1).write.mode("overwrite").parquet(f"{path}/ranks")
    rank_of = np.zeros(int(table.max(initial=0)) + 1, np.uint32)
    rank_of[table] = np.arange(len(table))
    shared = spark.sparkContext.broadcast(rank_of)

    def run(batches):
        part, held, sizes, ids, n = TaskContext.get().partitionId(), [], [], [], 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_block(held, sizes, np.concatenate(ids))], pa.binary())], names=["part", "block"])

        for batch in batches:
            for doc, count, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n and n + count > BLOCK_IDS:
                    yield block()
                    held, sizes, ids, n = [], [], [], 0
                held.append(doc)
                sizes.append(count)
                ids.append(shared.value[_unpack(blob, count)])
                n += count
        if held:
            yield block()

    total = tokens.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    dealt = tokens.withColumn("h", F.xxhash64("ids")).repartitionByRange(partitions_for(spark, total, part_bytes), "doc", "h")
    parts = dealt.sortWithinPartitions("doc", "h", "ids").drop("h")
    parts.mapInArrow(run, "part int, block binary").select("part", F.col("block").cast("string")).write.mode("overwrite").partitionBy("part").text(f"{path}/data")


def _files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/data")
    return found.select(F.regexp_extract("path", r"/part=(\d+)/", 1).cast("int").alias("part"), "content")


def _decoded(spark: SparkSession, path: str, column: str, value) -> DataFrame:
    """(part, doc_id, offset, n_tokens, column): value makes the last column ("name type") from a document's ids."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # bounded by the vocabulary
    shared = spark.sparkContext.broadcast(np.array([r.id for r in ranks], "<u4"))
    name, kind = column.split()

    def run(batches):
        for batch in batches:
            for part, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                offset = 0
                for docs, sizes, control, data in _blocks(content.as_buffer().to_pybytes()):
                    ids = shared.value[decode_ranks(control, data, int(sizes.sum()))]
                    cuts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part] * len(docs), pa.int32()),
                            pa.array(docs, mask=docs == _NULL_ID),
                            pa.array(offset + cuts[:-1]),
                            pa.array(sizes.astype(np.int64)),
                            pa.array([value(ids[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary() if kind == "binary" else pa.int64()),
                        ],
                        names=["part", "doc_id", "offset", "n_tokens", name],
                    )
                    offset += int(cuts[-1])

    return _files(spark, path).mapInArrow(run, f"part int, doc_id long, offset long, n_tokens long, {column}")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(part, doc_id, offset, n_tokens, ids): ids as little-endian unsigned 32-bit integers.

    offset counts the part's ids before the document.
    """
    return _decoded(spark, path, "ids binary", lambda ids: ids.tobytes())


def scratch_path(spark: SparkSession) -> str:
    """A new place for token files in the folder that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{unique_name('token-files')}"


def document_index(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document of the files at path.

    start counts the ids of all documents before: those of the parts before, of which there is one sum
    a part, and the offset within. Files are decoded once; a checkpoint holds a narrow row a document
    and no ids. Null and repeated ids have a row each, documents without words one with the end id
    alone; files of an empty table give no rows.
    """
    rows = cut(_decoded(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.tobytes())))
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    starts = totals.selectExpr("part", "sum(n) OVER (ORDER BY part) - n AS part_start")  # a row a file
    return rows.join(starts, "part").select(F.col("doc_id").alias(id_col), (F.col("part_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = END_ID) -> DataFrame:
    """Write token files and read them back as document_index does.

    One row for each row of docs; nulls, empty and long texts, repeated rows, empty tables and other
    columns as in write_token_files. Files written where no path is given go once they are decoded.
    """
    spark, at = docs.sparkSession, path or scratch_path(docs.sparkSession)
    write_token_files(docs, at, tokenizer, id_col, text_col, end_id=end_id)
    index = document_index(spark, at, id_col)
    if path is None:
        remove_folder(spark, at)
    return index
