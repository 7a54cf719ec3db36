"""Scan of source trees: listing, references per file, resolution by join, classification, graph.

One small tokenizer runs over the bytes of each file (mapInArrow); listing, exclusions, boundaries,
ignore comments, resolution and normalization are DataFrame operations on its rows.
"""

from __future__ import annotations

import bisect
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.errors import InvalidPattern
from edgeloom.functions.patterns import extension, folder, glob_regex, stem
from edgeloom.model import AVAILABILITIES, CLASSES, KINDS, bit_of
from edgeloom.operators.components import cut
from edgeloom.operators.graph import normalize

# Directories that no scan enters, files that start a project of their own, the root's ignore file.
EXCLUDED = (
    ".git", ".hg", ".svn", ".zig-cache", "zig-cache", "zig-out", "zig-pkg", ".cache",
    "vendor", "deps", "node_modules", "coverage", "dist", "generated", "doc", "docs",
)
MARKERS = ("build.zig.zon", "build.zig")
IGNORE_FILE = ".archignore"
#: Kinds whose targets are paths from the source's folder.
RELATIVE = ("zig_file", "zon_file", "embedded_file")
#: The word before the colon of an ignore comment.
MARKER = "edgeloom"

_TOKEN = re.compile(
    rb"""//[^\n]* | \\\\[^\n]* | @?"(?:[^"\\\n]|\\[^\n])*" | '(?:[^'\\\n]|\\[^\n])*' | @?[A-Za-z_][A-Za-z0-9_]* | [{}()\[\];] | "|'""",
    re.VERBOSE,
)
_CALLS = {b"@import": "import", b"@embedFile": "embedFile", b"@cInclude": "cInclude"}
_CLOSING = {b"}": b"{", b")": b"(", b"]": b"["}
_ESCAPE = re.compile(rb"\\(x[0-9A-Fa-f]{2}|u\{[0-9A-Fa-f]+\}|.)", re.DOTALL)
_SIMPLE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"\\": b"\\", b'"': b'"', b"'": b"'"}


# Listing


def exclusion(pattern: str) -> Column:
    """A column over path: whether the file or a directory above it is excluded.

    A pattern with a leading slash or any separator is matched with paths from the root, with or
    without a slash after a directory; one without is matched with each name.
    """
    bare = pattern.removeprefix("/")
    if not bare:
        raise InvalidPattern(f"empty exclusion {pattern!r}")
    inner = glob_regex(bare).removeprefix("(?sd)^").removesuffix(r"\z")
    if pattern.startswith("/") or "/" in bare or "\\" in bare:
        return F.rlike(F.col("path"), F.lit(rf"(?sd)^(?:{inner})(?:\z|/.*\z|(?<=/).*\z)"))
    return F.exists(F.split(F.col("path"), "/"), lambda name: F.rlike(name, F.lit(rf"(?sd)^(?:{inner})\z")))


def parse_ignore_file(text: str) -> tuple[str, ...]:
    """The patterns of an ignore file: trimmed lines without blank and # ones; negation and . or .. segments are errors."""
    out = []
    for number, line in enumerate(text.split("\n"), 1):
        line = line.strip(" \t\r")
        if not line or line.startswith("#"):
            continue
        bare = re.sub(r"[/\\]+", "/", line.removeprefix("/"))
        if line.startswith("!") or "\0" in line or not bare or bare.startswith("/") or {".", ".."} & set(bare.split("/")):
            raise InvalidPattern(f"line {number} of an ignore file: {line!r}")
        glob_regex(bare)
        out.append(line)
    return tuple(out)


def read_ignore_file(spark: SparkSession, root: str) -> tuple[str, ...]:
    """The patterns of the ignore file in root; none without one.

    Spark's readers pass over names that start with a dot, so this one file is opened through the
    file system that they use.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{IGNORE_FILE}")
    system = at.getFileSystem(conf)
    if not system.exists(at):
        return ()
    stream = system.open(at)
    try:
        return parse_ignore_file(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def exclude(rows: DataFrame, patterns=()) -> DataFrame:
    """rows(path, ...) without the files that any pattern excludes."""
    for p in patterns:
        rows = rows.where(~exclusion(p))
    return rows


def default_exclusions(rows: DataFrame) -> DataFrame:
    """rows(path, ...) without files below a directory of a name that no scan enters."""
    folders = F.split(F.col("path"), "/")
    return rows.where(~F.arrays_overlap(F.slice(folders, F.lit(1), F.size(folders) - 1), F.array(*[F.lit(x) for x in EXCLUDED])))


def _outermost(spark: SparkSession, ordered: DataFrame, marked: DataFrame) -> dict[int, str]:
    """For each partition of ordered(part, key, ...), the outermost marked folder that its first key lies in, if any.

    One row a partition reaches the driver.
    """
    first = ordered.groupBy("part").agg(F.min("key").alias("key"))
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("key", "/")) - 1), lambda n: F.concat(F.array_join(F.slice(F.split("key", "/"), F.lit(1), n), "/"), F.lit("/")))
    ends = first.where(F.instr("key", "/") > 0).select("part", F.explode(above).alias("key"))  # of the first keys alone
    return {r.part: r.key for r in ends.join(marked, "key", "left_semi").groupBy("part").agg(F.min("key").alias("key")).collect()}


def within_boundary(rows: DataFrame, everything: DataFrame | None = None) -> DataFrame:
    """rows(path, ...) without files at or below a subdirectory that has a marker file of its own.

    everything(path) is the listing that markers are looked for in. Paths and marked folders are sorted together by
    range: what is below a folder follows it without a gap, so one pass tells what lies inside, and a path has
    one row however deep it lies. Paths are told apart only; rows that repeat one stay or go together.
    """
    every = rows if everything is None else everything
    spark, name = rows.sparkSession, F.element_at(F.split("path", "/"), -1)
    marked = every.where(name.isin(*MARKERS) & (F.instr("path", "/") > 0)).select(F.concat(folder(F.col("path")), F.lit("/")).alias("key")).distinct()
    both = rows.select(F.col("path").alias("key"), F.lit(False).alias("mark")).distinct().union(marked.select("key", F.lit(True)))
    ordered = both.repartitionByRange("key").sortWithinPartitions("key", F.desc("mark"))
    ordered = cut(ordered.withColumn("part", F.spark_partition_id()))
    carried = _outermost(spark, ordered, marked)

    def run(batches):
        inside = None
        for batch in batches:
            keys, marks, parts = (c.to_pylist() for c in batch.columns)
            if inside is None and keys:
                inside = carried.get(parts[0], "")
            kept = []
            for key, mark in zip(keys, marks, strict=True):
                if inside and key.startswith(inside):
                    continue
                if mark:
                    inside = key
                else:
                    kept.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], names=["path"])

    return rows.join(ordered.select("key", "mark", "part").mapInArrow(run, "path string"), "path", "left_semi")


class _Store:
    """A root folder as tasks see it: its folders' entries and its files' bytes, symbolic links passed over.

    Paths are relative to the root. Local folders are read by the operating system, others by Arrow's file systems.
    """

    def __init__(self, root: str):
        self.base, self.system = re.sub("^file:/+", "/", root.rstrip("/")), None
        if not self.base.startswith("/"):
            self.system, self.base = pafs.FileSystem.from_uri(root.rstrip("/"))
        self.linked: dict[str, bool] = {"": False}

    def at(self, path: str) -> str:
        return f"{self.base}/{path}" if path else self.base

    def entries(self, path: str) -> list[tuple[str, bool]]:
        """(path, whether it is a folder) of what a folder holds."""
        below = f"{path}/" if path else ""
        if self.system:
            found = self.system.get_file_info(pafs.FileSelector(self.at(path)))
            return [(below + f.base_name, f.type == pafs.FileType.Directory) for f in found]
        with os.scandir(self.at(path)) as found:
            return [(below + f.name, f.is_dir(follow_symlinks=False)) for f in found if not f.is_symlink()]

    def _is_linked(self, path: str) -> bool:
        if path not in self.linked:
            self.linked[path] = self._is_linked(path.rpartition("/")[0]) or os.path.islink(self.at(path))
        return self.linked[path]

    def is_file(self, path: str) -> bool:
        if self.system:
            return self.system.get_file_info(self.at(path)).type == pafs.FileType.File
        return os.path.isfile(self.at(path)) and not self._is_linked(path)

    def read(self, path: str) -> bytes:
        if self.system:
            with self.system.open_input_stream(self.at(path)) as f:
                return f.read()
        with open(self.at(path), "rb") as f:
            return f.read()


#: Folders that a task opens below one that it was given, before it hands the others back to be dealt out.
DESCENT = 64


def tree(spark: SparkSession, root: str, exclusions: tuple[str, ...] = (), default: bool = False, boundary: bool = False) -> DataFrame:
    """(path, is_folder, opened): what stands under root, folders listed by the executors.

    Folders of a name that no scan enters (default), those that a pattern excludes and, with boundary, those
    within a folder that has a marker file of its own are not opened, so their contents have no rows.
    The root has no row. Each job opens the folders that the last one found, and unless there are patterns
    a task opens DESCENT more below each, so that a small tree takes one job; no path reaches the driver.
    Jobs run when this is called.
    """
    workers, more = int(spark.conf.get("spark.sql.shuffle.partitions")), 0 if exclusions else DESCENT
    schema = "path string, is_folder boolean, enter boolean, pending boolean"

    def run(batches):
        store = _Store(root)
        for batch in batches:
            for given in batch.column(0).to_pylist():
                left, stack, out = more, [given], []
                while stack:
                    folder_ = stack.pop()
                    found = store.entries(folder_)
                    nested = boundary and bool(folder_) and any(not d and p.rpartition("/")[2] in MARKERS for p, d in found)
                    for path, is_folder in found:
                        enter = is_folder and not nested and not (default and path.rpartition("/")[2] in EXCLUDED)
                        here = enter and left > 0
                        if here:
                            stack.append(path)
                            left -= 1
                        out.append((path, is_folder, enter, enter and not here))
                    while len(out) > 5000 or (out and not stack):
                        part, out = out[:5000], out[5000:]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.string(), *[pa.bool_()] * 3), strict=True)], names=["path", "is_folder", "enter", "pending"])

    levels, front = [], spark.createDataFrame([("",)], "path string")
    while True:
        opened = F.col("enter")
        for p in exclusions:
            opened &= ~exclusion(p)
        found = front.repartition(workers).mapInArrow(run, schema)
        found = cut(found.select("path", "is_folder", opened.alias("opened"), "pending"))
        levels.append(found.drop("pending"))
        front = found.where("opened AND pending").select("path")
        if front.isEmpty():
            return reduce(DataFrame.union, levels)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files under root, of whatever kind, relative to it; symbolic links are passed over."""
    return tree(spark, root).where("NOT is_folder").select("path")


def present(rows: DataFrame, root: str) -> DataFrame:
    """The paths of rows(path) that are files under root, each looked up by the task that has it."""

    def run(batches):
        store = _Store(root)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([p for p in batch.column(0).to_pylist() if store.is_file(p)], pa.string())], names=["path"])

    return rows.select("path").where("path != '' AND path IS NOT NULL").mapInArrow(run, "path string")


def _scanned(spark: SparkSession, root: str, exclusions: tuple[str, ...], default: bool, boundary: bool, ignore_file: bool) -> tuple[DataFrame, DataFrame]:
    """((path) of the files that a scan's folders hold, (path) of those that it takes)."""
    patterns = (*exclusions, *(read_ignore_file(spark, root) if ignore_file else ()))
    listed = cut(tree(spark, root, patterns, default, boundary).where("NOT is_folder").select("path"))
    keep = exclude(default_exclusions(listed) if default else listed, patterns)
    if boundary:
        keep = within_boundary(keep, listed)
    return listed, keep.where(F.endswith("path", F.lit(".zig")) | F.endswith("path", F.lit(".zon")))


def _read(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    def run(batches):
        store = _Store(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([store.read(path)], pa.binary())], names=["path", "content"])

    return paths.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, "path string, content binary")


def files(spark: SparkSession, root: str, exclusions: tuple[str, ...] = (), default: bool = True, boundary: bool = True, ignore_file: bool = True) -> DataFrame:
    """(path, content) of the .zig and .zon files under root, paths relative to it, empty files included.

    Left out are files below a default-excluded directory, those of nested projects, and what the
    root's ignore file or the given patterns exclude, and what symbolic links lead to. Folders that are left out
    are not listed, and no other file is opened.
    """
    return _read(spark, root, _scanned(spark, root, exclusions, default, boundary, ignore_file)[1])


def file_info(rows: DataFrame) -> DataFrame:
    """(path, stem, extension, directory, n_bytes) of files(path, content); the root's directory is empty."""
    path = F.col("path")
    return rows.select("path", stem(path).alias("stem"), extension(path).alias("extension"), F.when(F.instr(path, "/") > 0, folder(path)).otherwise("").alias("directory"), F.octet_length("content").cast("long").alias("n_bytes"))


# References


def _text(literal: bytes) -> str:
    def one(m):
        code = m[1]
        if code[:1] == b"x" and len(code) == 3:
            return bytes([int(code[1:], 16)])
        if code[:2] == b"u{":
            return chr(int(code[2:-1], 16)).encode()
        return _SIMPLE.get(code, code)

    return _ESCAPE.sub(one, literal).decode("utf-8", "replace")


@dataclass
class _Found:
    calls: list[tuple]
    comments: list[tuple]
    problem: str | None


def _tokenize(content: bytes) -> _Found:
    """(call, target, first byte, last byte, in a test) of each call, (comment, byte, trailing) of each comment."""
    tokens, comments, open_, problem = [], [], [], None
    last_line_with_code, starts = -1, [0, *(m.end() for m in re.finditer(rb"\n", content))]
    row = 0
    for m in _TOKEN.finditer(content):
        text, at = m[0], m.start()
        while row + 1 < len(starts) and starts[row + 1] <= at:
            row += 1
        if text.startswith(b"//"):
            if not text.startswith((b"///", b"//!")):
                comments.append((text[2:].decode("utf-8", "replace"), at, bool(content[starts[row] : at].strip())))
            continue
        last_line_with_code = row
        tokens.append((text, at, m.end()))
        if text in (b"{", b"(", b"["):
            open_.append(text)
        elif text in _CLOSING and (not open_ or open_.pop() != _CLOSING[text]):
            problem = problem or f"unexpected {text.decode()} in line {row + 1}"
        elif text in (b'"', b"'"):
            problem = problem or f"unended literal in line {row + 1}"
    if open_:
        problem = problem or f"{open_[-1].decode()} is not closed after line {last_line_with_code + 1}"
    calls, depth, tests, includes, pending = [], 0, [], [], False
    for k, (text, at, _) in enumerate(tokens):
        if text in (b"{", b"("):
            depth += 1
            if text == b"{" and pending:
                tests.append(depth)
                pending = False
        elif text in (b"}", b")"):
            if tests and tests[-1] == depth:
                tests.pop()
            if includes and includes[-1] == depth:
                includes.pop()
            depth -= 1
        elif text == b"test" and not tests:
            pending = True
        elif text == b";":
            pending = False
        elif text == b"@cImport" and tokens[k + 1 : k + 2] and tokens[k + 1][0] == b"(":
            includes.append(depth + 1)
        elif text in _CALLS:
            after = tokens[k + 1 : k + 4]
            whole = len(after) == 3 and after[0][0] == b"(" and after[1][0][:1] == b'"' and len(after[1][0]) > 1 and after[2][0] == b")"
            if whole and (text != b"@cInclude" or includes):
                calls.append((_CALLS[text], _text(after[1][0][1:-1]), at, after[2][2], bool(tests)))
    return _Found(calls, comments, problem)


def _lines(content: bytes) -> list[int]:
    return [0, *(m.end() for m in re.finditer(rb"\n", content))]


def _map_files(rows: DataFrame, make, schema: str, strict: bool) -> DataFrame:
    """make(path, content, found) of each code file, as rows; a file with a problem gives none, or fails the job."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _tokenize(content or b"")
                if found.problem and strict:
                    raise ValueError(f"{path}: {found.problem}")
                if not found.problem:
                    out += make(path, content or b"", found)
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            kinds = [pa.bool_() if c.split()[1] == "boolean" else pa.int64() if c.split()[1] == "long" else pa.list_(pa.string()) if "array" in c else pa.string() for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return rows.where(F.endswith("path", F.lit(".zig"))).select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, schema)


def kind_of(call: Column, target: Column) -> Column:
    return (
        F.when(call == "embedFile", "embedded_file").when(call == "cInclude", "c_header").when(target == "std", "standard_library").when(target == "builtin", "builtin_module")
        .when(target == "root", "root_module").when(F.endswith(target, F.lit(".zig")), "zig_file").when(F.endswith(target, F.lit(".zon")), "zon_file").otherwise("named_module")
    )


def references(rows: DataFrame, strict: bool = False) -> DataFrame:
    """(source, target, kind, location, last_line, in_test): one row for each call with a literal target.

    Comments and strings, of several lines too, are passed over; equal calls have locations of their
    own; offsets and columns count bytes. A C header counts inside of an import of C only. A file
    whose brackets or literals do not end gives no references, or fails the job if strict. Null and
    empty contents have none; a file is read whole by one task.
    """

    def make(path, content, found):
        starts = _lines(content)
        out = []
        for call, target, at, end, tested in found.calls:
            row = bisect.bisect_right(starts, at)
            out.append((path, call, target, at, row, at - starts[row - 1] + 1, bisect.bisect_right(starts, end - 1), tested))
        return out

    found = _map_files(rows, make, "source string, call string, target string, byte_offset long, line long, column long, last_line long, in_test boolean", strict)
    return found.select("source", "target", kind_of(F.col("call"), F.col("target")).alias("kind"), F.struct("byte_offset", "line", "column").alias("location"), "last_line", "in_test")


def _directive(marker: str):
    """A function of (path, line, comment, trailing): (line, trailing, targets) of an ignore comment, None for any other."""
    start = re.compile(rf"\s*{re.escape(marker)}(?![\w-])")
    shape = re.compile(rf"\s*{re.escape(marker)}:\s*ignore(?:\s+(?P<targets>[^\s,]+(?:(?:\s*,\s*|\s+)[^\s,]+)*))?\s*")

    def read(path, line, text, trailing):
        if not start.match(text):
            return None
        m = shape.fullmatch(text)
        if not m:
            raise ValueError(f"{path}:{line}: malformed ignore comment: //{text}")
        return line, trailing, re.split(r"[\s,]+", m["targets"]) if m["targets"] else []

    return read


def directives(rows: DataFrame, marker: str = MARKER, strict: bool = False) -> DataFrame:
    """(path, line, trailing, targets) of each ignore comment, "// marker: ignore [targets]"; a malformed one fails the job.

    targets, separated by commas or white space, is empty for all. trailing tells whether code
    stands before it on its line.
    """
    read = _directive(marker)

    def make(path, content, found):
        starts = _lines(content)
        said = (read(path, bisect.bisect_right(starts, at), text, trailing) for text, at, trailing in found.comments)
        return [(path, *x) for x in said if x]

    return _map_files(rows, make, "path string, line long, trailing boolean, targets array<string>", strict)


def drop_ignored(refs: DataFrame, ignored: DataFrame) -> DataFrame:
    """References without those that a directive takes out: a trailing one on its lines, one of its own on the next."""
    d = ignored.select(F.col("path").alias("d_path"), F.col("line").alias("d_line"), "trailing", "targets")
    first = F.col("location.line")
    on_line = F.when(F.col("trailing"), F.col("d_line").between(first, F.col("last_line"))).otherwise(first == F.col("d_line") + 1)
    return refs.join(d, (F.col("source") == F.col("d_path")) & on_line & ((F.size("targets") == 0) | F.array_contains("targets", F.col("target"))), "left_anti")


_CALL = "struct<call: string, target: string, byte_offset: bigint, line: bigint, column: bigint, last_line: bigint, in_test: boolean>"
_COMMENT = "struct<line: bigint, trailing: boolean, targets: array<string>>"


def scan(rows: DataFrame, marker: str = MARKER, strict: bool = False) -> DataFrame:
    """(path, calls, comments): what references() and directives() find in each code file, in one row and one pass over it.

    A file that gives no references has empty arrays, whose lengths the file bounds otherwise.
    """
    matching = _directive(marker)

    def run(batches: Iterator[pa.RecordBatch]):
        call_type = pa.list_(pa.struct([("call", pa.string()), ("target", pa.string()), *((n, pa.int64()) for n in ("byte_offset", "line", "column", "last_line")), ("in_test", pa.bool_())]))
        comment_type = pa.list_(pa.struct([("line", pa.int64()), ("trailing", pa.bool_()), ("targets", pa.list_(pa.string()))]))
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _tokenize(content or b"")
                if found.problem and strict:
                    raise ValueError(f"{path}: {found.problem}")
                starts = _lines(content or b"")
                line = lambda at: bisect.bisect_right(starts, at)  # noqa: B023, E731
                own = [] if found.problem else [dict(call=c, target=t, byte_offset=at, line=line(at), column=at - starts[line(at) - 1] + 1, last_line=line(end - 1), in_test=tested) for c, t, at, end, tested in found.calls]
                said = [] if found.problem else [x for x in (matching(path, line(at), text, trailing) for text, at, trailing in found.comments) if x]
                out.append((path, own, [dict(line=n, trailing=t, targets=names) for n, t, names in said]))
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), call_type, comment_type), strict=True)], names=["path", "calls", "comments"])

    code = rows.where(F.endswith("path", F.lit(".zig"))).select("path", F.col("content").cast("binary").alias("content"))
    return code.mapInArrow(run, f"path string, calls array<{_CALL}>, comments array<{_COMMENT}>")


def kept_references(scanned: DataFrame) -> DataFrame:
    """The references of scanned(path, calls, comments) that no ignore comment takes out, as drop_ignored gives them."""

    def taken_out(call: Column, comment: Column) -> Column:
        on_line = F.when(comment["trailing"], comment["line"].between(call["line"], call["last_line"])).otherwise(call["line"] == comment["line"] + 1)
        return on_line & ((F.size(comment["targets"]) == 0) | F.array_contains(comment["targets"], call["target"]))

    kept = F.filter("calls", lambda c: ~F.exists("comments", lambda d: taken_out(c, d)))
    rows = scanned.select(F.col("path").alias("source"), F.explode(kept).alias("c")).select("source", "c.*")
    return rows.select("source", "target", kind_of(F.col("call"), F.col("target")).alias("kind"), F.struct("byte_offset", "line", "column").alias("location"), "last_line", "in_test")


def with_digest(rows: DataFrame) -> DataFrame:
    return rows.where(F.endswith("path", F.lit(".zig"))).select("path", "content", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


def new_contents(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(digest, content): each content of the code files of rows(path, content) that known(digest, ...) does not have, once."""
    keyed = with_digest(rows)
    if known is not None:
        keyed = keyed.join(known.select("digest"), "digest", "left_anti")
    return keyed.groupBy("digest").agg(F.first("content").alias("content"))


def content_table(rows: DataFrame, known: DataFrame | None = None, marker: str = MARKER, strict: bool = False) -> DataFrame:
    """(digest, calls, comments) of the contents of rows, to be kept beside the graph: known's rows and those of new contents.

    Only contents that known lacks are tokenized: none of an unchanged, moved or copied file. Rows of contents
    that no file has any longer stay out of a scan's way and may be kept.
    """
    new = new_contents(rows, known).select(F.concat("digest", F.lit(".zig")).alias("path"), "content")
    fresh = scan(new, marker, strict).select(F.substring_index("path", ".", 1).alias("digest"), "calls", "comments")
    return fresh if known is None else known.select("digest", "calls", "comments").unionByName(fresh)


def scan_with(rows: DataFrame, table: DataFrame) -> DataFrame:
    """scan() of rows from the table that content_table made of them."""
    return with_digest(rows).drop("content").join(table, "digest").select("path", "calls", "comments")


def option_filters(refs: DataFrame, include_resources: bool = True, include_c: bool = True, include_tests: bool = True) -> DataFrame:
    """References without resources, C headers or those inside tests, as the options say."""
    for wanted, of in ((include_resources, F.col("kind") == "embedded_file"), (include_c, F.col("kind") == "c_header"), (include_tests, F.col("in_test"))):
        refs = refs if wanted else refs.where(~of)
    return refs


# Resolution and classification


def fold_path(path: Column) -> Column:
    """path without . and ..; null if it leaves its root."""
    step = lambda acc, x: (
        F.when(acc.isNull() | ((x == "..") & (F.size(acc) == 0)), F.lit(None).cast("array<string>"))
        .when((x == ".") | (x == ""), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def module_status(kind: Column, declared: Column, origin: Column, mapped: Column, listed: Column) -> Column:
    """The status of a module reference: an alias of its unit first, then what the compiler provides."""
    return (
        F.when(declared & (origin == "package"), "resolved_package").when(declared & mapped.isNull(), "outside_project").when(declared & listed, "resolved_project")
        .when(declared, "missing").when(kind.isin("standard_library", "builtin_module"), "compiler_provided").otherwise("unresolved")
    )


def classify_module(kind: Column, status: Column) -> tuple[Column, Column, Column]:
    """(class, availability, external) of a module reference by its status."""
    compiler = (status == "compiler_provided") | ((status == "unresolved") & kind.isin("root_module", "standard_library", "builtin_module"))
    kind_class = F.when(status == "resolved_project", "internal").when(compiler, "compiler").otherwise("external")
    return kind_class, F.when(status.isin("unresolved", "missing", "outside_project"), status).otherwise("resolved"), status != "resolved_project"


def default_metadata(external: Column, kinds: Column) -> tuple[Column, Column]:
    """(classes, availabilities) masks of an edge made by hand, from its kinds."""
    has = lambda *names: kinds.bitwiseAND(sum(1 << KINDS.index(n) for n in names)) != 0
    one = lambda name, when: F.when(when, 1 << CLASSES.index(name)).otherwise(0)
    outside = (
        one("compiler", has("standard_library", "builtin_module", "root_module"))
        .bitwiseOR(one("resource", has("embedded_file"))).bitwiseOR(one("c_header", has("c_header"))).bitwiseOR(one("external", has("named_module", "zig_file", "zon_file")))
    )
    outside = F.when(outside == 0, 1 << CLASSES.index("external")).otherwise(outside)
    known = ~external | has("standard_library", "builtin_module")
    return F.when(external, outside).otherwise(1), F.when(known, 1).otherwise(1 << AVAILABILITIES.index("unresolved"))


def relative_target(source: Column, target: Column) -> Column:
    """Where a relative target of a source leads, from the root; null for an absolute one or one that leaves the root."""
    joined = fold_path(F.when(F.instr(source, "/") > 0, F.concat(folder(source), F.lit("/"), target)).otherwise(target))
    return F.when(F.startswith(target, F.lit("/")), F.lit(None)).otherwise(joined)


def referred_paths(refs: DataFrame) -> DataFrame:
    """(path): where the relative targets of references lead."""
    found = refs.where(F.col("kind").isin(*RELATIVE)).select(relative_target(F.col("source"), F.col("target")).alias("path"))
    return found.where("path IS NOT NULL").distinct()


def resolve(refs: DataFrame, listed: DataFrame, aliases: DataFrame | None = None, units: DataFrame | None = None) -> DataFrame:
    """References as normalize takes them: resolved against listed(path) and aliases(alias, path[, unit]).

    Relative targets are folded and joined with listed: found ones are resolved, absent ones
    missing, absolute and escaping ones outside of the project. A named module's alias gives its file
    or, with a null path, a package (external). units(unit, root) are compilation units: a source
    that is a unit's root has that unit's aliases; otherwise a single unit serves all sources, and of
    several none. Without units the aliases hold for all sources.
    """
    relative = F.col("kind").isin(*RELATIVE)
    rows = refs.withColumn("at", F.when(relative, relative_target(F.col("source"), F.col("target"))))
    if aliases is not None:
        known = aliases.select(F.col("alias").alias("target"), F.col("path").alias("module"), F.lit(True).alias("declared"), *(["unit"] if units is not None else []))
        if units is not None:
            only = units.agg(F.when(F.count("*") == 1, F.min("unit")).alias("only"))
            rows = rows.join(units.select(F.col("root").alias("source"), F.col("unit").alias("own")), "source", "left").join(F.broadcast(only))
            rows = rows.withColumn("unit", F.coalesce("own", "only")).join(known, ["target", "unit"], "left").drop("own", "only", "unit")
        else:
            rows = rows.join(known, "target", "left")
    else:
        rows = rows.withColumns({"module": F.lit(None).cast("string"), "declared": F.lit(None).cast("boolean")})
    declared = F.coalesce("declared", F.lit(False)) & ~relative & (F.col("kind") != "c_header")
    rows = rows.withColumn("wanted", F.when(relative, F.col("at")).otherwise(F.when(declared, fold_path(F.col("module")))))
    rows = rows.join(listed.select(F.col("path").alias("wanted"), F.lit(True).alias("listed")).distinct(), "wanted", "left")
    return _classified(rows, relative, declared, F.when(F.col("module").isNull(), "package").otherwise("project"))


def _classified(rows: DataFrame, relative: Column, declared: Column, origin: Column) -> DataFrame:
    """rows(source, target, kind, location, at, wanted, listed) with the masks of their edges."""
    kind, listed = F.col("kind"), F.coalesce("listed", F.lit(False))
    status = F.when(relative & F.col("at").isNull(), "outside_project").when(relative & listed, "resolved_project").when(relative, "missing").otherwise(module_status(kind, declared, origin, F.col("wanted"), listed))
    module_class, availability, external = classify_module(kind, F.col("status"))
    of_kind = F.when(kind == "embedded_file", "resource").when(kind == "c_header", "c_header").otherwise(module_class)
    outside = external | (kind == "c_header")
    return rows.withColumn("status", status).select(
        "source",
        F.when(F.col("status").isin("resolved_project") | (relative & (F.col("wanted") != "")), F.col("wanted")).otherwise(F.col("target")).alias("target"),
        outside.alias("external"),
        bit_of(KINDS, kind).alias("kind"),
        bit_of(CLASSES, of_kind).alias("class"),
        bit_of(AVAILABILITIES, availability).alias("availability"),
        "location",
    )


def self_edge_files(rows: DataFrame) -> DataFrame:
    """Only code gets a self-edge."""
    return rows.where(F.endswith("path", F.lit(".zig"))).select("path")


def graph_of(rows: DataFrame, aliases: DataFrame | None = None, units: DataFrame | None = None, *, listed: DataFrame | None = None, scanned: DataFrame | None = None, marker: str = MARKER, include_resources: bool = True, include_c: bool = True, include_tests: bool = True, strict: bool = False) -> DataFrame:
    """The normalized edges of files(path, content): scan, ignore comments, options, resolution, self-edges.

    listed(path) is what references may resolve to, the files themselves if it is not given; scanned is scan() of
    the rows, or scan_with() a table of their contents, where that is at hand. A file is tokenized once.
    """
    refs = kept_references(scan(rows, marker, strict) if scanned is None else scanned)
    refs = option_filters(refs, include_resources, include_c, include_tests)
    return normalize(resolve(refs, rows.select("path") if listed is None else listed, aliases, units), self_edge_files(rows))


def project_graph(spark: SparkSession, root: str, aliases: DataFrame | None = None, units: DataFrame | None = None, *, exclusions: tuple[str, ...] = (), table: DataFrame | None = None, marker: str = MARKER, strict: bool = False, **options) -> DataFrame:
    """The normalized edges of the project under root, in one call.

    table is a content_table of the same marker, for a project that has been scanned before: only contents
    that it lacks are tokenized. A reference may lead into a folder that the scan does not list; such targets
    are looked up one by one.
    """
    listed, paths = _scanned(spark, root, exclusions, True, True, True)
    rows = _read(spark, root, paths)
    if table is not None:
        scanned = cut(scan_with(rows, content_table(rows, table, marker, strict)))
    else:
        scanned = cut(scan(rows, marker, strict))
    wanted = referred_paths(kept_references(scanned))
    if aliases is not None:
        wanted = wanted.union(aliases.select(fold_path(F.col("path")).alias("path")))
    more = present(wanted.distinct().join(listed, "path", "left_anti"), root)
    return graph_of(paths, aliases, units, listed=listed.union(more), scanned=scanned, **options)
