"""Workspaces: several packages under one root, with qualified identities and modules across packages."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.errors import InvalidOptions
from edgeloom.functions.patterns import folder
from edgeloom.operators.graph import normalize
from edgeloom.sources import projects

# The file that makes a directory a package, and what joins a package's id to a path.
MANIFEST = "build.zig.zon"
SEPARATOR = "::"
_RESERVED = ("std", "builtin", "root")


@dataclass(frozen=True)
class Package:
    """A package's id and its directory below the workspace's root ("." for the root itself)."""

    id: str
    path: str


@dataclass(frozen=True)
class Module:
    """An alias of a unit: a file of its own package, of another one, or (origin "package") of none here."""

    name: str
    path: str
    package: str | None = None
    origin: str = "project"


@dataclass(frozen=True)
class Unit:
    """A compilation unit: its aliases hold for its root source, and for all of a package with one unit."""

    id: str
    modules: tuple[Module, ...] = ()
    package: str | None = None
    root: str | None = None


def validate_units(units: tuple[Unit, ...]) -> None:
    """Ids are given and differ; so are a unit's aliases, none of them a name that the compiler owns."""
    if len({u.id for u in units}) != len(units):
        raise InvalidOptions("two units have the same id")
    for u in units:
        if not u.id or u.package == "" or u.root == "":
            raise InvalidOptions(f"empty id, package or root in unit {u.id!r}")
        if len({m.name for m in u.modules}) != len(u.modules):
            raise InvalidOptions(f"an alias is declared twice in unit {u.id!r}")
        for m in u.modules:
            if not m.name or not m.path or m.name in _RESERVED or m.origin not in ("project", "package"):
                raise InvalidOptions(f"alias {m.name!r} of unit {u.id!r}")
            if m.package == "" or (m.package and m.origin == "package"):
                raise InvalidOptions(f"package of alias {m.name!r} of unit {u.id!r}")


def validate_packages(packages: tuple[Package, ...]) -> tuple[Package, ...]:
    """The packages sorted by id; ids and directories are given and differ, no id holds the separator."""
    if not packages:
        raise InvalidOptions("a workspace needs a package")
    for p in packages:
        if not p.id or SEPARATOR in p.id or "\0" in p.id:
            raise InvalidOptions(f"package id {p.id!r}")
    clean = [Package(p.id, re.sub(r"[/\\]+", "/", p.path).strip("/") or ".") for p in packages]
    if len({p.id for p in clean}) != len(clean) or len({p.path for p in clean}) != len(clean):
        raise InvalidOptions("two packages have the same id or directory")
    return tuple(sorted(clean, key=lambda p: p.id))


def discover(listed: DataFrame) -> tuple[Package, ...]:
    """A package for each directory of listed(path) with a manifest, its directory being its id; the root's is "root"."""
    name = F.element_at(F.split("path", "/"), -1)
    found = projects.default_exclusions(listed).where(name == MANIFEST).select(folder(F.col("path")).alias("at")).distinct().collect()  # a row a package
    return validate_packages(tuple(Package("root" if r["at"] == "." else r["at"], r["at"]) for r in found))


def qualified(package: Column, path: Column) -> Column:
    return F.concat(package, F.lit(SEPARATOR), path)


def assign(rows: DataFrame, packages: tuple[Package, ...]) -> DataFrame:
    """rows(path, ...) with package and inner, the path below its package; files of no package are left out.

    A file belongs to its nearest package, so nested packages do not share files. Packages are declared, so their
    prefixes are a constant, the longest first, of which each path takes the first that it starts with:
    no row is multiplied or moved.
    """
    longest = sorted(packages, key=lambda p: -len(p.path) if p.path != "." else 1)
    known = F.array(*[F.struct(F.lit(p.id).alias("package"), F.lit("" if p.path == "." else f"{p.path}/").alias("prefix")) for p in longest])
    own = F.get(F.filter(known, lambda p: F.startswith(F.col("path"), p["prefix"])), F.lit(0))
    found = rows.withColumn("__own", own).where("__own IS NOT NULL")
    inner = F.substring(F.col("path"), F.length("__own.prefix") + 1, F.length("path"))
    return found.withColumns({"package": F.col("__own.package"), "inner": inner}).drop("__own")


def workspace_references(rows: DataFrame, listed: DataFrame, refs: DataFrame, units: tuple[Unit, ...] = ()) -> DataFrame:
    """References as normalize takes them, with qualified ends.

    rows and listed are (path, package, inner); refs has sources by path. A relative target stays in
    its package: what leaves it is outside of the project. A named module is looked up among the
    aliases of the source's unit, whose file may lie in another package.
    """
    validate_units(units)
    spark = rows.sparkSession
    known = listed.select(qualified(F.col("package"), F.col("inner")).alias("wanted"), F.lit(True).alias("listed")).distinct()
    own = rows.select(F.col("path").alias("source"), "package", "inner")
    r = refs.join(own, "source")
    table = spark.createDataFrame([(u.id, u.package, u.root) for u in units], "unit string, package string, root string")
    exact = table.where("root IS NOT NULL").groupBy("package", F.col("root").alias("inner")).agg(F.min("unit").alias("exact"))
    only = table.groupBy("package").agg(F.when(F.count("*") == 1, F.min("unit")).alias("only"))
    r = r.join(F.broadcast(exact), ["package", "inner"], "left").join(F.broadcast(only), "package", "left").withColumn("unit", F.coalesce("exact", "only")).drop("exact", "only")
    aliases = [(u.id, m.name, m.package or u.package, None if m.origin == "package" else m.path, m.origin) for u in units for m in u.modules]
    r = r.join(F.broadcast(spark.createDataFrame(aliases, "unit string, target string, to_package string, module string, origin string")), ["unit", "target"], "left")
    relative = F.col("kind").isin("zig_file", "zon_file", "embedded_file")
    declared = F.col("origin").isNotNull() & ~relative & (F.col("kind") != "c_header")
    folded = projects.fold_path(F.when(F.instr("inner", "/") > 0, F.concat(folder(F.col("inner")), F.lit("/"), "target")).otherwise(F.col("target")))
    r = r.withColumn("at", F.when(relative & ~F.startswith("target", F.lit("/")), folded))
    r = r.withColumn("wanted", F.when(relative, qualified(F.col("package"), F.col("at"))).when(declared, qualified(F.col("to_package"), projects.fold_path(F.col("module")))))
    r = r.join(known, "wanted", "left").withColumn("source", qualified(F.col("package"), F.col("inner")))
    return projects._classified(r, relative, declared, F.coalesce("origin", F.lit("project")))


def graph_of(rows: DataFrame, packages: tuple[Package, ...], units: tuple[Unit, ...] = (), *, listed: DataFrame | None = None, package_exclusions: dict[str, tuple[str, ...]] | None = None, exclusions: tuple[str, ...] = (), marker: str = projects.MARKER, include_resources: bool = True, include_c: bool = True, include_tests: bool = True, strict: bool = False) -> DataFrame:
    """The normalized edges of a workspace's files(path, content), between qualified paths.

    Three layers of exclusions add up: the root's, already taken from rows; each package's own, on
    paths below it; and those of the call, on qualified paths.
    """
    packages = validate_packages(packages)
    own = assign(rows, packages)
    for package, patterns in (package_exclusions or {}).items():
        gone = projects.exclude(own.where(F.col("package") == package).select(F.col("inner").alias("path"), F.col("path").alias("whole")), patterns)
        own = own.where(F.col("package") != package).unionByName(own.where(F.col("package") == package).join(gone.select(F.col("whole").alias("path")), "path", "left_semi"))
    if exclusions:
        kept = projects.exclude(own.select(qualified(F.col("package"), F.col("inner")).alias("path"), F.col("path").alias("whole")), exclusions)
        own = own.join(kept.select(F.col("whole").alias("path")), "path", "left_semi")
    refs = projects.kept_references(projects.scan(own, marker, strict))
    refs = projects.option_filters(refs, include_resources, include_c, include_tests)
    known = own.select("path", "package", "inner") if listed is None else assign(listed, packages)
    named = own.select(qualified(F.col("package"), F.col("inner")).alias("path"))
    return normalize(workspace_references(own, known, refs, units), projects.self_edge_files(named))


def workspace_graph(spark: SparkSession, root: str, packages: tuple[Package, ...] = (), units: tuple[Unit, ...] = (), **options) -> DataFrame:
    """The edges of the workspace under root: of the given packages, or of all that have a manifest.

    The root's ignore file holds for all packages, a package's own for it.
    """
    listed = projects.listing(spark, root)
    chosen = validate_packages(packages) if packages else discover(listed)
    own = {p.id: projects.read_ignore_file(spark, root if p.path == "." else f"{root.rstrip('/')}/{p.path}") for p in chosen if p.path != "."}
    rows = projects.files(spark, root, boundary=False)
    return graph_of(rows, chosen, units, listed=listed, package_exclusions={k: v for k, v in own.items() if v}, **options)
