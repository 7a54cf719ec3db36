"""The edge table: enumerations as bits, and the schema that every operator takes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Members in the order of their bits.
KINDS = ("zig_file", "zon_file", "named_module", "standard_library", "builtin_module", "root_module", "embedded_file", "c_header")
CLASSES = ("internal", "external", "compiler", "resource", "c_header")
AVAILABILITIES = ("resolved", "unresolved", "missing", "outside_project")
CATEGORIES = ("package_module", "unresolved_module", "unavailable_module", "compiler_module", "c_header", "resource")

LOCATION = "struct<byte_offset: bigint, line: bigint, column: bigint>"
EDGES = f"source string, target string, external boolean, kinds int, classes int, availabilities int, locations array<{LOCATION}>"


def bit(members: tuple[str, ...], *names: str) -> int:
    return sum(1 << members.index(n) for n in names)


def bit_of(members: tuple[str, ...], name: Column) -> Column:
    out = F.lit(0)
    for n in members:
        out = F.when(name == n, bit(members, n)).otherwise(out)
    return out


def names_of(members: tuple[str, ...], mask: Column, separator: str = "|") -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(mask.bitwiseAND(1 << k) != 0, n) for k, n in enumerate(members)])), separator)
