"""Globs, regexes and selectors as Spark columns, so that every filter stays in the scan's plan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgeloom.errors import InvalidPattern

FILENAME, PATH, FOLDER, NAME = "filename", "path", "folder", "name"
_SPECIAL = set("\\^$.|?*+()[]{}")


def quote(text: str) -> str:
    return "".join("\\" + c if c in _SPECIAL else c for c in text)


def normalize_path(path: Column) -> Column:
    """Separators as single slashes; . and .. stay. Paths that are normal already meet no regex."""
    odd = F.contains(path, F.lit("\\")) | F.contains(path, F.lit("//"))
    return F.when(odd, F.regexp_replace(path, r"[/\\]+", "/")).otherwise(path)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, ".").otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def stem(path: Column) -> Column:
    """The file name without its last extension; a leading dot starts no extension."""
    name = basename(path)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"(?<=.)(\.[^.]*)$", 1)


def _char_class(glob: str, at: int) -> tuple[str, int] | None:
    """(regex, end) of the class that starts at glob[at] == "["; None if it is a plain bracket."""
    close = glob.find("]", at + 1)
    body = glob[at + 1 : close] if close > 0 else ""
    negated = body.startswith("!")
    body = body[negated:]
    if close < 0 or not body:
        return None
    out, i = "", 0
    while i < len(body):
        low, high = body[i], body[i]
        if i + 2 < len(body) and body[i + 1] == "-":
            high = body[i + 2]
            i += 2
        i += 1
        if low > high or low <= "/" <= high:
            raise InvalidPattern(f"class range {low}-{high} in {glob!r}")
        both = ["\\" + c if c in "\\]^-[&" else c for c in (low, high)]
        out += both[0] if low == high else "-".join(both)
    return f"[{'^/' if negated else ''}{out}]", close + 1


def _glob_parts(glob: str) -> list[tuple[str, str | None]]:
    """(regex, the character that it stands for or None) of each part of a glob."""
    if not glob:
        raise InvalidPattern("empty pattern")
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) or glob.startswith("**\\", i):
            out.append(("(?:.*/)?", None))
            i += 3
        elif glob.startswith("**", i):
            out.append((".*", None))
            i += 2
        elif c == "[" and (found := _char_class(glob, i)):
            out.append((found[0], None))
            i = found[1]
        else:
            out.append({"*": ("[^/]*", None), "?": ("[^/]", None), "\\": ("/", "/")}.get(c, (quote(c), c)))
            i += 1
    return out


def glob_regex(glob: str) -> str:
    """An anchored Java regex: * and ? stay within a segment, ** crosses them, **/ may match nothing."""
    return rf"(?sd)^{''.join(part for part, _ in _glob_parts(glob))}\z"


def check_regex(source: str) -> str:
    """The regex with $ at the very end only; look-around and back-references are refused."""
    if not source:
        raise InvalidPattern("empty pattern")
    if re.search(r"\(\?(?:[=!>]|<[=!])", source) or re.search(r"(?<!\\)(?:\\\\)*\\(?:[1-9]|k<)", source):
        raise InvalidPattern(f"look-around and back-references are not supported: {source!r}")
    try:
        re.compile(re.sub(r"\(\?P?<", "(?P<", source).replace(r"\z", r"\Z"))
    except re.error as e:
        raise InvalidPattern(f"{source!r}: {e}") from e
    return "(?d)" + re.sub(r"(?<!\\)((?:\\\\)*)\$", r"\1\\z", source)


@dataclass(frozen=True)
class Filter:
    """One pattern on one field of a path, and exclusions that take back what it selects."""

    source: str
    target: str = PATH
    exact: bool = False
    is_glob: bool = True
    exclusions: tuple[Filter, ...] = field(default=())

    def excluding(self, *others: Filter) -> Filter:
        return replace(self, exclusions=self.exclusions + others)

    @property
    def regex(self) -> str:
        return glob_regex(self.source) if self.is_glob else check_regex(self.source)

    @property
    def literal_ends(self) -> tuple[str, str, bool]:
        """(start, end, whole): what each match starts and ends with; whole if it is just that text, or ** between them.

        A regex has ends only if it is a literal; one that is not exact has no end without its anchor.
        """
        if self.is_glob:
            parts = _glob_parts(self.source)
            plain = [c for _, c in parts]
            first = plain.index(None) if None in plain else len(plain)
            last = len(plain) - plain[::-1].index(None) if None in plain else 0
            rest = [part for part, c in parts if c is None]
            return "".join(plain[:first]), "".join(plain[last:]), not rest or (rest == [".*"] and last == first + 1)
        body = re.fullmatch(r"(\^?)((?:[^\\^$.|?*+()\[\]{}]|\\[\\^$.|?*+()\[\]{}])+)(\$?)", self.source, re.DOTALL)
        if body is None:
            return "", "", False
        text = re.sub(r"\\(.)", r"\1", body[2], flags=re.DOTALL)
        both = self.exact or (bool(body[1]) and bool(body[3]))
        return text if both or body[1] else "", text if both or body[3] else "", both

    def field_of(self, path: Column, name: Column | None = None) -> Column:
        """What the pattern is held against."""
        if self.target == NAME and name is None:
            raise InvalidPattern("this candidate has no declaration name")
        return {FILENAME: basename, PATH: lambda p: p, FOLDER: folder, NAME: lambda p: name}[self.target](path)

    def positive(self, path: Column, name: Column | None = None) -> Column:
        value = self.field_of(path, name)
        found = F.rlike(value, F.lit(self.regex))
        if self.exact and not self.is_glob:  # a glob's regex is anchored at both ends already
            found = found & (F.regexp_extract(value, self.regex, 0) == value)
        return found

    def matches(self, path: Column, name: Column | None = None) -> Column:
        out = self.positive(path, name)
        for e in self.exclusions:
            if e.target != NAME or name is not None:
                out = out & ~F.coalesce(e.positive(path, name), F.lit(False))
        return out


def glob(source: str, target: str = PATH) -> Filter:
    found = Filter(source, target, exact=True)
    found.regex  # noqa: B018  raises on a bad pattern
    return found


def regex(source: str, target: str = PATH, exact: bool = False) -> Filter:
    found = Filter(source, target, exact, is_glob=False)
    found.regex  # noqa: B018
    return found


def exact_file(path: str) -> Filter:
    if not path:
        raise InvalidPattern("empty path")
    return Filter(quote(re.sub(r"[/\\]+", "/", path)), PATH, exact=True, is_glob=False)


def any_of(filters, path: Column, name: Column | None = None) -> Column:
    """Alternatives of one selector call; none matches nothing."""
    return reduce(lambda a, b: a | b, [f.matches(path, name) for f in filters], F.lit(False))


def all_of(selectors, path: Column, name: Column | None = None) -> Column:
    """Selector calls together; none at all matches everything."""
    return reduce(lambda a, b: a & b, [any_of(s, path, name) for s in selectors], F.lit(True))


def by_two_names(filters, path: Column, name: Column, qualified: Column) -> Column:
    """Declarations: either name may match, an exclusion on either rejects."""
    out = F.lit(False)
    for f in filters:
        bare = replace(f, exclusions=())
        hit = bare.matches(path, name) | bare.matches(path, qualified)
        for e in f.exclusions:
            hit = hit & ~F.coalesce(e.positive(path, name) | e.positive(path, qualified), F.lit(False))
        out = out | hit
    return out


def collapse_folder(path: Column, depth: int) -> Column:
    """The first depth folders of a path; a file at the root stays."""
    if depth < 1:
        raise InvalidPattern("depth starts at 1")
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.least(F.size(parts) - 1, F.lit(depth))), "/")).otherwise(path)


def collapse_pattern(path: Column, source: str, replacement: str) -> Column:
    """Every match replaced; $0 to $9 are groups, $$ is a dollar sign, a leading ^ anchors each rest anew."""
    java = check_regex(source)
    groups = re.compile(source).groups
    out, i = "", 0
    while i < len(replacement):
        c = replacement[i]
        if c == "$":
            following = replacement[i + 1 : i + 2]
            if following == "$":
                out += r"\$"
            elif following.isdigit() and int(following) <= groups:
                out += "$" + following + ("\\" if replacement[i + 2 : i + 3].isdigit() else "")
            else:
                raise InvalidPattern(f"group reference at {i} in {replacement!r}")
            i += 2
        else:
            out, i = out + ("\\\\" if c == "\\" else c), i + 1
    return F.regexp_replace(path, re.sub(r"^(\(\?d\))\^", r"\1\\G", java), out)
