import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from edgeloom.errors import InvalidPattern
from edgeloom.functions.patterns import FILENAME, FOLDER, NAME, all_of, by_two_names, collapse_folder, collapse_pattern, exact_file, extension, folder, glob, normalize_path, regex, stem


def selected(spark, pattern, paths):
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    return {r[0] for r in rows.where(pattern.matches(F.col("p"))).collect()}


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "p string").select(column(F.col("p"))).first()[0]


def fits(tokens, text):
    """Whether the tokens of a glob take up the whole text, by trying all ways."""
    if not tokens:
        return not text
    head, rest = tokens[0], tokens[1:]
    if head == "**/":
        return fits(rest, text) or any(fits(rest, text[k + 1 :]) for k, c in enumerate(text) if c == "/")
    if head in ("*", "**"):
        return any(fits(rest, text[k:]) for k in range(len(text) + 1) if head == "**" or "/" not in text[:k])
    if head == "?":
        return bool(text) and text[0] != "/" and fits(rest, text[1:])
    return text.startswith(head) and fits(rest, text[len(head) :])


def test_globs_against_all_ways_to_match(spark):
    r = random.Random(5)
    paths = sorted({"/".join("".join(r.choice("xy.") for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 4))) for _ in range(150)})
    hits = 0
    for _ in range(40):
        tokens = [r.choice(["x", "y", ".", "/", "*", "**", "**/", "?"]) for _ in range(r.randint(1, 6))]
        tokens = [t for t, after in itertools.zip_longest(tokens, tokens[1:]) if not (t.startswith("*") and after and after[0] in "*/")]
        if not tokens:
            continue
        want = {p for p in paths if fits(tokens, p)}
        assert selected(spark, glob("".join(tokens)), paths) == want, tokens
        hits += len(want)
    assert hits > 100


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        (glob("unit[a-c].src"), ["unita.src", "unitc.src"], ["unitd.src", "unit/.src", "x/unita.src"]),
        (glob("unit[!a-c]"), ["unitd", "unit1"], ["unita", "unit/"]),
        (glob("odd[.src"), ["odd[.src"], ["odd.src"]),
        (glob("odd[].src"), ["odd[].src"], ["odd.src", "odd[.src"]),
        (glob("q?z"), ["q\U0001f600z"], ["qz", "q/z"]),
        (glob("line"), ["line"], ["line\n"]),
        (glob("line**"), ["line/b\nc"], ["aline"]),
        (regex("^line$"), ["line"], ["line\n", "a line"]),
        (regex("in"), ["line"], ["lne"]),
        (regex("q|qz", exact=True), ["q"], ["qz"]),
        (exact_file("lib\\\\io.src"), ["lib/io.src"], ["lib/ioXsrc"]),
        (glob("io.src", FILENAME), ["lib/io.src", "io.src"], ["io.src/x"]),
        (glob(".", FOLDER), ["io.src"], ["lib/io.src"]),
        (glob("lib/**").excluding(glob("*.gen", FILENAME)), ["lib/a/b"], ["lib/a.gen", "x"]),
    ],
)
def test_matching(spark, pattern, yes, no):
    assert selected(spark, pattern, yes + no) == set(yes)


def test_bad_patterns():
    for bad in (lambda: glob(""), lambda: glob("a[.-0]"), lambda: glob("[z-a]"), lambda: regex("("), lambda: regex("(?=a)b"), lambda: regex(r"(a)\1"), lambda: exact_file("")):
        with pytest.raises(InvalidPattern):
            bad()


def test_path_parts(spark):
    assert one(spark, "lib\\io//net/./dump.old.gz", normalize_path) == "lib/io/net/./dump.old.gz"
    assert one(spark, "io/dump.old.gz", stem) == "dump.old"
    assert one(spark, "io/dump.old.gz", extension) == ".gz"
    assert one(spark, "dump", folder) == "."
    assert one(spark, ".profile", extension) == ""


def test_collapse_folder(spark):
    for path in ("net/tcp/v4/socket", "net/tcp/socket", "socket"):
        parts = path.split("/")
        for depth in (1, 2, 5):
            want = "/".join(parts[: min(depth, len(parts) - 1)]) or path
            assert one(spark, path, lambda c, depth=depth: collapse_folder(c, depth)) == want
    with pytest.raises(InvalidPattern):
        collapse_folder(F.lit("a/b"), 0)


@pytest.mark.parametrize(
    ("path", "source", "replacement"),
    [("net/tcp/socket", "(net|io)/([a-z]+)", r"\2:\1"), ("tcp/tcp/x", "tcp/", "_"), ("éa", "q*", "-"), ("tcp", "(t)(c)", r"\2\g<1>0"), ("net.net", r"n(e)t", r"\1$")],
)
def test_collapse_pattern(spark, path, source, replacement):
    ours = re.sub(r"\\g<(\d)>|\\(\d)", lambda m: f"${m[1] or m[2]}", replacement.replace("$", "$$"))
    assert one(spark, path, lambda c: collapse_pattern(c, source, ours)) == re.sub(source, replacement, path)


def test_collapse_pattern_beyond_plain_replacement(spark):
    assert one(spark, "net/net/x", lambda c: collapse_pattern(c, "^net/", "")) == "x"
    assert one(spark, "xy", lambda c: collapse_pattern(c, "(x)(q)?", "<$2>")) == "<>y"


def test_bad_replacements():
    for bad in ("$", "$2", "$x"):
        with pytest.raises(InvalidPattern):
            collapse_pattern(F.lit("a"), "(a)", bad)


def test_selectors_and_names(spark):
    rows = spark.createDataFrame([("lib/io", "open", "Io.open"), ("lib/net", "send", "Net.send")], "p string, name string, qualified string")
    p, name, qualified = F.col("p"), F.col("name"), F.col("qualified")
    assert rows.where(all_of([], p)).count() == 2
    assert rows.where(all_of([[]], p)).count() == 0
    assert rows.where(all_of([[glob("lib/*")], [glob("*/net"), glob("*/none")]], p)).count() == 1
    assert rows.where(by_two_names([glob("Io.*", NAME)], p, name, qualified)).count() == 1
    assert rows.where(by_two_names([glob("*", NAME).excluding(glob("Net.send", NAME))], p, name, qualified)).count() == 1
    with pytest.raises(InvalidPattern):
        glob("a", NAME).matches(p)
