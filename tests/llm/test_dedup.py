import pickle
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from test_textkernels import thue_morse

from edgeloom.llm import decontaminate, itq_dedup, minhash_dedup, substring_dedup

DOCS = "doc_id long, text string, doc string, g int, n long"


def corpus(seed, n=60):
    """Families of edited copies, exact copies, shared passages, short, empty, blank, null and long texts."""
    r = random.Random(seed)
    words = lambda k: [f"w{r.randrange(400)}" for _ in range(k)]
    passage, out = words(30), []
    for i in range(n):
        base = words(r.choice((8, 40, 90)))
        if out and r.random() < 0.6:
            base = (r.choice(out)[1] or "x y").split()
            for _ in range(r.choice((0, 1, 2, 6))):
                base[r.randrange(len(base))] = f"w{r.randrange(400)}"
        if r.random() < 0.2:
            base = base[:20] + passage + base[20:]
        out.append((i * 3 % n if n % 3 else i, r.choice((" ", "\n")).join(base)))
    out += [(1000, None), (1001, ""), (1002, " \n "), (1003, "One two"), (1004, "one  TWO"), (1005, "a b c d e " * 4000), (1006, "a b c d e " * 4001)]
    return out


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "other", 1, 2) for i, t in docs], DOCS).repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    monkeypatch.setattr(minhash_dedup, "FAMILY_BLOCK", 3)
    docs = corpus(seed) + [(5, "seventeen other words that belong to the document of number five too and to nobody else at all")]
    found = minhash_dedup.near_duplicates(frame(spark, docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute.near_duplicates(docs)
    assert len(found) == len({i for i, _ in docs})


def test_near_duplicates_with_a_rarer_passage(spark):
    """A superset of a family's text whose added passage fewer documents hold than the family has members."""
    r = random.Random(11)
    words = lambda k: [f"v{r.randrange(10**6)}" for _ in range(k)]
    docs = []
    for family in range(12):
        base, passage = words(200), words(64)
        texts = [base]
        for _ in range(9):
            near = list(base)
            near[r.randrange(200)] = words(1)[0]
            texts.append(near)
        texts += [base + passage] + [words(30) + passage for _ in range(4)]
        docs += [(100 * family + k, " ".join(t)) for k, t in enumerate(texts)]
    found = minhash_dedup.near_duplicates(frame(spark, docs)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in found} == brute.near_duplicates(docs)


@pytest.mark.parametrize("few_blocks", [0, 100])
def test_cells_pair_sets_of_sizes_that_can_link(spark, monkeypatch, few_blocks):
    """Every pair of two components whose sizes allow a link meets, in one cell; classes make the cells fewer."""
    monkeypatch.setattr(minhash_dedup, "FEW_BLOCKS", few_blocks)
    r = random.Random(8)
    rows = [(k % 3, 10 * k, r.choice((1, 1, 1, 10 * k)), r.choice((1, 3, 4, 30, 40, 41, 900, 1200, 10**6))) for k in range(240)]
    frame = spark.createDataFrame(rows, "key int, doc long, comp long, n long")
    cells = minhash_dedup._cells(frame, "key", ["n"], 5, minhash_dedup._size_class(75)).collect()
    met = [
        tuple(sorted((a.doc, b.doc)))
        for c in cells for a in c.members for b in c.members
        if a.comp != b.comp and a.block == c.i and b.block == c.j and (c.i != c.j or a.doc < b.doc)
    ]
    allowed = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] != b[2] and 4 * min(a[3], b[3]) >= 3 * max(a[3], b[3])}
    assert len(met) == len(set(met)) and allowed <= set(met)
    every = sum(a[0] == b[0] and a[1] < b[1] and a[2] != b[2] for a in rows for b in rows)
    assert len(met) == every if few_blocks else len(met) < every / 2


def test_near_duplicates_of_many_sizes_around_one_passage(spark, monkeypatch):
    """A passage that documents of all sizes hold, in one long list that is cut by size."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    monkeypatch.setattr(minhash_dedup, "FEW_BLOCKS", 1)
    r = random.Random(12)
    words = lambda k: [f"v{r.randrange(10**6)}" for _ in range(k)]
    passage, docs = words(80), []
    for k in range(60):
        texts = [words(r.choice((2, 10, 20, 40, 80, 120)))]
        if k % 3 == 0:
            texts.append([*texts[0], *words(r.choice((1, 12, 24)))])
        docs += [(10 * k + j, " ".join(passage + t)) for j, t in enumerate(texts)]
    found = minhash_dedup.near_duplicates(frame(spark, docs)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in found} == brute.near_duplicates(docs)


def test_near_duplicates_edges(spark):
    nulls = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    rows = sorted(tuple(r) for r in minhash_dedup.near_duplicates(nulls).where("doc_id IS NOT NULL").collect())
    assert rows == [(1, 2, 1, True)]
    assert minhash_dedup.near_duplicates(nulls.limit(0)).count() == 0
    assert minhash_dedup.drop_near_duplicates(nulls).count() == 3


@pytest.mark.parametrize("group_bytes", [300, 1 << 20])
def test_substring_dedup(spark, group_bytes):
    docs = corpus(3)
    found = substring_dedup.dedup_substrings(frame(spark, docs), group_bytes=group_bytes, shard_bytes=2000)
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute.substring_dedup(docs))


def test_substring_dedup_edges(spark):
    long = " ".join(f"x{k}" for k in range(20))
    rows = spark.createDataFrame([(None, long), (2, long), (2, long + " y"), (3, "z " + long)], "doc_id long, text string")
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed) for r in substring_dedup.dedup_substrings(rows).collect())
    assert found == [(-1, 20), (2, 0), (2, 0), (3, 20)]
    assert substring_dedup.dedup_substrings(rows.limit(0)).count() == 0


@pytest.mark.parametrize("chunk_bytes, pass_bytes, piece", [(1 << 20, 32 << 20, 1 << 13), (200, 400, 3), (200, 32 << 20, 1)])
def test_contamination(spark, monkeypatch, chunk_bytes, pass_bytes, piece):
    """One chunk; several passes with items cut into pieces; and pieces of one window each."""
    monkeypatch.setattr(decontaminate, "PASS_BYTES", pass_bytes)
    monkeypatch.setattr(decontaminate, "PIECE_WINDOWS", piece)
    docs = corpus(4)
    r = random.Random(9)
    items = [(k, " ".join((r.choice(docs[:60])[1] or "").split()[5:25])) for k in range(8)] + [(90, "Three, short W7!"), (91, None), (92, ""), (93, "one two"), (None, "ONE-two"), (93, "one two")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    found = decontaminate.contamination(frame(spark, docs), bench, chunk_bytes=chunk_bytes)
    got = sorted((x.doc_id, x.n_words, sum(s.last - s.first + 1 for s in x.spans), x["items"]) for x in found.collect())
    want = sorted(brute.contamination(docs, items))
    assert got == want and any(w[2] for w in want)
    kept = decontaminate.drop_contaminated(frame(spark, docs), bench, chunk_bytes=chunk_bytes)
    assert kept.columns == ["doc_id", "text", "doc", "g", "n"]
    assert sorted(x.doc_id for x in kept.collect()) == [w[0] for w in want if not w[2]]


def test_compiled_patterns_stay_near_their_text():
    r = random.Random(2)
    known = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(20_000)]
    shared = " ".join(r.choice(known) for _ in range(10))
    items = [(f"i{k}", " ".join(r.choice(known) for _ in range(r.randint(30, 400))) + " " + shared) for k in range(400)]
    patterns = decontaminate.compile_patterns(items)
    assert len(pickle.dumps(patterns, 5)) <= 4 * sum(len(text) for _, text in items)
    texts = [shared.upper(), items[7][1], "nothing of it " * 20]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    hit, found = decontaminate.search(patterns, decontaminate.read_words(data, np.cumsum([0] + [len(t) for t in texts])))
    everyone = {i for i, _ in items}
    assert found == {0: everyone, 1: everyone} and int(hit.sum()) == 10 + len(items[7][1].split())


def test_contamination_without_a_benchmark(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((r.n_words, len(r.spans)) for r in decontaminate.contamination(docs, none).collect()) == [(0, 0), (2, 0)]
    assert decontaminate.contamination(docs.limit(0), none).count() == 0


def vectors(seed):
    r = np.random.default_rng(seed)
    rows, centre = [], r.normal(size=16)
    for i in range(150):
        if i % 3 == 0:
            centre = r.normal(size=16)
        x = centre + r.normal(size=16) * r.choice([0, 0.05, 0.12, 0.2])
        rows.append((i, [float(v) for v in x.astype(np.float32)], int(i % 2) if i % 50 else None))
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [None] * 16, 1), (203, [float("nan")] * 16, 1), (204, [], 1), (205, [1.0, 2.0], 1), (206, [2.0, 4.0], 1), (207, [float("inf")] + [1.0] * 15, 1)]
    return rows + [(300 + k, rows[1][1], rows[1][2]) for k in range(4)]


@pytest.mark.parametrize(("kind", "tables"), [("float", 8), ("double", 3)])
def test_vectors(spark, kind, tables, monkeypatch):
    monkeypatch.setattr(itq_dedup, "BLOCK", 3)
    rows = vectors(5)
    found = itq_dedup.near_duplicate_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int"), tables=tables, cosine=0.98)
    usable = {i: (np.array(v, float), l) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = [
        (a, b) for a in usable for b in usable
        if a < b and usable[a][1] == usable[b][1] and len(usable[a][0]) == len(usable[b][0])
        and usable[a][0] @ usable[b][0] / np.linalg.norm(usable[a][0]) / np.linalg.norm(usable[b][0]) >= 0.98
    ]
    root = brute.join(links, [r[0] for r in rows])
    want = {i: (sum(i in l for l in links), root[i], root[i] == i) for i, _, _ in rows}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found.collect()} == want
    assert len(links) > 40


def test_vectors_without_any(spark):
    none = spark.createDataFrame([(1, None, 1), (None, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.n_links, r.kept) for r in itq_dedup.near_duplicate_vectors(none).collect()) == [(0, True), (0, True)]
    assert itq_dedup.near_duplicate_vectors(none.limit(0)).count() == 0


def test_vectors_have_even_codes():
    sample = np.random.default_rng(1).normal(size=(2000, 32)) * np.linspace(1, 4, 32)
    codes = itq_dedup.fit_codes(itq_dedup._units(sample), bits=32, tables=4)
    z = codes.project(itq_dedup._units(sample))
    assert abs((z > 0).mean(axis=0) - 0.5).max() < 0.1
    assert np.allclose(codes.axes.T @ codes.axes, np.eye(32))




def test_long_words_that_differ_are_not_taken_for_copies(spark):
    one, two = thue_morse(1024)
    head = " ".join(f"h{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"{head} {one}"), (2, f"{head} {two}"), (3, f"{head} {one}")], "doc_id long, text string")
    found = {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(docs).collect()}
    assert found == {1: 0, 2: 0, 3: 13}
    docs = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}


def _compared(x, cosine=0.98):
    """The share of all pairs that meet in a bucket, by tables chosen for this many rows."""
    units = itq_dedup._units(x)
    codes = itq_dedup.choose_tables(units, itq_dedup.fit_codes(units, tables=0), cosine, len(x), float(len(x)) ** 2)
    buckets = {}
    for _, t, c in itq_dedup.entries(codes, codes.steps(units), cosine):
        buckets[t, c] = buckets.get((t, c), 0) + 1
    return sum(n * (n - 1) for n in buckets.values()) / (len(x) * (len(x) - 1))


def test_fewer_pairs_are_compared_as_vectors_are_added():
    r = np.random.default_rng(4)
    x, common = r.normal(size=(24_000, 64)), r.normal(size=64)
    few, many = _compared(x[:3000]), _compared(x)
    assert many < 0.6 * few < 0.3
    assert _compared(x[:4000] + common) < 0.5
    assert _compared(x[:1000] + 3 * common) <= 1  # all of them, once: no tables would compare fewer


def test_vectors_of_a_common_direction(spark):
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=(120, 16)) + 3, r.normal(size=(120, 16)) * 0.3 + 3]).astype(np.float32)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    found = itq_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(1)).withColumn("z", F.lit("x")))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    assert {r.vec_id: r.n_links for r in found.collect()} == {k: int(near[k].sum()) - 1 for k in range(240)}
