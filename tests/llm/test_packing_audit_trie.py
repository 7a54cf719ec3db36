import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from edgeloom.llm import filter_audit, packing, prefix_trie, ranges

BPE = public_tokenizers.path("word_bpe_49k.json")


# Packing


def naive_best_fit(lengths, window):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= n
        else:
            left.append(window - n)
    return sorted(window - r for r in left)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_fit_against_a_search_of_all_windows(lengths):
    where, used = packing.best_fit(np.array(lengths, np.int64), 64)
    assert sorted(used.tolist()) == naive_best_fit(lengths, 64)
    assert np.bincount(where, weights=lengths, minlength=len(used)).tolist() == used.tolist() if lengths else not len(used)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=60), st.sampled_from([0, 2, 5]))
def test_each_id_lies_in_one_piece_and_padding_is_little(lengths, tolerance):
    row, start, length, sequence = packing.pack_lengths(np.array(lengths), 64, tolerance)
    seen = Counter((int(r), int(s) + k) for r, s, n in zip(row, start, length, strict=True) for k in range(n))
    assert seen == Counter((r, k) for r, n in enumerate(lengths) for k in range(n))
    used = np.bincount(sequence, weights=length).astype(int)
    assert used.min() > 0 and used.max() <= 64
    assert all(64 - u <= tolerance or u & (u - 1) == 0 for u in used.tolist())


def test_whole_documents_stay_whole_where_they_fit():
    lengths = np.array([40, 24, 30, 34, 64, 50, 14, 200])
    row, _, length, _ = packing.pack_lengths(lengths, 64, 0)
    assert Counter(row.tolist()) == Counter([0, 1, 2, 3, 4, 5, 6, 7, 7, 7, 7]) and length.sum() == lengths.sum()


def test_packed_documents(spark):
    r = random.Random(3)
    word = lambda: r.choice(["river", "Stone,", "naïve", "x1", "…", "</s>", "12345"])
    docs = [(k, " ".join(word() for _ in range(r.choice((0, 1, 5, 40, 300))))) for k in range(120)]
    docs += [(7, "again"), (None, "nobody"), (None, "nobody"), (200, None), (201, " \n"), (202, "word " * 9000)]
    frame = spark.createDataFrame([(i, t, 1, "x", b"y") for i, t in docs], "doc_id long, text string, start int, length string, ids binary").repartition(3)
    found = packing.pack(frame, BPE, window=64, chunk_ids=3000, tolerance=4).collect()
    tokenizer = Tokenizer.from_file(BPE)
    whole = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in docs)
    by_sequence, pieces = {}, {}
    for x in found:
        by_sequence.setdefault(x.sequence_id, []).append(x)
        pieces.setdefault((x.doc_id, x.doc_tokens), []).append(x)
        assert len(x.ids) == 4 * x.length
    for rows in by_sequence.values():
        at = 0
        for x in sorted(rows, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 64 and {x.padded_length for x in rows} == {at if at & (at - 1) == 0 else 64}
        assert 64 - at <= 4 or at & (at - 1) == 0
    for (doc, n), rows in pieces.items():
        same = [t for (i, t), k in whole.items() if i == doc and len(t) == n for _ in range(k)]
        if len(same) == 1:  # else pieces of equal documents can't be told apart
            ids = b"".join(x.ids for x in sorted(rows, key=lambda x: x.start))
            assert np.frombuffer(ids, "<u4").tolist() == list(same[0])
    assert sum(x.length for x in found) == sum(len(t) * k for (_, t), k in whole.items())
    assert packing.pack(frame.limit(0), BPE).count() == 0


# Filter audit


def test_first_failures():
    table = filter_audit.first_failure_table()
    for mask in range(32):
        for k, order in enumerate(permutations("ABCDE")):
            fails = [s for s, f in enumerate(order) if mask >> "ABCDE".index(f) & 1]
            assert table[mask, k] == (fails[0] if fails else 5)


def failed(docs):
    out = []
    for i, lang, text in docs:
        t = text or ""
        w = brute.white_words(t)
        f = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t)]
        f.append(i is not None and any(j is not None and j < i and (u or "") == t for j, _, u in docs))
        out.append((i, lang or "", "".join(n for n, x in zip("ABCDE", f, strict=True) if x)))
    return out


def audited(docs, quality, toxic):
    rows, out = failed(docs), {}
    for part in {p for _, p, _ in rows}:
        mine = [(i, f) for i, p, f in rows if p == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                shapley[name] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(name in f for _, f in mine) - len(gone), sum(f == name for _, f in mine), sum(i in quality for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for key in [k for k in out if k[0] == part]:
            out[key].append(shapley[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit(spark):
    r = random.Random(5)
    docs = []
    for k in range(150):
        words = [f"w{r.randrange(r.choice((60, 4000)))}" for _ in range(r.choice((1, 150, 199, 200, 230)))]
        if r.random() < 0.3:
            words[0] = r.choice("#$%&*|")
        text = " ".join(words)
        docs.append((k, r.choice(["en", "de", None, ""]), text.upper() if r.random() < 0.3 else text))
    docs += [(300 + k, "en", docs[k][2]) for k in range(20)] + [(301, "fr", docs[1][2]), (310, "en", None), (311, "de", ""), (310, "en", ""), (None, "en", docs[2][2]), (None, None, docs[2][2])]
    exact = " ".join([f"v{k}" for k in range(100)] * 2)  # half of the words are different: not under the limit
    docs += [(400, "en", exact), (401, "en", exact + " v1"), (402, "en", "é" * 97 + "ABC"), (403, "en", "é" * 96 + "ABCD"), (404, "x", "Aa " * 60_000)]
    quality, toxic = {k for k in range(0, 320, 2)}, {k for k in range(0, 320, 3)}
    labels = [(k, int(k in quality), int(k in toxic)) for k in range(0, 320)] + [(4, 0, None), (4, 1, 1), (None, 1, 1)]
    toxic.add(4)
    frame = spark.createDataFrame([(i, lang, t, 9, "m") for i, lang, t in docs], "doc_id long, lang string, text string, mask int, part string").repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit_documents(frame, known).collect()
    assert {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in found} == audited(docs, quality, toxic)
    assert len(found) == 600 * len({lang or "" for _, lang, _ in docs})
    assert filter_audit.audit_documents(frame.limit(0), known).count() == 0
    assert all(x.good_lost == 0 for x in filter_audit.audit_documents(frame, known.limit(0)).collect())


def test_audit_hands_on_many_parts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 3)
    frame = spark.range(40).selectExpr("id AS doc_id", "concat('p', id % 11) AS lang", "'one two' AS text").coalesce(1)
    found = filter_audit.audit_documents(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    rows = found.where("filter_order = 'ABCDE' AND step = 1").collect()
    assert {(x.part, x.removed) for x in rows} == {(f"p{k}", len(range(k, 40, 11))) for k in range(11)}


# Running sums by range


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums(spark, parts, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        r = random.Random(parts)
        rows = [(r.choice((1, 1, 1, 1, 2, 3, -4)), k, r.randrange(-(2**63), 2**63)) for k in range(300)] + [(5, 0, 1)]
        frame = spark.createDataFrame(rows, "g long, k long, v long")
        found = ranges.running(ranges.range_sorted(frame, "g", "k"), "g", {"n": F.lit(1), "s": F.col("v")})
        want, n, s = [], Counter(), Counter()
        for g, k, v in sorted(rows):
            n[g], s[g] = n[g] + 1, (s[g] + v + 2**63) % 2**64 - 2**63
            want.append((g, k, v, n[g], s[g]))
        assert [(x.g, x.k, x.v, x.n, x.s) for x in sorted(found.collect(), key=lambda x: (x.g, x.k))] == want
        assert ranges.running(ranges.range_sorted(frame.limit(0), "g"), "g", {"n": F.lit(1)}).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# Prefix trie


def trie(rows):
    own = {}
    for c, turn, role, text in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[1] is not None, x[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    rebuilt = {}
    for c, turns in own.items():
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(turns if base == c else own.get(base, [])[:h] + turns[h:])
    nodes = {t[:d] for t in rebuilt.values() for d in range(len(t) + 1)}
    members = {p: [c for c in sorted(rebuilt) if rebuilt[c][: len(p)] == p] for p in nodes}
    children = Counter(p[:-1] for p in nodes if p)
    out = []
    for p in nodes:
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(str(c) for c in members[p] if len(rebuilt[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), children[p], sum(children[q] == 0 for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(-12, 60), 1001, 1003, 2000, 2001]:
        if r.random() < 0.15:
            continue
        for turn in range(r.choice((1, 2, 3, 6, 11))):
            text = r.choice(["hi", "hi", "é" * 5, "", None, f"t{r.randrange(3)}"])
            rows.append((c, turn if turn or r.random() < 0.5 else None, r.choice(["user", "user", None]), text))
    copies = [(500 + 5 * k, turn, "user", f"same {turn}") for k in range(80) for turn in range(4)]
    rows += [*copies, (7, 90, "a", "twice"), (7, 90, "a", "twice"), (None, 1, "user", "lost"), (3000, 1, "user", "long " * 20_000)]
    rows += [(4000, k, "user", f"turn {k % 3}") for k in range(150)]  # one conversation with a fifth of all rows
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_trie(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "MERGED", 2)
    monkeypatch.setattr(prefix_trie, "BLOCK", 128)
    monkeypatch.setattr(prefix_trie, "COMBINED", 40 if seed == 1 else 500_000)
    rows = talks(seed)
    frame = spark.createDataFrame([(c, t, role, text, 1, "z", 3) for c, t, role, text in rows], "conv_id long, turn long, role string, text string, part int, least string, n long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = prefix_trie.prefix_trie(frame).collect()
        empty = prefix_trie.prefix_trie(frame.limit(0)).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((tuple(x) for x in found), key=str) == trie(rows)
    assert empty == 0


# What a table's partitions must not change, and vectors at the ends of the range


def test_a_mix_does_not_depend_on_partitions(spark):
    from edgeloom.llm import curriculum

    r = random.Random(6)
    rows = [(None if k % 3 else k % 5, f"text {k} " + " ".join(r.choice("abc") for _ in range(4)), "s") for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = [curriculum.mix(frame.repartition(n), share=0.7).collect() for n in (1, 5, 7)]
    assert taken[0] == taken[1] == taken[2] and 20 < len(taken[0]) < 36


def test_vectors_of_extreme_length(spark):
    from edgeloom.llm import itq_dedup

    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.01e200]), (3, [1e-200, 1e-200]), (4, [5e-324, 5e-324]), (5, [1.0, -1.0]), (6, [1e308, -1.7e308]), (7, [0.0, 0.0]), (8, [float("inf"), 1.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, label string")
    found = {x.vec_id: (x.n_links, x.component_id) for x in itq_dedup.near_duplicate_vectors(frame).collect()}
    assert found == {**{k: (3, 1) for k in (1, 2, 3, 4)}, **{k: (0, k) for k in (5, 6, 7, 8)}}
