import zlib
from collections import Counter
from pathlib import Path

import brute
import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from edgeloom.llm import quality
from edgeloom.llm.common import shared_folder
from edgeloom.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave, written and reread as in a real run."""
    base = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(base / name))
        docs = spark.read.parquet(str(base / name))
        out.append(docs)
    return out


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "decontamination", "mixing", "token_output"]


def test_quality_stage(spark, stages):
    """The documents that stay are those whose plain pairwise sum over all features is positive."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    machine = quality.fit(stages[0], labels)
    kept, some = {r.doc_id for r in stages[1].collect()}, 0
    for r in stages[0].where("n_chars < 3000").collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        stats, words, hashes = quality.statistics(data, np.array([0, len(data)]))
        full = np.column_stack([stats, [[np.log1p(r.n_chars)]]])
        _, slot, value = quality._with_bins(quality._hashed(words, hashes, 1), full, machine.edges)
        gram = (machine.factors[slot] @ machine.factors[slot].T) * np.outer(value, value)
        z = machine.bias + machine.linear[slot] @ value + np.tril(gram, -1).sum()
        if abs(z) > 1e-6:
            assert (z > 0) == (r.doc_id in kept)
            some += 1
    assert some > 100
    known = {r.doc_id: r.quality for r in labels.collect()}
    marked = [known[i] for i in kept if i in known]
    assert 0 < len(kept) < stages[0].count() and sum(marked) / len(marked) > 0.95


def test_near_duplicate_stage(stages):
    docs = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(i for i, (_, _, kept) in brute.near_duplicates(docs).items() if kept)


def test_decontamination_stage(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = brute.contamination([(r.doc_id, r.text) for r in stages[2].collect()], items)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(i for i, _, hit, _ in found if not hit)


def test_mixing_stage(stages):
    """How often each document is taken, by SQL over the documents that the stage got."""
    rows = stages[3].toPandas()
    con = duckdb.connect()
    con.register("documents", rows)
    want = {i: int(taken // size) for i, size, taken in con.sql(f"SELECT doc_id, size, taken FROM ({ORACLES['op3_curriculum_mix']})").fetchall() if size}
    assert Counter(r.doc_id for r in stages[4].collect()) == +Counter(want)


def test_no_table_stays(spark, stages):
    """What run() wrote is gone before its rows are read, and they are those of the stages one by one."""
    base = Path(shared_folder(spark))
    before = {p.name for p in base.iterdir()}
    out = corpus_pipeline.run(spark, SF)
    left = {p.name for p in base.iterdir()} - before
    assert not [n for n in left if n.startswith(("pipeline-", "token-files-"))]
    assert Counter(tuple(r) for r in out.collect()) == Counter(tuple(r) for r in stages[5].collect())


def test_token_stage(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in stages[4].collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[(r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    rows = stages[5].collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows]).tolist()[:-1]]
