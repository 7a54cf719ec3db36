"""The corpus pipeline: documents in, token files out, one written table between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgeloom.llm import curriculum, decontaminate, minhash_dedup, quality, token_files
from edgeloom.llm.common import remove_folder, shared_folder, unique_name


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return minhash_dedup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of the benchmark occurs go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order."""
    return curriculum.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents as token files, read back: a row for each time that a document is taken."""
    import public_tokenizers  # only this stage needs it

    return token_files.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: SQL cannot express the first and the last stage; tests/llm/test_pipeline.py holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, keep_tables: bool = False) -> DataFrame:
    """All stages over documents, each stage's rows written as Parquet and reread by the next.

    A stage's table goes once the next one is written, unless it is to be kept, so that two stand on
    disk at a time; a stage that fails can be run again on the table before it. The last stage reads its
    table while it is built and returns a checkpoint's rows, so that its table goes too.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark).rstrip('/')}/{unique_name('pipeline')}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        at = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if k and not keep_tables:
            remove_folder(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    out = STAGES[-1][1](spark, docs, sf_dir)
    if not keep_tables:
        remove_folder(spark, base)
    return out
