"""From raw documents to encoded training data, stage by stage.

Each stage works on all that its predecessor kept; its result is written as
Parquet and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane.llm import bpe, mixing, near_dedup, pii, quality
from terrane.llm.common import discard, documents, stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go; without labels all stay.

    An empty text is scored like any other.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the least doc_id.

    Texts without words, null ones too, are alike to nothing and stay, and so do
    rows without doc_id.
    """
    gone = near_dedup.near_duplicates(docs, near_dedup.Plan(shingle=5, percent=80)).filter("not kept")
    return docs.join(gone.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced in the texts."""
    return pii.sanitised(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated towards the target weights; every document stays once at least."""
    return mixing.mixed(docs).select("doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token counts and digests of what goes to training, one row for each occurrence.

    A text without words has no tokens.
    """
    return bpe.encoded(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII", remove_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Hashes of floating-point models, sketches and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
