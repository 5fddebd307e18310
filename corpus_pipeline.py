"""A corpus pipeline: five stages over the documents table, each an operator whose decisions take effect.

Every stage works on what its predecessor kept, written as Parquet and read again.

Defined cases, for every stage: a null text stays null and counts as empty: the quality classifier judges it as a text
without words, it has no copies, no passages, no identifiers and no pieces; a null id is a document of its own that
stays; rows that repeat an id stay or go together in near_dedup and are judged one by one elsewhere; an empty table
gives an empty one; columns beyond those of documents are dropped, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import fm_index, near_dup, pii, piece_lattice, weak_quality
from quillstone.runtime import keep_until_exit, scratch, scratch_path, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    judged = weak_quality.classify(docs, COLUMNS, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("accepted").select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest id.

    Rows that repeat an id count as one document: all of them stay or go.
    """
    found = near_dup.near_duplicates(docs.select("doc_id", "text")).where("NOT kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(found, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every passage of the benchmark out of the texts."""
    return fm_index.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), COLUMNS, cleaned=True).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the name of its kind in place of every identifier."""
    return pii.detect(docs, COLUMNS, redacted=True).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The best segmentation of each text into pieces, with the scores of the best three."""
    return piece_lattice.encode(docs, ["doc_id", "lang", "source"], str(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [("quality", quality), ("near_dedup", dedup), ("decontaminate", decontaminate), ("pii", redact), ("encode", encode)]

#: SQL can't express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the tables between them lie in the shared folder.

    When a stage's table is written, its predecessor's and the stage's own scratch tables are deleted; the last one
    stays until the process ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch():
        for name, stage in STAGES[:-1]:
            docs = _written(stage(spark, docs, sf_dir), scratch_path(spark, name))
        path = f"{shared_dir(spark)}/quillstone-pipeline-{uuid.uuid4().hex}"
        docs = _written(STAGES[-1][1](spark, docs, sf_dir), path)
    keep_until_exit(spark, path)
    return docs


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
