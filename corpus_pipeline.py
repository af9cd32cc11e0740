"""A corpus from raw documents to packed sequences, stage by stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stemma.llm import language, mixing, packing, quality, simhash
from stemma.llm.common import shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like any other; rows with a null id and repeated rows
    stay or go by their text; an empty table gives an empty one; without a label all stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go.

    So do null texts and those without a letter. Rows with a null id and repeated rows stay
    or go by their text; an empty table, or one without any known language, gives an empty one.
    """
    return language.keep_known(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    Null and empty texts are near-duplicates of each other; of rows with one id the one with the
    smallest row hash stays, so repeated rows become one; rows with a null id all stay; an empty
    table gives an empty one.
    """
    return simhash.keep_one_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the target shares of sources, languages and topics.

    Null sources and languages are a category; a null id draws by its text; repeated rows stay or
    go together; an empty table gives an empty one.
    """
    return mixing.keep_sample(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in packed sequences.

    A null or empty text is one token; null ids and repeated rows are packed like any other; an
    empty table gives no pieces.
    """
    return packing.pack(docs, digest=True)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned stages and hashed shingles have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again, an empty table too."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
