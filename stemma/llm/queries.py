"""The queries of the training-data operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import binary, language, lengths, licenses, media, merkle, mixing, packing, quality, simhash
from stemma.llm.common import table


def op1_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages drawn as images: each page's group of cropped or edited copies."""
    pages = table(spark, sf_dir, "pages")
    return media.find_copies(media.rendered(pages, "page_id", "html"), "page_id")


def op2_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    blank = lambda c: F.coalesce(F.col(c), F.lit("?")).alias(c)
    return mixing.mix(docs).select("doc_id", blank("source"), blank("lang"), "topic", "tokens", "probability", "kept")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op5_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.with_digest(binary.packed_rows(table(spark, sf_dir, "documents")))


def op6_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints_with_edits(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), digest=True)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.context_limits(lengths.token_lengths(table(spark, sf_dir, "documents").select("text"), keep=[]))


def op10_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_image_copies, op2_simhash_groups, op3_source_mix, op4_license_scan, op5_token_matrices, op6_merkle_fingerprints, op7_language_id, op8_best_fit_packing, op9_token_counts, op10_quality_scores)
}

#: DuckDB SQL where it can say the same.
ORACLE_SQL: dict[str, str] = {"op3_source_mix": mixing.sql(), "op6_merkle_fingerprints": merkle.SQL}
