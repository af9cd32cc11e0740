"""Validity intervals of ordered versions, and look-ups in them.

All windows share the partition key and order, so a chain of these operators
takes one shuffle on the partition id.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions.text import found

FAR = date(9999, 12, 31)
FAR_INTS = (99991231, 99991230)


def chain() -> Window:
    return Window.partitionBy("partition_id").orderBy("start", "n")


def timeline(versions: DataFrame, today: date) -> DataFrame:
    """Adds ``end`` (the day before the next start, not before the own start; far for the last), ``next_id`` and ``status``."""
    w = chain()
    end = F.greatest("start", F.date_sub(F.lead("start", 1, FAR).over(w), 1))
    x = versions.withColumn("next_id", F.lead("version_id").over(w)).withColumn("end", end)
    return x.withColumn("status", status(F.col("end"), today))


def status(end: Column, today: date) -> Column:
    """In force while open-ended or not yet over on the given day."""
    return F.when(end >= F.lit(date(9999, 12, 30)), "VIGENTE").when(end < F.lit(today), "STORICO").otherwise("VIGENTE")


def overlapping(rows: DataFrame, start, end) -> DataFrame:
    return rows.where((F.col("start") <= F.lit(end)) & (F.col("end") >= F.lit(start)))


def contained(rows: DataFrame, start, end) -> DataFrame:
    return rows.where((F.col("start") >= F.lit(start)) & (F.col("end") <= F.lit(end)))


def at(rows: DataFrame, day) -> DataFrame:
    """What was in force on a day: the version that contains it; of several that begin together, the last."""
    inside = overlapping(rows, day, day)
    w = Window.partitionBy("partition_id").orderBy(F.desc("start"), F.desc("n"))
    return inside.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def current(rows: DataFrame, today) -> DataFrame:
    """In force by status and already begun."""
    return rows.where((F.col("status") == "VIGENTE") & (F.col("start") <= F.lit(today)))


def original(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("n") == 1)


def latest(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("partition_id").orderBy(F.desc("start"), F.desc("n"))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def overlap_join(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows and windows (partition_id, from, to) that overlap; joined on the partition, so never a nested loop."""
    return rows.join(windows, "partition_id").where("start <= to and end >= from")


def file_versions(files: DataFrame, original_date: Column, by: Sequence[str] = ()) -> DataFrame:
    """(path, is_original, version, start) from file names, with the columns that files are told apart by; malformed ones are dropped, and so are later files of one date and version."""
    name = F.element_at(F.split("path", "/"), -1)
    x = files.select("path", *by, name.alias("name"), name.contains("_ORIGINALE_").alias("is_original"))
    v = F.nullif(F.regexp_extract("name", r"_V([0-9]+)", 1), F.lit("")).cast("int")
    d = F.try_to_date(found(F.col("name"), r"_VIGENZA_([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd")
    x = x.withColumn("start", F.when(F.col("is_original") & original_date.isNotNull(), original_date).otherwise(d))
    x = x.withColumn("version", F.coalesce(v, F.when(F.col("is_original"), 1))).where("start is not null and version is not null")
    w = Window.partitionBy(*by, "start", "version").orderBy("path")
    return x.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "name")
