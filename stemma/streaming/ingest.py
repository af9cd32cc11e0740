"""Incremental ingest of version records into the full and the current table.

A file stream with an explicit schema; its checkpoint remembers which files are
done, and each micro-batch leaves out ids that the table already holds, so a
batch that runs again adds nothing twice. Failed rows aren't marked as done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stemma.sources.index import RECORD, documents

SCHEMA = ", ".join(f"`{c}` string" for c in RECORD)


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, unless no batch has made it yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def add_batch(batch: DataFrame, all_path: str, current_path: str) -> None:
    """Documents of the batch that the table lacks, to both tables; each id once."""
    spark = batch.sparkSession
    docs = documents(batch).dropDuplicates(["versione_id"])
    have = _there(spark, all_path)
    if have is not None:
        docs = docs.join(have.select("versione_id"), "versione_id", "left_anti")
    # the full table last: ids that it holds are done, and a batch that stops before is made up for by the next attempt
    docs = docs.persist()
    try:
        now = docs.where("is_current")
        held = _there(spark, current_path)
        if held is not None:
            now = now.join(held.select("versione_id"), "versione_id", "left_anti")
        now.write.mode("append").parquet(current_path)
        docs.write.mode("append").parquet(all_path)
    finally:
        docs.unpersist()


def start(spark: SparkSession, folder: str, all_path: str, current_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    stream = spark.readStream.schema(SCHEMA).json(folder)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: add_batch(df, all_path, current_path))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def refreshed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``is_current`` from the status anew, and the current table that follows from it."""
    x = rows.withColumn("is_current", F.col("stato_vigenza") == "VIGENTE")
    return x, x.where("is_current")
