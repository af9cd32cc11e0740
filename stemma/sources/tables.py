"""The test tables and the domain's views of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the versions of their customers: version_id, partition_id, start (date), state, change, price, n."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("partition_id").orderBy("start", "version_id")
    rows = o.select(
        F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("partition_id"), F.to_date("o_orderdate").alias("start"),
        F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("change"), F.col("o_totalprice").alias("price"),
    )
    return rows.withColumn("n", F.row_number().over(w).cast("long"))


def event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the versions of their users: version_id, partition_id, start (date), text, n."""
    w = Window.partitionBy("partition_id").orderBy("ts", "version_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("version_id"), F.col("user_id").alias("partition_id"), "ts", F.to_date("ts").alias("start"), F.col("event_type").alias("text"))
    return rows.withColumn("n", F.row_number().over(w).cast("long")).drop("ts")


def laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(version_id, law): the law behind an order, the smallest supplier of its lines."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("version_id")).agg(F.concat(F.lit("urn:nir:stato:legge;"), F.min("l_suppkey").cast("string")).alias("law"))
