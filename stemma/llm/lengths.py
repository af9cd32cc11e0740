"""Exact token-length histogram, and what it answers for every context limit.

Documents are counted by encoded length, before anything is shuffled. For each
length L that occurs, sums from L upwards give how many documents and tokens
lie at or beyond L and how many tokens remain if every document is cut at L.
The sums are taken in two steps (within ranges of lengths, then over ranges),
so no task gets the whole histogram.

Defined results: null and empty texts have length 0; null ids and repeated rows
count like any other; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm import tokens
from stemma.llm.common import map_rows, shared_checkpoint

#: Lengths in a range.
RANGE = 64


def token_lengths(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The documents with ``n_tokens``."""
    path = path or tokens.public_path()

    def make():
        enc = tokens.encoder(path)

        def fn(texts: pa.Array):
            return (np.array([len(enc.ids(t)) if t else 0 for t in texts.to_pylist()], np.int64),)

        return fn

    return map_rows(docs, {"text": F.col("text")}, [T.StructField("n_tokens", T.LongType(), False)], make, keep)


def context_limits(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """A row for each length that occurs.

    n_docs of that length; docs_from and tokens_from: of at least that length;
    kept_tokens: the total if each document is cut at that length; total_tokens;
    quantile: share of documents of at most that length.
    """
    hist = lengths.groupBy(F.col(length).cast("long").alias("length")).agg(F.count("*").alias("n_docs"))
    # read twice below; written once so that the texts are encoded once
    hist = shared_checkpoint(hist)
    hist = hist.withColumn("part", F.floor(F.col("length") / RANGE)).withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    down = Window.partitionBy("part").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    parts = hist.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    over = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each 64 lengths
    every = Window.partitionBy()
    above = parts.select("part", _or0(F.sum("d").over(over)).alias("docs_above"), _or0(F.sum("t").over(over)).alias("tokens_above"), F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("total_tokens"))
    x = hist.join(above, "part")
    x = x.withColumn("docs_from", F.sum("n_docs").over(down) + F.col("docs_above")).withColumn("tokens_from", F.sum("n_tokens").over(down) + F.col("tokens_above"))
    kept = F.col("total_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")
    share = (F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")
    return x.select("length", "n_docs", "docs_from", "tokens_from", kept.alias("kept_tokens"), "total_tokens", F.round(share, 9).alias("quantile"))


def _or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("long"))


def at_limits(limits: DataFrame, asked: list[int]) -> DataFrame:
    """Kept tokens and documents beyond, for any context limits (lengths need not occur)."""
    spark = limits.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in asked], "limit long")
    # kept = the sum of shorter documents' tokens + limit * documents of at least the limit
    nxt = limits.crossJoin(F.broadcast(wanted)).groupBy("limit").agg(
        F.min_by(F.struct("docs_from", "tokens_from"), F.when(F.col("length") >= F.col("limit"), F.col("length"))).alias("s"), F.max("total_tokens").alias("total_tokens")
    )
    docs, toks = _or0(F.col("s.docs_from")), _or0(F.col("s.tokens_from"))
    return nxt.select("limit", docs.alias("docs_from"), (F.col("total_tokens") - toks + F.col("limit") * docs).alias("kept_tokens"))
