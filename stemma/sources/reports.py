"""Evaluation reports as files: questions as JSON, figures as CSV and as a text table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.sources.index import write_csv


def text_lines(summary: DataFrame, keys: Sequence[str], figures: Sequence[str], width: int = 16) -> DataFrame:
    """(value): a heading, a rule and a line for each row by its keys; figures with four decimals, right-aligned."""
    cell = lambda c: F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), width, " ")
    figure = lambda c: F.lpad(F.coalesce(F.format_string("%.4f", F.col(c).cast("double")), F.lit("-")), width, " ")
    line: Column = F.concat(*[cell(k) for k in keys], *[figure(c) for c in figures])
    head = "".join(k[:width].ljust(width) for k in keys) + "".join(c[:width].rjust(width) for c in figures)
    top = summary.sparkSession.createDataFrame([(0, head), (1, "-" * len(head))], "at int, value string")
    rows = summary.select(F.lit(2).alias("at"), line.alias("value"))
    return top.unionByName(rows).orderBy("at", "value").select("value")


def write_reports(questions: DataFrame, summary: DataFrame, path: str, keys: Sequence[str], figures: Sequence[str]) -> None:
    """``questions`` as JSON in a folder for each combination of keys; ``summary`` (a row a combination) as CSV and text."""
    questions.write.mode("overwrite").partitionBy(*keys).json(f"{path}/questions")
    write_csv(summary, f"{path}/summary_csv")
    text_lines(summary, keys, figures).coalesce(1).write.mode("overwrite").text(f"{path}/summary_txt")
