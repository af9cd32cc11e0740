"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells (source, language, topic) by tokens. Factors of
the cells are raked, one margin after the other, until the cells' tokens have
the target shares of sources, languages and topics: each category's cells are
multiplied by its goal over its sum. It ends when none is multiplied by a number
further than RESIDUAL from 1, or after ROUNDS. The factors are scaled to the
token budget, with no probability above 1, and each document is kept with its
cell's probability by a number drawn from its id. Only DataFrame functions run.
What is raked is the table of cells, a row for each combination that occurs. Up
to ``CELLS`` of them are read into one partition, where a round needs no shuffle;
of more, every sum is a grouping with partial sums. Only single numbers come to
the driver.

Defined results: null sources, languages and topics are each a category of
their own ("?"); a null or empty text counts one token; a null id draws from
the text; rows of equal id and text are kept or left out together; an empty
table gives no rows; categories without a weight get none of the tokens, and if
none of a margin's has any, nothing is kept. A cell whose probability reaches 1
falls short of its share if the budget asks for more than it has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm.common import col, shared_table, without

MARGINS = ("source", "lang", "topic")
#: Target weights of the categories, ``*`` of each category that isn't named; shares are weights over the sum of those that occur.
TARGETS: dict[str, dict[str, float]] = {
    "source": {"*": 1.0},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.12, "*": 0.03},
    "topic": {"prose": 0.88, "legal": 0.03, "tabular": 0.02, "noisy": 0.05, "*": 0.02},
}
#: Rounds of raking at most, the change of factors at which it ends, rounds of fitting the budget, and the share of all tokens to keep.
ROUNDS, RESIDUAL, FITS, BUDGET = 14, 1e-12, 8, 0.6
#: Cells up to which one partition has them all and documents stay in place; beyond it both are shuffled.
CELLS = 200_000


def token_estimate(text: Column) -> Column:
    """Four bytes a token, at least one."""
    return F.greatest(F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4), F.lit(1)).cast("double")


def topic_of(text: Column) -> Column:
    """A coarse subject from surface signs: tabular, noisy, legal or prose."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains(" | "), "tabular").when(t.contains("***") | t.contains("!!") | t.contains("###"), "noisy").when(t.contains("icense") | t.contains("ights reserved"), "legal").otherwise("prose")


def draw(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from the id (or the text, if the id is null)."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(16**13)


def weight(category: Column, weights: Mapping[str, float]) -> Column:
    out = F.lit(float(weights.get("*", 0.0)))
    for name, w in weights.items():
        if name != "*":
            out = F.when(category == name, F.lit(float(w))).otherwise(out)
    return out


def gathered(cells: DataFrame) -> DataFrame:
    """The cells in one partition, if they are few."""
    return cells.coalesce(1) if cells.count() <= CELLS else cells


def _with_sums(cells: DataFrame, m: str, few: bool) -> DataFrame:
    """The cells with ``now``, the tokens by factors of their category of a margin."""
    own = F.sum(F.col("tokens") * F.col("factor"))
    if few:
        return cells.withColumn("now", own.over(Window.partitionBy(m)))
    return cells.join(cells.groupBy(m).agg(own.alias("now")).hint("merge"), m)


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS, rounds: int = ROUNDS, residual: float = RESIDUAL) -> DataFrame:
    """Cells (the targets' margins and ``tokens``) with ``factor``: tokens * factor has the target shares and sums to 1.

    A category whose cells all have factor 0 through other margins keeps 0. A
    round is one plan, written and read again. Each exchange of a plan costs the
    driver a thread and memory that it keeps, and each broadcast still more: few
    cells are summed by windows in one partition, more are merged with sorted sums.
    """
    margins = list(targets)
    few = cells.count() <= CELLS
    held = lambda x: x.coalesce(1) if few else x
    out = first = held(cells)
    for m in margins:
        own = first.select(m).distinct().withColumn("w", weight(F.col(m), targets[m]))
        every = own.agg(F.sum("w")).first()[0] or 0.0
        out = out.join(own.select(m, (F.col("w") / every if every else F.lit(0.0)).alias(f"goal_{m}")).hint("merge"), m)
    cells = held(shared_table(out.withColumn("factor", F.lit(1.0))))
    names = cells.columns
    for _ in range(rounds):
        now = cells
        for m in margins:
            now = _with_sums(now, m, few).withColumn(f"by_{m}", F.when(F.col("now") > 0, F.col(f"goal_{m}") / F.col("now")).otherwise(1.0))
            now = now.withColumn("factor", F.col("factor") * F.col(f"by_{m}")).drop("now")
        now = held(shared_table(now))
        moved = now.agg(F.max(F.greatest(*[F.abs(F.col(f"by_{m}") - 1) for m in margins]))).first()[0]
        cells = now.select(*names)
        if (moved or 0.0) <= residual:
            break
    return cells.drop(*[f"goal_{m}" for m in margins])


def probabilities(cells: DataFrame, budget: float = BUDGET, fits: int = FITS) -> DataFrame:
    """Cells with ``probability``: factors scaled so that expected tokens meet the budget, as far as probabilities up to 1 allow."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    scale = goal = budget * total
    for _ in range(fits):
        full = F.col("factor") * scale >= 1
        at_one, free = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("factor")))).first()
        if not free:
            break
        scale, before = max(goal - at_one, 0.0) / free, scale
        if scale == before:
            break
    return cells.withColumn("probability", F.least(F.col("factor") * scale, F.lit(1.0)))


def with_cells(docs: DataFrame) -> DataFrame:
    """Each document as one struct, ``row``, beside what mixing goes by; so no name can clash."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("?"))
    return docs.select(
        F.struct(*[col(c) for c in docs.columns]).alias("row"), blank("source").alias("source"), blank("lang").alias("lang"), topic_of(F.col("text")).alias("topic"),
        token_estimate(F.col("text")).alias("tokens"), draw(F.col("doc_id"), F.col("text")).alias("draw"),
    )


def sampled(docs: DataFrame, budget: float = BUDGET, targets: Mapping[str, Mapping[str, float]] = TARGETS) -> DataFrame:
    """(row, topic, tokens, probability, kept) of every document."""
    rows = with_cells(docs)
    cells = shared_table(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    cells = shared_table(probabilities(gathered(shared_table(rake(cells, {m: targets[m] for m in MARGINS}))), budget)).select(*MARGINS, "probability")
    joined = rows.join(F.broadcast(cells) if cells.count() <= CELLS else cells, list(MARGINS))
    p = F.round("probability", 6)
    return joined.select("row", "topic", F.col("tokens").cast("long").alias("tokens"), p.alias("probability"), (F.col("draw") < p).alias("kept"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """All documents with ``topic``, ``tokens``, ``probability`` and ``kept``; columns of these names give way."""
    names = ["topic", "tokens", "probability", "kept"]
    return sampled(docs, **options).select(*[F.col("row").getField(c).alias(c) for c in without(docs, names)], *names)


def keep_sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled documents, with their own columns only."""
    return sampled(docs, **options).where("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def sql(targets: Mapping[str, Mapping[str, float]] = TARGETS, rounds: int = ROUNDS, fits: int = FITS, budget: float = BUDGET) -> str:
    """The same rows by DuckDB, with every round written out."""
    of = lambda m: "CASE " + " ".join(f"WHEN {m} = '{k}' THEN {w}" for k, w in targets[m].items() if k != "*") + f" ELSE {targets[m].get('*', 0.0)} END" if len(targets[m]) > 1 else str(targets[m]["*"])
    parts = ["""d AS (SELECT doc_id, coalesce(source, '?') AS source, coalesce(lang, '?') AS lang,
  CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'tabular' WHEN contains(coalesce(text, ''), '***') OR contains(coalesce(text, ''), '!!') OR contains(coalesce(text, ''), '###') THEN 'noisy'
    WHEN contains(coalesce(text, ''), 'icense') OR contains(coalesce(text, ''), 'ights reserved') THEN 'legal' ELSE 'prose' END AS topic,
  greatest(ceil(strlen(coalesce(text, '')) / 4), 1)::DOUBLE AS tokens,
  ('0x' || substring(md5(coalesce(doc_id::VARCHAR, 't' || coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw FROM documents)""",
        "c AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM d GROUP BY ALL)"]
    for m in targets:
        parts.append(f"g_{m} AS (SELECT {m}, w / sum(w) OVER () AS goal_{m} FROM (SELECT DISTINCT {m}, ({of(m)})::DOUBLE AS w FROM c))")
    parts.append("r0 AS (SELECT c.*, " + ", ".join(f"goal_{m}" for m in targets) + ", 1.0::DOUBLE AS factor FROM c " + " ".join(f"JOIN g_{m} USING ({m})" for m in targets) + ")")
    k = 0
    for _ in range(rounds):
        for m in targets:
            parts.append(f"r{k + 1} AS MATERIALIZED (SELECT * REPLACE (factor * goal_{m} / sum(tokens * factor) OVER (PARTITION BY {m}) AS factor) FROM r{k})")
            k += 1
    parts.append(f"s0 AS MATERIALIZED (SELECT {budget} * sum(tokens) AS goal, {budget} * sum(tokens) AS scale FROM c)")
    for i in range(fits):
        free, one = "sum(CASE WHEN factor * scale >= 1 THEN 0 ELSE tokens * factor END)", "sum(CASE WHEN factor * scale >= 1 THEN tokens ELSE 0 END)"
        parts.append(f"s{i + 1} AS MATERIALIZED (SELECT goal, CASE WHEN {free} > 0 THEN greatest(goal - {one}, 0) / {free} ELSE scale END AS scale FROM r{k}, s{i} GROUP BY goal, scale)")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, source, lang, topic, d.tokens::BIGINT AS tokens, round(least(factor * scale, 1.0), 6) AS probability, draw < round(least(factor * scale, 1.0), 6) AS kept FROM d JOIN r{k} USING (source, lang, topic), s{fits}"
