"""Typed edges between acts, partitions and versions, and the neighbourhoods asked of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.sources.staging import staged


def evolution(timeline: DataFrame, law_of: DataFrame | None = None) -> DataFrame:
    """EVOLVE_IN: (start_id, end_id, partition_id, action, start, end, law): the later version's change, interval and law."""
    w = Window.partitionBy("partition_id").orderBy("start", "n")
    nxt = lambda c: F.lead(c).over(w)
    x = timeline.select("partition_id", F.col("version_id").alias("start_id"), nxt("version_id").alias("end_id"), nxt("change").alias("action"), nxt("start").alias("__s"), nxt("end").alias("__e"))
    x = x.where("end_id is not null").select("start_id", "end_id", "partition_id", "action", F.col("__s").alias("start"), F.col("__e").alias("end"))
    return x if law_of is None else x.join(law_of.withColumnRenamed("version_id", "end_id"), "end_id", "left")


def has_version(latest: DataFrame) -> DataFrame:
    return latest.select("partition_id", "version_id", "start", "end", "status")


def repealed_by(versions: DataFrame, edges: DataFrame, is_repeal: Column) -> DataFrame:
    """ABROGATO_DA: (partition_id, law, repealed): the law on the edge into the repealing version; without a law, no edge."""
    repeals = versions.where(is_repeal).select("partition_id", F.col("version_id").alias("end_id"), F.col("start").alias("repealed"))
    return repeals.join(edges.select("end_id", "law"), "end_id").where("law is not null").select("partition_id", "law", "repealed").distinct()


def citations(raw: DataFrame, dates: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """CITA / CITA_ATTO: raw (version_id, target, kind) with the citing version's interval; targets (target) keeps known ones only."""
    x = raw.distinct()
    if targets is not None:
        x = x.join(targets, "target", "left_semi")
    return x.join(dates.select("version_id", "start", "end"), "version_id").select("version_id", "target", "kind", "start", "end")


def loaded(edges: DataFrame, nodes_from: DataFrame, nodes_to: DataFrame, start: str, end: str) -> DataFrame:
    """Edges both of whose ends exist, each once; the nodes are one-column tables of ids."""
    a, b = nodes_from.columns[0], nodes_to.columns[0]
    x = edges.join(nodes_from.select(F.col(a).alias(start)), start, "left_semi")
    return x.join(nodes_to.select(F.col(b).alias(end)), end, "left_semi").distinct().select(*edges.columns)


def unique_keys(nodes: DataFrame, key: str) -> DataFrame:
    """Keys that stand more than once (none in a valid graph)."""
    return nodes.groupBy(key).count().where("count > 1")


def top(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n of each group; Spark keeps n a task before it shuffles."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def versions_near(hits: DataFrame, timeline: DataFrame, edges: DataFrame, start, end, n: int = 6) -> DataFrame:
    """For each hit partition its versions within the range, with the edge that led to them, the first n by date."""
    inside = timeline.join(hits, "partition_id").where((F.col("start") >= F.lit(start)) & (F.col("end") <= F.lit(end)))
    into = edges.select(F.col("end_id").alias("version_id"), F.col("start_id").alias("previous_id"), "action")
    return top(inside, ["partition_id"], ["start", "n"], n).join(into, "version_id", "left")


def then_and_now(hits: DataFrame, timeline: DataFrame, start, end) -> DataFrame:
    """For each hit its first version within the range, other than the one in force, beside that one."""
    mine = timeline.join(hits, "partition_id")
    now = mine.where("status = 'VIGENTE'").groupBy("partition_id").agg(F.max_by(F.struct("version_id", "price"), F.struct("start", "n")).alias("v"))
    old = mine.where((F.col("start") >= F.lit(start)) & (F.col("end") <= F.lit(end))).join(now, "partition_id").where("version_id <> v.version_id")
    old = top(old, ["partition_id"], ["start", "n"], 1)
    return old.select("partition_id", F.col("version_id").alias("old_id"), F.col("price").alias("old_value"), F.col("v.version_id").alias("new_id"), F.col("v.price").alias("new_value"))


def modifying_laws(hits: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """For each hit the first n laws that changed it, with action and date, by date."""
    laws = edges.where("law is not null").join(hits, "partition_id").select("partition_id", "law", "action", "start").distinct()
    return top(laws, ["partition_id"], ["start", "law", "action"], n)


def cited_now(cites: DataFrame, current: DataFrame, n: int = 3) -> DataFrame:
    """Two hops: a version's cited partitions and their current versions, n for each version."""
    now = current.select(F.col("partition_id").alias("target"), F.col("version_id").alias("current_id"), F.col("start").alias("current_start"))
    x = cites.select("version_id", "target").join(now, "target").distinct()
    return top(x, ["version_id"], ["target", "current_id"], n)


def chain_depth(timeline: DataFrame) -> DataFrame:
    """(version_id, partition_id, depth, chain_length): steps from the first version along EVOLVE_IN."""
    w = Window.partitionBy("partition_id")
    return timeline.select("version_id", "partition_id", (F.col("n") - 1).alias("depth"), F.count("*").over(w).alias("chain_length"))


def depths(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(version_id, depth): steps from a chain's first version to each of its versions along EVOLVE_IN, by doubling the steps of each round."""
    jump = edges.select(F.col("end_id").alias("version_id"), F.col("start_id").alias("back"), F.lit(1).cast("long").alias("steps")).distinct()
    for _ in range(rounds):
        jump = staged(jump)
        far = jump.select(F.col("version_id").alias("back"), F.col("back").alias("__b"), F.col("steps").alias("__s"))
        if not jump.join(far.select("back"), "back", "left_semi").head(1):
            break
        jump = jump.join(far, "back", "left").select("version_id", F.coalesce("__b", "back").alias("back"), (F.col("steps") + F.coalesce("__s", F.lit(0))).alias("steps"))
    ends = jump.select("version_id", F.col("steps").alias("depth"))
    first = jump.select(F.col("back").alias("version_id")).join(jump.select("version_id"), "version_id", "left_anti").distinct()
    return ends.unionByName(first.withColumn("depth", F.lit(0).cast("long")))


def around(nodes: DataFrame, edges: Sequence[DataFrame]) -> DataFrame:
    """(node, other, edge): neighbours of the nodes over edge tables (start, end, edge), whichever way they point."""
    every = reduce(DataFrame.unionByName, [e.select("start", "end", "edge") for e in edges])
    both = every.select(F.col("start").alias("node"), F.col("end").alias("other"), "edge").unionByName(every.select(F.col("end").alias("node"), F.col("start").alias("other"), "edge"))
    return both.join(nodes.select("node").distinct(), "node", "left_semi").distinct()


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Nodes by key: a new node's filled columns over those of the old one, new keys added."""
    both = old.select(key, *[F.col(c).alias(f"__{c}") for c in old.columns if c != key]).join(new, key, "full")
    return both.select(key, *[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in old.columns if c != key])


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of each node and edge table."""
    one = [df.agg(F.count("*").alias("rows")).select(F.lit(k).alias("name"), "rows") for k, df in tables.items()]
    return reduce(DataFrame.unionByName, one)


def with_label(nodes: DataFrame, label: str, column: str = "label") -> DataFrame:
    """Nodes one of whose semicolon-separated labels it is."""
    return nodes.where(F.array_contains(F.split(column, ";"), label))
