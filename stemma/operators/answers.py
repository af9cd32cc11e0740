"""Answers that need no language model: the literal text and the history of an article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions.text import first_filled, sentences_once


def until(end: Column) -> Column:
    return F.when(end.isin(99991231, 99991230), "in vigore").otherwise(end.cast("string"))


def direct(contexts: DataFrame) -> DataFrame:
    """(qid, answer): each context's source line and text, in order; contexts: qid, rank, number, code, title, start, end, state, text."""
    tag = F.coalesce(F.concat(F.lit(" "), F.nullif("code", F.lit(""))), F.concat(F.lit(" — "), F.nullif("title", F.lit(""))), F.lit(""))
    source = F.concat(F.col("number"), tag, F.lit(" [vigente dal "), F.col("start").cast("string"), F.lit(" "), until(F.col("end")), F.lit("]"))
    source = F.concat(source, F.when(F.col("state") != "ATTIVO", F.concat(F.lit(" ["), F.col("state"), F.lit("]"))).otherwise(""))
    line = F.concat(source, F.lit("\n\n"), F.coalesce("text", F.lit("")))
    x = contexts.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return x.select("qid", F.array_join(F.transform("l", lambda s: s["line"]), "\n\n---\n\n").alias("answer"))


def largest_partition(contexts: DataFrame) -> DataFrame:
    """The contexts of each question's partition with most versions; of equals the one that begins first, then came first."""
    g = contexts.where("partition_id is not null").groupBy("qid", "partition_id").agg(F.count("*").alias("versions"), F.min("start").alias("since"), F.min("rank").alias("came"))
    w = Window.partitionBy("qid").orderBy(F.desc("versions"), "since", "came")
    best = g.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("qid", "partition_id", "versions")
    return contexts.join(best, ["qid", "partition_id"])


def history(contexts: DataFrame) -> DataFrame:
    """(qid, answer): the largest partition's versions in order of time."""
    x = largest_partition(contexts).withColumn("__t", F.coalesce("text", F.lit("")))
    kind = F.when((F.coalesce("change", F.lit("")) != "") & (F.col("change") != "originale"), F.concat(F.lit(" "), F.col("change"))).otherwise("")
    state = F.when(F.col("state") != "ATTIVO", F.concat(F.lit(" ["), F.col("state"), F.lit("]"))).otherwise("")
    line = F.concat(F.lit("  ["), F.col("start").cast("string"), F.lit(" → "), until(F.col("end")), F.lit("]"), kind, state, F.lit("\n    "), F.substring("__t", 1, 300), F.when(F.length("__t") > 300, "...").otherwise(""))
    head = first_filled(F.col("code"), F.col("title"))
    g = x.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("start", "rank", line.alias("line")))).alias("l"), F.min_by(F.struct("number", F.coalesce(head, F.lit("")).alias("code")), F.struct("start", "rank")).alias("h"), F.max("versions").alias("n"))
    first = F.concat(F.lit("Storia di "), F.col("h.number"), F.lit(" "), F.col("h.code"), F.lit(" ("), F.col("n").cast("string"), F.lit(" versioni nel dataset)\n"))
    return g.select("qid", F.concat_ws("\n", first, F.array_join(F.transform("l", lambda s: s["line"]), "\n")).alias("answer"))


def all_versions(articles: DataFrame, docs: DataFrame, size: int = 50) -> DataFrame:
    """The versions of each asked article (qid, number, code, from, to), by date, at most ``size`` a question; several versions of a partition stay.

    Versions never meet all questions of their article. ``to`` only ends a list
    by date, so questions of one article and ``from`` share theirs. For that list,
    an article's versions are dealt by how many of its distinct ``from`` they last
    to; of each range of 1, 2, 4, ... such numbers the first ``size`` suffice, and
    a ``from`` takes the few ranges that make up its own number and all above.
    """
    key, order = ["number", "code"], ["valido_dal_raw", "versione_id"]
    d = docs.withColumnsRenamed({"numero_puro": "number", "codice_breve_atto": "code"})
    own, asking = ([c for c in x.columns if c not in key] for x in (d, articles))

    def first(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= size).drop("__r")

    asked = articles.select(*key, "from").where("number is not null and code is not null and `from` is not null").distinct()
    d = first(d.where("number is not null and code is not null and valido_dal_raw is not null and valido_al_raw is not null"), [*key, "valido_al_raw"])
    # a version's number: of the article's ``from`` that are not after its end
    at = lambda x, c, is_from: x.select(*key, F.col(c).alias("__at"), F.lit(is_from).alias("__from"), *[F.col(n) if not is_from else F.lit(None).alias(n) for n in own])
    w = Window.partitionBy(*key)
    x = at(d, "valido_al_raw", 0).unionByName(at(asked, "from", 1))
    x = x.withColumns({"__n": F.sum("__from").over(w.orderBy("__at", F.desc("__from")).rowsBetween(Window.unboundedPreceding, 0)) - 1, "__last": F.sum("__from").over(w) - 1})
    x = x.where("__from = 0 and __n >= 0").drop("__at", "__from")
    node = "transform(sequence(0, length(bin(__last)) - 1), l -> struct(l as level, shiftright(__n, l){right} as node))"
    x = x.select(*key, F.inline(F.expr(node.format(right=""))), *own).where("level = 0 or node % 2 = 1")
    held = first(x, [*key, "level", "node"])
    f = asked.withColumns({"__n": F.row_number().over(w.orderBy("from")) - 1, "__last": F.count("*").over(w) - 1})
    right = F.filter(F.expr(node.format(right=" + 1")), lambda s: s["node"] % 2 == 1)
    f = f.select(*key, "from", F.inline(F.concat(F.expr("array(struct(0 as level, __n as node))"), right)))
    hits = first(f.join(held, [*key, "level", "node"]), [*key, "from"]).drop("level", "node")
    x = hits.join(articles, [*key, "from"]).where(F.col("valido_dal_raw") <= F.col("to"))
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)).cast("long"))
    return x.where(F.col("rank") <= size).select(*key, *own, *asking, "rank")


def context_block(contexts: DataFrame, limit: int = 800) -> DataFrame:
    """(qid, context): the numbered sources for a generator: head, validity, opening; contexts: qid, rank, number, code, title, start, end, state, text and, where asked, versions."""
    code, title = F.coalesce("code", F.lit("")), F.coalesce("title", F.lit(""))
    head = F.concat(F.coalesce("number", F.lit("")), F.when(code != "", F.concat(F.lit(" "), code)).otherwise(""), F.when(title != "", F.concat(F.lit(" — "), title)).otherwise(""))
    state = F.when((F.coalesce("state", F.lit("")) != "") & (F.col("state") != "ATTIVO"), F.concat(F.lit(" ["), F.col("state"), F.lit("]"))).otherwise("")
    several = F.lit("")
    if "versions" in contexts.columns:
        note = F.concat(F.lit("\n  ⚠ Nota: nel periodo richiesto valgono "), F.col("versions").cast("string"), F.lit(" versioni di questo articolo; è riportata quella in vigore più a lungo."))
        several = F.when(F.col("versions") > 1, note).otherwise("")
    text = F.substring(sentences_once(F.coalesce("text", F.lit(""))), 1, limit)
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), head, F.lit("\nVigenza: "), F.coalesce(F.col("start").cast("string"), F.lit("?")), F.lit(" → "), until(F.col("end")), state, several, F.lit("\nTesto: "), text, F.lit("\n\n"))
    x = contexts.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return x.select("qid", F.array_join(F.transform("l", lambda s: s["line"]), "").alias("context"))
