"""From questions to answers in one plan: window, filters, search, fusion, answer.

All questions go through together, keyed by ``qid``; a row of ``docs`` is a
search document as ``sources.index.documents`` makes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions import patterns as P
from stemma.functions import questions as Q
from stemma.operators import answers, graph, search

SIZE, TOP = 8, 5
FIELDS = {"title": 3.0, "numero": 3.0, "numero_puro": 3.0, "testo_puro": 1.0, "names": 1.0}


def understood(questions: DataFrame, expand: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(qid, question) with from, to, code, number, years, asks_text, asks_history, text, size.

    ``expand`` makes the search text of questions without an article from (question, code); by default they are searched as they are.
    """
    q = F.col("question")
    x = questions.withColumns({"w": Q.window(q), "code": Q.short_code(q), "number": Q.article(q), "years": Q.years(q), "asks_history": Q.asks_history(q)})
    x = x.withColumn("asks_text", Q.asks_text(q, F.col("number")))
    every = F.col("asks_history") & (F.col("w.start") == P.CURRENT)  # a history needs the earlier versions too
    x = x.withColumns({"from": F.when(every, P.OPEN_START).otherwise(F.col("w.start")), "to": F.when(every, P.OPEN_END).otherwise(F.col("w.end"))}).drop("w")
    themes = F.col("asks_history") & F.col("number").isNull()
    size = F.when(F.col("code").isNull() & F.col("number").isNull(), 2 * SIZE).otherwise(SIZE)
    size = F.when((F.col("from") == P.ORIGINAL) & F.col("number").isNull(), F.greatest(size, F.lit(12))).otherwise(size)
    asked = q if expand is None else F.when(F.col("number").isNull(), F.coalesce(F.nullif(expand(q, F.col("code")), F.lit("")), q)).otherwise(q)
    return x.withColumns({"text": F.when(themes, Q.themes(q, F.col("code"))).otherwise(F.concat_ws(" ", "code", asked)), "size": size})


def admissible(hits: DataFrame) -> DataFrame:
    """Hits (numero_puro, codice_breve_atto, beside the question's code and years) whose number is no year of the question, and no single digit of another code."""
    x = hits.where(~F.coalesce(F.array_contains("years", F.col("numero_puro")), F.lit(False)))
    same = F.col("code").isNull() | F.coalesce(F.col("codice_breve_atto") == F.col("code"), F.lit(False))
    return x.where(same | ~F.coalesce(F.col("numero_puro").rlike("^[0-9]$"), F.lit(False)))


def _in_window(start: Column, end: Column, today: int) -> Column:
    d = F.col("valido_dal_raw")
    within = (d <= end.cast("int")) & (F.col("valido_al_raw") >= start.cast("int"))
    return F.when(start == P.CURRENT, (F.col("stato_vigenza") == "VIGENTE") & (d <= today)).when(start == P.ORIGINAL, F.col("num_versione") == 0).otherwise(within)


def found(asked: DataFrame, docs: DataFrame, today: int) -> DataFrame:
    """Lexical hits, then vector hits if the questions have a ``vector``, of the strictest filters that leave any.

    Levels: code, article and window; without the article; the window alone;
    nothing but an open window.
    """
    ids = docs.withColumns({"doc_id": F.col("versione_id"), "names": F.array_join("aliases", " ")})
    scores = [search.best_field(ids, asked.select("qid", "text"), FIELDS, 2**31 - 1).select("qid", "doc_id", "score").withColumn("way", F.lit(0))]
    if "vector" in asked.columns:
        near = search.nearest(ids.where("embedding is not null").select("doc_id", F.col("embedding").alias("vector")), asked.select("qid", "vector"), 4 * SIZE)
        # twice what the question takes, before any filter
        near = near.join(asked.select("qid", F.col("size").alias("__size")), "qid").where(F.col("rank") <= 2 * F.col("__size"))
        scores.append(near.select("qid", "doc_id", "score").withColumn("way", F.lit(1)))
    hits = scores[0] if len(scores) == 1 else scores[0].unionByName(scores[1])
    rows = ids.select("doc_id", "partizione_id", "num_versione", "numero", "numero_puro", "titolo_atto", "codice_breve_atto", "stato_vigenza", "stato_norma", "tipo_modifica", "testo_puro", "valido_dal_raw", "valido_al_raw")
    x = hits.join(asked.select("qid", "code", "number", "years", "from", "to", "size"), "qid").join(rows, "doc_id")
    x = admissible(x)
    same = F.col("code").isNull() | F.coalesce(F.col("codice_breve_atto") == F.col("code"), F.lit(False))
    article = F.col("number").isNull() | F.coalesce(F.col("numero_puro") == F.col("number"), F.lit(False))
    window = F.coalesce(_in_window(F.col("from"), F.col("to"), today), F.lit(False))
    # a hit's strictest level; a question keeps the hits of the strictest that any of its hits reaches
    x = x.withColumn("level", F.when(window & same & article, 0).when(window & same, 1).when(window, 2).otherwise(3))
    x = x.withColumn("least", F.min("level").over(Window.partitionBy("qid"))).where("level <= least")
    x = x.withColumn("r", F.row_number().over(Window.partitionBy("qid", "way").orderBy(F.desc("score"), "doc_id"))).where("r <= size")
    return x.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("way", "r"))).drop("least", "r")


def contexts(asked: DataFrame, docs: DataFrame, today: int, score: Column | None = None, top: int = TOP) -> DataFrame:
    """(qid, rank, partition_id, version_id, number, code, title, start, end, state, change, text, level) of the versions that answer each question.

    ``score`` is a reranker's value over the fused hits; by default their order stays.
    """
    bound = lambda c, other: F.coalesce(F.expr(f"try_cast(`{c}` as int)"), F.lit(int(other)))
    hits = found(asked, docs, today).select(
        "qid", "pos", "level", F.col("doc_id").alias("version_id"), F.col("partizione_id").alias("partition_id"), F.col("numero_puro").alias("number"), F.col("numero").alias("article"), F.col("codice_breve_atto").alias("code"),
        F.col("code").alias("asked_code"), F.col("titolo_atto").alias("title"), F.col("stato_vigenza").alias("status"), F.col("stato_norma").alias("state"), F.col("tipo_modifica").alias("change"), F.col("testo_puro").alias("text"),
        F.col("valido_dal_raw").alias("start"), F.col("valido_al_raw").alias("end"), bound("from", P.OPEN_START).alias("from"), bound("to", P.OPEN_END).alias("to"),
    )
    kept = search.coherent(search.fused(hits), F.coalesce(F.col("code") == F.col("asked_code"), F.col("asked_code").isNull()))
    best = search.reranked(kept, -F.col("rank") if score is None else score, top)
    return best.select("qid", F.col("new_rank").alias("rank"), "partition_id", "version_id", F.col("article").alias("number"), "code", "title", "start", "end", "state", "change", "text", "level")


def enriched(contexts: DataFrame, evolves: DataFrame, cites: DataFrame, n_laws: int = 5, n_cited: int = 3) -> DataFrame:
    """The contexts with what the graph holds around them: laws (of changes to the partition, by date) and cited (partitions that the version cites).

    evolves: partition_id, law, action, start; cites: version_id, target.
    """
    laws = graph.modifying_laws(contexts.select("partition_id").distinct(), evolves, n_laws).groupBy("partition_id").agg(F.array_sort(F.collect_list(F.struct("rank", "law", "action", "start"))).alias("laws"))
    cited = graph.top(cites.join(contexts.select("version_id").distinct(), "version_id", "left_semi").select("version_id", "target").distinct(), ["version_id"], ["target"], n_cited)
    cited = cited.groupBy("version_id").agg(F.array_sort(F.collect_list("target")).alias("cited"))
    return contexts.join(laws, "partition_id", "left").join(cited, "version_id", "left")


def ask(
    questions: DataFrame, docs: DataFrame, today: int, generate: Callable[[DataFrame], DataFrame] | None = None, score: Column | None = None,
    expand: Callable[[Column, Column], Column] | None = None, evolves: DataFrame | None = None, cites: DataFrame | None = None,
) -> DataFrame:
    """(qid, mode, answer) for questions (qid, question and, for vector search, vector).

    mode: ``text`` (the literal text), ``history`` (all versions of the article
    found that begin within the window), ``generated`` (by ``generate``, which
    makes (qid, answer) of contexts; null without one) or ``none`` (nothing
    found). ``expand`` is a hook for the search text; with the graph's edges
    (``evolves`` and ``cites``) the generator's contexts are enriched.
    """
    asked = understood(questions, expand)
    got = contexts(asked, docs, today, score)
    flags = asked.select("qid", "asks_text", "asks_history", "from", "to")
    mode = F.when(F.col("asks_text"), "text").when(F.col("asks_history"), "history").otherwise("generated")
    of = got.join(flags.select("qid", mode.alias("mode")), "qid")
    versions = docs.select(
        F.col("partizione_id").alias("partition_id"), F.col("numero").alias("number"), F.col("codice_breve_atto").alias("code"), F.col("titolo_atto").alias("title"), F.col("valido_dal_raw").alias("start"), F.col("valido_al_raw").alias("end"),
        F.col("stato_norma").alias("state"), F.col("tipo_modifica").alias("change"), F.col("testo_puro").alias("text"),
    )
    chain = of.where("mode = 'history'").select("qid", "rank", "partition_id").join(versions, "partition_id")
    parts = [answers.direct(of.where("mode = 'text'")), answers.history(chain)]
    if generate is not None:
        held = of.where("mode = 'generated'").drop("mode")
        parts.append(generate(held if evolves is None or cites is None else enriched(held, evolves, cites)).select("qid", "answer"))
    said = parts[0]
    for p in parts[1:]:
        said = said.unionByName(p)
    found_any = got.select("qid").distinct().withColumn("any", F.lit(True))
    x = asked.select("qid", mode.alias("mode")).join(found_any, "qid", "left").join(said, "qid", "left")
    return x.select("qid", F.when(F.col("any"), F.col("mode")).otherwise("none").alias("mode"), F.when(F.col("any"), F.col("answer")).otherwise(P.NO_SOURCES).alias("answer"))
