"""Queries of search, answers, evaluation, graph and files beyond the first catalogue, each with the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions import patterns as P
from stemma.functions import text
from stemma.operators import answers, ask, graph, metrics, search, temporal
from stemma.plans.catalogue import COMPLETE, ABLATION, EDGES, GRADES, HITS, REPEAL, STOP, TALK, TL, TOKENS, _dates, _edges, _graded, _hits, _rx, _talk, _timeline, _window_sql, query
from stemma.sources import index, reports
from stemma.sources.staging import shared_folder
from stemma.sources.tables import history, table

S, E = "strftime(start, '%Y%m%d')::INT", "strftime(\"end\", '%Y%m%d')::INT"

# ------------------------------------------------------------ search


@query(f"""WITH f AS (SELECT doc_id, text, 1.0::DOUBLE AS boost FROM documents UNION ALL SELECT doc_id, source || ' ' || lang, 3.0::DOUBLE FROM documents), d AS (SELECT doc_id, boost, {TOKENS} AS w FROM f), q AS (SELECT DISTINCT item_id AS qid, unnest({TOKENS}) AS term FROM (SELECT item_id, 'src3 en ' || text AS text FROM benchmark)),
st AS (SELECT boost, count(*) AS n, avg(len(w)) AS avgdl FROM d GROUP BY boost), p AS (SELECT boost, doc_id, dl, term, count(*) AS tf FROM (SELECT boost, doc_id, len(w) AS dl, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT boost, term, count(*) AS df FROM p GROUP BY ALL),
x AS (SELECT qid, doc_id, boost, round(boost * sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 4) AS score FROM q JOIN p USING (term) JOIN df USING (boost, term) JOIN st USING (boost) GROUP BY qid, doc_id, boost),
b AS (SELECT qid, doc_id, max(score) AS score FROM x GROUP BY qid, doc_id) SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= 10""")
def best_field_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"), F.concat_ws(" ", "source", "lang").alias("head"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("src3 en "), "text").alias("text"))
    return search.best_field(docs, asked, {"body": 1.0, "head": 3.0}).select("qid", "doc_id", "score", "rank")


@query(f"""WITH {TALK}, q AS (SELECT id, text, lower(text) AS d FROM s), x AS (SELECT id, {_window_sql(1)} AS f, {_window_sql(2)} AS t, CASE {" ".join(f"WHEN regexp_matches(d, {_rx(p)}) THEN {_rx(c)}" for p, c in P.code_patterns(plain=True))} END AS code, regexp_extract(d, {_rx(P.ARTICLE_ASKED)}, 1) AS n, list_distinct(regexp_extract_all(d, {_rx(P.YEARS)}, 1)) AS years,
  {" OR ".join(f"contains(d, '{w}')" for w in P.HISTORY_WORDS)} OR {" OR ".join(f"regexp_matches(d, {_rx(p)})" for p in P.HISTORY_FORMS)} AS asks_history FROM q),
y AS (SELECT *, CASE WHEN n <> '' AND NOT list_contains(years, regexp_extract(n, '^\\d+')) THEN n END AS number, CASE WHEN asks_history AND f = '{P.CURRENT}' THEN '{P.OPEN_START}' ELSE f END AS "from", CASE WHEN asks_history AND f = '{P.CURRENT}' THEN '{P.OPEN_END}' ELSE t END AS "to" FROM x),
z AS (SELECT *, CASE WHEN code IS NULL AND number IS NULL THEN 16 ELSE 8 END AS size0 FROM y) SELECT id, "from", "to", code, number, CASE WHEN "from" = '{P.ORIGINAL}' AND number IS NULL THEN greatest(size0, 12) ELSE size0 END AS size FROM z""")
def understood_questions(spark, sf_dir):
    asked = _talk(spark, sf_dir).withColumnsRenamed({"id": "qid", "text": "question"})
    return ask.understood(asked).select(F.col("qid").alias("id"), "from", "to", "code", "number", "size")


@query("""WITH h AS (SELECT l_orderkey, l_linenumber, (l_partkey % 40)::VARCHAR AS numero_puro, l_returnflag AS codice_breve_atto, CASE WHEN l_suppkey % 3 > 0 THEN 'R' END AS code, CASE WHEN l_suppkey % 2 = 0 THEN ['12', '30'] ELSE [] END AS years FROM lineitem)
SELECT l_orderkey, l_linenumber, numero_puro FROM h WHERE NOT list_contains(years, numero_puro) AND (code IS NULL OR codice_breve_atto = code OR NOT regexp_matches(numero_puro, '^[0-9]$'))""")
def admissible_hits(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 40).cast("string").alias("numero_puro"), F.col("l_returnflag").alias("codice_breve_atto"), F.when(F.col("l_suppkey") % 3 > 0, "R").alias("code"),
        F.when(F.col("l_suppkey") % 2 == 0, F.array(F.lit("12"), F.lit("30"))).otherwise(F.array().cast("array<string>")).alias("years"),
    )
    return ask.admissible(x).select("l_orderkey", "l_linenumber", "numero_puro")


# ------------------------------------------------------------ answers

CONTEXTS = TL + f""", ctx AS (SELECT partition_id % 50 AS qid, row_number() OVER (PARTITION BY partition_id % 50 ORDER BY price DESC, version_id) AS rank, partition_id, 'Art. ' || partition_id AS number, CASE WHEN partition_id % 3 > 0 THEN 'c.c.' END AS code, 'Atto ' || state AS title, {S} AS start, {E} AS "end", CASE WHEN state = 'F' THEN 'ATTIVO' ELSE 'STORICO' END AS state, change, 'Testo di ' || version_id || '. Testo di ' || version_id || '. Fine.' AS text FROM tl)"""
UNTIL = "CASE WHEN \"end\" IN (99991231, 99991230) THEN 'in vigore' ELSE \"end\"::VARCHAR END"


def _contexts(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    t = _dates(_timeline(spark, sf_dir), "start", "end")
    w = Window.partitionBy("qid").orderBy(F.desc("price"), "version_id")
    k, v = F.col("partition_id"), F.concat(F.lit("Testo di "), F.col("version_id").cast("string"), F.lit(". "))
    return t.withColumn("qid", k % 50).select(
        "qid", F.row_number().over(w).cast("long").alias("rank"), "partition_id", "version_id", F.concat(F.lit("Art. "), k.cast("string")).alias("number"), F.when(k % 3 > 0, "c.c.").alias("code"), F.concat(F.lit("Atto "), "state").alias("title"),
        "start", "end", F.when(F.col("state") == "F", "ATTIVO").otherwise("STORICO").alias("state"), "change", F.concat(v, v, F.lit("Fine.")).alias("text"),
    )


@query(f"""WITH {CONTEXTS} SELECT qid, md5(string_agg(number || coalesce(' ' || code, ' — ' || title, '') || ' [vigente dal ' || start || ' ' || {UNTIL} || ']' || CASE WHEN state <> 'ATTIVO' THEN ' [' || state || ']' ELSE '' END || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS answer_md5 FROM ctx WHERE rank <= 5 GROUP BY qid""")
def direct_answers(spark, sf_dir):
    return answers.direct(_contexts(spark, sf_dir).where("rank <= 5")).select("qid", F.md5("answer").alias("answer_md5"))


LARGEST = CONTEXTS + """, g AS (SELECT qid, partition_id, count(*) AS versions, min(start) AS since, min(rank) AS came FROM ctx GROUP BY ALL), best AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY qid ORDER BY versions DESC, since, came) = 1)"""


@query(f"WITH {LARGEST} SELECT qid, partition_id, versions FROM best")
def largest_partition(spark, sf_dir):
    return answers.largest_partition(_contexts(spark, sf_dir)).select("qid", "partition_id", "versions").distinct()


@query(f"""WITH {LARGEST}, x AS (SELECT ctx.*, versions FROM ctx JOIN best USING (qid, partition_id)) SELECT qid, md5('Storia di ' || arg_min(number, start::BIGINT * 1000000 + rank) || ' ' || arg_min(coalesce(code, title), start::BIGINT * 1000000 + rank) || ' (' || max(versions) || ' versioni nel dataset)' || chr(10) || chr(10) ||
  string_agg('  [' || start || ' → ' || {UNTIL} || '] ' || change || CASE WHEN state <> 'ATTIVO' THEN ' [' || state || ']' ELSE '' END || chr(10) || '    ' || text, chr(10) ORDER BY start, rank)) AS answer_md5 FROM x GROUP BY qid""")
def history_answers(spark, sf_dir):
    return answers.history(_contexts(spark, sf_dir)).select("qid", F.md5("answer").alias("answer_md5"))


@query(f"""WITH {CONTEXTS} SELECT qid, md5(string_agg('[' || rank || '] ' || number || coalesce(' ' || code, '') || ' — ' || title || chr(10) || 'Vigenza: ' || start || ' → ' || {UNTIL} || CASE WHEN state <> 'ATTIVO' THEN ' [' || state || ']' ELSE '' END || chr(10) || 'Testo: ' || CASE WHEN length(text) < 50 THEN text ELSE text[: (length(text) - 6) // 2] || ' Fine.' END || chr(10) || chr(10), '' ORDER BY rank)) AS context_md5 FROM ctx WHERE rank <= 5 GROUP BY qid""")
def context_blocks(spark, sf_dir):
    # texts as far as they go; a repeated sentence stands once in those of 50 characters and more
    return answers.context_block(_contexts(spark, sf_dir).where("rank <= 5")).select("qid", F.md5("context").alias("context_md5"))


@query(f"""WITH {TL}, d AS (SELECT version_id, partition_id % 7 AS number, state AS code, {S} AS s, {E} AS e FROM tl), a AS (SELECT c_custkey AS qid, c_custkey % 7 AS number, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS code, 19950000 + (c_custkey % 5) * 10000 AS f, 20001231 AS t FROM customer WHERE c_custkey % 40 = 0)
SELECT qid, version_id::VARCHAR AS version_id, row_number() OVER (PARTITION BY qid ORDER BY s, version_id::VARCHAR) AS rank FROM d JOIN a USING (number, code) WHERE s <= t AND e >= f QUALIFY rank <= 50""")
def all_versions_of_article(spark, sf_dir):
    t = _dates(_timeline(spark, sf_dir), "start", "end")
    docs = t.select(F.col("version_id").cast("string").alias("versione_id"), (F.col("partition_id") % 7).alias("numero_puro"), F.col("state").alias("codice_breve_atto"), F.col("start").alias("valido_dal_raw"), F.col("end").alias("valido_al_raw"))
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").where(k % 40 == 0).select(k.alias("qid"), (k % 7).alias("number"), F.when(k % 2 == 0, "F").otherwise("O").alias("code"), (19950000 + (k % 5) * 10000).alias("from"), F.lit(20001231).alias("to"))
    return answers.all_versions(asked, docs).select("qid", F.col("versione_id").alias("version_id"), "rank")


@query(f"""WITH {TL}, x AS (SELECT version_id, 'Art. ' || partition_id AS number, CASE WHEN partition_id % 2 = 0 THEN 'c.c.' ELSE '' END AS short, CASE WHEN partition_id % 3 = 0 THEN 'Codice Civile' ELSE '' END AS common, {S} AS s, {E} AS e, status, CASE WHEN n = 1 THEN 'originale' ELSE change END AS kind, 'Testo ' || version_id AS text FROM tl)
SELECT version_id, md5(number || CASE WHEN short <> '' THEN ' ' || short WHEN common <> '' THEN ' ' || common ELSE ' Titolo' END || CASE WHEN common <> '' THEN chr(10) || chr(10) || common ELSE '' END || chr(10) || chr(10) || 'Vigente dal ' || s || ' ' ||
  CASE status WHEN 'STORICO' THEN 'storico, fino al ' || e ELSE CASE WHEN e = 99991231 THEN 'in vigore' ELSE 'fino al ' || e END END || CASE WHEN kind <> 'originale' THEN chr(10) || chr(10) || 'Tipo modifica: ' || kind ELSE '' END || chr(10) || chr(10) || text) AS text_md5 FROM x""")
def embedding_texts(spark, sf_dir):
    t = _dates(_timeline(spark, sf_dir), "start", "end")
    k, none = F.col("partition_id"), F.lit("")
    made = text.embedding_text(
        F.concat(F.lit("Art. "), k.cast("string")), F.when(k % 2 == 0, "c.c.").otherwise(""), F.when(k % 3 == 0, "Codice Civile").otherwise(""), none, none, F.lit("Titolo"), F.col("start").cast("string"), F.col("end").cast("string"),
        F.when(F.col("n") == 1, "originale").otherwise(F.col("change")), F.col("status"), F.concat(F.lit("Testo "), F.col("version_id").cast("string")),
    )
    return t.select("version_id", F.md5(made).alias("text_md5"))


# ------------------------------------------------------------ evaluation


def _at(k: int) -> tuple[str, str]:
    return COMPLETE.replace("rank <= 10", f"rank <= {k}").replace("r <= 10", f"r <= {k}"), ABLATION.replace("rank <= 10", f"rank <= {k}").replace("r <= 10", f"r <= {k}").replace("hits / 10", f"hits / {k}")


@query(f"WITH {GRADES}, {_at(3)[0]} SELECT * FROM m")
def metrics_complete_at_3(spark, sf_dir):
    return metrics.complete(*_graded(spark, sf_dir), 3)


@query(f"WITH {GRADES}, {_at(5)[0]} SELECT * FROM m")
def metrics_complete_at_5(spark, sf_dir):
    return metrics.complete(*_graded(spark, sf_dir), 5)


@query(f"WITH {GRADES}, {_at(5)[1]} SELECT * FROM m")
def metrics_ablation_at_5(spark, sf_dir):
    return metrics.ablation(*_graded(spark, sf_dir), 5)


@query(f"WITH {GRADES}, {COMPLETE}, i2 AS (SELECT qid % 200 AS mode, qid % 300 AS category, avg(precision) AS precision, avg(recall) AS recall, avg(mrr) AS mrr, avg(ndcg) AS ndcg FROM m GROUP BY ALL) SELECT mode, count(*) AS groups, round(avg(precision) + 1e-9, 4) AS precision, round(avg(recall) + 1e-9, 4) AS recall, round(avg(mrr) + 1e-9, 4) AS mrr, round(avg(ndcg) + 1e-9, 4) AS ndcg FROM i2 GROUP BY mode")
def metrics_macro_average(spark, sf_dir):
    m = metrics.complete(*_graded(spark, sf_dir), 10).withColumns({"mode": F.col("qid") % 200, "category": F.col("qid") % 300})
    return metrics.macro_averaged(m, ["mode"], "category")


RESULTS = TL + """, r AS (SELECT partition_id % 100 AS qid, row_number() OVER (PARTITION BY partition_id % 100 ORDER BY start, version_id) AS rank, partition_id AS number, state AS code, version_id // 3 AS version_id FROM tl)"""


def _results(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    t = _timeline(spark, sf_dir).withColumn("qid", F.col("partition_id") % 100)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("start", "version_id")).cast("long")
    return t.select("qid", rank.alias("rank"), F.col("partition_id").cast("string").alias("number"), F.col("state").alias("code"), F.floor(F.col("version_id") / 3).alias("version_id"))


@query(f"""WITH {RESULTS}, c AS (SELECT c_custkey % 100 AS qid, CASE WHEN c_custkey % 4 > 0 THEN c_custkey END AS number, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS code, CASE WHEN c_custkey % 3 = 0 THEN 2 END AS grade, CASE WHEN c_custkey % 5 > 0 THEN 4 END AS versions FROM customer),
x AS (SELECT *, count(*) OVER (PARTITION BY qid, number, code) AS held FROM r) SELECT x.qid, x.rank, coalesce(max(CASE WHEN c.number IS NULL THEN coalesce(c.grade, 1) WHEN held >= coalesce(c.versions, 1) THEN coalesce(c.grade, 3) ELSE 1 END) FILTER (c.code IS NOT NULL), 0)::INT AS grade
FROM x LEFT JOIN c ON c.qid = x.qid AND c.code = x.code AND (c.number IS NULL OR c.number = x.number) GROUP BY ALL""")
def evolutive_grades_complete(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select((k % 100).alias("qid"), F.when(k % 4 > 0, k.cast("string")).alias("number"), F.when(k % 2 == 0, "F").otherwise("O").alias("code"), F.when(k % 3 == 0, 2).alias("grade"), F.when(k % 5 > 0, 4).alias("versions"))
    return metrics.evolved(_results(spark, sf_dir).drop("version_id"), c)


@query(f"""WITH {RESULTS}, f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY qid, version_id ORDER BY rank) = 1 THEN 1 ELSE 0 END AS new FROM r), s AS (SELECT *, sum(new) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS seen FROM f)
SELECT qid, rank, CASE WHEN seen >= 5 + qid % 7 THEN 3 ELSE 0 END AS grade FROM s""")
def evolutive_grades_of_distinct_versions(spark, sf_dir):
    r = _results(spark, sf_dir).select("qid", "rank", "version_id")
    return metrics.reached(r, r.select("qid").distinct().withColumn("versions", 5 + F.col("qid") % 7))


@query(f"""WITH {RESULTS}, c AS (SELECT DISTINCT c_custkey % 100 AS qid, 'F' AS code, CASE WHEN c_custkey % 3 = 0 THEN 3 END AS grade FROM customer) SELECT r.qid, r.rank, coalesce(max(coalesce(c.grade, 1)) FILTER (c.code IS NOT NULL), 0) AS grade FROM r LEFT JOIN c ON c.qid = r.qid AND c.code = r.code GROUP BY ALL""")
def default_grades(spark, sf_dir):
    k, none = F.col("c_custkey"), F.lit(None)
    c = table(spark, sf_dir, "customer").select((k % 100).alias("qid"), F.lit("F").alias("code"), none.cast("string").alias("number"), none.cast("int").alias("from"), none.cast("int").alias("to"), F.when(k % 3 == 0, 3).alias("grade")).distinct()
    r = _results(spark, sf_dir).withColumns({"start": none.cast("int"), "end": none.cast("int")})
    return metrics.matched(r, c, default=1)


@query(f"""WITH {GRADES}, {ABLATION}, cu AS (SELECT k.qid, k.r AS rank, CASE WHEN k.label = q.label THEN 3 WHEN abs(k.label - q.label) = 1 THEN 1 ELSE 0 END AS grade FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM x WHERE label < 5 QUALIFY r <= 16) k JOIN embeddings q ON q.vec_id = k.qid WHERE k.doc_id <> k.qid),
o AS (SELECT c2.qid, round(coalesce(1 / min(CASE WHEN grade >= 1 THEN rank END), 0), 4) AS mrr FROM (SELECT DISTINCT qid FROM c) c2 LEFT JOIN cu ON cu.qid = c2.qid GROUP BY c2.qid) SELECT 'base' AS config, qid, m.mrr AS mrr_on, o.mrr AS mrr_off, round(m.mrr - o.mrr, 4) AS delta FROM m JOIN o USING (qid)""")
def graph_on_off(spark, sf_dir):
    """Two runs of the same search: over all vectors, and without those that only the graph would bring."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    of = v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), "vector", F.col("label").alias("ql"))
    grades, criteria = _graded(spark, sf_dir)
    hits = search.nearest(v.where("label < 5"), of.select("qid", "vector"), 16).where("rank <= 16").join(of.select("qid", "ql"), "qid").where("doc_id <> qid")
    grade = F.when(F.col("label") == F.col("ql"), 3).when(F.abs(F.col("label") - F.col("ql")) == 1, 1).otherwise(0)
    on = metrics.ablation(grades, criteria, 10).withColumn("mode", F.lit("on"))
    off = metrics.ablation(hits.select("qid", "rank", grade.alias("grade")), criteria, 10).withColumn("mode", F.lit("off"))
    return metrics.on_off(on.unionByName(off).withColumn("config", F.lit("base"))).select("config", "qid", "mrr_on", "mrr_off", "delta")


@query("""WITH x AS (SELECT o_orderpriority AS config, o_orderstatus AS category, avg(o_totalprice) AS MRR FROM orders GROUP BY ALL) SELECT rpad('config', 16, ' ') || rpad('category', 16, ' ') || lpad('MRR', 16, ' ') AS value UNION ALL SELECT repeat('-', 48) UNION ALL SELECT rpad(config, 16, ' ') || rpad(category, 16, ' ') || lpad(printf('%.4f', MRR), 16, ' ') FROM x""")
def report_table(spark, sf_dir):
    x = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("config"), F.col("o_orderstatus").alias("category")).agg(F.avg("o_totalprice").alias("MRR"))
    return reports.text_lines(x, ["config", "category"], ["MRR"])


# ------------------------------------------------------------ graph


@query(f"""WITH {EDGES}, {HITS}, u AS (SELECT start_id AS s, end_id AS e, 'EVOLVE_IN' AS edge FROM e UNION ALL SELECT partition_id, version_id, 'HA_VERSIONE' FROM (SELECT -partition_id AS partition_id, version_id FROM tl)), b AS (SELECT s AS node, e AS other, edge FROM u UNION ALL SELECT e, s, edge FROM u)
SELECT DISTINCT node, other, edge FROM b WHERE node IN (SELECT version_id FROM tl JOIN hits USING (partition_id))""")
def neighbours_either_way(spark, sf_dir):
    t = _timeline(spark, sf_dir)
    ways = [graph.evolution(t).select(F.col("start_id").alias("start"), F.col("end_id").alias("end"), F.lit("EVOLVE_IN").alias("edge")), t.select((-F.col("partition_id")).alias("start"), F.col("version_id").alias("end"), F.lit("HA_VERSIONE").alias("edge"))]
    return graph.around(t.join(_hits(spark, sf_dir), "partition_id").select(F.col("version_id").alias("node")), ways)


@query(f"WITH {TL} SELECT version_id, n - 1 AS depth FROM tl WHERE next_id IS NOT NULL OR n > 1")
def evolution_depth_along_edges(spark, sf_dir):
    return graph.depths(graph.evolution(_timeline(spark, sf_dir)))


@query(f"WITH {EDGES} SELECT n_name AS act, count(DISTINCT e.partition_id) AS partitions, count(DISTINCT law) AS laws FROM e JOIN customer ON c_custkey = e.partition_id JOIN nation ON n_nationkey = c_nationkey WHERE action = '{REPEAL}' AND law IS NOT NULL GROUP BY n_name")
def repeals_of_an_act(spark, sf_dir):
    e = _edges(spark, sf_dir).where((F.col("action") == REPEAL) & F.col("law").isNotNull())
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    x = e.join(c.select(F.col("c_custkey").alias("partition_id"), "c_nationkey"), "partition_id").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy(F.col("n_name").alias("act")).agg(F.countDistinct("partition_id").alias("partitions"), F.countDistinct("law").alias("laws"))


@query(f"WITH {EDGES} SELECT law, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS acts FROM e JOIN customer ON c_custkey = e.partition_id JOIN nation ON n_nationkey = c_nationkey WHERE action = '{REPEAL}' AND law IS NOT NULL GROUP BY law")
def acts_repealed_by_a_law(spark, sf_dir):
    e = _edges(spark, sf_dir).where((F.col("action") == REPEAL) & F.col("law").isNotNull())
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    x = e.join(c.select(F.col("c_custkey").alias("partition_id"), "c_nationkey"), "partition_id").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy("law").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("acts"))


@query("SELECT coalesce(a.c_custkey, b.k) AS key, coalesce(b.name, a.c_name) AS name, coalesce(b.bal, a.c_acctbal) AS balance FROM customer a FULL JOIN (SELECT c_custkey * 2 AS k, CASE WHEN c_custkey % 3 > 0 THEN 'neu ' || c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END AS bal FROM customer) b ON a.c_custkey = b.k")
def merged_nodes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    new = c.select((k * 2).alias("key"), F.when(k % 3 > 0, F.concat(F.lit("neu "), "c_name")).alias("name"), F.when(k % 2 == 0, F.col("c_acctbal") + 1).alias("balance"))
    return graph.merged(c.select(k.alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), new, "key")


@query("SELECT l_orderkey AS key, count(*) AS copies FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return graph.unique_keys(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")), "key").withColumnRenamed("count", "copies")


# ------------------------------------------------------------ files


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS state, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS priority FROM orders")
def partials_by_name(spark, sf_dir):
    o, out = table(spark, sf_dir, "orders"), _folder(spark, "partials")
    own = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("priority"))
    index.write_csv(own.where("state = 'F'"), f"{out}/f")
    index.write_csv(own.where("state <> 'F'").select("state", "id"), f"{out}/rest")
    return index.read_partials(spark, [f"{out}/f", f"{out}/rest"], "id").select("id", "state", "priority")


@query("SELECT o_orderkey AS id, o_orderstatus AS act, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT o_orderkey, 'O', 0.0::DOUBLE FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0")
def partial_parts_replaced(spark, sf_dir):
    o, out = table(spark, sf_dir, "orders"), _folder(spark, "parts")
    index.write_partial(o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("act")), out)
    index.write_partial(o.where("o_orderstatus = 'O' and o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lit(0.0).alias("price"), F.lit("O").alias("act")), out)
    return spark.read.parquet(out).select("id", "act", "price")


@query("SELECT 'u#art_' || o_custkey || '_V' || o_orderkey AS version_id, 'u#art_' || o_custkey AS partition_id, 'Art. ' || o_custkey || ' c.c.' AS title, strftime(o_orderdate, '%Y%m%d')::INT AS start, 99991231 AS \"end\", o_orderstatus = 'O' AS is_current FROM orders")
def records_from_json(spark, sf_dir):
    o, out = table(spark, sf_dir, "orders"), _folder(spark, "records")
    k = F.col("o_custkey").cast("string")
    row = F.struct(
        F.concat(F.lit("u#art_"), k, F.lit("_V"), F.col("o_orderkey").cast("string")).alias("versione_id"), F.concat(F.lit("Art. "), k).alias("numero"), F.lit("c.c.").alias("codice_breve_atto"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("valido_dal"), F.when(F.col("o_orderstatus") == "O", "VIGENTE").otherwise("STORICO").alias("stato_vigenza"),
    )
    o.select(row.alias("v")).write.json(out)
    d = index.documents(index.read_records(spark, out))
    return d.select(F.col("versione_id").alias("version_id"), F.col("partizione_id").alias("partition_id"), "title", F.col("valido_dal_raw").alias("start"), F.col("valido_al_raw").alias("end"), "is_current")


@query("SELECT row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS qid, 'Domanda ' || n_nationkey AS question, 'A' AS kind, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::VARCHAR END AS number, r_name AS code, 3 AS grade FROM nation JOIN region ON n_regionkey = r_regionkey")
def question_sets(spark, sf_dir):
    n, r, out = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), _folder(spark, "questions")
    x = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    k = F.col("n_nationkey").cast("string")
    wanted = F.array(F.struct(F.when(F.col("n_nationkey") % 2 == 0, k).alias("numero_puro"), F.col("r_name").alias("codice_breve_atto"), F.lit(3).alias("grado")))
    one = F.to_json(F.struct(F.concat(F.lit("Domanda "), k).alias("domanda"), F.lit("A").alias("tipo"), wanted.alias("rilevanti")))
    sets = x.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", one.alias("q")))).alias("l"))
    sets.select(F.concat(F.lit("["), F.array_join(F.transform("l", lambda s: s["q"]), ",\n"), F.lit("]")).alias("value"), "r_name").write.partitionBy("r_name").text(out)
    questions, criteria = index.read_questions(spark, f"{out}/*/*")
    return questions.join(criteria.select("file", "qid", "number", "code", "grade"), ["file", "qid"]).select("qid", "question", "kind", "number", "code", "grade")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'neu' ELSE o_orderstatus END AS state FROM orders")
def upserted_rows(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))
    return index.upserted(old, old.where("id % 3 = 0").withColumn("state", F.lit("neu")), "id")


@query("SELECT 0 AS attempt, true AS made, 0::BIGINT AS rows, 3 AS columns UNION ALL SELECT 1, false, 0, 3 UNION ALL SELECT 2, true, 0, 3")
def tables_made_like_another(spark, sf_dir):
    n, out = table(spark, sf_dir, "nation"), _folder(spark, "like")
    got = []
    for attempt, force in enumerate((False, False, True)):
        made = index.create_table(spark, out, n, force)
        df = spark.read.parquet(out)
        got.append((attempt, made, df.count(), len(df.columns)))
    return spark.createDataFrame(got, "attempt int, made boolean, rows long, columns int")


@query("SELECT o_custkey AS partition_id, min(o_orderdate)::DATE::VARCHAR AS first_day, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS version_id FROM orders GROUP BY o_custkey")
def first_seen_partitions(spark, sf_dir):
    from stemma.sources.akn import first_seen

    return first_seen(history(spark, sf_dir), "partition_id", ["start", "version_id"]).select("partition_id", F.col("start").cast("string").alias("first_day"), "version_id")


# The first catalogue's file names, folders and answers came from a few rows of ours; these go through the tables.


@query("""WITH f AS (SELECT '/a/' || (o_custkey % 200) || '/' || CASE WHEN o_orderkey % 50 = 0 THEN 'X_ORIGINALE_.xml' WHEN o_orderkey % 51 = 0 THEN 'rotto.xml' ELSE 'X_VIGENZA_' || strftime(o_orderdate, '%Y-%m-%d') || '_V' || (o_orderkey % 9 + 1) || '.xml' END AS path, (o_custkey % 200)::VARCHAR AS act, CASE WHEN o_orderkey % 50 = 0 THEN DATE '1990-05-01' WHEN o_orderkey % 51 = 0 THEN NULL ELSE o_orderdate::DATE END AS start, CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE (o_orderkey % 9 + 1)::INT END AS version FROM orders)
SELECT act, path, strftime(start, '%Y%m%d')::INT AS start, version FROM f WHERE start IS NOT NULL QUALIFY row_number() OVER (PARTITION BY act, start, version ORDER BY path) = 1""")
def file_timeline_of_acts(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.when(k % 50 == 0, "X_ORIGINALE_.xml").when(k % 51 == 0, "rotto.xml").otherwise(F.concat(F.lit("X_VIGENZA_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_V"), (k % 9 + 1).cast("string"), F.lit(".xml")))
    act = (F.col("o_custkey") % 200).cast("string")
    f = table(spark, sf_dir, "orders").select(F.concat(F.lit("/a/"), act, F.lit("/"), name).alias("path"), act.alias("act"))
    return _dates(temporal.file_versions(f, F.lit(date(1990, 5, 1)), ["act"]).select("act", "path", "start", "version"), "start")


@query("""WITH c AS (SELECT conv_id, string_agg(text, ' ') FILTER (role = 'user') AS src, string_agg('Art. ' || (conv_id % 50) || ' e art. ' || turn || '-bis', '; ') AS said FROM conversations GROUP BY conv_id), n AS (SELECT conv_id, src, unnest(list_distinct(regexp_extract_all(said, '[Aa]rt\\.\\s*(\\d+(?:[\\-][a-z]+)?)', 1))) AS n FROM c),
u AS (SELECT conv_id, n FROM n WHERE NOT contains(conv_id::VARCHAR, regexp_extract(n, '^\\d+'))) SELECT c.conv_id, coalesce((SELECT string_agg(n, ',' ORDER BY n) FROM u WHERE u.conv_id = c.conv_id), '') AS unsupported FROM c""")
def unsupported_articles_of_answers(spark, sf_dir):
    from stemma.functions.questions import unsupported_articles

    said = F.concat(F.lit("Art. "), (F.col("conv_id") % 50).cast("string"), F.lit(" e art. "), F.col("turn").cast("string"), F.lit("-bis"))
    x = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.collect_list(said), "; ").alias("said"))
    sources = F.array(F.struct(F.col("conv_id").cast("string").alias("number"), F.lit("").alias("label"), F.lit(None).cast("string").alias("text")))
    return x.select("conv_id", F.array_join(unsupported_articles(F.col("said"), sources), ",").alias("unsupported"))
