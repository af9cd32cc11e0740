"""The graph's tables from XML files, which are made of the test tables.

Nations are acts, years of orders their files, customers the articles of a file;
a file in eleven is cut off. The SQL form knows the tables only, not the XML.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions import patterns as P
from stemma.functions import text
from stemma.operators import etl
from stemma.plans.catalogue import TODAY, query
from stemma.sources import akn
from stemma.sources.acts import mismatches
from stemma.sources.staging import staged
from stemma.sources.tables import table

FIRST = 1995
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _day(n: Column) -> Column:
    return F.concat(F.lit("1990-01-"), F.lpad((n + 1).cast("string"), 2, "0"))


def _folder(n: Column) -> Column:
    plain = F.concat(F.lit("LEGGE_"), F.regexp_replace(_day(n), "-", ""), F.lit("_"), (n + 1).cast("string"))
    return F.when(n == 3, "REGIO DECRETO_19420316_262").otherwise(plain)


def _urn(n: Column, kind: str = "legge") -> Column:
    return F.when(n == 3, "urn:nir:stato:regio.decreto:1942-03-16;262").otherwise(F.concat(F.lit(f"urn:nir:stato:{kind}:"), _day(n), F.lit(";"), (n + 1).cast("string")))


def _akn(n: Column) -> Column:
    return F.when(n == 3, "/akn/it/act/regio_decreto/stato/1942-03-16/262").otherwise(F.concat(F.lit("/akn/it/act/legge/stato/"), _day(n), F.lit("/"), (n + 1).cast("string")))


def files(spark, sf_dir) -> DataFrame:
    """(path, content) of the acts' files."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    x = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("nat"), F.col("c_mktsegment").alias("seg"), F.year("o_orderdate").alias("y"))
    x = x.agg(F.max_by("o_orderpriority", "o_orderkey").alias("pri"), F.max("o_orderkey").alias("ok"))
    k, pri = F.col("cust").cast("string"), F.col("pri")
    says = (
        F.when(pri == "1-URGENT", "(abrogato)").when(pri == "2-HIGH", "Il comma 2 è stato abrogato.").when(pri == "3-MEDIUM", F.concat(F.lit("Il termine è prorogato di "), (F.col("cust") % 30).cast("string"), F.lit(" giorni.")))
        .when((pri == "5-LOW") & (F.col("cust") % 2 == 0), "Nota redazionale sul testo.").otherwise(F.concat(F.lit("Testo della materia "), F.lower("seg"), F.lit(" secondo la legge.")))
    )
    inner = F.concat(_urn((F.col("ok") % 25), "LEGGE"), F.lit("#art. "), (F.col("ok") % 50).cast("string"))
    article = F.concat(F.lit('<article eId="art_'), k, F.lit('"><num>Art. '), k, F.lit("</num><content><p>"), says, F.lit('<ref href="'), inner, F.lit('"/><ref href="'), _akn(F.col("ok") % 30), F.lit('"/></p></content></article>'))
    chapters = x.groupBy("nat", "y", "seg").agg(F.array_sort(F.collect_list(F.struct("cust", article.alias("a")))).alias("l"), F.min("cust").alias("least"), F.max("cust").alias("most"))
    number = reduce(lambda w, i: w.when(F.col("seg") == SEGMENTS[i], str(i + 1)), range(1, len(SEGMENTS)), F.when(F.col("seg") == SEGMENTS[0], "1"))
    chapter = F.concat(F.lit("<chapter><num>Capo "), number, F.lit("</num><heading>"), F.col("seg"), F.lit("</heading>"), F.array_join(F.transform("l", lambda s: s["a"]), ""), F.lit("</chapter>"))
    acts = chapters.groupBy("nat", "y").agg(F.array_sort(F.collect_list(F.struct("seg", chapter.alias("c")))).alias("l"), F.min("least").alias("least"), F.max("most").alias("most"))
    nat, v = F.col("nat"), F.col("y") - FIRST + 1
    rp = F.transform(F.filter(F.sequence(F.lit(1), F.lit(6)), lambda i: i != 4), lambda i: F.concat(F.lit('<passiveRef eId="rp'), i.cast("string"), F.lit('" href="/akn/it/act/decreto_legge/stato/'), (i + FIRST).cast("string"), F.lit("-01-01/"), (i + 10).cast("string"), F.lit('/!main"/>')))
    content = F.concat(
        F.lit('<akomaNtoso xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"><act><meta><identification><FRBRWork><FRBRalias name="urn:nir" value="'), F.when(nat == 5, "urn:altro").otherwise(_urn(nat)),
        F.lit('"/><FRBRalias name="eli" value="eli/'), nat.cast("string"), F.lit('"/><FRBRname value="Atto '), nat.cast("string"), F.lit('"/></FRBRWork><FRBRExpression><FRBRdate date="'), F.col("y").cast("string"), F.lit('-01-01"/></FRBRExpression></identification><references>'),
        F.array_join(rp, ""), F.lit("</references></meta><body>"), F.array_join(F.transform("l", lambda s: s["c"]), ""), F.lit('</body><attachments><attachment><doc name="Allegato 1"><mainBody><p>Tabella di cui agli artt. '), F.col("least").cast("string"), F.lit(" e "), F.col("most").cast("string"),
        F.lit('.</p></mainBody></doc></attachment><attachment><doc name="Allegato 1_art_6"><mainBody><p>Voce di dettaglio.</p></mainBody></doc></attachment></attachments></act></akomaNtoso>'),
    )
    cut = F.when((nat + F.col("y")) % 11 == 0, F.substring(content, F.lit(1), F.length(content) - 20)).otherwise(content)
    name = F.when(v == 1, "_ORIGINALE_.xml").otherwise(F.concat(F.lit("_VIGENZA_"), F.col("y").cast("string"), F.lit("-01-01_V"), v.cast("string"), F.lit(".xml")))
    return acts.select(F.concat(F.lit("/data/"), _folder(nat), F.lit("/"), _folder(nat), name).alias("path"), F.encode(cut, "UTF-8").alias("content"))


# The same rows, from the tables alone.
_DAY = "'1990-01-' || lpad(({0} + 1)::VARCHAR, 2, '0')"
_URN = f"CASE WHEN {{0}} = 3 THEN 'urn:nir:stato:regio.decreto:1942-03-16;262' ELSE 'urn:nir:stato:legge:' || {_DAY} || ';' || ({{0}} + 1) END"
_FOLDER = f"CASE WHEN nat = 3 THEN 'REGIO DECRETO_19420316_262' ELSE 'LEGGE_' || replace({_DAY.format('nat')}, '-', '') || '_' || (nat + 1) END"
INT = "strftime({}, '%Y%m%d')::INT"
S, E = INT.format("start"), INT.format('"end"')
BASE = f"""m AS (SELECT c_custkey AS cust, c_nationkey AS nat, c_mktsegment AS seg, year(o_orderdate) AS y, arg_max(o_orderpriority, o_orderkey) AS pri, max(o_orderkey) AS ok FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
f AS (SELECT *, ({_URN.format('nat')}) AS urn, ({_FOLDER}) AS act, (nat + y) % 11 <> 0 AS fine, (y - {FIRST} + 1)::INT AS version, CASE WHEN y = {FIRST} THEN CASE WHEN nat = 3 THEN DATE '1942-03-16' ELSE ({_DAY.format('nat')})::DATE END ELSE make_date(y, 1, 1) END AS start FROM (SELECT nat, y, min(cust) AS least, max(cust) AS most FROM m GROUP BY ALL)),
t AS (SELECT *, greatest(start, lead(start, 1, DATE '9999-12-31') OVER w - 1) AS "end", lead(version) OVER w AS next_version, '/data/' || act || '/' || act || CASE WHEN y = {FIRST} THEN '_ORIGINALE_.xml' ELSE '_VIGENZA_' || y || '-01-01_V' || version || '.xml' END AS path,
  max_by(fine, y) OVER (PARTITION BY nat) AS last_fine FROM f WINDOW w AS (PARTITION BY nat ORDER BY start, version)),
tl AS (SELECT *, CASE WHEN "end" >= DATE '9999-12-30' THEN 'VIGENTE' WHEN "end" < DATE '{TODAY}' THEN 'STORICO' ELSE 'VIGENTE' END AS status,
  CASE WHEN last_fine AND version BETWEEN 2 AND 7 AND version <> 5 THEN 'urn:nir:stato:decreto.legge:' || ({FIRST} + version - 1) || '-01-01;' || (9 + version) END AS law FROM t)"""
NODES = BASE + """, a AS (SELECT tl.*, m.cust, seg, ok, urn || '#art_' || cust AS partition_id, pri, CASE pri WHEN '1-URGENT' THEN '(abrogato)' WHEN '2-HIGH' THEN 'Il comma 2 è stato abrogato.' WHEN '3-MEDIUM' THEN 'Il termine è prorogato di ' || (cust % 30) || ' giorni.' ELSE 'Testo della materia ' || lower(seg) || ' secondo la legge.' END AS plain,
  'Art. ' || cust AS number, 'articolo' AS type, 'strutturale' AS method, 'Norma;Articolo' AS label FROM m JOIN tl USING (nat, y) WHERE fine AND NOT (pri = '5-LOW' AND cust % 2 = 0)),
x AS (SELECT tl.*, NULL AS cust, NULL AS seg, NULL AS ok, urn || '#all_allegato_1' AS partition_id, NULL AS pri, 'Tabella di cui agli artt. ' || least || ' e ' || most || '.' AS plain, 'Allegato 1' AS number, 'allegato' AS type, 'allegato' AS method, 'Norma;Allegato' AS label FROM tl WHERE fine
  UNION ALL SELECT tl.*, NULL, NULL, NULL, urn || '#all_allegato_1_art_6', NULL, 'Voce di dettaglio.', 'Allegato 1_art_6', 'articolo', 'allegato', 'Norma;Articolo' FROM tl WHERE fine),
n AS (SELECT *, partition_id || '_V' || version AS version_id, CASE pri WHEN '1-URGENT' THEN 'ABROGATO' WHEN '2-HIGH' THEN 'PARZIALMENTE_ABROGATO' ELSE 'ATTIVO' END AS state,
  CASE WHEN version = 1 THEN 'originale' WHEN pri = '1-URGENT' THEN 'abrogazione' WHEN pri = '2-HIGH' THEN 'parzialmente_abrogato' WHEN pri = '3-MEDIUM' THEN 'proroga' ELSE 'modificato' END AS change, CASE WHEN pri = '1-URGENT' THEN '[NORMA ABROGATA] ' ELSE '' END || plain AS text
  FROM (SELECT * FROM a UNION ALL SELECT * FROM x))"""
RUNS = NODES + f""", d AS (SELECT *, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS fp FROM n), e AS (SELECT *, CASE WHEN lag(fp, 1, '-') OVER (PARTITION BY partition_id ORDER BY start, version) <> fp THEN 1 ELSE 0 END AS ch FROM d),
g AS (SELECT *, sum(ch) OVER (PARTITION BY partition_id ORDER BY start, version ROWS UNBOUNDED PRECEDING) AS run FROM e),
r0 AS (SELECT partition_id, run, arg_min(version_id, version) AS version_id, min(version) AS version, arg_min(text, version) AS text, arg_min(change, version) AS change, min_by(law, version) AS law0, arg_min(ok, version) AS ok, min(start) AS start, max("end") AS "end", first(urn) AS urn FROM g GROUP BY partition_id, run),
r AS (SELECT r0.* EXCLUDE (law0), n.law, CASE WHEN r0."end" >= DATE '9999-12-30' THEN 'VIGENTE' WHEN r0."end" < DATE '{TODAY}' THEN 'STORICO' ELSE 'VIGENTE' END AS status FROM r0 JOIN n USING (version_id)),
ev AS (SELECT start_id, end_id, partition_id, action, start, "end", law FROM (SELECT partition_id, version_id AS start_id, lead(version_id) OVER w AS end_id, lead(change) OVER w AS action, lead(start) OVER w AS start, lead("end") OVER w AS "end", lead(law) OVER w AS law FROM r WINDOW w AS (PARTITION BY partition_id ORDER BY start, version)) WHERE end_id IS NOT NULL),
latest AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY partition_id ORDER BY start DESC, version DESC) = 1)"""


def _dates(df: DataFrame) -> DataFrame:
    return df.withColumns({c: text.date_int(F.col(c)) for c in ("start", "end", "repealed") if c in df.columns})


def _tables(spark, sf_dir) -> dict[str, DataFrame]:
    return etl.tables(files(spark, sf_dir), TODAY)


@query(f"WITH {BASE} SELECT act, count(*) AS files, count(*) FILTER (NOT fine) AS corrupt FROM tl GROUP BY act")
def etl_corrupt_files(spark, sf_dir):
    parsed = staged(akn.parsed(files(spark, sf_dir)))
    return etl.corrupt_by_act(parsed.select("path"), parsed)


@query(f"""WITH {BASE} SELECT urn, CASE WHEN nat = 3 THEN 'Regio Decreto n. 262 del 16/03/1942' ELSE 'Legge n. ' || (nat + 1) || ' del ' || lpad((nat + 1)::VARCHAR, 2, '0') || '/01/1990' END AS title, CASE WHEN nat = 3 THEN 'Codice Civile' END AS common_name, CASE WHEN nat = 3 THEN 'c.c.' END AS short_code, nat = 3 AS is_code,
  CASE WHEN nat = 3 THEN 'Legge;Codice' ELSE 'Legge' END AS label, CASE WHEN any_fine THEN 'eli/' || nat END AS eli, CASE WHEN any_fine THEN first_fine || '-01-01' END AS in_force FROM (SELECT nat, any_value(urn) AS urn, bool_or(fine) AS any_fine, min(y) FILTER (fine) AS first_fine FROM tl GROUP BY nat)""")
def etl_acts(spark, sf_dir):
    parsed = staged(akn.parsed(files(spark, sf_dir)))
    return etl.acts(parsed.select("path"), parsed).select("urn", "title", "common_name", "short_code", "is_code", "label", "eli", "in_force")


@query(f"WITH {BASE} SELECT DISTINCT act AS folder, 'urn:altro' AS xml_urn, urn FROM tl WHERE nat = 5 AND fine")
def etl_urn_mismatches(spark, sf_dir):
    parsed = staged(akn.parsed(files(spark, sf_dir)))
    return mismatches(etl.acts(parsed.select("path"), parsed)).select("folder", "xml_urn", "urn")


@query(f'WITH {BASE} SELECT path, version, y = {FIRST} AS is_original, {S} AS start, {E} AS "end", next_version, status, law FROM tl')
def etl_timeline(spark, sf_dir):
    parsed = staged(akn.parsed(files(spark, sf_dir)))
    return _dates(etl.timeline(parsed.select("path"), parsed, TODAY).select("path", "version", "is_original", "start", "end", "next_version", "status", "law"))


@query(f"""WITH {NODES} SELECT partition_id, number, urn AS act_urn, type, method, label, CASE WHEN seg IS NOT NULL THEN 'Capo ' || list_position({list(SEGMENTS)}, seg) END AS chapter_num, seg AS chapter_heading, regexp_extract(partition_id, '([0-9]+)$', 1) AS digits
FROM n QUALIFY row_number() OVER (PARTITION BY partition_id ORDER BY start, version) = 1""")
def etl_partitions(spark, sf_dir):
    return _tables(spark, sf_dir)["partitions"].select("partition_id", "number", "act_urn", "type", "method", "label", "chapter_num", "chapter_heading", "digits")


@query(f"""WITH {RUNS} SELECT version_id, partition_id, version AS n, text, {S} AS start, {E} AS "end", status, change, CASE WHEN change = 'abrogazione' THEN 'ABROGATO' WHEN change = 'parzialmente_abrogato' THEN 'PARZIALMENTE ABROGATO' WHEN status = 'VIGENTE' AND version_id IN (SELECT version_id FROM latest) THEN 'ATTIVO' ELSE 'STORICO' END AS state FROM r""")
def etl_versions(spark, sf_dir):
    return _dates(_tables(spark, sf_dir)["versions"].select("version_id", "partition_id", "n", "text", "start", "end", "status", "change", "state"))


@query(f'WITH {RUNS} SELECT start_id, end_id, action, {S} AS start, {E} AS "end", law FROM ev')
def etl_evolution(spark, sf_dir):
    return _dates(_tables(spark, sf_dir)["evolves"])


@query(f"WITH {RUNS} SELECT DISTINCT r.partition_id, ev.law, {INT.format('r.start')} AS repealed FROM r JOIN ev ON end_id = version_id WHERE r.change = 'abrogazione' AND ev.law IS NOT NULL")
def etl_repealed_by(spark, sf_dir):
    return _dates(_tables(spark, sf_dir)["repealed_by"])


@query(f"""WITH {RUNS} SELECT DISTINCT version_id, ({_URN.format('(ok % 25)')}) || '#art_' || (ok % 50) AS target, 'articolo' AS kind, {S} AS start, {E} AS "end" FROM r WHERE ok IS NOT NULL""")
def etl_cites(spark, sf_dir):
    return _dates(_tables(spark, sf_dir)["cites"])


@query(f"""WITH {RUNS} SELECT DISTINCT version_id, ({_URN.format('(ok % 30)')}) AS target, 'legge' AS kind, {S} AS start, {E} AS "end" FROM r WHERE ok IS NOT NULL AND ok % 30 IN (SELECT nat FROM tl)""")
def etl_cites_act(spark, sf_dir):
    return _dates(_tables(spark, sf_dir)["cites_act"])


@query(f"""WITH {NODES} SELECT DISTINCT urn || '#art_' || k AS start, urn || '#all_allegato_1' AS "end" FROM (SELECT urn, unnest([least, most]) AS k FROM tl WHERE fine) WHERE urn || '#art_' || k IN (SELECT partition_id FROM n)""")
def etl_refers_to(spark, sf_dir):
    return _tables(spark, sf_dir)["refers_to"]


@query(f"""WITH {NODES} SELECT DISTINCT partition_id AS start, urn AS "end", 'APPARTIENE' AS edge FROM n UNION ALL SELECT DISTINCT partition_id, urn || '#all_allegato_1', 'SOTTO_PARTIZIONE' FROM n WHERE partition_id LIKE '%\\_art\\_6' ESCAPE '\\' AND label = 'Norma;Articolo' AND method = 'allegato'""")
def etl_structure(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return t["belongs_to"].withColumn("edge", F.lit("APPARTIENE")).unionByName(t["part_of"].withColumn("edge", F.lit("SOTTO_PARTIZIONE")))


@query(f"""WITH {RUNS}, c AS (SELECT 'acts' AS name, count(DISTINCT nat) AS rows FROM tl UNION ALL SELECT 'partitions', count(DISTINCT partition_id) FROM n UNION ALL SELECT 'versions', count(*) FROM r UNION ALL SELECT 'has_version', count(*) FROM latest UNION ALL SELECT 'evolves', count(*) FROM ev
UNION ALL SELECT 'repealed_by', count(DISTINCT (r.partition_id, ev.law, r.start)) FROM r JOIN ev ON end_id = version_id WHERE r.change = 'abrogazione' AND ev.law IS NOT NULL UNION ALL SELECT 'cites', count(*) FROM r WHERE ok IS NOT NULL UNION ALL SELECT 'cites_act', count(*) FROM r WHERE ok IS NOT NULL AND ok % 30 IN (SELECT nat FROM tl)
UNION ALL SELECT 'refers_to', count(DISTINCT urn || '#art_' || k) FROM (SELECT urn, unnest([least, most]) AS k FROM tl WHERE fine) WHERE urn || '#art_' || k IN (SELECT partition_id FROM n) UNION ALL SELECT 'belongs_to', count(DISTINCT partition_id) FROM n UNION ALL SELECT 'part_of', count(DISTINCT urn) FROM n)
SELECT name, rows FROM c""")
def etl_table_counts(spark, sf_dir):
    from stemma.operators import graph

    return graph.counts(_tables(spark, sf_dir))


@query("""SELECT o_orderkey::VARCHAR AS versione_id, strftime(o_orderdate, '%Y%m%d') AS valido_dal, o_orderstatus AS stato_vigenza FROM orders""")
def clean_graph_columns(spark, sf_dir):
    from stemma.sources.index import clean_columns

    o = table(spark, sf_dir, "orders")
    return clean_columns(o.select(F.col("o_orderkey").cast("string").alias("versione_id:ID(Versione)"), F.date_format("o_orderdate", "yyyyMMdd").alias("valido_dal:INT"), F.col("o_orderstatus").alias("stato_temporale")))


@query("""WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey % 3000 AS k, l_suppkey % 4 AS form FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE form WHEN 0 THEN 'urn:nir:stato:decreto.legislativo:2005-03-07;82#art_' || k || '_bis' WHEN 1 THEN 'urn:nir:stato:legge:1990-08-07;' || k WHEN 2 THEN 'urn:nir:stato:decreto.del.presidente.della.repubblica:1988-09-22;' || k || '#allegato_a' ELSE NULL END AS urn FROM u""")
def href_to_urn(spark, sf_dir):
    k, form = (F.col("l_partkey") % 3000).cast("string"), F.col("l_suppkey") % 4
    href = (
        F.when(form == 0, F.concat(F.lit("urn:nir:stato:DecretoLegislativo:2005-03-07;82~art"), k, F.lit("-bis")))
        .when(form == 1, F.concat(F.lit(" /akn/it/act/LEGGE/stato/1990-08-07/"), k, F.lit("/!main ")))
        .when(form == 2, F.concat(F.lit("urn:nir:stato:d.p.r.:1988-09-22;"), k, F.lit("#Allegato A"))).otherwise("")
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.urn_of(href).alias("urn"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'art_' || c_custkey || '_bis' WHEN 1 THEN 'art_' || c_custkey || '_ter' WHEN 2 THEN 'disp_' || c_custkey ELSE 'art_' || c_custkey END AS node_id,
 CASE c_custkey % 4 WHEN 0 THEN 'Art. ' || c_custkey || '-bis' WHEN 1 THEN 'Art. ' || c_custkey || '-ter' WHEN 2 THEN 'Disp. ' || c_custkey ELSE 'Art. ' || c_custkey END AS label, CASE c_custkey % 4 WHEN 0 THEN 'strutturale' WHEN 2 THEN 'testuale_disp' ELSE 'testuale' END AS method FROM customer""")
def node_identifiers(spark, sf_dir):
    k, form = F.col("c_custkey").cast("string"), F.col("c_custkey") % 4
    e_id = F.when(form == 0, F.concat(F.lit("ART-"), k, F.lit(" bis"))).when(form == 1, "")
    opening = F.when(form == 1, F.concat(F.lit("Testo dell'articolo "), k, F.lit("-ter della legge"))).when(form == 2, F.concat(F.lit(" "), k, F.lit(". Disposizione"))).otherwise(F.concat(F.lit("ART "), k))
    n = text.node_id(e_id, opening)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), n["id"].alias("node_id"), n["label"].alias("label"), n["method"].alias("method"))


@query("""SELECT s_suppkey AS id, 'all_allegato_' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '_art_' || s_suppkey ELSE '' END AS annex_id, CASE WHEN s_suppkey % 2 = 0 THEN 'all_allegato_' || s_suppkey END AS parent, 'par_par_' || s_suppkey AS paragraph_id, 'Par. par_' || s_suppkey AS paragraph_label FROM supplier""")
def annex_and_paragraph_identifiers(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    own = text.annex_id(F.concat(F.lit("Allegato "), k, F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("-art "), k)).otherwise("")))
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), own.alias("annex_id"), text.annex_parent(own).alias("parent"), text.paragraph_id(none, k).alias("paragraph_id"), text.paragraph_label(none, k).alias("paragraph_label"))


@query(f"""WITH s AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) % 3 AS k FROM documents) SELECT doc_id, CASE WHEN k = 0 THEN md5('[NORMA ABROGATA] ' || text) ELSE md5(text) END AS marked, length(text) < 5 OR k = 1 OR regexp_matches(text, '{P.NOTE_TITLE}') AS skipped FROM s""")
def marked_and_skipped_nodes(spark, sf_dir):
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").withColumn("k", F.row_number().over(Window.orderBy("doc_id")) % 3)
    marked = text.marked_repealed(F.col("text"), F.when(F.col("k") == 0, "ABROGATO").otherwise("ATTIVO"))
    return d.select("doc_id", F.md5(marked).alias("marked"), text.skipped_node(F.col("text"), F.when(F.col("k") == 1, " NOTE all'atto").otherwise("Articolo")).alias("skipped"))
