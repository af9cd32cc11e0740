"""The queries over the test tables, by name, each with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.functions import patterns as P
from stemma.functions import questions, text
from stemma.operators import delta, graph, metrics, search, temporal
from stemma.plans import samples
from stemma.sources.tables import event_versions, history, laws, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TODAY = date(1998, 1, 1)
SPAN = (date(1995, 1, 1), date(1996, 12, 31))
REPEAL = "1-URGENT"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------ common parts

INT = "strftime({}, '%Y%m%d')::INT"
H = """h AS (SELECT o_orderkey AS version_id, o_custkey AS partition_id, o_orderdate::DATE AS start, o_orderstatus AS state, o_orderpriority AS change, o_totalprice AS price,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) AS n FROM orders)"""
TL = H + f""", t AS (SELECT *, greatest(start, lead(start, 1, DATE '9999-12-31') OVER w - 1) AS "end", lead(version_id) OVER w AS next_id FROM h WINDOW w AS (PARTITION BY partition_id ORDER BY start, n)),
tl AS (SELECT *, CASE WHEN "end" >= DATE '9999-12-30' THEN 'VIGENTE' WHEN "end" < DATE '{TODAY}' THEN 'STORICO' ELSE 'VIGENTE' END AS status FROM t)"""
LAW = "law AS (SELECT l_orderkey AS version_id, 'urn:nir:stato:legge;' || min(l_suppkey)::VARCHAR AS law FROM lineitem GROUP BY l_orderkey)"
EDGES = TL + ", " + LAW + """, e0 AS (SELECT partition_id, version_id AS start_id, lead(version_id) OVER w AS end_id, lead(change) OVER w AS action, lead(start) OVER w AS start, lead("end") OVER w AS "end"
  FROM tl WINDOW w AS (PARTITION BY partition_id ORDER BY start, n)), e AS (SELECT e0.*, law.law FROM e0 LEFT JOIN law ON law.version_id = e0.end_id WHERE end_id IS NOT NULL)"""
S, E = INT.format("start"), INT.format('"end"')


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.timeline(history(spark, sf_dir), TODAY)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.evolution(_timeline(spark, sf_dir), laws(spark, sf_dir))


def _dates(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: text.date_int(F.col(n)) for n in names})


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions that a search has found: the customers of one segment."""
    return table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("partition_id"))


HITS = "hits AS (SELECT c_custkey AS partition_id FROM customer WHERE c_mktsegment = 'BUILDING')"

# ------------------------------------------------------------ temporal


@query(f"WITH {TL} SELECT version_id, partition_id, n, {S} AS start, {E} AS \"end\", next_id, status FROM tl")
def timeline_intervals(spark, sf_dir):
    return _dates(_timeline(spark, sf_dir).select("version_id", "partition_id", "n", "start", "end", "next_id", "status"), "start", "end")


@query(f"WITH {TL} SELECT version_id, partition_id, {S} AS start FROM tl WHERE status = 'VIGENTE' AND start <= DATE '{TODAY}'")
def current_versions(spark, sf_dir):
    return _dates(temporal.current(_timeline(spark, sf_dir), TODAY).select("version_id", "partition_id", "start"), "start")


@query(f"WITH {H} SELECT version_id, partition_id, {S} AS start FROM h WHERE n = 1")
def original_versions(spark, sf_dir):
    return _dates(temporal.original(history(spark, sf_dir)).select("version_id", "partition_id", "start"), "start")


@query(f"WITH {H} SELECT version_id, partition_id, {S} AS start, n FROM h QUALIFY row_number() OVER (PARTITION BY partition_id ORDER BY start DESC, n DESC) = 1")
def latest_per_partition(spark, sf_dir):
    return _dates(temporal.latest(history(spark, sf_dir)).select("version_id", "partition_id", "start", "n"), "start")


@query(f"WITH {TL} SELECT version_id, partition_id, {S} AS start FROM tl WHERE start <= DATE '1996-06-15' AND \"end\" >= DATE '1996-06-15' QUALIFY row_number() OVER (PARTITION BY partition_id ORDER BY start DESC, n DESC) = 1")
def point_in_time(spark, sf_dir):
    return _dates(temporal.at(_timeline(spark, sf_dir), date(1996, 6, 15)).select("version_id", "partition_id", "start"), "start")


@query(f"WITH {TL} SELECT version_id, partition_id, {S} AS start, {E} AS \"end\" FROM tl WHERE start <= DATE '{SPAN[1]}' AND \"end\" >= DATE '{SPAN[0]}'")
def interval_overlap_filter(spark, sf_dir):
    return _dates(temporal.overlapping(_timeline(spark, sf_dir), *SPAN).select("version_id", "partition_id", "start", "end"), "start", "end")


@query(f"WITH {TL} SELECT version_id, partition_id, {S} AS start, {E} AS \"end\" FROM tl WHERE start >= DATE '{SPAN[0]}' AND \"end\" <= DATE '{SPAN[1]}'")
def interval_containment_filter(spark, sf_dir):
    return _dates(temporal.contained(_timeline(spark, sf_dir), *SPAN).select("version_id", "partition_id", "start", "end"), "start", "end")


@query(f"""WITH {TL}, w AS (SELECT c_custkey AS partition_id, DATE '1995-01-01' + (c_custkey % 1000)::INT AS "from" FROM customer)
SELECT version_id, partition_id, {S} AS start, {INT.format('"from"')} AS "from" FROM tl JOIN w USING (partition_id) WHERE start <= "from" + 90 AND "end" >= "from" """)
def interval_overlap_join(spark, sf_dir):
    first = F.date_add(F.lit(date(1995, 1, 1)), (F.col("c_custkey") % 1000).cast("int"))
    windows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("partition_id"), first.alias("from"), F.date_add(first, 90).alias("to"))
    return _dates(temporal.overlap_join(_timeline(spark, sf_dir), windows).select("version_id", "partition_id", "start", "from"), "start", "from")


@query("""WITH f(path) AS (VALUES """ + samples.values(samples.FILES) + """), p AS (SELECT path, regexp_extract(path, '[^/]+$') AS name FROM f),
x AS (SELECT path, contains(name, '_ORIGINALE_') AS is_original, nullif(regexp_extract(name, '_V([0-9]+)', 1), '')::INT AS v, CASE WHEN contains(name, '_ORIGINALE_') THEN DATE '1990-05-01' ELSE try_cast(nullif(regexp_extract(name, '_VIGENZA_([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') AS DATE) END AS start FROM p)
SELECT path, is_original, """ + S + """ AS start, coalesce(v, CASE WHEN is_original THEN 1 END) AS version FROM x WHERE start IS NOT NULL AND (v IS NOT NULL OR is_original)
QUALIFY row_number() OVER (PARTITION BY start, coalesce(v, 1) ORDER BY path) = 1""")
def file_timeline(spark, sf_dir):
    return _dates(temporal.file_versions(samples.frame(spark, samples.FILES, "path"), F.lit(date(1990, 5, 1))), "start")


# ------------------------------------------------------------ delta

EV = """v AS (SELECT event_id AS version_id, user_id AS partition_id, ts::DATE AS start, event_type AS text, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
t AS (SELECT *, greatest(start, lead(start, 1, DATE '9999-12-31') OVER w - 1) AS "end", CASE WHEN text IS NULL OR text = '' THEN 'testo_mancante' ELSE regexp_replace(lower(text), '[^a-z0-9]', '', 'g') END AS fp FROM v WINDOW w AS (PARTITION BY partition_id ORDER BY start, n)),
c AS (SELECT *, CASE WHEN lag(fp, 1, 'inizio_blocco') OVER (PARTITION BY partition_id ORDER BY start, n) <> fp THEN 1 ELSE 0 END AS ch FROM t),
g AS (SELECT *, sum(ch) OVER (PARTITION BY partition_id ORDER BY start, n ROWS UNBOUNDED PRECEDING) AS run FROM c),
r AS (SELECT partition_id, run::BIGINT AS run, arg_min(version_id, n) AS version_id, min(n) AS n, arg_min(text, n) AS text, min(start) AS start, max("end") AS "end", count(*) AS n_versions FROM g GROUP BY partition_id, run)"""


def _runs(spark, sf_dir):
    return delta.compact(temporal.timeline(event_versions(spark, sf_dir), TODAY))


@query(f"WITH {EV} SELECT partition_id, run, version_id, n, text, {S} AS start, {E} AS \"end\", n_versions FROM r")
def delta_detection(spark, sf_dir):
    return _dates(_runs(spark, sf_dir), "start", "end")


@query(f"WITH {EV} SELECT (SELECT count(*) FROM v) AS n_raw, count(*) AS n_runs, round(100 * (1 - count(*) / (SELECT count(*) FROM v)), 2) AS saved_percent FROM r")
def delta_stats(spark, sf_dir):
    return delta.compression(table(spark, sf_dir, "events"), _runs(spark, sf_dir))


@query(f"WITH {EV} SELECT partition_id, version_id, text, {S} AS start FROM r WHERE start <= DATE '2024-01-15' AND \"end\" >= DATE '2024-01-15' QUALIFY row_number() OVER (PARTITION BY partition_id ORDER BY start DESC, n DESC) = 1")
def runs_at_a_day(spark, sf_dir):
    return flagship(spark, sf_dir)


def flagship(spark, sf_dir):
    """Runs of equal versions, then what was in force on a day."""
    return _dates(temporal.at(_runs(spark, sf_dir), date(2024, 1, 15)).select("partition_id", "version_id", "text", "start"), "start")


@query("""WITH d AS (SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'testo_mancante' ELSE regexp_replace(lower(text), '[^a-z0-9]', '', 'g') END AS fp FROM documents)
SELECT md5(fp) AS fingerprint, min(doc_id) AS first_id, count(*) AS copies FROM d GROUP BY fp""")
def fingerprint_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(text.fingerprint(F.col("text"))).alias("fingerprint"))
    return d.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


# ------------------------------------------------------------ edges


@query(f"WITH {EDGES} SELECT start_id, end_id, action, {S} AS start, {E} AS \"end\" FROM e")
def evolve_edges(spark, sf_dir):
    return _dates(graph.evolution(_timeline(spark, sf_dir)).select("start_id", "end_id", "action", "start", "end"), "start", "end")


@query(f"WITH {EDGES} SELECT start_id, end_id, law FROM e")
def law_lookup_left_join(spark, sf_dir):
    return _edges(spark, sf_dir).select("start_id", "end_id", "law")


@query(f"WITH {TL} SELECT partition_id, version_id, {S} AS start, {E} AS \"end\", status FROM tl QUALIFY row_number() OVER (PARTITION BY partition_id ORDER BY start DESC, n DESC) = 1")
def has_version_edges(spark, sf_dir):
    return _dates(graph.has_version(temporal.latest(_timeline(spark, sf_dir))), "start", "end")


@query(f"WITH {EDGES} SELECT DISTINCT tl.partition_id, e.law, {INT.format('tl.start')} AS repealed FROM tl JOIN e ON e.end_id = tl.version_id WHERE tl.change = '{REPEAL}' AND e.law IS NOT NULL")
def repealed_by(spark, sf_dir):
    return _dates(graph.repealed_by(history(spark, sf_dir), _edges(spark, sf_dir), F.col("change") == REPEAL), "repealed")


_KIND = {"1-URGENT": "abrogazione", "2-HIGH": "parzialmente_abrogato"}


@query(f"""WITH {TL}, k AS (SELECT *, CASE change WHEN '1-URGENT' THEN 'abrogazione' WHEN '2-HIGH' THEN 'parzialmente_abrogato' ELSE 'modificato' END AS kind FROM tl)
SELECT version_id, kind, CASE WHEN kind = 'abrogazione' THEN 'ABROGATO' WHEN kind = 'parzialmente_abrogato' THEN 'PARZIALMENTE ABROGATO' WHEN status = 'VIGENTE' THEN 'ATTIVO' ELSE 'STORICO' END AS state FROM k""")
def state_realign(spark, sf_dir):
    kind = F.when(F.col("change") == "1-URGENT", "abrogazione").when(F.col("change") == "2-HIGH", "parzialmente_abrogato").otherwise("modificato")
    x = _timeline(spark, sf_dir).withColumn("kind", kind)
    return x.select("version_id", "kind", text.realigned(F.col("kind"), F.col("status") == "VIGENTE").alias("state"))


def _raw(spark, sf_dir, target, kind):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.col(target).alias("target"), F.lit(kind).alias("kind"))


@query(f"WITH {TL} SELECT DISTINCT version_id, l_partkey AS target, 'rinvio' AS kind, {S} AS start, {E} AS \"end\" FROM lineitem JOIN tl ON version_id = l_orderkey")
def cite_edges(spark, sf_dir):
    return _dates(graph.citations(_raw(spark, sf_dir, "l_partkey", "rinvio"), _timeline(spark, sf_dir)), "start", "end")


@query(f"WITH {TL} SELECT DISTINCT version_id, l_suppkey AS target, 'atto' AS kind, {S} AS start, {E} AS \"end\" FROM lineitem JOIN tl ON version_id = l_orderkey WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def cite_act_edges(spark, sf_dir):
    acts = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("target"))
    return _dates(graph.citations(_raw(spark, sf_dir, "l_suppkey", "atto"), _timeline(spark, sf_dir), acts), "start", "end")


@query("SELECT DISTINCT l_orderkey AS version_id, l_partkey AS target FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25) AND l_orderkey IN (SELECT o_orderkey FROM orders)")
def dangling_edges_dropped(spark, sf_dir):
    edges = _raw(spark, sf_dir, "l_partkey", "x").drop("kind")
    return graph.loaded(edges, table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "part").where("p_size <= 25").select("p_partkey"), "version_id", "target")


@query("SELECT c_custkey AS partition_id, n_name AS act, r_name AS code FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def partition_to_act(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    acts = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    return c.join(acts, c["c_nationkey"] == acts["n_nationkey"]).select(F.col("c_custkey").alias("partition_id"), F.col("n_name").alias("act"), F.col("r_name").alias("code"))


@query("SELECT o_orderkey, count(*) AS copies FROM orders GROUP BY o_orderkey HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return graph.unique_keys(table(spark, sf_dir, "orders"), "o_orderkey").withColumnRenamed("count", "copies")


# ------------------------------------------------------------ neighbourhoods


@query(f"""WITH {EDGES}, {HITS}, x AS (SELECT tl.*, row_number() OVER (PARTITION BY partition_id ORDER BY start, n) AS rank FROM tl JOIN hits USING (partition_id) WHERE start >= DATE '{SPAN[0]}' AND "end" <= DATE '{SPAN[1]}')
SELECT x.partition_id, x.version_id, rank, e.start_id AS previous_id, e.action FROM x LEFT JOIN e ON e.end_id = x.version_id WHERE rank <= 6""")
def neighbourhood_versions_top6(spark, sf_dir):
    return graph.versions_near(_hits(spark, sf_dir), _timeline(spark, sf_dir), graph.evolution(_timeline(spark, sf_dir)), *SPAN).select("partition_id", "version_id", "rank", "previous_id", "action")


@query(f"""WITH {TL}, {HITS}, m AS (SELECT tl.* FROM tl JOIN hits USING (partition_id)), now AS (SELECT * FROM m WHERE status = 'VIGENTE' QUALIFY row_number() OVER (PARTITION BY partition_id ORDER BY start DESC, n DESC) = 1)
SELECT m.partition_id, m.version_id AS old_id, m.price AS old_value, now.version_id AS new_id, now.price AS new_value FROM m JOIN now USING (partition_id) WHERE m.version_id <> now.version_id AND m.start >= DATE '{SPAN[0]}' AND m."end" <= DATE '{SPAN[1]}'
QUALIFY row_number() OVER (PARTITION BY m.partition_id ORDER BY m.start, m.n) = 1""")
def historical_vs_current(spark, sf_dir):
    return graph.then_and_now(_hits(spark, sf_dir), _timeline(spark, sf_dir), *SPAN)


@query(f"""WITH {EDGES}, {HITS}, x AS (SELECT DISTINCT partition_id, law, action, start FROM e JOIN hits USING (partition_id) WHERE law IS NOT NULL)
SELECT partition_id, law, action, {S} AS start, row_number() OVER (PARTITION BY partition_id ORDER BY start, law, action) AS rank FROM x QUALIFY rank <= 5""")
def modifying_laws_top5(spark, sf_dir):
    return _dates(graph.modifying_laws(_hits(spark, sf_dir), _edges(spark, sf_dir)), "start")


@query(f"""WITH {TL}, cur AS (SELECT partition_id AS target, version_id AS current_id, start FROM tl WHERE status = 'VIGENTE' AND start <= DATE '{TODAY}'),
x AS (SELECT DISTINCT l_orderkey AS version_id, l_partkey AS target, current_id, start FROM lineitem JOIN cur ON l_partkey = target)
SELECT version_id, target, current_id, {INT.format('start')} AS current_start, row_number() OVER (PARTITION BY version_id ORDER BY target, current_id) AS rank FROM x QUALIFY rank <= 3""")
def cited_current_2hop(spark, sf_dir):
    cites = _raw(spark, sf_dir, "l_partkey", "x")
    return _dates(graph.cited_now(cites, temporal.current(_timeline(spark, sf_dir), TODAY)).select("version_id", "target", "current_id", "current_start", "rank"), "current_start")


@query(f"WITH {H} SELECT version_id, partition_id, n - 1 AS depth, count(*) OVER (PARTITION BY partition_id) AS chain_length FROM h")
def evolution_chain_depth(spark, sf_dir):
    return graph.chain_depth(history(spark, sf_dir))


@query(f"WITH {EDGES} SELECT law, count(DISTINCT partition_id) AS partitions, count(*) AS versions FROM e WHERE law IS NOT NULL AND action = '{REPEAL}' GROUP BY law")
def repealed_by_law(spark, sf_dir):
    e = _edges(spark, sf_dir).where((F.col("action") == REPEAL) & F.col("law").isNotNull())
    return e.groupBy("law").agg(F.countDistinct("partition_id").alias("partitions"), F.count("*").alias("versions"))


@query("SELECT 'Legge' AS name, count(*) AS rows FROM nation UNION ALL SELECT 'Partizione', count(*) FROM customer UNION ALL SELECT 'Versione', count(*) FROM orders UNION ALL SELECT 'CITA', count(*) FROM lineitem UNION ALL SELECT 'APPARTIENE', count(*) FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)")
def graph_counts(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    member = t("customer").join(t("nation").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi")
    return graph.counts({"Legge": t("nation"), "Partizione": t("customer"), "Versione": t("orders"), "CITA": t("lineitem"), "APPARTIENE": member})


@query("SELECT n_nationkey AS act, n_name AS name FROM nation WHERE list_contains(string_split(CASE WHEN n_regionkey = 3 THEN 'Legge;Codice' ELSE 'Legge' END, ';'), 'Codice')")
def multi_label_nodes(spark, sf_dir):
    acts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("act"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 3, "Legge;Codice").otherwise("Legge").alias("label"))
    return graph.with_label(acts, "Codice").select("act", "name")


# ------------------------------------------------------------ texts


def _rx(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


TEXTS = "s AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT * FROM (VALUES " + samples.values(samples.TEXTS, numbered=True) + ") v(id, text))"
TALK = "s AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'user' UNION ALL SELECT * FROM (VALUES " + samples.values(samples.QUESTIONS, numbered=True) + ") v(id, text))"


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(samples.frame(spark, samples.TEXTS, "text", numbered=True))


def _talk(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return c.unionByName(samples.frame(spark, samples.QUESTIONS, "text", numbered=True))


STATE = f"CASE WHEN regexp_matches(text, {_rx(P.REPEALED_ONLY)}) OR regexp_matches(substring(lower(text), 1, 80), {_rx(P.REPEALED_START)}) THEN 'ABROGATO' WHEN regexp_matches(lower(text), {_rx(P.REPEALED_PART)}) THEN 'PARZIALMENTE_ABROGATO' ELSE 'ATTIVO' END"


@query(f"WITH {TEXTS} SELECT id, {STATE} AS state FROM s")
def classify_state(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", text.state(F.col("text")).alias("state"))


@query(f"WITH {TEXTS}, x AS (SELECT id, text, {STATE} AS state FROM s) SELECT id, CASE WHEN id = -1 THEN 'originale' WHEN state = 'ABROGATO' AND regexp_matches(lower(text), {_rx(P.REPEALED_UNIT)}) THEN 'parzialmente_abrogato' WHEN state = 'PARZIALMENTE_ABROGATO' THEN 'parzialmente_abrogato' WHEN state = 'ABROGATO' THEN 'abrogazione' "
       + " ".join(f"WHEN regexp_matches({'text' if p == P.REPLACED else 'lower(text)'}, {_rx(p)}) THEN '{k}'" for p, k in P.CHANGES) + " ELSE 'modificato' END AS change FROM x")
def classify_modification(spark, sf_dir):
    x = _texts(spark, sf_dir).withColumn("state", text.state(F.col("text")))
    return x.select("id", text.change(F.col("text"), F.col("id") == -1, F.col("state")).alias("change"))


@query(f"WITH {TEXTS} SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS numbers FROM (SELECT id, flatten(list_transform(regexp_extract_all(text, {_rx(P.ARTICLE_LIST)}), lambda m: regexp_extract_all(m, '[0-9]+'))) AS l FROM s)")
def article_numbers(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", F.array_join(text.article_numbers(F.col("text")), ",").alias("numbers"))


@query("""WITH p AS (SELECT doc_id AS id, text, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.;!?])\\s+', '\\1' || chr(10), 'g'), '\\n+', chr(10), 'g'), chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS parts FROM documents),
k AS (SELECT *, list_transform(parts, lambda s: substring(regexp_replace(lower(s), '\\s+', ' ', 'g'), 1, 80)) AS keys FROM p)
SELECT id, md5(CASE WHEN length(text) < 50 THEN text ELSE array_to_string(list_filter(parts, lambda s, i: list_position(keys, keys[i]) = i), ' ') END) AS text_md5 FROM k""")
def dedup_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(text.sentences_once(F.col("text"))).alias("text_md5"))


def _window_sql(which: int) -> str:
    out = "CASE "
    for rule in P.WINDOWS:
        parts = [f"'{x}'" if kind == "lit" else f"regexp_extract(d, {_rx(rule[0])}, {x})" if kind == "year" else f"(regexp_extract(d, {_rx(rule[0])}, {x})::INT - 1)::VARCHAR" for kind, x in questions._filled(rule[which], None)]
        out += f"WHEN regexp_matches(d, {_rx(rule[0])}) THEN {' || '.join(parts)} "
    return out + "WHEN " + " OR ".join(f"contains(d, '{w}')" for w in P.NOW_WORDS) + f" THEN '{P.CURRENT}' ELSE '{(P.OPEN_START, P.OPEN_END)[which - 1]}' END"


@query(f'WITH {TALK}, q AS (SELECT id, lower(text) AS d FROM s) SELECT id, {_window_sql(1)} AS "from", {_window_sql(2)} AS "to" FROM q')
def question_window(spark, sf_dir):
    w = _talk(spark, sf_dir).select("id", questions.window(F.col("text")).alias("w"))
    return w.select("id", F.col("w.start").alias("from"), F.col("w.end").alias("to"))


YEARS = f"list_sort(list_distinct(regexp_extract_all(d, {_rx(P.YEARS)}, 1)))"


@query(f"""WITH {TALK}, q AS (SELECT id, text, lower(text) AS d, {YEARS.replace('(d,', '(lower(text),')} AS years, regexp_extract(lower(text), {_rx(P.ARTICLE_ASKED)}, 1) AS n FROM s)
SELECT id, array_to_string(years, ',') AS years, CASE WHEN n <> '' AND NOT list_contains(years, regexp_extract(n, '^\\d+')) THEN n END AS article,
  CASE {" ".join(f"WHEN regexp_matches(d, {_rx(p)}) THEN {_rx(c)}" for p, c in P.code_patterns(plain=True))} END AS code FROM q""")
def question_filters(spark, sf_dir):
    q = F.col("text")
    return _talk(spark, sf_dir).select("id", F.array_join(questions.years(q), ",").alias("years"), questions.article(q).alias("article"), questions.short_code(q).alias("code"))


@query(f"""WITH {TALK}, q AS (SELECT id, lower(text) AS d, regexp_extract(lower(text), {_rx(P.ARTICLE_ASKED)}, 1) AS n, {YEARS.replace('(d,', '(lower(text),')} AS years FROM s)
SELECT id, n <> '' AND NOT list_contains(years, regexp_extract(n, '^\\d+')) AND ({" OR ".join(f"contains(d, '{w}')" for w in P.TEXT_WORDS)}) AS asks_text,
  {" OR ".join(f"contains(d, '{w}')" for w in P.HISTORY_WORDS)} OR {" OR ".join(f"regexp_matches(d, {_rx(p)})" for p in P.HISTORY_FORMS)} AS asks_history FROM q""")
def question_intent(spark, sf_dir):
    q = F.col("text")
    return _talk(spark, sf_dir).select("id", questions.asks_text(q, questions.article(q)).alias("asks_text"), questions.asks_history(q).alias("asks_history"))


STOP = "[" + ", ".join(f"'{w}'" for w in P.STOP_WORDS) + "]"


@query(f"""WITH {TALK}, w AS (SELECT id, text, list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace(text, {_rx(P.CODE_NAME)}, '', 'g'), '\\b\\d{{4}}\\b', '', 'g')), '[a-zA-Z\\x{{00C0}}-\\x{{024F}}'']+'), lambda x: NOT list_contains({STOP}, x) AND length(x) > 3) AS kept FROM s)
SELECT id, CASE WHEN len(kept) > 0 THEN array_to_string(kept, ' ') ELSE text END AS themes FROM w""")
def theme_terms(spark, sf_dir):
    return _talk(spark, sf_dir).select("id", questions.themes(F.col("text")).alias("themes"))


@query(f"""WITH s AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'assistant' UNION ALL SELECT * FROM (VALUES {samples.values(samples.ANSWERS, numbered=True)}) v(id, text))
SELECT id, length(text) AS n_chars, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n_words, {" OR ".join(f"contains(lower(text), '{w}')" for w in P.LAW_WORDS)} AS cites_laws, {" OR ".join(f"contains(lower(text), '{w}')" for w in P.VERSION_WORDS)} AS cites_versions,
  len(regexp_extract_all(text, '[Aa]rt\\.')) AS n_citations, contains(text, '{P.NO_SOURCES}') AS says_no_sources, contains(text, '⚠') OR contains(lower(text), 'verificare') AS warns FROM s""")
def answer_features(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    c = c.unionByName(samples.frame(spark, samples.ANSWERS, "text", numbered=True))
    return c.select("id", *[v.alias(k) for k, v in questions.answer_features(F.col("text")).items()])


@query(f"""WITH a AS (SELECT * FROM (VALUES {samples.values(samples.ANSWERS, numbered=True)}) v(id, text)), src(number, label, text) AS (VALUES {", ".join("(" + ", ".join(_rx(x) for x in r) + ")" for r in samples.SOURCES)}),
c AS (SELECT id, unnest(list_distinct(regexp_extract_all(text, '[Aa]rt\\.\\s*(\\d+(?:[\\-][a-z]+)?)', 1))) AS n FROM a),
u AS (SELECT id, n FROM c WHERE NOT EXISTS (SELECT 1 FROM src WHERE contains(number, regexp_extract(n, '^\\d+')) OR contains(label, regexp_extract(n, '^\\d+')) OR contains(substring(src.text, 1, 300), regexp_extract(n, '^\\d+'))))
SELECT a.id::BIGINT AS id, coalesce((SELECT string_agg(n, ',' ORDER BY n) FROM u WHERE u.id = a.id), '') AS unsupported FROM a""")
def hallucination_check(spark, sf_dir):
    sources = F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip(("number", "label", "text"), r)]) for r in samples.SOURCES])
    return samples.frame(spark, samples.ANSWERS, "text", numbered=True).select("id", F.array_join(questions.unsupported_articles(F.col("text"), sources), ",").alias("unsupported"))


@query("WITH f(folder) AS (VALUES " + samples.values(samples.FOLDERS) + "), x AS (SELECT folder, regexp_extract(folder, '^([a-zA-Z][a-zA-Z_ -]+?)_(\\d{8})_(\\d+)$', 1) AS kind, try_strptime(regexp_extract(folder, '_(\\d{8})_(\\d+)$', 1), '%Y%m%d')::DATE AS d, regexp_extract(folder, '_(\\d+)$', 1) AS num FROM f),\n"
       "y AS (SELECT *, lower(regexp_replace(trim(regexp_replace(kind, '\\s+', ' ', 'g')), '[_ -]+', '.', 'g')) AS t FROM x WHERE kind <> '' AND d IS NOT NULL),\n"
       "m(key, common_name, short_code) AS (VALUES " + ", ".join("(" + ", ".join(_rx(v) for v in r) + ")" for r in P.MAIN_ACTS) + ")\n"
       "SELECT folder, 'urn:nir:stato:' || t || ':' || strftime(d, '%Y-%m-%d') || ';' || num AS urn, common_name, short_code, short_code IS NOT NULL AS is_code FROM y LEFT JOIN m ON key = t || ':' || strftime(d, '%Y-%m-%d') || ';' || num")
def act_metadata(spark, sf_dir):
    from stemma.sources.acts import metadata

    return metadata(samples.frame(spark, samples.FOLDERS, "folder")).select("folder", "urn", "common_name", "short_code", "is_code")


# ------------------------------------------------------------ search

TOKENS = "list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '\\b(" + "|".join(search.ELISIONS) + ")[''’]', ' ', 'g'), '[^a-z0-9\\x{00E0}-\\x{00FF}]+'), lambda w: w <> '' AND NOT list_contains(" + STOP + ", w))"


@query(f"""WITH d AS (SELECT doc_id, {TOKENS} AS w FROM documents), q AS (SELECT DISTINCT item_id AS qid, unnest({TOKENS}) AS term FROM benchmark), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
x AS (SELECT qid, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 4) AS score FROM q JOIN p USING (term) JOIN f USING (term) CROSS JOIN st GROUP BY qid, doc_id)
SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM x QUALIFY rank <= 10""")
def bm25_topk(spark, sf_dir):
    return search.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")).select("qid", "doc_id", "score", "rank")


KNN = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT q.vec_id AS qid, v.vec_id AS doc_id, v.label, round(list_inner_product(q.e, v.e), 5) AS score FROM v q, v WHERE q.vec_id % 100 = 0),
k16 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM x QUALIFY r <= 16)"""


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    return v, v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), "vector")


@query(f"WITH {KNN} SELECT qid, doc_id, score, r AS rank FROM k16 WHERE r <= 8")
def knn_topk(spark, sf_dir):
    return search.nearest(*_vectors(spark, sf_dir)).select("qid", "doc_id", "score", "rank")


@query(f"WITH {KNN} SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM k16 WHERE label < 5 QUALIFY rank <= 8")
def knn_postfilter(spark, sf_dir):
    return search.nearest(*_vectors(spark, sf_dir), keep=F.col("label") < 5).select("qid", "doc_id", "score", "rank")


FUSE = TL + f""", hk AS (SELECT c_nationkey AS qid, row_number() OVER (PARTITION BY c_nationkey ORDER BY price DESC, version_id) AS pos, partition_id, version_id, state, status, {S} AS start, {E} AS "end" FROM tl JOIN customer ON c_custkey = partition_id QUALIFY pos <= 30),
hv AS (SELECT c_nationkey AS qid, 30 + row_number() OVER (PARTITION BY c_nationkey ORDER BY start DESC, version_id) AS pos, partition_id, version_id, state, status, {S} AS start, {E} AS "end" FROM tl JOIN customer ON c_custkey = partition_id QUALIFY pos <= 60),
hits AS (SELECT *, partition_id % 7 AS number FROM hk UNION ALL SELECT *, partition_id % 7 FROM hv),
b AS (SELECT *, min(pos) OVER (PARTITION BY qid, partition_id) AS place, row_number() OVER (PARTITION BY qid, partition_id ORDER BY (CASE WHEN start <= 19955666 AND "end" >= 19955666 THEN 1 ELSE 0 END) DESC, start DESC, pos) AS r FROM hits),
n AS (SELECT *, max(CASE WHEN status = 'VIGENTE' THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS now FROM b WHERE r = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS r2 FROM n WHERE now = 0 OR status = 'VIGENTE'),
d AS (SELECT *, row_number() OVER (PARTITION BY qid, number, state ORDER BY place) AS r3 FROM c WHERE r2 <= 20)"""


def _fusion(spark, sf_dir):
    t = _timeline(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("partition_id"), F.col("c_nationkey").alias("qid")), "partition_id")
    pos = lambda o: F.row_number().over(Window.partitionBy("qid").orderBy(o, "version_id"))
    lexical = t.withColumn("pos", pos(F.desc("price"))).where("pos <= 30")
    vector = t.withColumn("pos", pos(F.desc("start"))).where("pos <= 30").withColumn("pos", F.col("pos") + 30)
    hits = _dates(lexical.unionByName(vector), "start", "end")
    hits = hits.select("qid", "pos", "partition_id", "version_id", (F.col("partition_id") % 7).alias("number"), F.col("state").alias("code"), "status", "start", "end", F.lit(19950101).alias("from"), F.lit(19961231).alias("to"))
    return search.fused(hits)


@query(f"WITH {FUSE} SELECT qid, version_id, partition_id, row_number() OVER (PARTITION BY qid ORDER BY place) AS rank FROM d WHERE r3 = 1")
def hybrid_fusion(spark, sf_dir):
    return _fusion(spark, sf_dir).select("qid", "version_id", "partition_id", "rank")


@query(f"""WITH {FUSE}, f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS rank FROM d WHERE r3 = 1), m AS (SELECT *, max(CASE WHEN state = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS any_f FROM f)
SELECT qid, version_id, row_number() OVER (PARTITION BY qid ORDER BY partition_id % 10 DESC, rank) AS new_rank FROM m WHERE any_f = 0 OR state = 'F' QUALIFY new_rank <= 5""")
def coherence_and_rerank(spark, sf_dir):
    return search.reranked(search.coherent(_fusion(spark, sf_dir), F.col("code") == "F"), F.col("partition_id") % 10).select("qid", "version_id", "new_rank")


@query(f"""WITH {H}, q AS (SELECT c_custkey AS qid FROM customer), l0 AS (SELECT partition_id AS qid, version_id, 0 AS level FROM h WHERE change = '{REPEAL}' AND state = 'F'), l1 AS (SELECT partition_id AS qid, version_id, 1 AS level FROM h WHERE state = 'F'), l2 AS (SELECT partition_id AS qid, version_id, 2 AS level FROM h),
u AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) SELECT qid, version_id, level FROM u QUALIFY level = min(level) OVER (PARTITION BY qid)""")
def relaxation_ladder(spark, sf_dir):
    h = history(spark, sf_dir).select(F.col("partition_id").alias("qid"), "version_id", "change", "state")
    strict = h.where((F.col("change") == REPEAL) & (F.col("state") == "F"))
    return search.relaxed([x.select("qid", "version_id") for x in (strict, h.where("state = 'F'"), h)])


# ------------------------------------------------------------ evaluation

GRADES = KNN + """, g AS (SELECT k.qid, k.r AS rank, CASE WHEN k.label = q.label THEN 3 WHEN abs(k.label - q.label) = 1 THEN 1 ELSE 0 END AS grade FROM k16 k JOIN embeddings q ON q.vec_id = k.qid WHERE k.doc_id <> k.qid),
c AS (SELECT q.vec_id AS qid, CASE WHEN v.label = q.label THEN 3 ELSE 1 END AS grade FROM embeddings q JOIN embeddings v ON abs(v.label - q.label) <= 1 AND v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)"""


def _graded(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    of = v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.col("label").alias("ql"))
    hits = search.nearest(v, q, 16).where("rank <= 16").join(of, "qid").where("doc_id <> qid")
    hits = hits.join(v.select("doc_id", F.col("label").alias("dl")), "doc_id") if "label" not in hits.columns else hits.withColumnRenamed("label", "dl")
    grade = F.when(F.col("dl") == F.col("ql"), 3).when(F.abs(F.col("dl") - F.col("ql")) == 1, 1).otherwise(0)
    near = F.explode(F.array(F.col("ql") - 1, F.col("ql"), F.col("ql") + 1)).alias("label")
    criteria = of.select("qid", "ql", near).join(v.select("doc_id", "label"), "label").where("doc_id <> qid").select("qid", F.when(F.col("label") == F.col("ql"), 3).otherwise(1).alias("grade"))
    return hits.select("qid", "rank", grade.alias("grade")), criteria


COMPLETE = """a AS (SELECT qid, count(*) FILTER (grade > 0) AS hits, count(*) AS n, sum((pow(2.0, grade) - 1) / log2(rank + 1)) AS dcg FROM g WHERE rank <= 10 GROUP BY qid), f AS (SELECT qid, min(rank) AS first FROM g WHERE grade > 0 GROUP BY qid),
i AS (SELECT qid, count(*) AS wanted, sum(CASE WHEN r <= 10 THEN (pow(2.0, grade) - 1) / log2(r + 1) END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC) AS r FROM c) GROUP BY qid),
m AS (SELECT qid, round(coalesce(hits / n, 0), 4) AS precision, round(least(coalesce(hits, 0), wanted) / wanted, 4) AS recall, round(coalesce(1 / first, 0), 4) AS mrr, round(coalesce(dcg / ideal, 0), 4) AS ndcg FROM i LEFT JOIN a USING (qid) LEFT JOIN f USING (qid))"""
ABLATION = """a AS (SELECT qid, count(*) FILTER (grade >= 1 AND rank <= 10) AS hits, min(CASE WHEN grade >= 1 THEN rank END) AS first, sum(CASE WHEN rank <= 10 THEN (pow(2.0, grade) - 1) / log2(rank + 1) END) AS dcg, sum(CASE WHEN r <= 10 THEN (pow(2.0, grade) - 1) / log2(r + 1) END) AS ideal
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC) AS r FROM g) GROUP BY qid), w AS (SELECT qid, greatest(count(*) FILTER (grade = 3), 1) AS wanted FROM c GROUP BY qid),
m AS (SELECT qid, round(coalesce(hits / 10, 0), 4) AS precision, round(coalesce(hits / wanted, 0), 4) AS recall, round(coalesce(1 / first, 0), 4) AS mrr, round(coalesce(CASE WHEN ideal > 0 THEN dcg / ideal END, 0), 4) AS ndcg FROM w LEFT JOIN a USING (qid))"""


@query(f"WITH {GRADES}, {COMPLETE} SELECT * FROM m")
def metrics_complete(spark, sf_dir):
    return metrics.complete(*_graded(spark, sf_dir), 10)


@query(f"WITH {GRADES}, {ABLATION} SELECT * FROM m")
def metrics_ablation(spark, sf_dir):
    return metrics.ablation(*_graded(spark, sf_dir), 10)


@query(f"WITH {GRADES}, {COMPLETE} SELECT qid % 300 AS category, count(*) AS questions, round(avg(precision) + 1e-9, 4) AS precision, round(avg(recall) + 1e-9, 4) AS recall, round(avg(mrr) + 1e-9, 4) AS mrr, round(avg(ndcg) + 1e-9, 4) AS ndcg FROM m GROUP BY ALL")
def metrics_by_category(spark, sf_dir):
    m = metrics.complete(*_graded(spark, sf_dir), 10).withColumn("category", F.col("qid") % 300)
    return metrics.averaged(m, ["category"])


@query(f"""WITH {GRADES.replace("WHERE k.doc_id <> k.qid", "WHERE k.doc_id <> k.qid")}, {ABLATION}, o AS (SELECT c2.qid, round(coalesce(1 / min(CASE WHEN grade = 3 THEN rank END), 0), 4) AS mrr FROM (SELECT DISTINCT qid FROM c) c2 LEFT JOIN g ON g.qid = c2.qid GROUP BY c2.qid)
SELECT 'base' AS config, qid, m.mrr AS mrr_on, o.mrr AS mrr_off, round(m.mrr - o.mrr, 4) AS delta FROM m JOIN o USING (qid)""")
def ablation_delta(spark, sf_dir):
    grades, criteria = _graded(spark, sf_dir)
    on = metrics.ablation(grades, criteria, 10).withColumn("mode", F.lit("on"))
    off = metrics.ablation(grades.withColumn("grade", F.when(F.col("grade") == 3, 3).otherwise(0)), criteria, 10).withColumn("mode", F.lit("off"))
    return metrics.on_off(on.unionByName(off).withColumn("config", F.lit("base"))).select("config", "qid", "mrr_on", "mrr_off", "delta")


@query(f"""WITH {TL}, r AS (SELECT partition_id AS qid, n AS rank, state AS code, version_id % 5 AS number, {S} AS start, {E} AS "end" FROM tl WHERE n <= 10),
k AS (SELECT c_custkey AS qid, 'F' AS code, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 5 END AS number, CASE WHEN c_custkey % 3 > 0 THEN 19950101 END AS "from", 19961231 AS "to", 1 + 2 * (c_custkey % 2)::INT AS grade FROM customer)
SELECT r.qid, r.rank, coalesce(max(k.grade), 0) AS grade FROM r LEFT JOIN k ON k.qid = r.qid AND k.code = r.code AND (k.number IS NULL OR k.number = r.number) AND (k."from" IS NULL OR (r.start <= k."to" AND r."end" >= k."from")) WHERE r.qid IN (SELECT c_custkey FROM customer) GROUP BY ALL""")
def relevance_match(spark, sf_dir):
    r = _dates(_timeline(spark, sf_dir).where("n <= 10"), "start", "end").select(F.col("partition_id").alias("qid"), F.col("n").alias("rank"), F.col("state").alias("code"), (F.col("version_id") % 5).alias("number"), "start", "end")
    k = F.col("c_custkey")
    criteria = table(spark, sf_dir, "customer").select(k.alias("qid"), F.lit("F").alias("code"), F.when(k % 2 == 0, k % 5).alias("number"), F.when(k % 3 > 0, 19950101).alias("from"), F.lit(19961231).alias("to"), (1 + 2 * (k % 2)).cast("int").alias("grade"))
    return metrics.matched(r, criteria)


@query(f"""WITH {TL}, r AS (SELECT partition_id AS qid, n AS rank, version_id FROM tl WHERE n <= 10) SELECT qid, rank, CASE WHEN rank >= 2 THEN 3 ELSE 0 END AS grade FROM r""")
def evolutive_grades(spark, sf_dir):
    r = _timeline(spark, sf_dir).where("n <= 10").select(F.col("partition_id").alias("qid"), F.col("n").alias("rank"), "version_id")
    return metrics.reached(r, r.select("qid").distinct().withColumn("versions", F.lit(2)))


# ------------------------------------------------------------ ingest


@query("SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def new_records_anti_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.join(e.where("event_type = 'click'").select("event_id"), "event_id", "left_anti").select("event_id", "user_id")


@query(f"WITH {TL} SELECT version_id, partition_id, status = 'VIGENTE' AS is_current FROM tl WHERE status = 'VIGENTE'")
def current_index_refresh(spark, sf_dir):
    from stemma.sources.index import split_current, with_current

    return split_current(with_current(_timeline(spark, sf_dir)))[1].select("version_id", "partition_id", "is_current")


@query(f"""WITH {TL} SELECT 'urn#' || partition_id AS partizione_id, 'urn#' || partition_id || '_V' || n AS versione_id, 'Art. ' || (partition_id % 90) || CASE WHEN partition_id % 4 = 0 THEN ' bis' ELSE '' END || CASE WHEN state <> '' THEN ' ' || state ELSE '' END AS title,
  (partition_id % 90) || CASE WHEN partition_id % 4 = 0 THEN '-bis' ELSE '' END AS numero_puro, {S} AS valido_dal_raw, CASE WHEN {E} IS NULL THEN 99991231 ELSE {E} END AS valido_al_raw, status = 'VIGENTE' AS is_current FROM tl""")
def index_documents(spark, sf_dir):
    from stemma.sources.index import documents

    t = _dates(_timeline(spark, sf_dir), "start", "end")
    pid = F.concat(F.lit("urn#"), F.col("partition_id").cast("string"))
    number = F.concat(F.lit("Art. "), (F.col("partition_id") % 90).cast("string"), F.when(F.col("partition_id") % 4 == 0, " bis").otherwise(""))
    rows = t.select(F.concat(pid, F.lit("_V"), F.col("n").cast("string")).alias("versione_id"), number.alias("numero"), F.col("state").alias("codice_breve_atto"), F.col("start").cast("string").alias("valido_dal"), F.col("end").cast("string").alias("valido_al"), F.col("status").alias("stato_vigenza"))
    return documents(rows).select("partizione_id", "versione_id", "title", "numero_puro", "valido_dal_raw", "valido_al_raw", "is_current")


from stemma.plans import etl, retrieval  # noqa: E402, F401  (they add their queries)
