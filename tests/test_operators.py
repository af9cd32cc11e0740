"""Quirks and edge cases of the temporal, graph, text, search and metric operators."""

import itertools
import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from stemma.functions import questions, text
from stemma.operators import answers, delta, graph, metrics, search, temporal

FAR = date(9999, 12, 30)


def versions(spark, rows):
    return spark.createDataFrame([(f"v{i}", p, date.fromisoformat(d), n, t) for i, (p, d, n, t) in enumerate(rows)], "version_id string, partition_id string, start date, n long, text string")


def test_timeline_of_same_day_versions(spark):
    v = versions(spark, [("p", "2000-01-01", 1, "a"), ("p", "2000-01-01", 2, "b"), ("p", "2000-01-01", 10, "c"), ("p", "2001-01-01", 11, "d")])
    got = {r["n"]: r for r in temporal.timeline(v, date(2000, 6, 1)).collect()}
    assert [got[n]["end"] for n in (1, 2, 10, 11)] == [date(2000, 1, 1), date(2000, 1, 1), date(2000, 12, 31), FAR]
    assert [got[n]["status"] for n in (1, 2, 10, 11)] == ["STORICO", "STORICO", "VIGENTE", "VIGENTE"]
    assert [got[n]["next_id"] for n in (1, 2, 10, 11)] == ["v1", "v2", "v3", None]
    at = temporal.at(temporal.timeline(v, date(2000, 6, 1)), date(2000, 1, 1)).collect()
    assert [r["n"] for r in at] == [10]


def test_runs_of_equal_texts(spark):
    v = versions(spark, [("p", f"200{i}-01-01", i, t) for i, t in enumerate(["A", "A", "a!", "B", "A", None, ""])])
    got = delta.compact(temporal.timeline(v, date(2024, 1, 1))).orderBy("run").collect()
    assert [(r["version_id"], r["n_versions"], r["start"].year, r["end"]) for r in got] == [("v0", 3, 2000, date(2002, 12, 31)), ("v3", 1, 2003, date(2003, 12, 31)), ("v4", 1, 2004, date(2004, 12, 31)), ("v5", 2, 2005, FAR)]


def test_file_names(spark):
    names = ["/x/A_ORIGINALE_.xml", "/x/A_VIGENZA_1999-01-01_V2.xml", "/x/A_VIGENZA_1999-01-01_V2b.xml", "/x/A_VIGENZA_2000-02-30_V3.xml", "/x/A_VIGENZA_2001-01-01_V4.xml", "/x/none.xml"]
    got = temporal.file_versions(spark.createDataFrame([(n,) for n in names], "path string"), F.lit(date(1990, 1, 1))).collect()
    assert sorted((r["start"].year, r["version"]) for r in got) == [(1990, 1), (1999, 2), (2001, 4)]


def test_dangling_edges_are_dropped(spark):
    e = spark.createDataFrame([(1, 2), (1, 2), (1, 9), (8, 2)], "a long, b long")
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    assert [tuple(r) for r in graph.loaded(e, ids, ids, "a", "b").collect()] == [(1, 2)]


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw,want", [("20200131", 20200131), ("20200131.0", 20200131), ("", None), ("0", None), (None, None), ("2020", None)])
def test_int_dates(spark, raw, want):
    assert one(spark, text.int_date, raw) == want


@pytest.mark.parametrize("raw,want", [("20200131", date(2020, 1, 31)), ("20200230", None), ("x", None)])
def test_folder_dates(spark, raw, want):
    assert one(spark, text.folder_date, raw) == want


@pytest.mark.parametrize(
    "href,want",
    [
        ("urn:nir:stato:decretoLegislativo:2005-03-07;82~art5", "urn:nir:stato:decreto.legislativo:2005-03-07;82#art_5"),
        ("urn:nir:stato:costituzione:1947-12-27;1", "urn:nir:stato:costituzione:1947-12-27;1"),
        ("/akn/it/act/LEGGE/stato/1990-08-07/241/!main#art_3-bis", "urn:nir:stato:legge:1990-08-07;241#art_3_bis"),
        ("/akn/it/act/decretoLegge/stato/1990/5#allegato-A.1", "urn:nir:stato:decreto.legge:1990;5#allegato_a_1"),
        ("urn:nir:stato:legge:1990-08-07;241#main", "urn:nir:stato:legge:1990-08-07;241"),
        ("http://x/y", "http://x/y"),
        (" ", None),
        (None, None),
    ],
)
def test_references(spark, href, want):
    assert one(spark, text.urn_of, href) == want


@pytest.mark.parametrize(
    "e_id,opening,want",
    [
        ("Art 116-bis", "", ("art_116_bis", "Art. 116-bis", "strutturale")),
        ("art_116", "", ("art_116", "Art. 116", "strutturale")),
        (None, "Articolo 7-ter. Oggetto", ("art_7-ter".replace("-", "_"), "Art. 7-ter", "testuale")),
        (None, "12. Disposizione", ("disp_12", "Disp. 12", "testuale_disp")),
    ],
)
def test_node_ids(spark, e_id, opening, want):
    r = spark.createDataFrame([(e_id, opening)], "e string, t string").select(text.node_id(F.col("e"), F.col("t")).alias("n")).first()["n"]
    assert tuple(r) == want


def test_node_id_by_checksum(spark):
    import zlib

    r = spark.createDataFrame([(None, "solo testo")], "e string, t string").select(text.node_id(F.col("e"), F.col("t")).alias("n")).first()["n"]
    assert r["id"] == f"art_hash_{zlib.crc32(b'solo testo'):08x}" and r["method"] == "hash"


def test_repeated_half(spark):
    half = "Il comma primo si applica."
    assert one(spark, text.without_second_half, f"{half} {half}") == half
    assert one(spark, text.without_second_half, "breve breve") == "breve breve"


def test_sentences_once(spark):
    t = "Prima frase del testo. Seconda frase; prima  frase DEL testo.\n\nPrima frase del testo. Ultima frase qui"
    assert one(spark, text.sentences_once, t) == "Prima frase del testo. Seconda frase; Ultima frase qui"


def test_embedding_text(spark):
    row = ("Art. 5", "", "Codice Civile", None, "c.c.", "t", "20000101", "99991231", "sostituzione", "VIGENTE", "Testo.")
    names = "number short common named alias title start end kind status text".split()
    df = spark.createDataFrame([row], ", ".join(f"{n} string" for n in names))
    got = df.select(text.embedding_text(*[F.col(n) for n in names]).alias("e")).first()["e"]
    assert got == "Art. 5 c.c.\n\nCodice Civile\n\nc.c.\n\nVigente dal 20000101 in vigore\n\nTipo modifica: sostituzione\n\nTesto."


@pytest.mark.parametrize(
    "q,want",
    [
        ("Testo originale dell'articolo", ("ORIGINALE", "ORIGINALE")),
        ("prima della riforma del 1975", ("19000101", "19741231")),
        ("tra il 1950 e il 1960", ("19500101", "19601231")),
        ("dal 1942 ad oggi", ("19420101", "99991231")),
        ("nel 1931", ("19310101", "19311231")),
        ("fino al 1990", ("19000101", "19891231")),
        ("non è ancora chiaro", ("IS_CURRENT", "IS_CURRENT")),
        ("che dice", ("19000101", "99991231")),
    ],
)
def test_windows(spark, q, want):
    assert tuple(one(spark, questions.window, q)) == want


def test_first_code_wins(spark):
    assert one(spark, questions.short_code, "il codice penale militare di pace") == "c.p.m.p."
    assert one(spark, questions.short_code, "art. 5 c.p.c.?") == "c.p.c."
    assert one(spark, questions.short_code, "nulla") is None


def fold(hits, start, end, cap=20):
    """Hits merged one after the other into a dictionary."""
    middle = (start + end) // 2 if start > 19000101 and end < 99991230 else None
    holds = lambda h: middle is not None and h["start"] <= middle <= h["end"]
    best: dict = {}
    for h in hits:
        if h["partition_id"] is None:
            continue
        old = best.get(h["partition_id"])
        if old is None or (holds(h), h["start"]) > (holds(old), old["start"]):
            best[h["partition_id"]] = h
    out = list(best.values())
    out = ([h for h in out if h["status"] == "VIGENTE"] or out)[:cap]
    seen, kept = set(), []
    for h in out:
        if (h["number"], h["code"]) not in seen:
            seen.add((h["number"], h["code"]))
            kept.append(h["version_id"])
    return kept


def test_fusion_is_the_fold(spark):
    rng = random.Random(1)
    names = "qid pos partition_id version_id number code status start end from to".split()
    rows, want = [], {}
    for qid in range(40):
        lo, hi = rng.choice([(19900101, 19991231), (19000101, 99991231)])
        own = []
        for pos in range(rng.randint(1, 30)):
            s = rng.randint(19800101, 20050101)
            own.append(dict(zip(names, (qid, pos, rng.choice([None, *"abcdefgh"]), f"{qid}-{pos}", rng.choice("12"), rng.choice("xyz"), rng.choice(["VIGENTE", "STORICO", "STORICO"]), s, s + rng.randint(0, 99999), lo, hi))))
        rows += [tuple(h[n] for n in names) for h in own]
        want[qid] = fold(own, lo, hi)
    df = spark.createDataFrame(rows, "qid long, pos int, partition_id string, version_id string, number string, code string, status string, start int, end int, `from` int, `to` int")
    got: dict = {q: [] for q in want}
    for r in search.fused(df).orderBy("qid", "rank").collect():
        got[r["qid"]].append(r["version_id"])
    assert got == want


def test_post_filter_may_leave_few(spark):
    v = spark.createDataFrame([(i, [float(i), 0.0], i % 2) for i in range(20)], "doc_id long, vector array<double>, odd int")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, vector array<double>")
    assert [r["doc_id"] for r in search.nearest(v, q, 2, F.col("odd") == 1).orderBy("rank").collect()] == [19, 17]
    assert search.nearest(v, q, 2, F.col("doc_id") < 5).count() == 0


def brute_metrics(grades, criteria, k):
    dcg = lambda gs: sum((2**g - 1) / math.log2(i + 2) for i, g in enumerate(gs[:k]))
    first = next((i + 1 for i, g in enumerate(grades) if g > 0), None)
    n = len(criteria)
    full = max(1, criteria.count(3))
    hits = sum(g > 0 for g in grades[:k])
    ideal, own = dcg(sorted(criteria, reverse=True)), dcg(sorted(grades, reverse=True))
    a = (hits / len(grades[:k]) if grades else 0, min(hits, n) / n, 1 / first if first else 0, dcg(grades) / ideal if ideal else 0)
    b = (hits / k, hits / full, a[2], dcg(grades) / own if own else 0)
    return tuple(round(x, 4) for x in a), tuple(round(x, 4) for x in b)


def test_both_metrics(spark):
    cases = [([3, 0, 1], [3, 1]), ([], [3]), ([0, 0], [3]), ([1, 3], [3, 3, 1]), ([3] * 12, [3])]
    g = spark.createDataFrame([(q, i + 1, x) for q, (gs, _) in enumerate(cases) for i, x in enumerate(gs)], "qid long, rank long, grade int")
    c = spark.createDataFrame([(q, x) for q, (_, cs) in enumerate(cases) for x in cs], "qid long, grade int")
    for k, (which, fn) in itertools.product((3, 5, 10), enumerate((metrics.complete, metrics.ablation))):
        got = {r["qid"]: (r["precision"], r["recall"], r["mrr"], r["ndcg"]) for r in fn(g, c, k).collect()}
        for q, (gs, cs) in enumerate(cases):
            assert got[q] == brute_metrics(gs, cs, k)[which], (q, k, which)


def test_threshold_of_versions(spark):
    r = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate("aabcb")], "qid long, rank long, version_id string")
    w = spark.createDataFrame([(1, 2)], "qid long, versions int")
    assert [x["grade"] for x in metrics.reached(r, w).orderBy("rank").collect()] == [0, 0, 3, 3, 3]


CONTEXT = "qid long, rank int, partition_id string, number string, code string, title string, start int, end int, state string, change string, text string"


def test_answers(spark):
    rows = [
        (1, 1, "p", "Art. 1", "c.c.", "t", 20000101, 20051231, "STORICO", "sostituzione", "Testo nuovo"),
        (1, 2, "p", "Art. 1", "c.c.", "t", 19900101, 19991231, "ATTIVO", "originale", "x" * 301),
        (1, 3, "q", "Art. 1", "", "t", 19800101, 99991231, "ATTIVO", None, None),
    ]
    df = spark.createDataFrame(rows, CONTEXT)
    d = answers.direct(df).first()["answer"].split("\n\n---\n\n")
    assert d[0] == "Art. 1 c.c. [vigente dal 20000101 20051231] [STORICO]\n\nTesto nuovo" and d[2].startswith("Art. 1 — t [vigente dal 19800101 in vigore]")
    h = answers.history(df).first()["answer"].split("\n")
    assert h[0] == "Storia di Art. 1 c.c. (2 versioni nel dataset)" and h[2] == "  [19900101 → 19991231]" and h[3].endswith("...") and h[4] == "  [20000101 → 20051231] sostituzione [STORICO]"


def test_search_in_blocks_is_the_joined_search(spark, monkeypatch):
    import random

    rng = random.Random(3)
    words = ["mare", "fondo", "legge", "vento", "ponte", "norma", "strada", "bosco"]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(200)], "doc_id long, text string").repartition(3)
    qs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=3))) for i in range(20)] + [(90, ""), (91, "altrove")], "qid int, text string")
    vectors = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(150)], "doc_id long, vector array<float>").repartition(4)
    asked = vectors.where("doc_id < 9").select(F.col("doc_id").alias("qid"), "vector")
    rows = lambda df: sorted(tuple(r) for r in df.select("qid", "doc_id", "score", "rank").collect())
    monkeypatch.setattr(search, "CELLS", 64)
    a, b = rows(search.bm25(docs, qs, 5)), rows(search.nearest(vectors, asked, 4))
    monkeypatch.setattr(search, "QUERIES", 1)
    assert a and a == rows(search.bm25(docs, qs, 5)) and b and b == rows(search.nearest(vectors, asked, 4))
    monkeypatch.setattr(search, "QUERIES", 100)
    index = search.forward_index(docs)
    assert a == rows(search.bm25(index, qs, 5, indexed=True))
    assert search.bm25(docs.limit(0), qs, 5).collect() == [] and search.bm25(docs, qs.limit(0), 5).collect() == []
    assert search.nearest(vectors, asked.limit(0), 4).collect() == []


def rows_of_joins(plan):
    """The rows that each join of an executed plan has made."""
    kind = plan.getClass().getSimpleName()
    inside = plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan() if kind.endswith("QueryStageExec") else None
    children = [inside] if inside is not None else [plan.children().apply(i) for i in range(plan.children().size())]
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in kind else []
    return own + [n for c in children for n in rows_of_joins(c)]


def all_versions_one_by_one(asked, docs, size):
    out = set()
    for qid in {q for q, *_ in asked}:
        own = [(d[3], d[0]) for a in asked if a[0] == qid for d in docs if None not in a + d[1:] and a[1:3] == d[1:3] and d[3] <= a[4] and d[4] >= a[3]]
        out |= {(qid, v, rank) for rank, (_, v) in enumerate(sorted(own)[:size], 1)}
    return out


@pytest.mark.parametrize("n_docs, n_asked, days, size", [(300, 60, 25, 5), (400, 300, 200, 3), (40, 40, 4, 50), (200, 100, 1000, 1)])
def test_all_versions_of_articles_with_many_windows(spark, n_docs, n_asked, days, size):
    rng = random.Random(days)
    some = lambda v: None if rng.random() < 0.04 else v
    docs = [(f"v{i}", some(rng.randrange(3)), some(rng.choice("FO")), some(s := rng.randrange(days)), some(s + rng.randrange(-2, days))) for i in range(n_docs)]
    asked = [(some(rng.randrange(n_asked)), some(rng.randrange(4)), some(rng.choice("FO")), some(s := rng.randrange(days)), some(s + rng.randrange(days))) for _ in range(n_asked)]
    d = spark.createDataFrame(docs, "versione_id string, numero_puro long, codice_breve_atto string, valido_dal_raw int, valido_al_raw int")
    a = spark.createDataFrame(asked, "qid long, number long, code string, `from` int, `to` int")
    got = {(r["qid"], r["versione_id"], r["rank"]) for r in answers.all_versions(a, d, size).collect()}
    assert got == all_versions_one_by_one([a for a in asked if a[0] is not None], docs, size) | {(None, v, r) for q, v, r in got if q is None}


def test_all_versions_do_not_meet_all_questions(spark):
    """1,000 questions about an article of 2,000 versions: two million pairs, 50,000 rows."""
    d = spark.range(2000).select(F.col("id").cast("string").alias("versione_id"), F.lit(1).alias("numero_puro"), F.lit("F").alias("codice_breve_atto"), F.col("id").cast("int").alias("valido_dal_raw"), F.lit(99991231).alias("valido_al_raw"))
    a = spark.range(1000).select(F.col("id").alias("qid"), F.lit(1).alias("number"), F.lit("F").alias("code"), (F.col("id") % 40).cast("int").alias("from"), F.lit(20001231).alias("to"))
    x = answers.all_versions(a, d).select("qid", "rank")
    assert len(x.collect()) == 50_000
    assert max(rows_of_joins(x._jdf.queryExecution().executedPlan())) <= 50_000
