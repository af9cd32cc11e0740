"""Nulls in any column, empty and long texts, repeated rows, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

from stemma.llm import binary, language, lengths, licenses, media, merkle, mixing, packing, quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, FP string, kept int, topic string, next string, lang_pred string, `a.b` int, __range int, n_tokens string"
LONG = "una frase lunga con parole diverse\n" * 12000


def rows():
    extra = ("s", "f", 1, "t", "n", "l", 7, 8, "k")
    base = [
        (1, "The cat sat on the mat and looked at the moon.", "en", "a", 5),
        (2, None, None, None, None),
        (3, "", "en", None, 0),
        (4, "Der Hund lief schnell durch den Wald und kam nicht heim.", "de", "b", 5),
        (5, LONG, "it", "a", len(LONG)),
        (6, "12 34 ... !!", "en", "b", 3),
        (None, "The dog has no id at all but a text.", "en", "a", 1),
        (7, "All rights reserved. Released under the MIT License.", "en", "b", 1),
        (7, "All rights reserved. Released under the MIT License.", "en", "b", 1),
        (8, "x", None, "a", None),
        (9, "\U0001f600 émoji ñandú", "es", "c", 2),
    ]
    return [r + extra for r in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, 1, None), (6, None, 0), (None, 1, 0), (7, 0, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "simhash": lambda d, l: simhash.near_duplicates(d),
    "mix": lambda d, l: mixing.mix(d),
    "scan": lambda d, l: licenses.scan(d),
    "matrices": lambda d, l: binary.packed_rows(d),
    "merkle": lambda d, l: merkle.fingerprints_with_edits(d),
    "language": lambda d, l: language.identify(d),
    "pack": lambda d, l: packing.pack(d),
    "lengths": lambda d, l: lengths.context_limits(lengths.token_lengths(d)),
    "quality": lambda d, l: quality.classify(d, l),
}
STAGES = {
    "quality": lambda d, l: quality.keep_good(d, l),
    "language": lambda d, l: language.keep_known(d),
    "near": lambda d, l: simhash.keep_one_each(d),
    "mix": lambda d, l: mixing.keep_sample(d),
}
PER_ROW = {"simhash", "mix", "scan", "merkle", "language", "quality"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(docs, labels, name):
    got = OPERATORS[name](docs, labels).collect()
    assert got
    if name in PER_ROW:
        assert len(got) == len(rows())
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, labels, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).collect() == []


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(docs, labels, name):
    out = STAGES[name](docs, labels)
    assert out.columns == docs.columns
    assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    kept = {tuple(r) for r in out.collect()}
    assert kept <= {tuple(r) for r in docs.collect()} and kept


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_nothing(docs, labels, name):
    assert STAGES[name](docs.limit(0), labels).collect() == []


@pytest.mark.parametrize("name", ["language", "quality", "mix", "scan"])
def test_all_null(spark, labels, name):
    d = spark.createDataFrame([(None, None, None, None, None)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    assert len(OPERATORS[name](d, labels).collect()) == 3


def test_single_document_is_its_own_next(spark):
    d = spark.createDataFrame([(5, "abcd efgh")], "doc_id long, text string")
    r = merkle.fingerprints_with_edits(d).first()
    assert r["near_next"] == 1.0 and r["n_chars"] == 9


def test_images_odd_rows(spark):
    x = media.encode(__import__("numpy").zeros((20, 20), "uint8"))
    d = spark.createDataFrame([(1, None), (2, b""), (3, b"junk"), (4, x), (5, x), (5, x), (None, x)], "id long, image binary").withColumn("key", F.lit("own"))
    got = {(r["id"], r["component_id"]) for r in media.find_copies(d, "id").collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (None, None)}
    assert media.find_copies(d.limit(0), "id").collect() == []
    nulls = spark.createDataFrame([(7, None), (8, None), (8, None), (None, None), (9, b"junk"), (10, b"junk")], "id long, image binary")
    assert {(r["id"], r["component_id"]) for r in media.find_copies(nulls, "id").collect()} == {(7, 7), (8, 8), (9, 9), (10, 9), (None, None)}
    # several images of one id: its group is that of the smallest
    many = spark.createDataFrame([(1, x), (2, b"junk"), (3, x), (3, b"junk")], "id long, image binary")
    assert len(media.find_copies(many, "id").collect()) == 4


def test_a_large_image(spark):
    import numpy as np

    x = np.random.default_rng(1).integers(0, 256, (400, 500)).astype("uint8")
    d = spark.createDataFrame([(1, media.encode(x)), (2, media.encode(x[50:, 30:]))], "id long, image binary")
    got = {r["id"]: (r["component_id"], r["n_features"] > 3000) for r in media.find_copies(d, "id").collect()}
    assert got == {1: (1, True), 2: (1, True)}


def test_long_and_null_texts_leave_no_language_out(spark):
    en, xx, yy = "the cat sat on the mat and saw the moon ", "zlorp qwiv drakk zuvv qwop ", "huumi oolai aaleu iouma "
    rows = [(i, "en", en * 3) for i in range(40)] + [(i, "xx", xx * 4000) for i in range(100, 112)]
    rows += [(i, "yy", None) for i in range(1000, 5000)] + [(i, "yy", yy * 3) for i in range(5000, 5006)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert language.fit(docs).languages == ["en", "xx", "yy"]
    got = {r["lang"]: set() for r in docs.select("lang").distinct().collect()}
    for r in language.predict(docs.where("text is not null"), language.fit(docs)).collect():
        got[r["lang"]].add(r["lang_pred"])
    assert got == {"en": {"en"}, "xx": {"xx"}, "yy": {"yy"}}


def test_rows_of_one_id_stay_for_each_of_their_groups(spark):
    a, b = "one clean text about the moon and stars", "another text entirely, on boats and harbours"
    docs = spark.createDataFrame([(3, b), (7, b), (7, a), (9, a), (7, a), (None, a)], "doc_id long, text string")
    for n in (1, 2, 5):
        got = sorted(simhash.keep_one_each(docs.repartition(n)).collect(), key=str)
        assert [tuple(r) for r in got] == [(3, b), (7, a), (None, a)]


def test_chain_over_a_row_without_id(spark, monkeypatch):
    prints = {"x": 0, "y": 0b111, "z": 0b111111, "far": 1 << 60 | 0b1010101010101 << 20}
    monkeypatch.setattr(simhash, "with_fingerprints", lambda docs, keep: docs.select(*keep, F.coalesce(*[F.when(F.col("text") == t, F.lit(x)) for t, x in prints.items()]).cast("long").alias("fp")))
    docs = spark.createDataFrame([(1, "x"), (None, "y"), (2, "z"), (None, "far")], "doc_id long, text string")
    got = {(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(1, 0, 1), (None, 7, 1), (2, 63, 1), (None, prints["far"], None)}


def test_next_without_any_id(spark):
    d = spark.createDataFrame([(None, t) for t in ("b", "c", "a", None)], "doc_id long, text string").repartition(3)
    rows = merkle.with_next(d.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["text"]).collect()
    assert {r["text"]: r["next"]["text"] for r in rows} == {"": "a", "a": "b", "b": "c", "c": ""}
    assert len(merkle.fingerprints_with_edits(d).collect()) == 4


def test_next_with_many_null_ids(spark):
    rows = [(i if i % 3 else None, f"text {i}") for i in range(300)]
    got = merkle.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), ["doc_id"], per=20).collect()
    assert sorted(r["text"] for r in got) == sorted(t for _, t in rows)
    ids = sorted(i for i, _ in rows if i is not None)
    assert {r["doc_id"]: r["next"]["doc_id"] for r in got if r["doc_id"] in ids[:-1]}.keys() == set(ids[:-1])


def test_star_of_many_links(spark):
    from stemma.llm.common import connected_components

    star = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    more = spark.createDataFrame([(100_000, 200_000), (300_001, 300_000)], "a long, b long")
    got = connected_components(star.unionByName(more)).groupBy("root").count().collect()
    assert {tuple(r) for r in got} == {(0, 100_002), (300_000, 2)}


def test_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from stemma.llm.common import shared_folder

    conf = lambda x: SimpleNamespace(get=lambda k: x)
    of = lambda master, x: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf(x)))
    assert shared_folder(of("spark://h:1", "hdfs://n/ck/")) == "hdfs://n/ck"
    assert shared_folder(of("local[2]", None))
    with pytest.raises(ValueError):
        shared_folder(of("spark://h:1", None))


def test_session_settings_stay(spark, docs):
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")}
    simhash.near_duplicates(docs).collect()
    packing.pack(docs).collect()
    assert before == {k: spark.conf.get(k) for k in before}


def test_values_of_odd_rows(docs, labels):
    """Null and empty texts, text without a letter, repeated rows: the results that the docstrings define."""
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    got = by(simhash.near_duplicates(docs))
    assert (got[2]["fp"], got[3]["fp"], got[2]["component_id"], got[3]["component_id"]) == (0, 0, 2, 2)
    got = by(language.identify(docs))
    assert {i: (got[i]["lang_pred"], got[i]["score"]) for i in (2, 3, 6)} == {i: ("und", 0.0) for i in (2, 3, 6)}
    assert got[9]["lang_pred"] in ("en", "de", "it", "es") and got[None]["lang_pred"] == "en"
    got = by(quality.classify(docs, labels))
    assert got[2]["score"] == got[3]["score"] and 0 <= got[2]["score"] <= 1
    got = by(licenses.scan(docs))
    for i in (2, 3):
        assert (got[i]["n_words"], got[i]["n_base"], got[i]["first_word"], got[i]["last_word"], got[i]["labels"], got[i]["score"]) == (0, 0, None, None, "", 0.0)
    assert (got[7]["base_labels"], got[7]["labels"], got[7]["n_words"]) == ("reserved", "mit,reserved", 8)
    got = by(mixing.mix(docs))
    assert got[2]["tokens"] == got[3]["tokens"] == 1 and got[2]["topic"] == "prose"
    got = by(merkle.fingerprints_with_edits(docs))
    assert got[2]["fingerprint"] == got[3]["fingerprint"] and got[2]["n_chars"] == 0 and got[2]["near_edited"] == 1.0
    got = [r for r in packing.pack(docs).collect() if r["doc_id"] in (2, 3)]
    assert [(r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in got] == [(0, 0, 1, bytes(4))] * 2
    got = {r["length"]: r["n_docs"] for r in lengths.context_limits(lengths.token_lengths(docs)).collect()}
    assert got[0] == 2 and sum(got.values()) == len(rows())


def test_names_of_results_may_be_names_of_columns(spark):
    d = spark.createDataFrame([(i, f"some text {i} " * 50, "x", 1, 2.0, "y", True) for i in range(5)], "doc_id long, text string, sequence_id string, offset int, positions double, ids string, open boolean")
    assert packing.pack(d, digest=True).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert binary.packed_rows(d).columns == binary.NAMES
    assert packing.pack(d).agg(F.countDistinct("doc_id")).first()[0] == binary.unpack(binary.packed_rows(d)).agg(F.countDistinct("doc_id")).first()[0] == 5


def test_pipeline_on_nothing(spark, tmp_path):
    import corpus_pipeline

    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_packing_stage(docs):
    import corpus_pipeline

    got = corpus_pipeline.packing_stage(docs.sparkSession, docs, "").collect()
    assert sorted({str(r["doc_id"]) for r in got}) == sorted({str(r[0]) for r in rows()})
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
