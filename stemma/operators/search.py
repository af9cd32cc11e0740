"""Lexical and vector search over tables of queries, and the fusion of their hits.

Queries are a table: every step is keyed by ``qid`` and none loops on the
driver. Sets of queries within stated bounds go to the documents by broadcast,
and each task returns its best hits; larger sets are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.functions import patterns as P

K1, B = 1.2, 0.75
#: Articles that an apostrophe joins to the next word.
ELISIONS = ("c", "l", "all", "dall", "dell", "nell", "sull", "coll", "pell", "gl", "agl", "dagl", "degl")


def tokens(text: Column, stop: Sequence[str] = P.STOP_WORDS, stem: bool = False) -> Column:
    """Lower-cased words without joined articles and stop words; ``stem`` drops final vowels."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\b(" + "|".join(ELISIONS) + r")['’]", " ")
    words = F.filter(F.split(t, r"[^a-z0-9\x{00E0}-\x{00FF}]+"), lambda w: (w != "") & ~w.isin(*stop))
    return F.transform(words, lambda w: F.when(F.length(w) > 4, F.regexp_replace(w, r"[aeiou\x{00E0}-\x{00FF}]+$", "")).otherwise(w)) if stem else words


#: Terms of all queries, and queries, up to which documents are scored where they lie; beyond either, postings are joined.
VOCABULARY, QUERIES = 100_000, 20_000
#: Scores held at once (documents of a batch x queries).
CELLS = 1 << 22


def forward_index(docs: DataFrame) -> DataFrame:
    """(doc_id, w): each document's words, split once; to be written and read again where many batches of queries are asked."""
    return docs.select("doc_id", tokens(F.col("text")).alias("w"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, boost: float = 1.0, indexed: bool = False) -> DataFrame:
    """(qid, doc_id, score, rank): docs (doc_id, text) for queries (qid, text).

    ``indexed``: docs are a ``forward_index``. Terms of queries that fit the
    bounds go to the documents, so that neither words nor scores are shuffled but
    the best k of each task and query.
    """
    terms = queries.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    split = (docs if indexed else forward_index(docs)).withColumn("dl", F.size("w"))
    known = terms.agg(F.countDistinct("term"), F.countDistinct("qid")).first()
    if known[0] <= VOCABULARY and known[1] <= QUERIES:
        return _scored_in_place(split, terms, k, boost)
    stats = split.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    vocabulary = terms.select("term").distinct()
    postings = split.select("doc_id", "dl", F.explode("w").alias("term")).join(vocabulary, "term", "left_semi").groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    # asking for tf keeps both branches on one exchange, so the texts are split once for them
    df = postings.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = postings.join(df, "term").join(F.broadcast(stats)).select("term", "doc_id", part.alias("part"))  # one row
    hits = terms.join(scored, "term").groupBy("qid", "doc_id").agg(F.round(F.sum("part") * boost, 4).alias("score"))
    return ranked(hits, k)


def _counted(batch_words: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of the words that are in the vocabulary."""
    import pyarrow.compute as pc

    term = pc.fill_null(pc.index_in(batch_words.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(batch_words)), np.diff(batch_words.offsets.to_numpy()))
    key, tf = np.unique((doc * len(vocabulary) + term)[term >= 0], return_counts=True)
    return key // max(1, len(vocabulary)), key % max(1, len(vocabulary)), tf


def _scored_in_place(split: DataFrame, terms: DataFrame, k: int, boost: float) -> DataFrame:
    spark = split.sparkSession
    asked = terms.toPandas()  # VOCABULARY terms and QUERIES queries at most
    words, term_of = np.unique(asked["term"].to_numpy(dtype=object).astype(str), return_inverse=True) if len(asked) else (np.zeros(0, str), np.zeros(0, int))
    qids = sorted(set(asked["qid"].tolist()))
    query_of = np.searchsorted(np.array(qids), asked["qid"].to_numpy()) if qids else np.zeros(0, int)
    vocabulary = words.tolist()

    def frequencies(batches):
        df = np.zeros(len(vocabulary), np.int64)
        n = length = 0
        known = pa.array(vocabulary, pa.string())
        for b in batches:
            _, term, _ = _counted(b.column(0), known)
            df += np.bincount(term, minlength=len(df))
            n, length = n + b.num_rows, length + len(b.column(0).flatten())
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(df), [-1, -2])), pa.array(np.append(df[df > 0], [n, length]))], ["term", "n"])

    got = {r["term"]: r["n"] for r in split.select("w").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, mean = got.get(-1, 0), got.get(-2, 0) / max(1, got.get(-1, 0))
    df = np.array([got.get(i, 0) for i in range(len(vocabulary))], float)
    held = spark.sparkContext.broadcast((vocabulary, np.log(1 + (n - df + 0.5) / (df + 0.5)), term_of, query_of, qids, mean))
    kind = terms.schema["qid"].dataType
    schema = T.StructType([T.StructField("qid", kind), split.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def scores(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        vocabulary, idf, term_of, query_of, qids, mean = held.value
        known, types = pa.array(vocabulary, pa.string()), [to_arrow_type(f.dataType) for f in schema]
        order = np.argsort(term_of, kind="stable")
        first = np.searchsorted(term_of[order], np.arange(len(vocabulary) + 1))
        for whole in batches:
            step = max(1, CELLS // max(1, len(qids)))
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                doc, term, tf = _counted(pa.array(b.column(0)), known)
                dl = b.column(1).to_numpy().astype(float)
                part = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / (mean or 1)))
                # every query that has the term, for each place of the term
                many = first[term + 1] - first[term]
                place = np.repeat(first[term] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))
                flat = query_of[order[place]] * b.num_rows + np.repeat(doc, many)
                out = np.bincount(flat, weights=np.repeat(part, many), minlength=len(qids) * b.num_rows).reshape(len(qids), b.num_rows)
                out = np.where(out > 0, np.floor(out * boost * 1e4 + 0.5) / 1e4, 0)
                ids = b.column(2)
                if k < b.num_rows:
                    # those at least as good as the k-th best, with all that tie with it
                    out = np.where(out >= np.partition(out, -k, axis=1)[:, -k, None], out, 0)
                q, d = np.nonzero(out)
                yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in q.tolist()], types[0]), ids.take(pa.array(d)), pa.array(out[q, d])], ["qid", "doc_id", "score"])

    return ranked(split.select("w", "dl", "doc_id").mapInArrow(scores, schema), k)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def best_field(docs: DataFrame, queries: DataFrame, fields: dict[str, float], k: int = 10) -> DataFrame:
    """The best of the fields' boosted scores, as a multi-field query."""
    # whoever is among the best k by some field's score is among the best k of that field
    parts = [bm25(docs.select("doc_id", F.col(f).alias("text")), queries, k, b).select("qid", "doc_id", "score") for f, b in fields.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ranked(out.groupBy("qid", "doc_id").agg(F.max("score").alias("score")), k)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, queries: DataFrame, size: int = 8, keep: Column | None = None) -> DataFrame:
    """(qid, doc_id, score, rank): the 2 * size nearest of vectors (doc_id, vector) for queries (qid, vector), then the filter, then size.

    Exact: a stated set of up to QUERIES queries against all rows, in blocks, of
    which each task keeps the best; more queries are joined with the rows.
    """
    few = queries.select("qid", "vector").where("vector is not null").limit(QUERIES + 1).collect()
    others = [c for c in vectors.columns if c != "vector"]
    if len(few) > QUERIES:
        score = F.round(inner_product(F.col("__q"), F.col("vector")), 5).alias("score")
        found = vectors.join(queries.select("qid", F.col("vector").alias("__q"))).select("qid", *others, score)
    else:
        found = _nearest_in_blocks(vectors.where("vector is not null").select("vector", *others), few, queries.schema["qid"], 2 * size)
    hits = ranked(found, 2 * size)
    if keep is not None:
        hits = hits.where(keep)
    return ranked(hits.drop("rank"), size)


def _nearest_in_blocks(vectors: DataFrame, few: list, qid: T.StructField, size: int) -> DataFrame:
    schema = T.StructType([qid, *vectors.schema.fields[1:], T.StructField("score", T.DoubleType())])
    held = vectors.sparkSession.sparkContext.broadcast(([r["qid"] for r in few], np.array([r["vector"] for r in few], float)))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        ids, asked = held.value
        kind = to_arrow_type(qid.dataType)
        if not ids:
            return
        for whole in batches:
            step = max(1, CELLS // len(ids))
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                rows = np.array(b.column(0).to_pylist(), float).reshape(b.num_rows, -1)
                score = asked @ rows.T * 1e5
                score = np.sign(score) * np.floor(np.abs(score) + 0.5) / 1e5
                least = np.partition(score, -size, axis=1)[:, -size, None] if size < b.num_rows else score.min(1, keepdims=True)
                q, d = np.nonzero(score >= least)  # ties stay, the window decides
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q.tolist()], kind), *[c.take(pa.array(d)) for c in b.columns[1:]], pa.array(score[q, d])], schema.names)

    return vectors.mapInArrow(run, schema)


def fused(hits: DataFrame, cap: int = 20) -> DataFrame:
    """One version a partition from lexical and vector hits.

    Hits: qid, pos, partition_id, number, code, status, start, end, from, to
    (the question's window as numbers, far ends open). A partition's best hit
    contains the window's middle (if both ends are closed), begins last, came
    first; it stands at the place of the partition's first hit. Hits in force
    win if there are any; then the first of each number and code stays.
    """
    closed = (F.col("from") > 19000101) & (F.col("to") < 99991230)
    middle = F.floor((F.col("from") + F.col("to")) / 2)
    holds = F.coalesce(closed & (F.col("start") <= middle) & (F.col("end") >= middle), F.lit(False)).cast("int")
    own = Window.partitionBy("qid", "partition_id")
    x = hits.where("partition_id is not null").withColumn("place", F.min("pos").over(own))
    x = x.withColumn("__r", F.row_number().over(own.orderBy(F.desc(holds), F.desc("start"), "pos"))).where("__r = 1")
    any_now = F.max((F.col("status") == "VIGENTE").cast("int")).over(Window.partitionBy("qid"))
    x = x.withColumn("__now", any_now).where("__now = 0 or status = 'VIGENTE'")
    x = x.withColumn("__r", F.row_number().over(Window.partitionBy("qid").orderBy("place"))).where(F.col("__r") <= cap)
    x = x.withColumn("__r", F.row_number().over(Window.partitionBy("qid", "number", "code").orderBy("place"))).where("__r = 1")
    return x.drop("__r", "__now").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("place")).cast("long"))


def coherent(hits: DataFrame, match: Column) -> DataFrame:
    """Hits that match, or all of a question none of whose hits does."""
    return hits.withColumn("__m", match.cast("int")).withColumn("__any", F.max("__m").over(Window.partitionBy("qid"))).where("__any = 0 or __m = 1").drop("__m", "__any")


def reranked(hits: DataFrame, score: Column, top: int = 5) -> DataFrame:
    """By a scorer's value, ties in the order before."""
    w = Window.partitionBy("qid").orderBy(F.desc("__s"), "rank")
    return hits.withColumn("__s", score).withColumn("new_rank", F.row_number().over(w).cast("long")).where(F.col("new_rank") <= top).drop("__s")


def relaxed(levels: Sequence[DataFrame]) -> DataFrame:
    """For each question the hits of the strictest level that has any; level counts from 0."""
    out = None
    for i, x in enumerate(levels):
        x = x.withColumn("level", F.lit(i))
        out = x if out is None else out.unionByName(x)
    return out.withColumn("__least", F.min("level").over(Window.partitionBy("qid"))).where("level = __least").drop("__least")
