"""Language identification by prediction by partial matching (PPM).

A tree of byte contexts of orders 0 to 3 is counted for each language, over all
256 bytes (A-Z count as a-z). A byte's probability comes from the longest context
that the language knows, by escape method C with exclusion: a context with T
bytes of D kinds gives n / (T + D) to a byte seen n times and hands D / (T + D)
to the next shorter context, over the bytes it hasn't seen itself. The counts
are frozen, so a byte's code length only depends on it and the three before. The
tree is sparse: what stands in it is looked up, and for any other byte the code
lengths of the escapes are added to that of the shorter context. A text's code
length in each language is the sum over all its bytes, in double precision.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
of equal code lengths the language first in the alphabet wins; without any
labelled document all are ``und``; null ids are predicted and never trained on;
repeated rows are predicted alike, and rows of one id and language are one
training text, the smallest; very long texts are read whole, in parts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm.common import col, held_out, map_rows

ORDER = 3
#: Bound of the training sample: documents of each language, bytes of a document, bytes of all languages (in equal parts), and
#: languages, of which there are fewer in ISO 639-3.
DOCS_A_LANGUAGE, BYTES_A_DOC, TRAIN_BYTES, LANGUAGES = 400, 1 << 16, 1 << 23, 8192
#: Languages whose trees are looked up together, and bytes of a text at once.
GROUP, PART = 8, 1 << 16
UNKNOWN = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32


def has_letter(data: bytes) -> bool:
    return bool(_ASCII_LETTER.search(data)) or any(map(str.isalpha, data.decode("utf-8", "replace")))


def grams(data: bytes) -> np.ndarray:
    """Each byte with the three before it (spaces before the first) as one number, the byte last."""
    s = np.concatenate((np.full(ORDER, 32, np.uint32), _FOLD[np.frombuffer(data, np.uint8)]))
    return s[:-3] << 24 | s[1:-2] << 16 | s[2:-1] << 8 | s[3:]


def mixed(counts: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of contexts' bytes (rows) from their counts and those of the shorter contexts; and the bits that an escape adds."""
    seen = counts > 0
    total, kinds = counts.sum(1, keepdims=True), seen.sum(1, keepdims=True)
    left = np.where(seen, 0, shorter).sum(1, keepdims=True)
    escape = np.where(left > 0, kinds, 0)
    handed = np.where(total > 0, escape / np.where(left > 0, left, 1) / np.maximum(total + escape, 1), 1.0)
    p = np.where(seen, counts / np.maximum(total + escape, 1), handed * shorter)
    return p, -np.log2(np.where(handed > 0, handed, 1.0))[:, 0]


class Index:
    """Rows of distinct 32-bit keys, by hash tables each of which holds what found no place in the one before."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint32(0))
        self.tables: list[tuple[np.uint32, np.uint32, np.ndarray]] = []
        left, factor = np.arange(len(keys), dtype=np.int32), 0x9E3779B1
        while len(left) or not self.tables:
            bits = max(4, int(len(left)).bit_length() + 2)
            table = np.full(1 << bits, -1, np.int32)
            shift = np.uint32(32 - bits)
            at = keys[left] * np.uint32(factor) >> shift
            table[at[::-1]] = left[::-1]
            self.tables.append((np.uint32(factor), shift, table))
            left, factor = left[table[at] != left], (factor * 0x85EBCA6B + 2) & 0xFFFFFFFF | 1

    def find(self, asked: np.ndarray) -> np.ndarray:
        """The row of each key asked for, -1 if it isn't there."""
        factor, shift, table = self.tables[0]
        out = table[asked * factor >> shift]
        # an empty place says that the key is in no later table either
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != asked))
        for factor, shift, table in self.tables[1:]:
            if not len(todo):
                return out
            own = asked[todo]
            out[todo] = got = table[own * factor >> shift]
            todo = todo[(got >= 0) & (self.keys[got] != own)]
        out[todo] = -1
        return out


class Tree:
    """One language's contexts: code lengths of what was seen, and of the escapes."""

    def __init__(self, texts: list[bytes], step: int = 1 << 12):
        g = np.concatenate([grams(t) for t in texts if t] or [np.zeros(0, np.uint32)])
        first, _ = mixed(np.bincount(g & 0xFF, minlength=1 << 8)[None], np.full((1, 256), 1 / 256))
        second, _ = mixed(np.bincount(g & 0xFFFF, minlength=1 << 16).reshape(256, 256), np.tile(first, (256, 1)))
        self.second = -np.log2(second).reshape(-1)
        self.third, self.third_bits, contexts, escapes, rows = self._order(g & 0xFFFFFF, lambda c: second[c & 0xFF], step, keep=True)
        self.escape2 = np.zeros(1 << 16)
        self.escape2[contexts] = escapes
        row_of = np.zeros(1 << 16, np.int64)
        row_of[contexts] = np.arange(len(contexts))
        self.fourth, self.fourth_bits, self.contexts, self.escape3, _ = self._order(g, lambda c: rows[row_of[c & 0xFFFF]], step)

    @staticmethod
    def _order(g: np.ndarray, shorter, step: int, keep: bool = False):
        keys, n = np.unique(g, return_counts=True)
        contexts, first = np.unique(keys >> 8, return_index=True)
        ends = np.append(first[1:], len(keys))
        bits, escapes, rows = np.zeros(len(keys)), np.zeros(len(contexts)), []
        for at in range(0, len(contexts), step):
            own = slice(first[at], ends[min(at + step, len(contexts)) - 1])
            row = np.searchsorted(contexts[at : at + step], keys[own] >> 8)
            counts = np.zeros((len(contexts[at : at + step]), 256))
            counts[row, keys[own] & 0xFF] = n[own]
            p, escapes[at : at + step] = mixed(counts, shorter(contexts[at : at + step]))
            bits[own] = -np.log2(p[row, keys[own] & 0xFF])
            if keep:
                rows.append(p)
        return keys, bits, contexts, escapes, np.concatenate(rows) if rows else np.zeros((1, 256))

    def bits2(self, g: np.ndarray) -> np.ndarray:
        """Code lengths of bytes behind two others (24-bit numbers)."""
        at, there = _placed(self.third, g)
        return np.where(there, self.third_bits[at] if len(self.third) else 0, self.escape2[g >> 8] + self.second[g & 0xFFFF])

    def bits3(self, g: np.ndarray) -> np.ndarray:
        at, there = _placed(self.fourth, g)
        return np.where(there, self.fourth_bits[at] if len(self.fourth) else 0, self.escaped(g >> 8) + self.bits2(g & 0xFFFFFF))

    def escaped(self, context: np.ndarray) -> np.ndarray:
        """What an escape from a context of three bytes adds; nothing if the language doesn't know it."""
        at, there = _placed(self.contexts, context)
        return np.where(there, self.escape3[at] if len(self.contexts) else 0, 0.0)


def _placed(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
    return at, (keys[at] == asked) if len(keys) else np.zeros(len(asked), bool)


class Forest:
    """The trees of up to GROUP languages, looked up together: a row of code lengths, one for each language."""

    def __init__(self, trees: list[Tree]):
        fourth = np.unique(np.concatenate([t.fourth for t in trees]))
        third = np.unique(np.concatenate([x for t in trees for x in (t.third, t.contexts)]))
        self.fourth, self.third = Index(fourth), Index(third)
        side = lambda f: np.stack([f(t) for t in trees], 1)
        self.bits3, self.bits2, self.escape3 = side(lambda t: t.bits3(fourth)), side(lambda t: t.bits2(third)), side(lambda t: t.escaped(third))
        self.escape2, self.bits1 = side(lambda t: t.escape2), side(lambda t: t.second)

    def bits(self, g: np.ndarray) -> np.ndarray:
        at = self.fourth.find(g)
        rest = g[at < 0]
        out = self.bits3[at[at >= 0]].sum(0)
        if len(rest):
            context = self.third.find(rest >> 8)
            out += self.escape3[context[context >= 0]].sum(0)
            rest &= np.uint32(0xFFFFFF)
            at = self.third.find(rest)
            out += self.bits2[at[at >= 0]].sum(0)
            rest = rest[at < 0]
            out += self.escape2[rest >> 8].sum(0) + self.bits1[rest & 0xFFFF].sum(0)
        return out


@dataclass
class Model:
    languages: list[str]
    forests: list[Forest]

    def code_lengths(self, data: bytes) -> np.ndarray:
        """Bits that the text takes in each language."""
        g = grams(data)
        out = np.zeros(len(self.languages))
        for at in range(0, len(g), PART):
            out += np.concatenate([f.bits(g[at : at + PART]) for f in self.forests])
        return out

    def predict(self, data: bytes) -> tuple[str, float]:
        if not self.languages or not has_letter(data):
            return UNKNOWN, 0.0
        bits = self.code_lengths(data)
        best = int(bits.argmin())
        return self.languages[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())


def train(texts: dict[str, list[bytes]]) -> Model:
    languages = sorted(texts)
    return Model(languages, [Forest([Tree(texts[x]) for x in languages[at : at + GROUP]]) for at in range(0, len(languages), GROUP)])


def fit(docs: DataFrame) -> Model:
    """Train on a bounded sample of the documents outside the held-out fold that have a language.

    Of each of the LANGUAGES most frequent languages, by the hash of their ids, at
    most DOCS_A_LANGUAGE documents with text, up to its part of TRAIN_BYTES; of
    each text its first BYTES_A_DOC bytes (or that part).
    """
    spark = docs.sparkSession
    size = F.octet_length("text").cast("long")
    rows = docs.where("doc_id is not null and lang is not null and text <> ''").where(~held_out()).select("doc_id", "lang", size.alias("size"))
    top = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not top:
        return train({})
    part = TRAIN_BYTES // len(top)
    most = min(BYTES_A_DOC, part)
    # a first cut by hash to some eight times the sample, so that no task gathers a large language's ids
    shares = F.broadcast(spark.createDataFrame([(r["lang"], min(1.0, 8 * DOCS_A_LANGUAGE / r["count"])) for r in top], "lang string, share double"))
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / float(1 << 53)
    by = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = rows.join(shares, "lang").where(drawn <= F.col("share"))
    first = few.withColumn("n", F.row_number().over(by)).where(F.col("n") <= DOCS_A_LANGUAGE)
    before = F.sum(F.least("size", F.lit(most))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    picked = first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < part).select("doc_id", "lang")
    ids = [(r["doc_id"], r["lang"]) for r in picked.distinct().collect()]  # TRAIN_BYTES or LANGUAGES * DOCS_A_LANGUAGE at most
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang", T.StringType())])
    mine = docs.where("text <> ''").select("doc_id", "lang", F.substring(col("text").cast("binary"), 1, most).alias("t"))
    mine = mine.join(F.broadcast(spark.createDataFrame(ids, schema)), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("t").alias("t"))
    texts: dict[str, list[bytes]] = {}
    for r in mine.orderBy("lang", "doc_id").collect():  # twice TRAIN_BYTES at most
        texts.setdefault(r["lang"], []).append(bytes(r["t"]))
    return train(texts)


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, where: str | None = None, least: float = 0.0) -> DataFrame:
    """Add ``lang_pred`` and ``score``; ``where`` names a flag (known language, score of at least ``least``) that filters instead."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def fn(texts: pa.Array):
            got = [(UNKNOWN, 0.0) if t is None else m.predict(t) for t in texts.to_pylist()]
            langs, scores = [g[0] for g in got], [g[1] for g in got]
            ok = [a != UNKNOWN and b >= least for a, b in got]
            return (ok,) if where else (langs, scores)

        return fn

    out = [T.StructField(where, T.BooleanType())] if where else [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)]
    return map_rows(docs, {"text": col("text").cast("binary")}, out, make, keep, where)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, by a model fitted on the others' fold."""
    return predict(docs, fit(docs), ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is recognised with a posterior of at least ``least``."""
    return predict(docs, fit(docs), docs.columns, "__known", least)
