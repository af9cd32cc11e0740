"""Quality classifier: random-indexing word vectors and a small numpy network.

Every word (letters, digits or signs in a row) is three symbols: the word itself
with its case folded, its shape (kind, case and length), and whether it repeats
the word before it. Each symbol has a sparse random index vector; its vector is
that index vector and, of unit length, the sum of the index vectors of the
symbols of its sort around it in the training texts. A document is the mean of
its words' vectors and nothing else. A network with one hidden layer gives a
logit, divided by a temperature that is fitted on a tenth of the training rows
kept apart.

Defined results: null and empty texts get the score of a document without
words; null ids are scored and never trained on; without labels every score is
0.5; repeated rows score alike, and rows of one id are one training text, the
smallest; very long texts are scored whole, in parts.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm.common import held_out, map_rows, text_bytes
from stemma.llm.words import run_hashes, runs

#: Bound of the training sample: labelled rows, and the first bytes of a text (64 MB in all).
ROWS, BYTES_A_DOC = 8000, 1 << 13
#: Word forms (by hash), shapes, numbers of a vector, words around that count, hidden units.
BUCKETS, SHAPES, SIZE, NEAR, HIDDEN = 1 << 16, 24, 96, 2, 32
SYMBOLS = BUCKETS + SHAPES + 2
#: Words whose vectors are summed at once.
PART = 4096
THRESHOLD = 0.3
SEED = 7

_KIND = np.full(256, 3, np.uint8)
_KIND[list(b"\t\n\v\f\r ")] = 0
_KIND[[b for b in range(256) if chr(b).isascii() and chr(b).isalpha() or b > 127]] = 1
_KIND[list(b"0123456789")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def symbols(data: bytes) -> np.ndarray:
    """The symbols of each word of a text: form, shape, and repeat; a row for each sort."""
    raw = np.frombuffer(data, np.uint8)
    kinds = _KIND[raw]
    starts = runs(kinds)
    if not len(starts):
        return np.zeros((3, 0), np.int64)
    kind, n = kinds[starts].astype(np.int64), np.diff(np.append(starts, len(raw)))
    caps = np.add.reduceat(((raw >= 65) & (raw <= 90)).astype(np.int64), starts)
    shape = np.where(kind == 1, np.minimum(caps, 2), 3) * 6 + np.searchsorted([2, 3, 5, 8, 12], n, "right")
    ink = kind > 0
    forms = (run_hashes(_LOWER[raw], starts)[ink] % np.uint64(BUCKETS)).astype(np.int64)
    same = np.concatenate(([False], forms[1:] == forms[:-1]))[: len(forms)]
    return np.stack((forms, BUCKETS + shape[ink], BUCKETS + SHAPES + same))


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    out = np.zeros((SYMBOLS, SIZE), np.float32)
    place = rng.integers(0, SIZE, (SYMBOLS, 4))
    sign = rng.choice(np.float32([-0.5, 0.5]), (SYMBOLS, 4))
    for k in range(4):
        out[np.arange(SYMBOLS), place[:, k]] += sign[:, k]
    return out


def symbol_vectors(texts: Iterable[np.ndarray]) -> np.ndarray:
    """Random indexing over the texts' symbols."""
    index = index_vectors()
    around = np.zeros_like(index)
    for ids in (sort for t in texts for sort in t):
        for gap in range(1, NEAR + 1):
            for a, b in ((ids[:-gap], ids[gap:]), (ids[gap:], ids[:-gap])):
                if not len(a):
                    continue
                order = np.argsort(a, kind="stable")
                first = runs(a[order])
                around[a[order][first]] += np.add.reduceat(index[b[order]], first, axis=0)
    norm = np.linalg.norm(around, axis=1, keepdims=True)
    around /= np.where(norm > 0, norm, 1)
    around += index
    return around


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits(self.layers, (x - self.mean) / self.spread) / self.temperature, -30, 30)))


def pooled(vectors: np.ndarray, data: bytes) -> np.ndarray:
    """The mean of the vectors of a text's words."""
    ids = symbols(data)
    n = ids.shape[1]
    out = np.zeros(SIZE)
    for at in range(0, n, PART):
        few, many = np.unique(ids[:, at : at + PART], return_counts=True)
        out += many @ vectors[few].astype(np.float64)
    return out / max(n, 1)


def logits(layers: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.maximum(x @ w1 + b1, 0) @ w2 + b2


def fit_network(x: np.ndarray, y: np.ndarray, rounds: int = 60, batch: int = 64, rate: float = 3e-3, decay: float = 1e-3) -> list[np.ndarray]:
    """Adam on the cross-entropy of a two-layer network."""
    rng = np.random.default_rng(SEED)
    d = x.shape[1]
    w = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(())]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            i = order[at : at + batch]
            h = np.maximum(x[i] @ w[0] + w[1], 0)
            g = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - y[i]) / len(i)
            back = np.outer(g, w[2]) * (h > 0)
            grads = [x[i].T @ back + decay * w[0], back.sum(0), h.T @ g + decay * w[2], g.sum()]
            step += 1
            for k, gk in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The one of a grid of temperatures with the least cross-entropy."""
    grid = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
    return float(min(grid, key=lambda t: np.logaddexp(0, np.where(y > 0, -z, z) / t).mean()))


def train(texts: list[bytes], labels: np.ndarray) -> Model:
    y = np.asarray(labels, np.float64)
    if not len(y):
        return Model(index_vectors(), np.zeros(SIZE), np.ones(SIZE), [np.zeros((SIZE, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(())])
    vectors = symbol_vectors(symbols(t) for t in texts)
    x = np.array([pooled(vectors, t) for t in texts])
    mean, spread = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / spread
    apart = np.arange(len(y)) % 10 == 0
    layers = fit_network(x[~apart], y[~apart]) if (~apart).any() else fit_network(x, y)
    return Model(vectors, mean, spread, layers, temperature(logits(layers, x[apart]), y[apart]))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on at most ROWS labelled documents outside the held-out fold, by the hash of their ids; of each text its first BYTES_A_DOC bytes."""
    rows = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    few = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(ROWS).collect()
    if not few:
        return train([], np.zeros(0))
    y = {r["doc_id"]: r["quality"] for r in few}
    ids = docs.sparkSession.createDataFrame([(k,) for k in y], T.StructType([T.StructField("doc_id", labels.schema["doc_id"].dataType)]))
    mine = docs.select("doc_id", F.substring(text_bytes(), 1, BYTES_A_DOC).alias("t"))
    got = mine.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("t").alias("t")).orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator()
    texts, good = [], []
    for r in got:
        texts.append(bytes(r["t"]))
        good.append(y[r["doc_id"]])
    return train(texts, np.array(good))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Add ``score`` and ``predicted``; ``where`` names a flag (predicted 1) that filters instead."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def fn(texts: pa.Array):
            s = m.score(np.array([pooled(m.vectors, t) for t in texts.to_pylist()]))
            good = s >= THRESHOLD
            return (good,) if where else (s, good.astype(np.int32))

        return fn

    out = [T.StructField(where, T.BooleanType())] if where else [T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)]
    return map_rows(docs, {"text": text_bytes()}, out, make, keep, where)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    return score(docs, fit(docs, labels), ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted to be good."""
    return score(docs, fit(docs, labels), docs.columns, "__good")
