"""SimHash near-duplicates by a Gray-order hierarchical index.

Distinct fingerprints are spread over the four 16-bit blocks that a radius of 3
leaves at least one of unchanged; a bucket with more than ``BUCKET`` of them is
spread again over four blocks of its remaining bits, and so on, so no task holds
an unbounded bucket and no link is lost. Within a bucket the fingerprints stand
in Gray rank order; nodes above them hold the bits that all below share, and a
search adds up the differing bits on its way down and drops whole groups once
the sum passes the radius.

Defined results: null and empty texts have fingerprint 0 and link like any
other; repeated rows and equal fingerprints fall together before the search; a
null id stays in the result, its component is its fingerprint's (null if no
document with an id is in its group); an empty table gives no rows;
further input columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm.common import col, connected_components, map_rows, shared_checkpoint, text_bytes

#: Block widths by level; each level has four blocks of what the levels above left of 64 bits.
LEVELS = (16, 12, 9, 6)
#: Fingerprints in a bucket beyond which it is spread again.
BUCKET = 1 << 15
#: Children of a node.
FAN = 16
#: Search pairs held at a time.
FRONT = 1 << 20


def shingle_hashes(data: bytes, size: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of each word shingle of the lower-cased bytes, repeats included."""
    words = data.lower().split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends]]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], seed) for s, e in zip(starts, ends[size - 1 :], strict=False)]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """One 64-bit fingerprint for each list of hashes: the bits that over half of them set."""
    out = np.zeros(len(hashes), np.uint64)
    counts = np.array([len(h) for h in hashes], np.int64)
    full = np.flatnonzero(counts)
    if not full.size:
        return out
    every = np.fromiter((x for h in hashes for x in h), np.uint64, int(counts.sum()))
    starts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
    lane = 16 if counts.max() < 1 << 16 else 32
    unit = np.uint64(sum(1 << k for k in range(0, 64, lane)))
    result = np.zeros(full.size, np.uint64)
    for k in range(lane):
        sums = np.add.reduceat((every >> np.uint64(k)) & unit, starts)
        for j in range(0, 64, lane):
            on = ((sums >> np.uint64(j)) & np.uint64((1 << lane) - 1)).astype(np.int64) * 2 > counts[full]
            result |= on.astype(np.uint64) << np.uint64(j + k)
    out[full] = result
    return out


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", size: int = 3, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """The documents with their SimHash as a 64-bit integer."""

    def make():
        def fn(texts: pa.Array):
            return (majority([shingle_hashes(t, size, seed) for t in texts.to_pylist()]).view(np.int64),)

        return fn

    return map_rows(docs, {"text": text_bytes(text)}, [T.StructField(out, T.LongType(), False)], make, keep=keep)


# ---------------------------------------------------------------- the index


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each pattern in the Gray code's order."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


class GrayIndex:
    """Nodes over buckets of fingerprints; all buckets of a block of rows at once."""

    def __init__(self, keys: np.ndarray, fps: np.ndarray):
        self.order = np.lexsort((gray_rank(fps), keys))
        self.fps = fps[self.order]
        keys = keys[self.order]
        zero = np.zeros(0, np.uint64)
        ones = np.full(len(fps), ~np.uint64(0))
        #: (pattern, shared mask, first child, children, last leaf, bucket); the leaves first
        leaf = np.arange(len(fps))
        self.levels = [(self.fps, ones, leaf, np.ones(len(fps), np.int64), leaf, keys)]
        while len(fps):
            pat, mask, _, _, last, key = self.levels[-1]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            start = np.flatnonzero((np.arange(len(key)) - first) % FAN == 0)
            if len(start) == len(key) and len(self.levels) > 1:
                break
            ands, ors = np.bitwise_and.reduceat(pat & mask, start), np.bitwise_or.reduceat(pat & mask, start)
            shared = np.bitwise_and.reduceat(mask, start) & ~(ands ^ ors)
            width = np.diff(np.append(start, len(key)))
            self.levels.append((ands & shared, shared, start, width, last[start + width - 1], key[start]))
        # bits that a parent has already counted are left out below
        self.own = [zero] * len(self.levels)
        for d in range(len(self.levels) - 1, -1, -1):
            mask = self.levels[d][1]
            if d + 1 < len(self.levels):
                _, above, _, width, _, _ = self.levels[d + 1]
                self.own[d] = mask & ~np.repeat(above, width)
            else:
                self.own[d] = mask
        if len(fps):
            _, _, _, width, _, key = self.levels[-1]
            bucket = np.cumsum(np.concatenate(([True], keys[1:] != keys[:-1]))) - 1
            self.root = bucket
            self.size = np.bincount(bucket)[bucket]

    def _slices(self, n: int):
        """Slices of queries whose searches stay within FRONT pairs."""
        work = np.cumsum(np.maximum(self.size // FAN, FAN))
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + FRONT, "right")))
            yield np.arange(at, to)
            at = to

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each pair of rows (as given) of a bucket within the radius, once, by slices."""
        for q in self._slices(len(self.fps)) if len(self.fps) else ():
            x, y = self._search(q, radius, None)
            yield self.order[x], self.order[y]

    def links(self, radius: int) -> np.ndarray:
        """For each row (as given) the row with the smallest place it is joined to within its bucket."""
        n = len(self.fps)
        label = np.arange(n)
        if not n:
            return label
        for q in self._slices(n):
            label = _merge(label, *self._search(q, radius, label))
        out = np.empty(n, np.int64)
        out[self.order] = self.order[label]
        return out

    def _search(self, q: np.ndarray, radius: int, label: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        top = len(self.levels) - 1
        node = self.root[q]
        acc = np.zeros(len(q), np.int64)
        uniform = None if label is None else self._uniform(label)
        for d in range(top, -1, -1):
            pat, _, first, width, last, _ = self.levels[d]
            acc = acc + np.bitwise_count((self.fps[q] ^ pat[node]) & self.own[d][node])
            live = (acc <= radius) & (last[node] > q)
            if uniform is not None:
                live &= uniform[d][node] != label[q]  # all below are joined to it already
            q, node, acc = q[live], node[live], acc[live]
            if not d:
                return q, node
            n = width[node]
            start = np.repeat(first[node] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
            q, acc, node = np.repeat(q, n), np.repeat(acc, n), start + np.arange(int(n.sum()))
        return q, node

    def _uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """The label that all leaves below a node share, else -1."""
        low = high = label
        out = [label]
        for _, _, start, _, _, _ in self.levels[1:]:
            low, high = np.minimum.reduceat(low, start), np.maximum.reduceat(high, start)
            out.append(np.where(low == high, low, -1))
        return out


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _rest(rest: Column, width: int, p: int) -> Column:
    """The bits without block p of that width."""
    low = rest.bitwiseAND(F.lit((1 << (width * p)) - 1)) if p else F.lit(0).cast("long")
    high = F.shiftleft(F.shiftrightunsigned(rest, width * (p + 1)), width * p) if width * (p + 1) < 64 else F.lit(0).cast("long")
    return high.bitwiseOR(low)


def _spread(rows: DataFrame, level: int) -> DataFrame:
    """A row for each of the four blocks of the bits that are left."""
    width = LEVELS[level]
    blocks = [
        F.struct(
            F.xxhash64(F.lit(level), F.col("key"), F.lit(p), F.shiftrightunsigned("rest", width * p).bitwiseAND(F.lit((1 << width) - 1))).alias("key"),
            _rest(F.col("rest"), width, p).alias("rest"),
        )
        for p in range(4)
    ]
    return rows.withColumn("to", F.explode(F.array(*blocks))).select(*[c for c in rows.columns if c in ("fp", "rep")], F.col("to.key").alias("key"), F.col("to.rest").alias("rest"))


def _bucket_links(radius: int, every: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def out(key, fp, rep):
            index = GrayIndex(key, fp.view(np.uint64))
            if every:
                for x, y in index.pairs(radius):
                    yield pa.RecordBatch.from_arrays([pa.array(rep[x]), pa.array(rep[y])], ["a", "b"])
                return
            to = index.links(radius)
            moved = np.flatnonzero(rep[to] != rep)
            yield pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[to[moved]])], ["a", "b"])

        for batch in batches:
            own = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
            held.append(own if len(own) == 3 else [*own, own[1]])
            rows += batch.num_rows
            if rows >= 1 << 17:
                key, fp, rep = map(np.concatenate, zip(*held))
                cut = int(np.argmax(key == key[-1]))  # the last bucket may go on
                if cut:
                    yield from out(key[:cut], fp[:cut], rep[:cut])
                held, rows = [[x[cut:] for x in (key, fp, rep)]], len(key) - cut
        if rows:
            yield from out(*map(np.concatenate, zip(*held)))

    return run


def fingerprint_links(nodes: DataFrame, radius: int = 3, bucket: int = BUCKET, every: bool = False) -> DataFrame:
    """(a, b): links that join all distinct fingerprints (``fp``) within the radius, directly or over others; by their ``rep`` ids, or themselves if they have none.

    With ``every`` each pair within the radius is a link of its own, once for each block table that has it, either way round.
    """
    if radius > 3:
        raise ValueError("four blocks prove a radius of 3 at most")
    names = [c for c in ("fp", "rep") if c in nodes.columns]
    rows = nodes.where(f"{names[-1]} is not null").select(*names, F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"))
    found: list[DataFrame] = []
    for level in range(len(LEVELS)):
        rows = _spread(rows, level)
        last = level == len(LEVELS) - 1
        large = None if last else shared_checkpoint(rows.groupBy("key").count().where(F.col("count") > bucket).select("key"))
        if large is not None and large.isEmpty():
            last, large = True, None
        here = rows if large is None else rows.join(large, "key", "left_anti")
        found.append(here.select("key", *names).repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links(radius, every), "a long, b long"))
        if last:
            break
        rows = rows.join(large, "key", "left_semi")
    links = found[0]
    for x in found[1:]:
        links = links.unionByName(x)
    return links


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable over links of at most ``radius`` differing bits."""
    return _grouped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], radius, bucket).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, keep: list[str], radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """The kept columns, fp, root (the smallest fingerprint that fp is linked to) and component_id (the smallest id of that group)."""
    prints = shared_checkpoint(with_fingerprints(docs, keep=keep))
    nodes = shared_checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # fingerprints stand for themselves, so that those of rows without an id are links of a chain too
    parts = connected_components(fingerprint_links(nodes.select("fp"), radius, bucket))
    of = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    of = shared_checkpoint(of)
    least = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    return prints.join(of.join(least, "root").select("fp", "root", "component_id"), "fp")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One document of each group stays: the one with the smallest id, of several with that id the one whose row has the smallest hash (documents without an id stay)."""
    plain = [col(f.name) for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    keyed = docs.withColumn("__key", F.xxhash64(*plain))
    first = _grouped(keyed.select("doc_id", "text", "__key"), ["doc_id", "__key"]).where("doc_id = component_id")
    chosen = first.groupBy("root").agg(F.min(F.struct("doc_id", "__key")).alias("s")).select("s.*").distinct()
    kept = keyed.where("doc_id is not null").join(chosen, ["doc_id", "__key"], "left_semi").dropDuplicates(["doc_id", "__key"])
    return kept.select(*[col(c) for c in docs.columns]).unionByName(docs.where("doc_id is null"))
