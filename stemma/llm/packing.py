"""Best-fit packing by the linear grouping scheme.

Pieces longer than an eighth of a sequence are put into groups of equal
cardinality by length and rounded up to their group's longest. For so few sizes
a linear program over configurations (which sizes fill one sequence) is solved
by column generation, with a knapsack to price them. Its whole multiples become
sequences, actual documents take the places of their group's size, and what is
left, with all small pieces, goes best-fit, longest first, into the room left.

Where best fit alone, longest first, needs fewer sequences, its answer is taken.

Each task packs its own documents, in blocks of at most ``BLOCK`` tokens, so
memory is bounded and texts aren't shuffled. Sequences with little room left
stay; the pieces of the ``OPEN`` with the most room of each block go on to
rounds of ever fewer tasks (a block's worth of pieces each) until one group is
left, so the number of sequences hardly depends on how the table is split. Each
round is written before the next reads it, so a task that is lost later changes
nothing.

Defined results: a null or empty text is one piece of one token (the end id);
null ids and repeated rows are packed like any other; an empty table gives no
pieces; no token is dropped or changed.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm import tokens
from stemma.llm.common import BATCH_ROWS, col, shared_table, sliced

LENGTH = 2048
#: Tokens that a task packs at once, and sequences of these that are packed again with those of others.
BLOCK, OPEN = 1 << 24, 16
GROUPS = 32


class Room:
    """Open sequences by the room left in them."""

    def __init__(self, most: int):
        self.at: list[list[int]] = [[] for _ in range(most + 1)]
        self.open = 0  # bit r is set if a sequence with room r exists

    def add(self, bin_: int, room: int) -> None:
        self.at[room].append(bin_)
        self.open |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        """The sequence with the least room that holds the size."""
        fit = self.open >> size
        if not fit:
            return None
        room = size + (fit & -fit).bit_length() - 1
        bin_ = self.at[room].pop()
        if not self.at[room]:
            self.open &= ~(1 << room)
        return bin_, room


def best_fit(sizes: np.ndarray, order: np.ndarray, bins: np.ndarray, used: list[int], most: int) -> None:
    """Put the pieces in this order into the sequences, opening new ones as needed."""
    room = Room(most)
    for b, u in enumerate(used):
        room.add(b, most - u)
    for i in order.tolist():
        size = int(sizes[i])
        got = room.take(size)
        if got is None:
            got = len(used), most
            used.append(0)
        b, r = got
        bins[i] = b
        used[b] += size
        room.add(b, r - size)


def best_pattern(sizes: np.ndarray, worth: np.ndarray, most: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within ``most`` that is worth most (unbounded knapsack)."""
    value = np.zeros(most + 1)
    pick = np.full(most + 1, -1)
    for g, s in enumerate(sizes.tolist()):
        w = worth[g]
        if w <= 1e-12:
            continue
        for at in range(s, most + 1, s):
            to = min(at + s, most + 1)
            new = value[at - s : to - s] + w
            better = new > value[at:to] + 1e-12
            value[at:to] = np.where(better, new, value[at:to])
            pick[at:to] = np.where(better, g, pick[at:to])
    out = np.zeros(len(sizes), np.int64)
    # a later size may have bettered an entry that an earlier one built on, so trace by value
    at = int(value.argmax())
    while at > 0 and pick[at] >= 0:
        g = pick[at]
        out[g] += 1
        at -= int(sizes[g])
    return float(out @ worth), out


def configurations(sizes: np.ndarray, counts: np.ndarray, most: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each, with the fewest sequences in all (fractional).

    After so many rounds the patterns at hand are taken: still a packing of all pieces, if not the least.
    """
    g = len(sizes)
    per = np.minimum(most // sizes, np.maximum(counts, 1))
    basis = np.diag(per).astype(float)
    x = counts / per
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(g))
        worth, pattern = best_pattern(sizes, dual, most)
        if worth <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, pattern.astype(float))
        able = step > 1e-9
        if not able.any():
            break
        ratio = np.where(able, x / np.where(able, step, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[:, out] = pattern
    return [(np.rint(basis[:, j]).astype(np.int64), float(x[j])) for j in range(g)]


class Pieces:
    """The pieces still to be placed, by size."""

    def __init__(self, sizes: np.ndarray, order: np.ndarray, most: int):
        self.at: list[list[int]] = [[] for _ in range(most + 1)]
        self.there = 0
        for i in order[::-1].tolist():
            self.at[int(sizes[i])].append(i)
            self.there |= 1 << int(sizes[i])

    def take(self, most: int, least: int = 1) -> int | None:
        """The longest piece of at most and at least these sizes."""
        size = (self.there & ((2 << most) - 1)).bit_length() - 1
        if size < least:
            return None
        i = self.at[size].pop()
        if not self.at[size]:
            self.there ^= 1 << size
        return i


def linear_grouping(sizes: np.ndarray, most: int, groups: int = GROUPS) -> np.ndarray:
    """The sequence of each piece."""
    bins = np.full(len(sizes), -1, np.int64)
    used: list[int] = []
    down = np.argsort(-sizes, kind="stable")
    large = down[sizes[down] > most // 8]
    if len(large):
        each = -(-len(large) // groups)
        tops, counts = np.unique([sizes[large[i // each * each]] for i in range(len(large))], return_counts=True)
        left = Pieces(sizes, large, most)
        found = [(np.repeat(tops, n)[::-1].tolist(), int(times + 1e-6)) for n, times in configurations(tops, counts, most)]
        for slots, times in sorted(found, reverse=True):
            for _ in range(times if slots else 0):
                own: list[int] = []
                total = 0
                # each place takes a document of its group or below; the last the longest that really fits
                for k, top in enumerate(slots):
                    i = left.take(most - total if 0 < k == len(slots) - 1 else min(top, most - total))
                    if i is None:
                        break
                    own.append(i)
                    total += int(sizes[i])
                while own and (i := left.take(most - total)) is not None:
                    own.append(i)
                    total += int(sizes[i])
                if own:
                    bins[own] = len(used)
                    used.append(total)
    rest = down[bins[down] < 0]
    best_fit(sizes, rest, bins, used, most)
    plain, fewer = np.empty(len(sizes), np.int64), []
    best_fit(sizes, down, plain, fewer, most)
    return plain if len(fewer) < len(used) else bins


def places(sizes: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Each piece's offset in its sequence, in the order given."""
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(sizes[order])
    new = np.concatenate(([True], np.diff(bins[order]) != 0)) if len(order) else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(new, ends - sizes[order], 0)) if len(order) else ends
    out = np.empty(len(sizes), np.int64)
    out[order] = ends - sizes[order] - base
    return out


def to_open(sizes: np.ndarray, bins: np.ndarray, most: int) -> np.ndarray:
    """Which pieces lie in sequences that are packed again: the OPEN with the most room, of those with over a 128th left."""
    room = most - np.bincount(bins, weights=sizes).astype(np.int64)
    again = np.argsort(-room, kind="stable")[:OPEN]
    return np.isin(bins, again[room[again] > most // 128])


#: doc_id, piece, start and length of pieces, and what is kept of their ids.
Piece = tuple[object, int, int, int, object]


def cut_pieces(batches: Iterator[pa.RecordBatch], path: str, most: int, keep: Callable[[bytes], object]) -> Iterator[Piece]:
    """The pieces of batches of (id, text); ``keep`` is given their ids, little-endian 32-bit."""
    enc = tokens.encoder(path)
    for batch in sliced(batches):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = tokens.document(enc, text).astype("<u4")
            for k, (a, b) in enumerate(tokens.cuts(len(ids), most)):
                yield doc, k, a, b - a, keep(ids[a:b].tobytes())


def read_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    for batch in sliced(batches):
        yield from zip(*[c.to_pylist() for c in batch.columns])


def packed_blocks(pieces: Iterator[Piece], most: int, block: int, packer: Callable[[np.ndarray, int], np.ndarray], round_: int, last: bool):
    """(pieces' columns, sizes, sequences, open) of each block of a task's pieces; sequences are unique among all tasks and rounds."""
    from pyspark import TaskContext

    sequence = round_ << 58 | TaskContext.get().partitionId() << 36
    held: list[Piece] = []
    n = 0

    def flush():
        nonlocal sequence, held, n
        columns = [list(c) for c in zip(*held)]
        sizes = np.array(columns[3], np.int64)
        bins = packer(sizes, most)
        out = columns, sizes, bins + sequence, np.zeros(len(bins), bool) if last else to_open(sizes, bins, most)
        sequence += int(bins.max()) + 1
        held, n = [], 0
        return out

    for p in pieces:
        held.append(p)
        n += p[3]
        if n >= block:
            yield flush()
    if held:
        yield flush()


def in_rounds(packed: Callable[[DataFrame, int, bool], DataFrame], first: DataFrame, pieces: Callable[[DataFrame], DataFrame], block: int) -> DataFrame:
    """All rows of ``packed`` (texts in round 0, then pieces; whether it is the last round) that aren't open, round by round."""
    now, done, round_, before = shared_table(packed(first, 0, False), "zstd"), [], 0, float("inf")
    while True:
        done.append(now.where("not open").drop("open"))
        left = pieces(now.where("open"))
        n = left.agg(F.sum("length")).first()[0] or 0
        if not n:
            break
        groups, round_ = -(-n // block), round_ + 1
        now = shared_table(packed(left.repartition(groups), round_, groups == 1 or groups >= before), "zstd")
        before = groups
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(col("doc_id"), F.coalesce(col("text"), F.lit("")).alias("text"))


def pack(
    docs: DataFrame, path: str | None = None, most: int = LENGTH, block: int = BLOCK, packer: Callable[[np.ndarray, int], np.ndarray] = linear_grouping, digest: bool = False
) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids (little-endian 32-bit), sequence_id, offset; ``digest``: ids_crc32 in place of ids."""
    path = path or tokens.public_path()
    src = id_and_text(docs)
    kind = src.schema["doc_id"]
    ids = T.StructField("ids_crc32", T.LongType()) if digest else T.StructField("ids", T.BinaryType())
    own = [kind, T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), ids]
    schema = T.StructType([*own, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("open", T.BooleanType())])

    def packed(rows: DataFrame, round_: int, last: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            types = [to_arrow_type(f.dataType) for f in own]
            found = read_pieces(batches) if round_ else cut_pieces(batches, path, most, zlib.crc32 if digest else bytes)
            for columns, sizes, bins, still in packed_blocks(found, most, block, packer, round_, last):
                offsets = places(sizes, bins)
                for at in range(0, len(sizes), 4 * BATCH_ROWS):
                    to = at + 4 * BATCH_ROWS
                    yield pa.RecordBatch.from_arrays([*[pa.array(c[at:to], t) for c, t in zip(columns, types)], pa.array(bins[at:to]), pa.array(offsets[at:to]), pa.array(still[at:to])], schema.names)

        return rows.mapInArrow(run, schema)

    return in_rounds(packed, src, lambda rows: rows.select([f.name for f in own]), block)
