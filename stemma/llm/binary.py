"""Packed token matrices by best-fit-decreasing with a segment tree.

Pieces, longest first, go to the open sequence with the least room that holds
them, found by a descent in a segment tree over the rooms 0 to the sequence
length. A sequence becomes one row: its ids as a fixed-width little-endian
32-bit row of the id matrix (zeros at the end), the cumulative lengths of its
segments, and positions that start again at each segment. Overlong documents
are cut into pieces without loss, so ``unpack`` gives every document back. Tasks
pack their own documents first; open sequences of all tasks are packed again
together (``packing.in_rounds``).

Defined results: a null or empty text is one end id; null ids, repeated rows
and very long texts are written like any other; an empty table writes none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm import tokens
from stemma.llm.packing import BLOCK, LENGTH, cut_pieces, id_and_text, in_rounds, packed_blocks, read_pieces

#: Rows that go back to the JVM at once; a row holds two id-wide matrices.
ROWS = 256


class Rooms:
    """A segment tree whose leaf r counts the open sequences with room r."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.count = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(self.width)]

    def add(self, bin_: int, room: int) -> None:
        self.bins[room].append(bin_)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        at = room + self.width
        while at:
            self.count[at] += by
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and give a sequence with the least room of at least the size."""
        at = size + self.width
        if not self.count[at]:
            # up to the first ancestor with something on its right, then down its left edge
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.width:
                at = 2 * at + (not self.count[2 * at])
        room = at - self.width
        self._change(room, -1)
        return self.bins[room].pop(), room


def best_fit_decreasing(sizes: np.ndarray, most: int) -> np.ndarray:
    """The sequence of each piece."""
    out = np.empty(len(sizes), np.int64)
    rooms, n = Rooms(most), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        got = rooms.take(size)
        if got is None:
            got, n = (n, most), n + 1
        out[i] = got[0]
        if got[1] > size:
            rooms.add(got[0], got[1] - size)
    return out


def packed_rows(docs: DataFrame, path: str | None = None, most: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """A row for each sequence: sequence_id, n_tokens, ids, positions (binary, ``most`` wide), cu_seqlens, doc_ids, pieces, starts."""
    path = path or tokens.public_path()
    src = id_and_text(docs)
    kind = src.schema["doc_id"].dataType
    fields = [T.LongType(), T.IntegerType(), T.BinaryType(), T.BinaryType(), T.ArrayType(T.IntegerType()), T.ArrayType(kind), T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType()), T.BooleanType()]
    schema = T.StructType([T.StructField(n, t) for n, t in zip((*NAMES, "open"), fields)])

    def packed(rows: DataFrame, round_: int, last: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            types = [to_arrow_type(t) for t in fields]
            found = read_pieces(batches) if round_ else cut_pieces(batches, path, most, bytes)
            for columns, sizes, bins, still in packed_blocks(found, most, block, best_fit_decreasing, round_, last):
                order = np.argsort(bins, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], np.diff(bins[order]) != 0)))
                made: list[tuple] = []
                for a, b in zip(first, np.append(first[1:], len(order))):
                    own = order[a:b].tolist()
                    ends = np.concatenate(([0], np.cumsum(sizes[own]))).astype(np.int32)
                    position = np.zeros(most, "<u4")
                    for i, at in zip(own, ends):
                        position[at : at + sizes[i]] = np.arange(sizes[i])
                    matrix = b"".join(columns[4][i] for i in own).ljust(4 * most, b"\0")
                    made.append((bins[own[0]], ends[-1], matrix, position.tobytes(), ends, *[[columns[k][i] for i in own] for k in range(3)], still[own[0]]))
                    if len(made) == ROWS or b == len(order):
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), types)], schema.names)
                        made = []

        return rows.mapInArrow(run, schema)

    def again(rows: DataFrame) -> DataFrame:
        return unpack(rows).select("doc_id", "piece", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), "ids")

    return in_rounds(packed, src, again, block)


NAMES = ["sequence_id", "n_tokens", "ids", "positions", "cu_seqlens", "doc_ids", "pieces", "starts"]


def write(docs: DataFrame, folder: str, **options) -> None:
    """Write the packed rows as Parquet, which keeps the matrices as fixed-width binary."""
    packed_rows(docs, **options).write.mode("errorifexists").parquet(folder)


def unpack(rows: DataFrame) -> DataFrame:
    """(doc_id, piece, start, ids): the pieces as they were, ids little-endian binary."""
    seg = F.explode(F.arrays_zip("doc_ids", "pieces", "starts", F.slice("cu_seqlens", 1, F.size("pieces")).alias("a"), F.slice("cu_seqlens", 2, F.size("pieces")).alias("b")))
    x = rows.select("ids", seg.alias("s"))
    return x.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.pieces").alias("piece"), F.col("s.starts").alias("start"), F.substring("ids", F.col("s.a") * 4 + 1, (F.col("s.b") - F.col("s.a")) * 4).alias("ids"))


def with_digest(rows: DataFrame) -> DataFrame:
    """The rows with checksums in place of the matrices."""
    return rows.select("sequence_id", "n_tokens", F.size("pieces").alias("n_segments"), "doc_ids", "pieces", "cu_seqlens", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))
