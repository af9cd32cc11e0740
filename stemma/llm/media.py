"""Image copies by local descriptors and geometric consensus.

Corners (segment test on a circle of 16 pixels, strongest of their surrounding)
are found on three scales; each is described by 64 binary brightness tests in
its patch, turned by the patch's own orientation. Descriptors meet in four block
tables of 16 bits, one of which any two within three bits share. Within a table
near ones are joined to visual words, so that any two descriptors within three
bits have a word in common. Words only bring images together; a pair of images
is a link by its own features: all pairs of their descriptors within three bits
vote for the shift and scale between their places, a descriptor once for a
shift, and enough votes for one shift (the fewer of both images' descriptors, and
onto either of them) make it a copy: whole, cropped or edited. Groups are the
connected components of all such links.

No word's images are paired with each other. In a few rounds each image is
compared with the one that most of its words have for their first, in an order
of images that changes from round to round; what belongs together by then needs
no further comparison. For what is left, an image asks only its rarer words who
else has them: the more frequent ones hold, all together, some descriptors too few
for a link (prefix filter); and a pair goes on only if the signatures of both
images' words, then a count of near descriptors, leave room for a link. So neither a group of copies nor a word that a third
of all images have gives pairs, and no link is lost.

Defined results: null, empty and unreadable images have no features and a group
of their own, unless another has the same bytes; images of equal bytes are one
before anything is compared; a descriptor that repeats in an image votes from
all its places; null ids belong to no group; repeated rows count once; an empty
table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
import struct
import zlib

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm.common import col, connected_components, drop_table, map_rows, shared_table, sliced
from stemma.llm.simhash import GrayIndex, _merge

#: Brightness step of a corner, scales, half a patch, pixels around in which a corner is the strongest, bits that may differ.
STEP, SCALES, HALF, AROUND, RADIUS = 30, 3, 6, 2, 3
#: Votes that make a link, and the least share of the smaller image's features.
VOTES, SHARE = 6, 0.2
#: Pixels described at once.
PIXELS = 1 << 17
#: Pairs or images up to which they are broadcast (16 bytes each).
BROADCAST_PAIRS = 1_000_000
#: Rounds in which each image is compared with one other, before pairs of images of different groups are; images of a word, as its rows see it on average, up to which no further round is worth it.
STARS, SHARED = 2, 64
#: Descriptors that a task hands on at once, in how many parts a block table is gone through, descriptors compared one by one, pairs of descriptors at once.
CHUNK, PARTS, WINDOW, CELLS = 1 << 19, 2, 2048, 1 << 22
#: Bits of an image's signature, a power of two, and the columns of ranked words.
SIGNATURE = 512
RANKED = ["word", "image", "group", "n_features", "need", "all", "up_to", "spare", *[f"mark{k}" for k in range(SIGNATURE // 64)]]
_ANGLES, _TESTS = 16, 64


# ---------------------------------------------------------------- images


def _nearest_of(a: int, b: int, c: int) -> int:
    """The one of left, above and corner that is nearest to left + above - corner."""
    p = a + b - c
    x, y, z = abs(p - a), abs(p - b), abs(p - c)
    return a if x <= y and x <= z else b if y <= z else c


def _png(data: bytes) -> np.ndarray | None:
    at, packed, head, palette = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    if head is None or head[2] != 8 or head[6]:
        return None
    w, h, _, kind = head[:4]
    k = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, w * k + 1)
    out = np.zeros((h, w * k), np.uint8)
    above = np.zeros((w, k), np.int64)
    for y in range(h):
        line, mode = raw[y, 1:].astype(np.int64).reshape(w, k), raw[y, 0]
        if mode == 1:
            line = line.cumsum(0) & 255
        elif mode == 2:
            line = (line + above) & 255
        elif mode in (3, 4):
            # each pixel needs the one before it, so these go pixel by pixel
            left, corner = [0] * k, [0] * k
            for at, (own, up) in enumerate(zip(line.tolist(), above.tolist())):
                if mode == 3:
                    left = [(x + ((a + b) >> 1)) & 255 for x, a, b in zip(own, left, up)]
                else:
                    left = [(x + _nearest_of(a, b, c)) & 255 for x, a, b, c in zip(own, left, up, corner)]
                    corner = up
                line[at] = left
        out[y], above = line.reshape(-1), line
    out = out.reshape(h, w, k)
    if kind == 3:
        out = palette[out[:, :, 0]]
    return gray(out[:, :, :3] if out.shape[2] >= 3 else out[:, :, 0])


def gray(x: np.ndarray) -> np.ndarray:
    return x if x.ndim == 2 else (x.astype(np.uint16).sum(2) // x.shape[2]).astype(np.uint8)


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM or PPM, PNG (8 bits a sample) or BMP (24 bits); None if it can't be read."""
    try:
        if data and (m := re.match(rb"P([56])\s+(\d+)\s+(\d+)\s+255\s", data)):
            w, h, k = int(m[2]), int(m[3]), 3 if m[1] == b"6" else 1
            x = np.frombuffer(data, np.uint8, w * h * k, m.end())
            return gray(x.reshape(h, w, 3)) if k == 3 else x.reshape(h, w)
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        if data and data[:2] == b"BM":
            start, (w, h), bits = struct.unpack("<I", data[10:14])[0], struct.unpack("<ii", data[18:26]), struct.unpack("<H", data[28:30])[0]
            if bits == 24:
                row = (w * 3 + 3) // 4 * 4
                x = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * 3].reshape(abs(h), w, 3)
                return gray(x[::-1] if h > 0 else x)
    except (ValueError, KeyError, IndexError, zlib.error, struct.error, TypeError):
        return None
    return None


def encode(x: np.ndarray) -> bytes:
    """Grey values as PGM."""
    return b"P5 %d %d 255\n" % x.shape[::-1] + np.ascontiguousarray(x, np.uint8).tobytes()


_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->")
_BLOCK = re.compile(r"(?i)</?(?:p|div|h\d|li|ul|br|article|nav|footer|header|table|tr|title|body|html|head|section)\b[^>]*>")
_TAG = re.compile(r"<[^>]*>")
_INK = (np.arange(256) * 97 % 200).astype(np.uint16)
_INK[32] = 255
#: Pixels across a drawn page, and bytes of text a pixel.
WIDTH, BYTES = 64, 2


def draw_page(text: str) -> bytes:
    """A page's visible text, a pixel for two bytes, a row for each 128 bytes of a block."""
    plain = entities.unescape(_TAG.sub("", _BLOCK.sub("\n", _HIDDEN.sub("", text))))
    rows = []
    for line in plain.split("\n"):
        b = " ".join(line.split()).encode()
        # a short row is filled with its own text, so that no two pages share blank corners
        rows += [(r * (BYTES * WIDTH // len(r) + 1))[: BYTES * WIDTH] for i in range(0, len(b), BYTES * WIDTH) if (r := b[i : i + BYTES * WIDTH] + b" ")]
    if not rows:
        return b""
    ink = _INK[np.frombuffer(b"".join(rows), np.uint8)]
    return encode((ink.reshape(-1, BYTES).sum(1) // BYTES).astype(np.uint8).reshape(-1, WIDTH))


def rendered(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """(page_id, image): each whole page as a bitmap; null: null."""

    def make():
        return lambda texts: ([None if t is None else draw_page(t) for t in texts.to_pylist()],)

    return map_rows(pages, {"html": col(html)}, [T.StructField("image", T.BinaryType())], make, [page_id])


# ---------------------------------------------------------------- features

_CIRCLE = [(-3, 0), (-3, 1), (-2, 2), (-1, 3), (0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1)]


def _arcs() -> np.ndarray:
    """Which 16-bit circles have nine neighbours in a row."""
    x = np.arange(1 << 16, dtype=np.uint32)
    x |= x << 16
    run = x.copy()
    for k in range(1, 9):
        run &= x >> k
    return (run & 0xFFFF) > 0


_ARC = _arcs()
_DISC = np.array([(dy, dx) for dy in range(-HALF, HALF + 1) for dx in range(-HALF, HALF + 1) if dy * dy + dx * dx <= HALF * HALF], np.int32)


def _tests() -> np.ndarray:
    """Offsets (angle, test, end, axis) of the turned brightness tests."""
    rng = np.random.default_rng(11)
    ends = np.clip(rng.normal(0, HALF / 2, (_TESTS, 2, 2)), -HALF * 0.7, HALF * 0.7)
    out = []
    for a in range(_ANGLES):
        t = 2 * np.pi * a / _ANGLES
        out.append(np.rint(ends @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])))
    return np.array(out).astype(np.int64)


_TEST = _tests()


def _corners(x: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the corners in the rows inside images; x has a border of HALF + 2."""
    b = HALF + 2
    h, w = x.shape[0] - 2 * b, x.shape[1] - 2 * b
    if h <= 0 or w <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mid = np.ascontiguousarray(x[b : b + h, b : b + w])
    above, below = np.minimum(mid, 255 - STEP) + np.uint8(STEP), np.maximum(mid, STEP) - np.uint8(STEP)
    # eight bits of a circle at a time
    up, down = ([np.zeros((h, w), np.uint8) for _ in range(2)] for _ in range(2))
    # sixteen steps of at most 15 each
    strength = np.zeros((h, w), np.uint8)
    for k, (dy, dx) in enumerate(_CIRCLE):
        c = x[b + dy : b + dy + h, b + dx : b + dx + w]
        up[k >> 3] |= (c > above).view(np.uint8) << np.uint8(k & 7)
        down[k >> 3] |= (c < below).view(np.uint8) << np.uint8(k & 7)
        d = np.maximum(c, mid)
        d -= np.minimum(c, mid)
        d >>= np.uint8(4)
        strength += d
    up, down = (x[0] | x[1].astype(np.uint16) << 8 for x in (up, down))
    # nine in a row are nine at least
    ys, xs = np.nonzero(((np.bitwise_count(up) > 8) | (np.bitwise_count(down) > 8)) & inside[b : b + h, None])
    corner = _ARC[up[ys, xs]] | _ARC[down[ys, xs]]
    ys, xs = ys[corner], xs[corner]
    # the strongest of its surrounding, of equal ones the first
    kind, room = (np.int32, 22) if h * w < 1 << 22 else (np.int64, 48)
    own = (strength[ys, xs].astype(kind) << room) + np.arange(len(ys), 0, -1, dtype=kind)
    most = np.zeros((h + 2 * AROUND, w + 2 * AROUND), kind)
    most[ys + AROUND, xs + AROUND] = own
    span = 1
    while span <= 2 * AROUND:
        more = min(span, 2 * AROUND + 1 - span)
        most = np.maximum(most[more:], most[:-more])
        most = np.maximum(most[:, more:], most[:, :-more])
        span += more
    best = most[ys, xs] == own
    return ys[best] + b, xs[best] + b


def _bits(x: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    flat, w = x.ravel(), x.shape[1]
    at = ys * w + xs
    my, mx = (flat.take(at[:, None] + _DISC @ (w, 1)).astype(np.int32) @ _DISC).T
    angle = np.rint(np.arctan2(my, mx) / (2 * np.pi) * _ANGLES).astype(np.int64) % _ANGLES
    off = _TEST[angle]
    off = off[..., 0] * w + off[..., 1]
    off += at[:, None, None]
    ends = flat.take(off)
    ones = ends[..., 0] < ends[..., 1]
    return np.packbits(ones, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def features(images: list[np.ndarray | None]) -> list[tuple[np.ndarray, ...]]:
    """(x, y, level, bits) of each image; images of a width are stacked and described together."""
    none = tuple(np.zeros(0, t) for t in (np.int32, np.int32, np.int32, np.int64))
    out: list[list] = [[] for _ in images]
    pad, small = HALF + 2, list(images)
    for level in range(SCALES):
        by: dict[int, list[int]] = {}
        for i, x in enumerate(images):
            if x is not None and min(x.shape) >> level >= 4:
                by.setdefault(x.shape[1], []).append(i)
        for own in by.values():
            for i in own if level else ():
                small[i] = _shrunk(small[i], 1)
            heights = np.array([len(small[i]) for i in own])
            image = np.repeat(np.arange(len(own)), heights + 2 * pad)
            row = np.arange(len(image)) - (np.cumsum(heights + 2 * pad) - heights - 2 * pad)[image] - pad
            inner = (row >= 0) & (row < heights[image])
            # each image in a border of its own pixels, mirrored
            tall = np.concatenate([small[i] for i in own])
            tall = tall[(np.cumsum(heights) - heights)[image] + _mirrored(row, heights[image])]
            tall = tall[:, _mirrored(np.arange(-pad, tall.shape[1] + pad), tall.shape[1])]
            ys, xs = _corners(tall, inner)
            which, inside = image[ys], row[ys]
            bits = _bits(tall, ys, xs).view(np.int64)
            at = np.searchsorted(which, np.arange(len(own) + 1))
            for j, i in enumerate(own):
                s = slice(at[j], at[j + 1])
                out[i].append(((xs[s] - pad) << level, inside[s] << level, np.full(at[j + 1] - at[j], level), bits[s]))
    return [tuple(np.concatenate(c) for c in zip(*o)) if o else none for o in out]


def _mirrored(at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Places before 0 and from n on as those that a mirror at either end shows."""
    at = at % (2 * n)
    return np.where(at < n, at, 2 * n - 1 - at)


def _shrunk(x: np.ndarray, level: int) -> np.ndarray:
    for _ in range(level):
        h, w = x.shape[0] // 2 * 2, x.shape[1] // 2 * 2
        y = x[:h, :w].astype(np.uint16)
        x = ((y[::2, ::2] + y[1::2, ::2] + y[::2, 1::2] + y[1::2, 1::2]) >> 2).astype(np.uint8)
    return x


def with_features(images: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns with n_features and the corners on all scales: bits (64-bit), xs, ys (32-bit) and levels (8-bit), little-endian arrays."""

    def make():
        def fn(data: pa.Array):
            own = [decode(d) for d in data.to_pylist()]
            got: list = []
            at = 0
            while at < len(own):
                to, n = at, 0
                while to < len(own) and (to == at or n < PIXELS):
                    n += 0 if own[to] is None else own[to].size
                    to += 1
                got += features(own[at:to])
                at = to
            packed = lambda k, kind: [g[k].astype(kind).tobytes() for g in got]
            return [len(g[0]) for g in got], packed(3, "<i8"), packed(0, "<i4"), packed(1, "<i4"), packed(2, "i1")

        return fn

    out = [T.StructField("n_features", T.IntegerType()), *[T.StructField(n, T.BinaryType()) for n in ARRAYS]]
    return map_rows(images, {"image": F.col("image")}, out, make, keep)


ARRAYS = ("bits", "xs", "ys", "levels")

# ---------------------------------------------------------------- words


def _block(bits: np.ndarray, p: int) -> np.ndarray:
    return (bits >> np.uint64(16 * p)) & np.uint64(0xFFFF)


def _packed(p: int, part: int, buckets: int):
    """Descriptors by the bucket of their block p, a row for each bucket and CHUNK."""

    def flush(bits: list[np.ndarray], images: list[np.ndarray]):
        b, no = np.concatenate(bits), np.concatenate(images)
        key = _block(b, p).astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(8)
        bucket = (key // np.uint32(PARTS) % np.uint32(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)
        own = np.flatnonzero(key % np.uint32(PARTS) == part)
        own = own[np.argsort(bucket[own], kind="stable")]
        ends = np.searchsorted(bucket[own], np.arange(buckets), "right")
        rows = [(k, b[own[s:e]].tobytes(), no[own[s:e]].tobytes()) for k, (s, e) in enumerate(zip([0, *ends[:-1]], ends)) if e > s]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "bits", "images"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, images, n = [], [], 0
        for batch in sliced(batches):
            for no, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bits.append(np.frombuffer(own, np.uint64))
                images.append(np.full(len(bits[-1]), no, np.int64))
                n += len(bits[-1])
            if n >= CHUNK:
                yield from flush(bits, images)
                bits, images, n = [], [], 0
        if n:
            yield from flush(bits, images)

    return run


def near_pairs(fps: np.ndarray, p: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places) of distinct descriptors within RADIUS that agree in block p and in none before it.

    Three differing bits leave one of four blocks of the other 48 bits alone too,
    so only descriptors that share both blocks are compared.
    """
    low = np.uint64((1 << (16 * p)) - 1)
    rest = (fps & low) | ((fps >> np.uint64(16)) & ~low)
    block, places = _block(fps, p), np.arange(len(fps), dtype=np.uint64)
    for q in range(4):
        key = block << np.uint64(12) | ((rest >> np.uint64(12 * q)) & np.uint64(0xFFF))
        # the 28 bits of a key and a place sort faster as one number
        order = (np.sort(key << np.uint64(36) | places) & np.uint64((1 << 36) - 1)).view(np.int64)
        key, own = key[order], fps[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, len(key)))
        found = []
        large = np.repeat(size > WINDOW, size)
        if large.any():
            at = np.flatnonzero(large)
            found = [(at[x], at[y]) for x, y in GrayIndex(key[at], own[at]).pairs(RADIUS)]
        ends = np.repeat(starts + size, size)
        at, gap = np.flatnonzero(~large), 1
        while len(at := at[at + gap < ends[at]]):
            near = at[np.bitwise_count(own[at] ^ own[at + gap]) <= RADIUS]
            if len(near):
                found.append((near, near + gap))
            gap += 1
        for x, y in found:
            differ = own[x] ^ own[y]
            fresh = np.ones(len(x), bool)
            for b in range(p):
                fresh &= _block(differ, b) != 0
            yield order[x[fresh]], order[y[fresh]]


def _words(p: int):
    """(word, image, hub, many, own): a word's images, the first of them, how many descriptors of the image it has, and which."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, images = [], []
        for batch in batches:
            bits += [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            images += [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
        if not bits:
            return
        fps, kind = np.unique(np.concatenate(bits), return_inverse=True)
        images = np.concatenate(images)
        order = np.lexsort((images, kind))
        kind, images = kind[order], images[order]
        once = np.concatenate(([True], (kind[1:] != kind[:-1]) | (images[1:] != images[:-1])))
        kind, images = kind[once], images[once]
        label = np.arange(len(fps))
        held, n = [], 0
        for x, y in near_pairs(fps, p):
            held.append((x, y))
            n += len(x)
            if n >= CHUNK:
                label, held, n = _merge(label, *map(np.concatenate, zip(*held))), [], 0
        if held:
            label = _merge(label, *map(np.concatenate, zip(*held)))
        # in the first table equal descriptors are a word too; in the others only near ones bring something new
        held = np.bincount(label, minlength=len(fps)) > 1
        if p == 0:
            held |= np.bincount(kind, minlength=len(fps))[: len(fps)] > 1
        word = label[kind]
        own = np.flatnonzero(held[word])
        order = own[np.lexsort((images[own], word[own]))]
        word, images, held = word[order], images[order], fps[kind[order]].view(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (images[1:] != images[:-1])))) if len(word) else np.zeros(0, np.int64)
        many = np.diff(np.append(new, len(word)))
        word, images = word[new], images[new]
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else new
        size = np.diff(np.append(first, len(word)))
        hub, keep = np.repeat(images[first], size), np.repeat(size, size) > 1
        name = (fps[word] ^ np.uint64(0x9E3779B97F4A7C15 * (p + 1) & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(held)).astype(np.int32)), pa.array(held)).filter(pa.array(keep))
        columns = [*[pa.array(c[keep]) for c in (name, images, hub, many.astype(np.int32))], lists]
        for at in range(0, len(lists), 1 << 16):
            yield pa.RecordBatch.from_arrays([c.slice(at, 1 << 16) for c in columns], ["word", "image", "hub", "many", "own"])

    return run


def visual_words(found: DataFrame) -> DataFrame:
    """(word, image, hub, many, own) of (no, n_features, bits): one block table after the other, each in PARTS, so that little is on disk at a time."""
    spark = found.sparkSession
    n = found.agg(F.sum("n_features")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (PARTS << 21)), 1)
    own = found.where("n_features > 0").select("no", "bits")
    tables = []
    for p in range(4):
        for part in range(PARTS):
            dealt = own.mapInArrow(_packed(p, part, buckets), "bucket int, bits binary, images binary").repartition(buckets, "bucket")
            tables.append(shared_table(dealt.mapInArrow(_words(p), "word long, image long, hub long, many int, own array<long>"), "zstd"))
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out


# ---------------------------------------------------------------- links


def _steps(x: np.ndarray) -> np.ndarray:
    return (np.sign(x) * np.floor(np.abs(x) / 4 + 0.5)).astype(np.int64)


def votes_between(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], least: float = 0) -> int:
    """The most descriptors of both images that agree on one scale and shift, brought onto either of them; images as (bits, xs, ys, levels). 0 as soon as they can't be ``least``, and no more than shows that they are."""
    found = []
    step = max(1, CELLS // max(1, len(b[0])))
    for at in range(0, len(a[0]), step):
        i, j = np.nonzero(np.bitwise_count(a[0][at : at + step, None] ^ b[0][None, :]) <= RADIUS)
        found.append((i + at, j))
    i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
    if min(np.count_nonzero(np.bincount(i)), np.count_nonzero(np.bincount(j))) < least:
        return 0
    best = 0
    for (u, iu), (v, jv) in (((a, i), (b, j)), ((b, j), (a, i))):
        if not len(iu):
            break
        up = u[3][iu].astype(np.int64) - v[3][jv]
        if u is b and not up.any():  # of one scale, the same shifts again
            break
        scale = 2.0**up
        shift = ((up + SCALES) << 56) + ((_steps(u[1][iu] - v[1][jv] * scale) & 0xFFFFFFF) << 28) + (_steps(u[2][iu] - v[2][jv] * scale) & 0xFFFFFFF)
        shifts, which, n = np.unique(shift, return_inverse=True, return_counts=True)
        if n.max() < least:
            continue
        counts = []
        for bits in (u[0][iu], v[0][jv]):
            order = np.lexsort((bits, which))
            w, x = which[order], bits[order]
            counts.append(np.bincount(w[np.concatenate(([True], (w[1:] != w[:-1]) | (x[1:] != x[:-1])))], minlength=len(shifts)))
        best = max(best, int(np.minimum(*counts).max()))
        if 0 < least <= best:
            break
    return best


def linked(pairs: DataFrame, found: DataFrame, votes: int = VOTES, share: float = SHARE) -> DataFrame:
    """The pairs (a, b) of images that are copies by their own features."""
    few = pairs.count() <= BROADCAST_PAIRS
    held = lambda x: F.broadcast(x) if few else x
    arrays = ["n_features", *ARRAYS]
    mine = found.select("no", *arrays)
    left = mine.join(held(pairs.select(F.col("a").alias("no"), "b")), "no").select(F.col("no").alias("a"), "b", *[F.col(c).alias(f"a_{c}") for c in arrays])
    right = mine.join(held(pairs.select(F.col("b").alias("no")).distinct()), "no", "left_semi").select(F.col("no").alias("b"), *[F.col(c).alias(f"b_{c}") for c in arrays])
    both = left.join(right, "b")

    def make():
        kinds = (np.uint64, np.int32, np.int32, np.int8)

        def fn(*columns: pa.Array):
            out = []
            for row in zip(*[c.to_pylist() for c in columns]):
                a, b = (tuple(np.frombuffer(x, k) for x, k in zip(row[s : s + 4], kinds)) for s in (0, 4))
                least = max(votes, share * min(len(a[0]), len(b[0])))
                out.append(votes_between(a, b, least) >= least)
            return (out,)

        return fn

    inputs = {f"{x}_{c}": F.col(f"{x}_{c}") for x in "ab" for c in ARRAYS}
    return map_rows(both, inputs, [T.StructField("ok", T.BooleanType())], make, ["a", "b"], "ok")


def star_pairs(words: DataFrame, sizes: DataFrame, votes: int = VOTES, share: float = SHARE) -> DataFrame:
    """(a, b): each image with the one that most of its descriptors' words have for their hub, if that is of another group.

    Only where these alone could be enough votes. words: (word, image, hub, many, group, hub_group).
    """
    met = words.where(F.col("group") != F.col("hub_group")).groupBy("image", "hub").agg(F.sum("many").alias("m")).where(F.col("m") >= votes)
    best = met.groupBy("image").agg(F.max(F.struct("m", "hub")).alias("s")).select("image", "s.hub", "s.m")
    few = best.count() <= BROADCAST_PAIRS
    size = lambda k: (F.broadcast if few else lambda x: x)(sizes).select(F.col("no").alias(k), F.col("n_features").alias(f"n_{k}"))
    able = best.join(size("image"), "image").join(size("hub"), "hub").where(F.col("m") >= share * F.least("n_image", "n_hub"))
    return able.select(F.col("hub").alias("a"), F.col("image").alias("b"))


def grouped(words: DataFrame, parts: DataFrame) -> DataFrame:
    """Of (word, image, many, own) the words whose images are in several groups, with ``group`` and ``images``, how many of them."""
    few = parts.count() <= BROADCAST_PAIRS
    x = words.select("word", "image", "many", "own").join((F.broadcast if few else lambda x: x)(parts.select(F.col("node").alias("image"), F.col("root").alias("g"))), "image", "left")
    x = x.withColumn("group", F.coalesce("g", "image")).drop("g")
    of = x.groupBy("word").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").cast("int").alias("images"))
    apart = shared_table(of.where("low < high").select("word", "images"), "zstd")
    return x.join(F.broadcast(apart) if apart.count() <= BROADCAST_PAIRS else apart, "word")


def with_hubs(words: DataFrame, seed: int) -> DataFrame:
    """The words with another hub and its group: the first in an order of images that the seed gives."""
    first = words.groupBy("word").agg(F.min(F.struct(F.xxhash64(F.lit(seed), "image"), F.col("image").alias("hub"), F.col("group").alias("hub_group"))).alias("h"))
    return words.join(first.select("word", "h.hub", "h.hub_group"), "word")


def _ranked(votes: int, share: float):
    """Of (image, word, group, many, images, n_features, own), an image's rows together: the rows with need, all, up_to, spare and the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        image, word, group, many, images, n = (rows.column(c).to_numpy() for c in ("image", "word", "group", "many", "images", "n_features"))
        order = np.lexsort((word, -images, image))
        image, word, group, many, n = (x[order] for x in (image, word, group, many, n))
        lists = rows.column("own").combine_chunks().take(pa.array(order))
        bits, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(order)), many)
        start = np.flatnonzero(np.concatenate(([True], image[1:] != image[:-1])))
        size = np.diff(np.append(start, len(image)))
        no = np.repeat(np.arange(len(start)), size)
        # a descriptor counts in the most frequent of its words
        by = np.lexsort((of, bits, no[of]))
        d, o = bits[by], no[of][by]
        fresh = np.bincount(of[by[np.concatenate(([True], (d[1:] != d[:-1]) | (o[1:] != o[:-1])))]], minlength=len(image))
        total = np.add.reduceat(fresh, start)
        up_to = np.cumsum(fresh) - np.repeat(np.cumsum(total) - total, size)
        place = word.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SIGNATURE.bit_length() + 1)
        marks = [np.bitwise_or.reduceat(np.where(place >> np.uint64(6) == k, np.uint64(1) << (place & np.uint64(63)), np.uint64(0)), start) for k in range(SIGNATURE // 64)]
        spare = np.add.reduceat(many, start) - sum(np.bitwise_count(m).astype(np.int64) for m in marks)
        need = np.ceil(np.maximum(votes, share * n)).astype(np.int32)
        # nobody needs less than votes
        keep = np.flatnonzero(up_to >= votes)
        wide = lambda x: x[no[keep]]
        columns = [word[keep], image[keep], group[keep], n[keep], need[keep], wide(total).astype(np.int32), up_to[keep].astype(np.int32), wide(spare).astype(np.int32), *[wide(m).view(np.int64) for m in marks]]
        for at in range(0, len(keep), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], RANKED)

    return run


def rest_pairs(words: DataFrame, sizes: DataFrame, votes: int = VOTES, share: float = SHARE) -> DataFrame:
    """(a, b): images of different groups that could be links; words (word, image, many, own, group), maybe with ``images``, how many a word has.

    Each image of a link has as many different descriptors in words that both have
    as the smaller one's need is. ``votes`` of them lie beyond its most frequent
    words, which together hold that need less ``votes`` of its descriptors, each
    counted in the most frequent of its words. So words within these are asked by
    neither, and only images that meet in ``votes`` descriptors of either go on.

    Images share single words by chance, the more of them the larger the table, so
    each row has its image's signature: all its words, a bit each. Descriptors of a
    link that share words share bits, a bit each but for those (``spare``) that fall
    on a bit of another. So pairs with fewer bits in common are no links, and are
    dropped where they meet.
    """
    if "images" not in words.columns:
        words = words.join(words.groupBy("word").agg(F.count("*").alias("images")), "word")
    few = sizes.count() <= BROADCAST_PAIRS
    named = sizes.select(F.col("no").alias("image"), "n_features")
    dealt = words.join(F.broadcast(named) if few else named, "image").select("image", "word", "group", "many", "images", "n_features", "own").repartition("image")
    kinds = ["long"] * 3 + ["int"] * 5 + ["long"] * (SIGNATURE // 64)
    own = shared_table(dealt.mapInArrow(_ranked(votes, share), ", ".join(f"`{n}` {k}" for n, k in zip(RANKED, kinds))), "zstd")
    marks = RANKED[8:]
    side = lambda x, rows, *names: rows.select("word", *[F.col(c).alias(f"{x}_{c}") for c in ("image", "group", "n_features", "up_to", "spare", *marks)], *names)
    larger = (F.col("a_n_features") < F.col("b_n_features")) | (F.col("a_n_features") == F.col("b_n_features")) & (F.col("a_image") < F.col("b_image"))
    asking = side("a", own.where((F.col("all") >= F.col("need")) & (F.col("up_to") >= F.col("need"))), "need")
    common = sum((F.bit_count(F.col(f"a_{m}").bitwiseAND(F.col(f"b_{m}"))) for m in marks), F.lit(0))
    able = (F.col("all") >= F.col("need")) & (F.col("b_up_to") >= F.col("need")) & (common + F.least("a_spare", "b_spare") >= F.col("need"))
    met = asking.join(side("b", own, "all"), "word").where((F.col("a_group") != F.col("b_group")) & larger & able)
    pairs = shared_table(met.select(F.col("a_image").alias("a"), F.col("b_image").alias("b")).distinct())
    drop_table(own)
    return sharing(pairs, words, sizes, votes, share)


def sharing(pairs: DataFrame, words: DataFrame, sizes: DataFrame, votes: int = VOTES, share: float = SHARE) -> DataFrame:
    """The pairs of which as many descriptors in words as a link takes, of either image, are near one of the other."""
    held = F.broadcast if pairs.count() <= BROADCAST_PAIRS else lambda x: x
    met = pairs.select(F.col("a").alias("image")).unionByName(pairs.select(F.col("b").alias("image"))).distinct()
    named = (F.broadcast if sizes.count() <= BROADCAST_PAIRS else lambda x: x)(sizes.select(F.col("no").alias("image"), "n_features"))
    own = words.select("image", "own").join(held(met), "image", "left_semi").groupBy("image").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("bits")).join(named, "image")
    own = shared_table(own, "zstd")
    left = own.select(F.col("image").alias("a"), F.col("bits").alias("a_bits"), "n_features").join(held(pairs), "a")
    both = left.join(own.select(F.col("image").alias("b"), F.col("bits").alias("b_bits")), "b")

    def make():
        def fn(n: pa.Array, a: pa.ListArray, b: pa.ListArray):
            parts = lambda x: np.split(x.flatten().to_numpy().view(np.uint64), np.cumsum(x.value_lengths().to_numpy())[:-1])
            out = []
            for need, u, v in zip(np.maximum(votes, share * n.to_numpy()), parts(a), parts(b)):
                near = np.bitwise_count(u[:, None] ^ v) <= RADIUS
                out.append(min(np.count_nonzero(near.any(0)), np.count_nonzero(near.any(1))) >= need)
            return (out,)

        return fn

    return shared_table(map_rows(both, {c: F.col(c) for c in ("n_features", "a_bits", "b_bits")}, [T.StructField("ok", T.BooleanType())], make, ["a", "b"], "ok"))


def image_groups(found: DataFrame, votes: int = VOTES, share: float = SHARE) -> DataFrame:
    """(node, root): each linked image with the first of its group; found: (no, n_features, bits, xs, ys, levels)."""
    words = visual_words(found)
    sizes = found.select("no", "n_features")
    left, met = words, words.withColumns({"group": F.col("image"), "hub_group": F.col("hub")})
    links = found.sparkSession.createDataFrame([], "a long, b long")
    for seed in range(STARS):
        new = shared_table(linked(shared_table(star_pairs(met, sizes, votes, share)), found, votes, share))
        if not new.head(1):
            continue
        links = links.unionByName(new)
        before, left = left, shared_table(grouped(left, shared_table(connected_components(links))), "zstd")
        drop_table(before)
        if left.agg(F.coalesce(F.avg("images"), F.lit(0))).first()[0] <= SHARED:
            break
        met = with_hubs(left, seed)
    left = left if "group" in left.columns else left.withColumn("group", F.col("image"))
    more = shared_table(linked(rest_pairs(left, sizes, votes, share), found, votes, share))
    return connected_components(links.unionByName(more))


def find_copies(images: DataFrame, image_id: str, votes: int = VOTES, share: float = SHARE) -> DataFrame:
    """(id, n_features, component_id) of each image; component_id is the smallest id of its group of copies."""
    key = F.coalesce(F.sha2("image", 256), F.concat(F.lit("null "), F.coalesce(col(image_id).cast("string"), F.lit(""))))
    rows = images.select(col(image_id).alias("id"), "image", key.alias("key"))
    # numbers hold once they are written
    every = shared_table(with_features(rows, ["id", "key"]).withColumn("no", F.monotonically_increasing_id()), "zstd")
    equal = shared_table(every.where("id is not null").groupBy("key").agg(F.min(F.struct("id", "no")).alias("s")).select("key", F.col("s.id").alias("rep"), "s.no"))
    found = every.join(F.broadcast(equal.select("no")) if equal.count() <= BROADCAST_PAIRS else equal.select("no"), "no", "left_semi")
    parts = shared_table(image_groups(found, votes, share))
    of = equal.join(parts.withColumnRenamed("node", "no"), "no", "left").withColumn("root", F.coalesce("root", "no"))
    of = of.join(of.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("key", "component_id")
    out = every.select("id", "key", "n_features").join(of, "key", "left")
    return out.select(F.col("id").alias(image_id), "n_features", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
