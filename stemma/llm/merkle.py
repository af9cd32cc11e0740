"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces.

Paragraphs are the lines of a text; a section ends with an empty line or a line
whose hash ends in 0 or 8. A paragraph's leaves are its pieces: a piece ends
with the space after a letter, digit or sign of ``ENDS``, after 64 code points at
the latest. Both are cut by content, so an insertion moves no later section and
no later piece (but in runs of 64 code points without such a place).
A paragraph's hash is taken over its text, a section's over its paragraphs'
hashes, the root over the sections'. The fingerprint is ``root:tree``: the first
128 bits of the root, and the leaves' hashes (32 bits each), with ``,`` after a
paragraph and ``|`` after the last one of a section.

Equal roots mean equal texts. Unequal ones are likened by the branches in which
they differ: the share of both texts' distinct leaves that both trees have.
``branches`` gives the tree's nodes, ``changed_branches`` the leaves in which two
texts differ; the likeness is one less their share.

Only built-in functions run. The next document is found without a global sort
of the texts: ids are cut into ranges of about equal numbers, one shuffle brings
each range together with the first document of the next, and a window within
the range looks one row ahead. Fingerprints are taken behind that shuffle, so
only texts go through it.

Defined results: a null text counts as empty, and its tree has one empty
paragraph without leaves; texts without leaves are unlike all but equal ones;
rows of equal ids follow one another by text; rows with a null id are spread
over the ranges by the hash of their text, come first there, by text, and each is
likened to the row after it; without any id all rows are one range and follow one
another by text; a single row is its own next document; an empty table gives no
rows. Ids are numbers, dates or times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm.common import col

#: Before a space these end a piece; about a fourth of the words of European languages end so.
ENDS = "AEae0-4.!?"
#: Code points of a piece at most.
PIECE = 64
_PIECES = f"[^\\n]{{0,{PIECE - 2}}}?[{ENDS}] |[^\\n]{{1,{PIECE}}}"
_EMPTY = "d41d8cd98f00b204e9800998ecf8427e"  # md5 of nothing
#: Documents in a range of ids, and ranges at most.
RANGE_DOCS, RANGES = 2048, 1 << 16


def paragraphs(text: Column) -> Column:
    """array<struct<hash, leaves array<string>>>, in order."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(_PIECES), F.lit(0)), lambda q: F.substring(F.md5(q), 1, 8))
    return F.transform(F.split(text, "\n"), lambda p: F.struct(F.md5(p).alias("hash"), leaves(p).alias("leaves")))


def _joined(nodes: Column, what: Callable[[Column], Column]) -> Column:
    """A string for each paragraph, with ``|`` after those that end a section and ``,`` after all others."""
    ends = lambda h: (h == _EMPTY) | F.substring(h, -1, 1).isin("0", "8")
    return F.array_join(F.transform(nodes, lambda n: F.concat(what(n), F.when(ends(n["hash"]), "|").otherwise(","))), "")


def section_strings(nodes: Column) -> Column:
    """Each section's paragraph hashes, joined."""
    return F.split(_joined(nodes, lambda n: n["hash"]), "\\|")


def root(nodes: Column) -> Column:
    return F.substring(F.sha2(F.array_join(F.transform(section_strings(nodes), lambda s: F.md5(s)), ","), 256), 1, 32)


def tree(nodes: Column) -> Column:
    return _joined(nodes, lambda n: F.array_join(n["leaves"], ""))


def leaves(nodes: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(nodes, lambda n: n["leaves"])))


def with_fingerprint(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """The rows with ``name`` and its distinct leaves, ``name_leaves``."""
    held = rows.withColumn("__nodes", paragraphs(text))
    return held.select(*[col(c) for c in rows.columns], F.concat(root(F.col("__nodes")), F.lit(":"), tree(F.col("__nodes"))).alias(name), leaves(F.col("__nodes")).alias(f"{name}_leaves"))


def leaves_of(fingerprint: Column) -> Column:
    """The distinct leaves that a fingerprint holds."""
    return F.array_distinct(F.regexp_extract_all(F.substring(fingerprint, F.lit(34), F.length(fingerprint)), F.lit("[0-9a-f]{8}"), F.lit(0)))


def likeness(a: Column, b: Column, a_leaves: Column | None = None, b_leaves: Column | None = None) -> Column:
    """1 for equal roots; else the share of both fingerprints' leaves in branches that both have, below 1."""
    x, y = leaves_of(a) if a_leaves is None else a_leaves, leaves_of(b) if b_leaves is None else b_leaves
    share = 2.0 * F.size(F.array_intersect(x, y)) / F.greatest(F.size(x) + F.size(y), F.lit(1))
    return F.when(F.substring(a, 1, 32) == F.substring(b, 1, 32), F.lit(1.0)).otherwise(F.least(share, F.lit(0.999999)))


def branches(docs: DataFrame) -> DataFrame:
    """(doc_id, section, section_hash, paragraph, paragraph_hash, piece, leaf): every leaf with its branch; paragraphs count from 0 in each section."""
    nodes = docs.select("doc_id", paragraphs(F.coalesce("text", F.lit(""))).alias("nodes"))
    written = _joined(F.col("nodes"), lambda n: F.concat(n["hash"], F.lit(":"), F.array_join(n["leaves"], "")))
    s = nodes.select("doc_id", F.posexplode(F.split(written, "\\|")).alias("section", "own"))
    p = s.select("doc_id", "section", F.md5(F.regexp_replace("own", ":[0-9a-f]*", "")).alias("section_hash"), F.posexplode(F.filter(F.split("own", ","), lambda x: x != "")).alias("paragraph", "own"))
    each = F.regexp_extract_all(F.substring("own", F.lit(34), F.length("own")), F.lit("[0-9a-f]{8}"), F.lit(0))
    return p.select("doc_id", "section", "section_hash", "paragraph", F.substring("own", 1, 32).alias("paragraph_hash"), F.posexplode(each).alias("piece", "leaf"))


def changed_branches(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, side, section, paragraph, piece, leaf): leaves of either side that the other lacks, in paragraphs and sections that it lacks too; each leaf once, where it stands first."""

    def only(x: DataFrame, y: DataFrame, side: str) -> DataFrame:
        left = x
        for node in ("section_hash", "paragraph_hash", "leaf"):  # from the top down: an equal branch has nothing that differs
            left = left.join(y.select("doc_id", node).distinct(), ["doc_id", node], "left_anti")
        first = left.groupBy("doc_id", "leaf").agg(F.min(F.struct("section", "paragraph", "piece")).alias("at"))
        return first.select("doc_id", F.lit(side).alias("side"), "at.*", "leaf")

    a, b = branches(before), branches(after)
    return only(a, b, "before").unionByName(only(b, a, "after"))


def _starts(docs: DataFrame, per: int, most: int) -> list:
    """First ids of the ranges: actual ids, in order, at most ``most``."""
    ids = docs.select("doc_id").where("doc_id is not null")
    n = ids.count()
    if not n:
        return []
    ranges = max(1, min(most, n // per))
    if ranges == 1:
        return [ids.agg(F.min("doc_id")).first()[0]]
    shares = [i / ranges for i in range(ranges)]
    about = ids.agg(F.percentile_approx("doc_id", shares, 10 * ranges).alias("q")).first()["q"]
    # the sketch works in doubles: take the smallest actual id at or above each
    low = sorted({about[0], *about[1:]})
    snapped = ids.groupBy(_range_of(F.col("doc_id"), low).alias("r")).agg(F.min("doc_id").alias("m")).collect()
    return sorted(r["m"] for r in snapped)


def _range_of(x: Column, starts: list) -> Column:
    """Number of the last start at or below x (0 for those before the first), by two steps of about a root each."""
    if len(starts) <= 1:
        return F.lit(0)
    step = max(1, int(len(starts) ** 0.5))
    every, coarse = F.array(*[F.lit(s) for s in starts]), F.array(*[F.lit(s) for s in starts[::step]])
    at = F.greatest(F.size(F.filter(coarse, lambda s: s <= x)) - 1, F.lit(0)) * step
    return F.coalesce(F.greatest(at + F.size(F.filter(F.slice(every, at + 1, F.lit(step)), lambda s: s <= x)) - 1, F.lit(0)), F.lit(0))


def with_next(rows: DataFrame, columns: list[str], per: int = RANGE_DOCS, most: int = RANGES, then: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """The rows with a struct ``next`` of the columns of the row after it by (doc_id, text); after the last comes the first.

    The rows must have doc_id and text. One shuffle; no join. ``then`` adds
    columns behind the shuffle, which ``columns`` may name too.
    """
    starts = _starts(rows, per, most)
    order = ("__ahead", F.col("doc_id").asc_nulls_first(), "text")
    if not starts:
        # no row has an id: one range, by text
        one, own = Window.partitionBy(F.lit(0)).orderBy("text"), F.struct(*columns)
        return then(rows).withColumn("next", F.coalesce(F.lead(own).over(one), F.first(own).over(one)))
    own = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(len(starts)))).otherwise(_range_of(col("doc_id"), starts))
    is_start = col("doc_id") == F.element_at(F.array(*[F.lit(s) for s in starts]), own.cast("int") + 1)
    before = F.when(is_start, F.when(own == 0, len(starts) - 1).otherwise(own - 1))
    both = F.array(F.struct(own.cast("int").alias("range"), F.lit(0).alias("ahead")), F.struct(before.cast("int").alias("range"), F.lit(1).alias("ahead")))
    dealt = rows.withColumn("__to", F.explode(F.filter(both, lambda s: s["range"].isNotNull())))
    dealt = then(dealt.select(*rows.columns, F.col("__to.range").alias("__range"), F.col("__to.ahead").alias("__ahead")).repartition("__range"))
    led = dealt.withColumn("next", F.lead(F.struct(*columns)).over(Window.partitionBy("__range").orderBy(*order)))
    return led.where("__ahead = 0").drop("__range", "__ahead")


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to both it and the next document.

    Edited: the last quarter of the code points (rounded down) gives way to as
    many of the next document's first, or all it has.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    x = with_next(rows, ["text", "fp", "fp_leaves"], then=lambda d: with_fingerprint(d, F.col("text"), "fp"))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next.text", F.lit(1), quarter))
    near_next = likeness(F.col("fp"), F.col("next.fp"), F.col("fp_leaves"), F.col("next.fp_leaves"))
    x = x.select("doc_id", n.cast("long").alias("n_chars"), "fp", "fp_leaves", F.round(near_next, 9).alias("near_next"), edited.alias("edited"))
    x = with_fingerprint(x.withColumn("edited_sha256", F.sha2("edited", 256)), F.col("edited"), "ed")
    near_edited = F.round(likeness(F.col("fp"), F.col("ed"), F.col("fp_leaves"), F.col("ed_leaves")), 9)
    return x.select("doc_id", "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("ed").alias("edited_fingerprint"), near_edited.alias("near_edited"), "near_next")


#: The same rows by DuckDB.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt FROM d WINDOW w AS (ORDER BY doc_id NULLS FIRST, t)),
x AS (SELECT doc_id, t, nt, left(t, (length(t) - length(t) // 4)::INT) || left(nt, (length(t) // 4)::INT) AS ed FROM e),
f AS (SELECT doc_id, t, ed, list_transform([t, ed, nt], lambda s: list_transform(string_split(s, chr(10)), lambda p:
  {{'h': md5(p), 'l': list_transform(regexp_extract_all(p, '{_PIECES}'), lambda q: substring(md5(q), 1, 8)),
    'e': CASE WHEN p = '' OR right(md5(p), 1) IN ('0', '8') THEN '|' ELSE ',' END}})) AS ns FROM x),
g AS (SELECT doc_id, length(t) AS n_chars, sha256(ed) AS edited_sha256,
  list_transform(ns, lambda n: substring(sha256(array_to_string(list_transform(string_split(array_to_string(list_transform(n, lambda p: p.h || p.e), ''), '|'), lambda z: md5(z)), ',')), 1, 32)) AS roots,
  list_transform(ns, lambda n: array_to_string(list_transform(n, lambda p: array_to_string(p.l, '') || p.e), '')) AS trees,
  list_transform(ns, lambda n: list_distinct(flatten(list_transform(n, lambda p: p.l)))) AS ks FROM f),
j AS (SELECT *, list_transform([2, 3], lambda i: 2.0::DOUBLE * len(list_intersect(ks[1], ks[i])) / greatest(len(ks[1]) + len(ks[i]), 1)) AS js FROM g)
SELECT doc_id, n_chars, edited_sha256, roots[1] || ':' || trees[1] AS fingerprint, roots[2] || ':' || trees[2] AS edited_fingerprint,
  round(CASE WHEN roots[1] = roots[2] THEN 1.0::DOUBLE ELSE least(js[1], 0.999999::DOUBLE) END, 9) AS near_edited,
  round(CASE WHEN roots[1] = roots[3] THEN 1.0::DOUBLE ELSE least(js[2], 0.999999::DOUBLE) END, 9) AS near_next
FROM j
"""
