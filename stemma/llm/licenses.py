"""License scan by diagonal voting.

Every run of K words of every document is hashed (a span with SAME
of a template's words in order can't be parted between all of them, so it has one); a Spark join with the
templates' run hashes gives places where they agree. A document place less a
template place is a diagonal; votes are summed by diagonal, neighbouring
diagonals (words put in or left out) are merged, and each merged span is
verified word by word against its template. Where sister licences share most of
their notice, the one that the words fit best stays. The templates are constants of
this file, so their table has a fixed size and is broadcast.

Defined results: null and empty texts have no words, no labels and score 0;
rows of the same or of a null id are each scanned on their own, by their texts;
equal rows get equal results; a very long text is scanned whole; an empty table gives no rows.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm.common import map_rows, shared_checkpoint, text_bytes
from stemma.llm.words import run_hashes, runs

#: Words of a run, diagonals that may lie between two that are merged, and the share of a template's words that a span must have.
K, GAP, SAME = 2, 4, 0.8
#: Names and identifiers that must stand whole: templates that begin with the first, or have at most so many words.
MARK, WHOLE = "SPDX-License-Identifier:", 4
#: Spans up to which the candidates are broadcast (24 bytes each); beyond it both sides are shuffled.
BROADCAST_SPANS = 1_000_000
#: Phrases that count wherever their words stand together.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices, short names and identifiers of public licences (fixed values: the licences' own words). Short ones must stand whole.
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT license"),
    ("mit", "The MIT License (MIT)"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Apache License Version 2.0"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"),
    ("bsd", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "SPDX-License-Identifier: GPL-2.0-only"),
    ("gpl", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-only"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "GNU Lesser General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("lgpl", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("agpl", "GNU Affero General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-2.0", "Mozilla Public License Version 2.0"),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("unlicense", "SPDX-License-Identifier: Unlicense"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc0", "CC0 1.0 Universal"),
    ("cc0", "SPDX-License-Identifier: CC0-1.0"),
    ("cc-by", "This work is licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "CC BY-SA"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "CC BY-NC"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nd", "CC BY-ND"),
)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_TO_WORDS = bytes(_LOWER[b] if _WORD[_LOWER[b]] else 32 for b in range(256))


def words(data: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and all that isn't ASCII."""
    return data.translate(_TO_WORDS).split()


def gram_hashes(data: bytes, k: int = K) -> np.ndarray:
    """A hash of each run of k words, by its first word's place."""
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    ink = _WORD[raw]
    starts = runs(ink)
    h = run_hashes(raw, starts)[ink[starts]] if len(starts) else np.zeros(0, np.uint64)
    if len(h) < k:
        return np.zeros(0, np.int64)
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
    return out.view(np.int64)


def template_table(spark, templates=TEMPLATES) -> DataFrame:
    """(h, template, at): the run hashes of the templates."""
    rows = [(int(h), t, at) for t, (_, text) in enumerate(templates) for at, h in enumerate(gram_hashes(text.encode()))]
    return spark.createDataFrame(rows, "h long, template int, at int")


def least_share(template: str) -> float:
    """The share of a template's words that a span must have: all of a name's or an identifier's."""
    return 1.0 if template.startswith(MARK) or len(words(template.encode())) <= WHOLE else SAME


def least_hits(n: int, same: float = SAME) -> tuple[int, int]:
    """The fewest runs of two words that a span with SAME of a template's n words shares with it, and the most words between the first and the last."""
    fewest = min(m - (n - m) - m // 4 - 1 for m in range(1, n + 1) if m >= same * n - 1e-9)
    return max(1, fewest), n + n // 4 + 1


def row_key() -> Column:
    """Tells rows of one id apart by their texts; equal rows share their hits, each counted once."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def candidate_spans(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, row, spans): for each document the merged diagonals (template, first, last word)."""

    def make():
        return lambda texts: ([gram_hashes(t) for t in texts.to_pylist()],)

    keyed = docs.select("doc_id", row_key().alias("row"), "text")
    grams = map_rows(keyed, {"text": text_bytes()}, [T.StructField("grams", T.ArrayType(T.LongType(), False))], make, ["doc_id", "row"])
    places = grams.select("doc_id", "row", F.posexplode("grams").alias("place", "h"))
    hits = places.join(F.broadcast(template_table(docs.sparkSession, templates)), "h")
    # an accepted span holds so many hits within so many words; other documents have none
    limits = [least_hits(len(words(text.encode())), least_share(text)) for _, text in templates]
    need, reach = (F.element_at(F.array(*[F.lit(x[k]) for x in limits]), F.col("template") + 1) for k in (0, 1))
    hits = hits.groupBy("doc_id", "row", "template").agg(F.array_sort(F.collect_set(F.struct("place", "at"))).alias("own"))
    hits = hits.withColumn("at_all", F.array_distinct(F.transform("own", lambda x: x["place"])))
    near = F.exists(F.sequence(F.lit(1), F.size("at_all") - need + 1), lambda i: F.element_at("at_all", (i + need - 1).cast("int")) - F.element_at("at_all", i) <= reach)
    hits = hits.where(F.when(F.size("at_all") >= need, near).otherwise(False)).select("doc_id", "row", "template", F.inline("own"))
    votes = hits.groupBy("doc_id", "row", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("votes"))
    order = Window.partitionBy("doc_id", "row", "template").orderBy("diagonal")
    new = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= GAP, 0).otherwise(1)
    merged = votes.withColumn("new", new).withColumn("group", F.sum("new").over(order))
    spans = merged.groupBy("doc_id", "row", "template", "group").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return spans.groupBy("doc_id", "row").agg(F.collect_list(F.struct("template", F.col("first").cast("int").alias("first"), (F.col("last") + K).cast("int").alias("last"))).alias("spans"))


def verified(own: list[bytes], template: list[bytes], first: int, last: int, same: float = SAME) -> float:
    """The best share of the template's words that the span has in order, against the longer of both; 0 if it can't be ``same``."""
    n = len(template)
    best = 0.0
    # a merged span of a template that stands several times over is taken piece by piece
    # and a run may stand at either end of the template
    need, known = same * n, set(template)
    for a in range(max(0, first - n), last, max(1, n // 3)):
        part = own[a : min(a + n + n // 3 + 1, last + n)]
        if sum(w in known for w in part) < need:
            continue
        blocks = [b for b in SequenceMatcher(None, part, template, False).get_matching_blocks() if b.size]
        if blocks:
            length = blocks[-1].a + blocks[-1].size - blocks[0].a
            best = max(best, sum(b.size for b in blocks) / max(n, length))
    return best


def outdone(spans: list[dict]) -> list[dict]:
    """The spans but those of which at least half lies in a span of another label with a larger share."""

    def within(s: dict, o: dict) -> bool:
        return 2 * (min(s["last"], o["last"]) - max(s["first"], o["first"])) >= s["last"] - s["first"]

    best: list[dict] = []
    for s in sorted(spans, key=lambda s: (-s["share"], s["first"], s["label"])):
        if not any(o["label"] != s["label"] and o["share"] > s["share"] and (within(s, o) or within(o, s)) for o in best):
            best.append(s)
    return best


def base_places(own: list[bytes]) -> list[tuple[int, str]]:
    """(place, label) of each phrase, wherever it stands."""
    found = []
    joined = b" " + b" ".join(own) + b" "
    for phrase, label in PHRASES:
        p = b" " + phrase.encode() + b" "
        place, before, at = 0, 0, joined.find(p)
        while at >= 0:
            place, before = place + joined.count(b" ", before, at), at
            found.append((place, label))
            at = joined.find(p, at + 1)
    return found


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """A row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    score: 1 with a base phrase, else the best verified share; spans: the
    verified ones as (label, first word, end, share).
    """
    spans = shared_checkpoint(candidate_spans(docs, templates))
    few = (spans.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST_SPANS
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "spans")
    rows = docs.select("doc_id", "text", row_key().alias("row"))
    joined = rows.join(F.broadcast(spans) if few else spans, rows["doc_id"].eqNullSafe(spans["__id"]) & (rows["row"] == spans["__row"]), "left")
    names = [label for label, _ in templates]
    parts = [words(text.encode()) for _, text in templates]
    least = [least_share(text) for _, text in templates]

    def make():
        def fn(texts: pa.Array, spans: pa.Array):
            out = []
            for text, found in zip(texts.to_pylist(), spans.to_pylist()):
                own = words(text)
                base = base_places(own)
                kept = []
                for s in found or []:
                    share = verified(own, parts[s["template"]], s["first"], s["last"], least[s["template"]])
                    if share >= least[s["template"]]:
                        kept.append({"label": names[s["template"]], "first": s["first"], "last": s["last"], "share": share})
                kept = outdone(kept)
                places, labels = [p for p, _ in base], {x for _, x in base}
                every = sorted(labels | {s["label"] for s in kept})
                score = 1.0 if base else max((s["share"] for s in kept), default=0.0)
                out.append((len(own), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(every), score, sorted(kept, key=lambda s: (s["first"], s["label"]))))
            return tuple(zip(*out))

        return fn

    span = T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("share", T.DoubleType())])
    fields = [
        T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span)),
    ]
    return map_rows(joined, {"text": text_bytes(), "spans": F.col("spans")}, fields, make, ["doc_id"])
