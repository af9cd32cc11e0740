"""What a question asks for and what an answer holds, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from stemma.functions import patterns as P


def _filled(template: str, year) -> list:
    """A template's literal and year parts."""
    out = []
    for lit, n, before in re.findall(r"([^{]*)(?:\{(\d)(-?)\})?", template):
        if lit:
            out.append(("lit", lit))
        if n:
            out.append(("before" if before else "year", int(n)))
    return out


def window(question: Column) -> Column:
    """struct(start, end): dates as YYYYMMDD, or the original or current text; the first rule that matches."""
    d = F.lower(question)

    def made(pattern: str, template: str) -> Column:
        parts = []
        for kind, x in _filled(template, None):
            if kind == "lit":
                parts.append(F.lit(x))
            else:
                y = F.regexp_extract(d, pattern, x)
                parts.append(y if kind == "year" else (y.cast("int") - 1).cast("string"))
        return F.concat(*parts)

    both = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    out = None
    for pattern, start, end in P.WINDOWS:
        value = both(made(pattern, start), made(pattern, end))
        out = F.when(d.rlike(pattern), value) if out is None else out.when(d.rlike(pattern), value)
    now = _any(d, P.NOW_WORDS)
    return out.when(now, both(F.lit(P.CURRENT), F.lit(P.CURRENT))).otherwise(both(F.lit(P.OPEN_START), F.lit(P.OPEN_END)))


def _any(x: Column, words) -> Column:
    hit = x.contains(words[0])
    for w in words[1:]:
        hit = hit | x.contains(w)
    return hit


def years(question: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit(P.YEARS), F.lit(1))))


def short_code(question: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """The short code of the first name that the question has; else null."""
    d = F.lower(question)
    return F.coalesce(*[F.when(d.rlike(p), F.lit(code)) for p, code in rules or P.code_patterns()])


def article(question: Column) -> Column:
    """The article number asked for, unless it is a year of the question."""
    d = F.lower(question)
    n = F.regexp_extract(d, P.ARTICLE_ASKED, 1)
    return F.when((n != "") & ~F.array_contains(years(question), F.regexp_extract(n, r"^\d+", 0)), n)


def asks_text(question: Column, number: Column) -> Column:
    return number.isNotNull() & _any(F.lower(question), P.TEXT_WORDS)


def asks_history(question: Column) -> Column:
    d = F.lower(question)
    out = _any(d, P.HISTORY_WORDS)
    for p in P.HISTORY_FORMS:
        out = out | d.rlike(p)
    return out


def themes(question: Column, prefix: Column | None = None) -> Column:
    """The words that carry the question's theme; the question itself if none does."""
    q = F.regexp_replace(F.regexp_replace(question, P.CODE_NAME, ""), r"\b\d{4}\b", "")
    words = F.regexp_extract_all(F.lower(q), F.lit(r"[a-zA-Z\x{00C0}-\x{024F}']+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*P.STOP_WORDS) & (F.length(w) > 3))
    out = F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(question)
    return out if prefix is None else F.when(prefix.isNotNull(), F.concat(prefix, F.lit(" "), out)).otherwise(out)


def answer_features(answer: Column) -> dict[str, Column]:
    """Length, words, citations, and words that speak of amending laws, of earlier versions, of missing sources or of doubt."""
    a = F.coalesce(answer, F.lit(""))
    low = F.lower(a)
    return {
        "n_chars": F.length(a).cast("long"),
        "n_words": F.size(F.filter(F.split(a, r"\s+"), lambda w: w != "")).cast("long"),
        "cites_laws": _any(low, P.LAW_WORDS),
        "cites_versions": _any(low, P.VERSION_WORDS),
        "n_citations": F.size(F.regexp_extract_all(a, F.lit(r"[Aa]rt\."), F.lit(0))).cast("long"),
        "says_no_sources": a.contains(P.NO_SOURCES),
        "warns": a.contains("⚠") | low.contains("verificare"),
    }


def unsupported_articles(answer: Column, sources: Column) -> Column:
    """Sorted article numbers cited in the answer that no source (array of number, label, text) has; a text counts by its first 300 characters."""
    cited = F.array_sort(F.array_distinct(F.regexp_extract_all(answer, F.lit(r"[Aa]rt\.\s*(\d+(?:[\-][a-z]+)?)"), F.lit(1))))
    blank = lambda x: F.coalesce(x, F.lit(""))

    def held(n: Column) -> Column:
        base = F.regexp_extract(n, r"^\d+", 0)
        return F.exists(sources, lambda s: F.contains(blank(s["number"]), base) | F.contains(blank(s["label"]), base) | F.contains(F.substring(blank(s["text"]), 1, 300), base))

    return F.filter(cited, lambda n: ~held(n))
