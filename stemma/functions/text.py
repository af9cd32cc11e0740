"""Extraction, normalisation and classification of version texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stemma.functions import patterns as P


def squish(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def found(x: Column, pattern: str, group: int = 1) -> Column:
    """A pattern's group, null without a match."""
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def first_filled(*xs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in xs])


# dates and keys


def date_int(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd").cast("int")


def int_date(x: Column) -> Column:
    """Eight-digit numbers as they are, all else null (decimal forms are cut)."""
    n = F.regexp_extract(F.trim(x), r"^(\d{8})(?:\.0*)?$", 1)
    return F.when(n == "", None).otherwise(n.cast("int"))


def act_type(x: Column) -> Column:
    return F.lower(F.regexp_replace(squish(x), r"[_ -]+", "."))


def folder_date(x: Column) -> Column:
    d = F.try_to_date(x, "yyyyMMdd")
    return F.when(F.date_format(d, "yyyyMMdd") == x, d)


def article_digits(partition_id: Column) -> Column:
    """The digits at an id's end."""
    return found(partition_id, r"(\d+)$")


def partition_of(version_id: Column, loose: bool = False) -> Column:
    """A version id without its version (``loose``: and all that follows it)."""
    return F.regexp_replace(version_id, r"_V[0-9]+.*$" if loose else r"_V\d+$", "")


def number_tag(number: Column) -> Column:
    """The first number with bis ... octies, lower-cased and hyphenated."""
    return F.regexp_replace(F.lower(found(number, P.NUMBER_TAG)), " ", "-")


def fingerprint(text: Column) -> Column:
    """Lower-cased a-z and digits; ``testo_mancante`` for null or empty texts."""
    cut = F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
    return F.when(text.isNull() | (text == ""), F.lit("testo_mancante")).otherwise(cut)


# classification


def _matches(x: Column, pattern: str) -> Column:
    held = [F.contains(x, F.lit(w)) for w in P.HOLDS[pattern]]
    some = held[0]
    for h in held[1:]:
        some = some | h
    return some & x.rlike(pattern)


def state(text: Column) -> Column:
    """ABROGATO, PARZIALMENTE_ABROGATO or ATTIVO."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    whole = t.rlike(P.REPEALED_ONLY) | F.substring(low, 1, 80).rlike(P.REPEALED_START)
    return F.when(whole, "ABROGATO").when(_matches(low, P.REPEALED_PART), "PARZIALMENTE_ABROGATO").otherwise("ATTIVO")


def change(text: Column, is_original: Column, state_: Column) -> Column:
    """The kind of change that a version brought."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    out = F.when(F.coalesce(is_original, F.lit(False)), "originale")
    out = out.when((state_ == "ABROGATO") & _matches(low, P.REPEALED_UNIT), "parzialmente_abrogato").when(state_ == "PARZIALMENTE_ABROGATO", "parzialmente_abrogato").when(state_ == "ABROGATO", "abrogazione")
    for pattern, kind in P.CHANGES:
        out = out.when(_matches(t if pattern == P.REPLACED else low, pattern), kind)
    return out.otherwise("modificato")


def realigned(kind: Column, is_current: Column) -> Column:
    return F.when(kind == "abrogazione", "ABROGATO").when(kind == "parzialmente_abrogato", "PARZIALMENTE ABROGATO").when(is_current, "ATTIVO").otherwise("STORICO")


def marked_repealed(text: Column, state_: Column) -> Column:
    return F.when(state_ == "ABROGATO", F.concat(F.lit(P.REPEALED_MARK), text)).otherwise(text)


def skipped_node(text: Column, title: Column) -> Column:
    """Texts under five characters and notes."""
    return F.coalesce(F.length(text) < 5, F.lit(True)) | F.coalesce(title.rlike(P.NOTE_TITLE), F.lit(False)) | F.coalesce(text.rlike(P.NOTE_TITLE), F.lit(False))


# references


def article_numbers(text: Column) -> Column:
    """All article numbers cited, each once, in order."""
    lists = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(P.ARTICLE_LIST), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0)))))


def urn_type(x: Column) -> Column:
    """An act type as URNs write it."""
    table = F.create_map(*[F.lit(v) for kv in P.ACT_TYPES.items() for v in kv])
    low = F.lower(x)
    bare = F.lower(F.regexp_replace(x, r"[._\-]", ""))
    return F.coalesce(F.try_element_at(table, low), F.try_element_at(table, bare), F.lower(F.regexp_replace(x, "([a-z])([A-Z])", "$1.$2")))


def _underscored(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, "_+", "_"), "^_|_$", "")


def _named(body, **values: Column) -> Column:
    """An expression of a struct of values each of which is worked out once a row, however often the expression uses it."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def fragment(f: Column) -> Column:
    """A fragment's normal form: an article, an annex, a plain id, or what is left of it."""
    low = F.lower(squish(F.coalesce(f, F.lit(""))))
    return _named(lambda x: _fragment(x["low"], x["art"]), low=low, art=F.regexp_extract(low, P.FRAGMENT_ARTICLE, 1))


def _fragment(low: Column, art: Column) -> Column:
    annex = P.FRAGMENT_ANNEX
    suffix = _underscored(F.regexp_replace(F.trim(F.regexp_extract(low, annex, 1)), r"[.\-\s]+", "_"))
    rest = _underscored(F.regexp_replace(F.regexp_replace(low, r"[\s\.]+", "_"), "[^a-z0-9_]", ""))
    out = F.when(low.isin("", "main", "!main"), "").when(art != "", F.concat(F.lit("art_"), F.regexp_replace(art, r"[.\-]", "_")))
    out = out.when(low.rlike(annex), F.concat(F.lit("allegato"), F.when(suffix != "", F.concat(F.lit("_"), suffix)).otherwise("")))
    return out.when(low.rlike("^[a-z][a-z0-9_]*$"), low).otherwise(rest)


def urn_of(href: Column) -> Column:
    """A reference as a URN with a normal fragment; unknown forms stay as they are."""
    h = F.regexp_replace(F.trim(href), "~", "#")
    parts = F.split(h, "#", 2)
    return _named(lambda x: _urn_of(x["h"], x["base"], x["frag"]), h=h, base=F.trim(F.get(parts, F.lit(0))), frag=F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))))


def _urn_of(h: Column, base: Column, frag: Column) -> Column:
    def joined(urn: Column, f: Column) -> Column:
        return _named(lambda x: F.concat(x["urn"], F.when(x["f"] != "", F.concat(F.lit("#"), x["f"])).otherwise("")), urn=urn, f=fragment(f))

    g = lambda p, i: F.regexp_extract(base, p, i)
    urn = F.concat(g(P.URN, 1), F.lit(":"), urn_type(g(P.URN, 2)), F.lit(":"), g(P.URN, 3), F.lit(";"), g(P.URN, 4))
    akn = F.concat(F.lit("urn:nir:stato:"), urn_type(g(P.AKN, 1)), F.lit(":"), g(P.AKN, 3), F.lit(";"), g(P.AKN, 4))
    inner = F.regexp_replace(g(P.AKN, 5), "^!?main/?", "")
    out = F.when(F.coalesce(h, F.lit("")) == "", None).when(base.rlike(P.URN), joined(urn, frag)).when(base.startswith("urn:nir"), base)
    return out.when(base.rlike(P.AKN), joined(akn, F.when(frag != "", frag).otherwise(inner))).otherwise(h)


def law_urn(href: Column) -> Column:
    """The law that a passive reference names, as a URN; null for other forms."""
    g = lambda i: F.regexp_extract(href, P.LAW_HREF, i)
    return F.when(g(1) != "", F.concat(F.lit("urn:nir:"), F.lower(g(2)), F.lit(":"), F.lower(F.regexp_replace(g(1), "_", ".")), F.lit(":"), g(3), F.lit(";"), g(4)))


def node_id(e_id: Column, opening: Column) -> Column:
    """struct(id, label, method) of an article: by its id, by its text, by a leading number, else by a checksum."""
    own = F.regexp_replace(F.lower(F.trim(e_id)), r"[\s\-]+", "_")
    num = found(own, r"(\d+(?:_[a-z]+)?)", 1)
    text = F.coalesce(opening, F.lit(""))
    art = F.regexp_extract(text, r"(?i)art(?:icolo|\.)?\s*(\d+(?:[\-\.][a-z0-9]+)?)", 1)
    lead = F.regexp_extract(F.trim(text), r"^(\d+(?:[\-][a-z]+)?)\.?", 1)
    check = F.lpad(F.lower(F.hex(F.crc32(text.cast("binary")))), 8, "0")
    made = lambda a, b, c: F.struct(a.alias("id"), b.alias("label"), F.lit(c).alias("method"))
    says = F.concat
    return (
        F.when(F.coalesce(own, F.lit("")) != "", made(own, F.coalesce(says(F.lit("Art. "), F.regexp_replace(num, "_", "-")), own), "strutturale"))
        .when(art != "", made(says(F.lit("art_"), F.regexp_replace(art, r"[\-\.]", "_")), says(F.lit("Art. "), art), "testuale"))
        .when(lead != "", made(says(F.lit("disp_"), F.regexp_replace(lead, "-", "_")), says(F.lit("Disp. "), lead), "testuale_disp"))
        .otherwise(made(says(F.lit("art_hash_"), check), says(F.lit("Art. ["), check, F.lit("]")), "hash"))
    )


def _id_part(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"[\s-]+", "_"))


def annex_id(name: Column) -> Column:
    """``all_`` and the first 60 characters of the name."""
    return F.concat(F.lit("all_"), F.substring(_id_part(first_filled(name, F.lit("allegato"))), 1, 60))


def annex_label(name: Column) -> Column:
    return F.initcap(F.substring(squish(first_filled(name, F.lit("all_generico"))), 1, 80))


def annex_parent(id_: Column) -> Column:
    """The annex that an annex part's id belongs to; null for a whole annex."""
    return F.when(id_.rlike(P.ANNEX_PART), F.regexp_replace(id_, P.ANNEX_PART_TAIL, ""))


def paragraph_id(e_id: Column, pos: Column) -> Column:
    """The id of a loose paragraph; without one of its own, by its place in the file (from 1)."""
    return F.concat(F.lit("par_"), _id_part(_paragraph(e_id, pos)))


def _paragraph(e_id: Column, pos: Column) -> Column:
    return first_filled(e_id, F.concat(F.lit("par_"), pos.cast("string")))


def paragraph_label(e_id: Column, pos: Column) -> Column:
    return F.concat(F.lit("Par. "), _paragraph(e_id, pos))


def modification(kind: Column, new_text: Column, by_text: tuple[tuple[str, str], ...]) -> Column:
    """What a modification does: by its declared kind, else by words of the new text, else ``modifica``."""
    out = F.when(F.lit(False), "")
    for x, rules in ((kind, P.MODIFICATION_KINDS), (new_text, by_text)):
        for word, what in rules:
            out = out.when(F.contains(F.lower(F.coalesce(x, F.lit(""))), F.lit(word)), what)
    return out.otherwise("modifica")


# texts


def without_second_half(text: Column) -> Column:
    """A text whose second half repeats the first is cut to the first; at most 100,000 characters."""
    n = F.length(text)
    half = squish(F.substring(text, F.lit(1), F.floor(n / 2).cast("int")))
    tail = squish(F.substring(text, F.floor(n / 2).cast("int") + 1, n))
    return F.substring(F.when((n > 20) & (F.length(half) > 10) & F.startswith(tail, half), half).otherwise(text), 1, 100000)


def sentences_once(text: Column) -> Column:
    """The text's sentences without those whose first 80 characters (case and spaces aside) have come before."""
    parts = F.split(F.regexp_replace(text, r"([.;!?])\s+", "$1\n"), "\n+")
    parts = F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    key = lambda s: F.substring(F.regexp_replace(F.lower(s), r"\s+", " "), 1, 80)
    # sorted by key, the first of each key is the one whose neighbour differs
    keyed = F.array_sort(F.transform(parts, lambda s, i: F.struct(key(s).alias("k"), i.alias("i"), s.alias("s"))))
    none = F.array(F.struct(F.lit(None).cast("string").alias("k"), F.lit(None).cast("int").alias("i"), F.lit(None).cast("string").alias("s")))
    pairs = F.transform(F.array(keyed), lambda a: F.zip_with(a, F.concat(none, a), lambda x, p: F.struct(x["i"].alias("i"), x["s"].alias("s"), (x.isNotNull() & ~F.equal_null(x["k"], p["k"])).alias("new"))))
    kept = F.array_sort(F.filter(F.flatten(pairs), lambda x: x["new"]))
    return F.when(F.length(text) < 50, text).otherwise(F.array_join(F.transform(kept, lambda x: x["s"]), " "))


def embedding_text(number: Column, short: Column, common: Column, named: Column, alias: Column, title: Column, start: Column, end: Column, kind: Column, status: Column, text: Column) -> Column:
    """What a version is embedded by: number and act, names, validity, change, text; one paragraph each."""
    tag = first_filled(short, alias, common, named, title)
    head = F.when(F.coalesce(number, F.lit("")) != "", F.concat_ws(" ", number, tag))
    names = F.array_sort(F.array_distinct(F.filter(F.array(common, named, alias), lambda x: F.coalesce(x, F.lit("")) != "")))
    until = (
        F.when(status == "ABROGATO", F.when(end != P.OPEN_END, F.concat(F.lit("abrogato, valido fino al "), end)).otherwise("abrogato"))
        .when(status == "STORICO", F.concat(F.lit("storico, fino al "), end))
        .otherwise(F.when(end == P.OPEN_END, "in vigore").otherwise(F.concat(F.lit("fino al "), end)))
    )
    valid = F.when((F.coalesce(start, F.lit("")) != "") & (F.coalesce(end, F.lit("")) != ""), F.concat(F.lit("Vigente dal "), start, F.lit(" "), until))
    changed = F.when((F.coalesce(kind, F.lit("")) != "") & (kind != "originale"), F.concat(F.lit("Tipo modifica: "), kind))
    parts = F.concat(F.array(head), names, F.array(valid, changed, text))
    return F.array_join(F.filter(parts, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), "\n\n")
