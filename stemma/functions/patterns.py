"""Word lists, patterns and look-up tables of the legal domain."""

# Patterns over a version's text.
REPEALED_START = r"^\s*\(*(articolo|capo|titolo|sezione)?\s*abrogato.*"
REPEALED_PART = r"(comma|lettera|parole|numero|\(\(.*\)).*abrogato.*"
REPEALED_ONLY = r"(?i)^\s*\(*abrogat[oa]\)*\s*\.?\s*$"
REPEALED_UNIT = r"(comma|lettera|numero|punto|alinea)\s+[^\s]+\s+abrogat"
SUPPRESSED = r"è\s+soppress[oa]|sono\s+soppress[ei]"
REPLACED = r"\(\("
ADDED = r"è\s+aggiunto|sono\s+aggiunti|è\s+inserito|sono\s+inseriti"
DEROGATED = r"\bderoga\b|\bin\s+deroga\s+a\b|non\s+si\s+applicano\s+le\s+disposizioni"
EXTENDED_TERM = r"termine.*prorogato|termini.*prorogati|differito\s+al"
SUSPENDED = r"efficacia.*sospesa|sospeso\s+fino\s+al"
INTERPRETED = r"si\s+interpreta\s+nel\s+senso\s+che|interpretazione\s+autentica"
WIDENED = r"si\s+applicano\s+anche|estend[e|o|ono]\s+l'applicabilità|estes[oa]\s+a"
NOTE_TITLE = r"(?i)^\s*(nota|note)\b"
FOLDER = r"(?i)^([A-Z][A-Z_ -]+?)_(\d{8})_(\d+)$"
ARTICLE_LIST = r"(?i)\b(?:artt?\.?|articoli?)\s*([0-9]+(?:\s*(?:,|e|ed)\s*[0-9]+)*)"

# Change types after the repeals, in the order they are tried; the second asks for the text as it is.
CHANGES = (
    (SUPPRESSED, "soppressione"),
    (REPLACED, "sostituzione"),
    (ADDED, "integrazione"),
    (DEROGATED, "deroga"),
    (EXTENDED_TERM, "proroga"),
    (SUSPENDED, "sospensione"),
    (INTERPRETED, "interpretazione_autentica"),
    (WIDENED, "estensione"),
)

#: Words one of which any match of the pattern holds; looked for first, as that is many times cheaper.
HOLDS = {
    REPEALED_PART: ("abrogato",),
    REPEALED_UNIT: ("abrogat",),
    SUPPRESSED: ("soppress",),
    REPLACED: ("((",),
    ADDED: ("aggiunt", "inserit"),
    DEROGATED: ("deroga", "disposizioni"),
    EXTENDED_TERM: ("prorogat", "differito"),
    SUSPENDED: ("sospes",),
    INTERPRETED: ("interpreta",),
    WIDENED: ("anche", "estend", "estes"),
}

# Act types by their spellings.
ACT_TYPES = {
    "decretolegislativo": "decreto.legislativo",
    "declegg": "decreto.legislativo",
    "decreto": "decreto.legislativo",
    "decretolegge": "decreto.legge",
    "decleg": "decreto.legge",
    "legge": "legge",
    "regiodecreto": "regio.decreto",
    "codice.civile": "regio.decreto",
    "codicecivile": "regio.decreto",
    "codice.penale": "regio.decreto",
    "codicepenale": "regio.decreto",
    "codice.navigazione": "regio.decreto",
    "codicenavigazione": "regio.decreto",
    "codice.procedura.civile": "regio.decreto",
    "codiceproceduraciville": "regio.decreto",
    "codice.procedura.penale": "regio.decreto",
    "codiceprocedurapenale": "regio.decreto",
    "decretodelpresidentedellarepubblica": "decreto.del.presidente.della.repubblica",
    "dpr": "decreto.del.presidente.della.repubblica",
    "decretoministeriare": "decreto.ministeriale",
    "dm": "decreto.ministeriale",
    "direttiva.ue": "direttiva.ue",
    "direttivaue": "direttiva.ue",
    "direttiva.ce": "direttiva.ue",
    "direttivace": "direttiva.ue",
}

# The 40 main acts by type, date and number: common name and short code.
MAIN_ACTS = (
    ("regio.decreto:1930-10-19;1398", "Codice Penale", "c.p."),
    ("regio.decreto:1940-10-28;1443", "Codice di Procedura Civile", "c.p.c."),
    ("regio.decreto:1941-02-20;303", "Codice Penale Militare di Guerra", "c.p.m.g."),
    ("regio.decreto:1941-09-09;1023", "Codice Penale Militare di Pace", "c.p.m.p."),
    ("regio.decreto:1941-12-18;1368", "Disposizioni attuazione codice di procedura civile", "disp. att. c.p.c."),
    ("regio.decreto:1942-03-16;262", "Codice Civile", "c.c."),
    ("regio.decreto:1942-03-30;318", "Disposizioni attuazione codice civile", "disp. att. c.c."),
    ("regio.decreto:1942-03-30;327", "Codice della Navigazione", "cod. nav."),
    ("decreto.del.presidente.della.repubblica:1952-02-15;328", "Regolamento esecuzione Codice Navale", "reg. cod. nav."),
    ("decreto.del.presidente.della.repubblica:1973-03-29;156", "Codice postale e telecomunicazioni", "cod. post."),
    ("decreto.del.presidente.della.repubblica:1988-09-22;447", "Approvazione codice procedura penale", "c.p.p. 1988"),
    ("decreto.del.presidente.della.repubblica:1992-12-16;495", "Regolamento esecuzione codice della strada", "reg. c.d.s."),
    ("decreto.del.presidente.della.repubblica:2010-10-05;207", "Regolamento esecuzione contratti pubblici", "reg. contr. pubbl."),
    ("decreto.legislativo:1989-07-28;271", "Norme attuazione codice procedura penale", "norme att. c.p.p."),
    ("decreto.legislativo:1992-04-30;285", "Nuovo Codice della Strada", "c.d.s."),
    ("decreto.legislativo:1992-12-31;546", "Disposizioni sul processo tributario", "d.lgs. 546/92"),
    ("decreto.legislativo:2003-06-30;196", "Codice della Privacy", "cod. privacy"),
    ("decreto.legislativo:2003-08-01;259", "Codice delle comunicazioni elettroniche", "c.c.e."),
    ("decreto.legislativo:2004-01-22;42", "Codice dei beni culturali", "cod. beni cult."),
    ("decreto.legislativo:2005-02-10;30", "Codice della proprietà industriale", "c.p.i."),
    ("decreto.legislativo:2005-03-07;82", "Codice dell'amministrazione digitale", "c.a.d."),
    ("decreto.legislativo:2005-07-18;171", "Codice della nautica da diporto", "cod. nautica"),
    ("decreto.legislativo:2005-09-06;206", "Codice del consumo", "cod. consumo"),
    ("decreto.legislativo:2005-09-07;209", "Codice delle assicurazioni private", "cod. ass."),
    ("decreto.legislativo:2006-04-03;152", "Norme in materia ambientale", "d.lgs. 152/06"),
    ("decreto.legislativo:2006-04-11;198", "Codice pari opportunità", "cod. parità"),
    ("decreto.legislativo:2006-04-12;163", "Codice dei contratti pubblici", "cod. appalti"),
    ("decreto.legislativo:2010-03-15;66", "Codice Ordinamento Militare", "c.o.m."),
    ("decreto.legislativo:2010-07-02;104", "Codice del processo amministrativo", "c.p.a."),
    ("decreto.legislativo:2011-05-23;79", "Codice della normativa statale", "d.lgs. 79/11"),
    ("decreto.legislativo:2011-09-06;159", "Codice delle leggi antimafia", "c.a.m."),
    ("decreto.legislativo:2016-04-18;50", "Codice appalti 2016", "d.lgs. 50/16"),
    ("decreto.legislativo:2016-08-26;174", "Codice della Giustizia Contabile", "c.g.c."),
    ("decreto.legislativo:2017-07-03;117", "Codice Terzo Settore", "c.t.s."),
    ("decreto.legislativo:2018-01-02;1", "D.Lgs. 1/2018", "d.lgs. 1/18"),
    ("decreto.legislativo:2019-01-12;14", "D.Lgs. 14/2019", "d.lgs. 14/19"),
    ("decreto.legislativo:2023-03-31;36", "Codice appalti 2023", "d.lgs. 36/23"),
    ("decreto.legislativo:2025-11-27;184", "Riordino normativo settoriale", "d.lgs. 184/25"),
    ("decreto:1989-09-30;334", "D.M. esecuzione c.p.p.", "d.m. 334/89"),
    ("decreto:2010-01-13;33", "D.M. attuazione contratti", "d.m. 33/10"),
)

# Names of codes in questions and their short codes; the first that occurs wins. Those written with signs stand between non-word characters.
ABBREVIATIONS = (
    (r"c\.p\.", "c.p."), (r"c\.c\.", "c.c."), (r"c\.p\.c\.", "c.p.c."), (r"c\.p\.p\.", "c.p.p. 1988"), (r"c\.d\.s\.", "c.d.s."), (r"c\.o\.m\.", "c.o.m."),
    (r"c\.g\.c\.", "c.g.c."), (r"c\.p\.i\.", "c.p.i."), (r"c\.a\.d\.", "c.a.d."), (r"c\.p\.m\.p\.", "c.p.m.p."), (r"c\.p\.m\.g\.", "c.p.m.g."),
)
NAMES = (
    (r"(?:^|\W)cod\.?\s*nav\.", "cod. nav."),
    (r"(?:^|\W)cod\.?\s*post\.", "cod. post."),
    ("disposizioni per l'attuazione del codice civile", "disp. att. c.c."),
    ("disposizioni attuazione codice civile", "disp. att. c.c."),
    ("disp. att. c.c.", "disp. att. c.c."),
    ("disposizioni per l'attuazione del codice di procedura civile", "disp. att. c.p.c."),
    ("disposizioni attuazione codice di procedura civile", "disp. att. c.p.c."),
    ("disposizioni attuazione procedura civile", "disp. att. c.p.c."),
    ("disp. att. c.p.c.", "disp. att. c.p.c."),
    ("regolamento di esecuzione ed attuazione del codice dei contratti pubblici", "reg. contr. pubbl."),
    ("regolamento esecuzione attuazione contratti pubblici", "reg. contr. pubbl."),
    ("regolamento esecuzione contratti pubblici", "reg. contr. pubbl."),
    ("codice dei contratti pubblici (abrogato 2006)", "cod. appalti 2006"),
    ("codice dei contratti pubblici abrogato 2006", "cod. appalti 2006"),
    ("codice dei contratti pubblici (abrogato 2016)", "cod. appalti 2016"),
    ("codice dei contratti pubblici abrogato 2016", "cod. appalti 2016"),
    ("codice della proprietà industriale", "c.p.i."),
    ("proprietà industriale", "c.p.i."),
    ("regolamento per l'esecuzione del codice della navigazione", "reg. cod. nav."),
    ("regolamento esecuzione codice della navigazione", "reg. cod. nav."),
    ("regolamento esecuzione codice navigazione", "reg. cod. nav."),
    ("regolamento di esecuzione e attuazione del codice della strada", "reg. c.d.s."),
    ("regolamento di esecuzione del codice della strada", "reg. c.d.s."),
    ("regolamento esecuzione attuazione codice della strada", "reg. c.d.s."),
    ("regolamento esecuzione codice della strada", "reg. c.d.s."),
    ("reg. c.d.s.", "reg. c.d.s."),
    ("regolamento contratti pubblici", "reg. contr. pubbl."),
    ("reg. contr. pubbl.", "reg. contr. pubbl."),
    ("norme di attuazione del codice di procedura penale", "norme att. c.p.p."),
    ("norme di attuazione e di coordinamento del codice di procedura penale", "norme att. c.p.p."),
    ("norme attuazione coordinamento codice procedura penale", "norme att. c.p.p."),
    ("norme att. c.p.p.", "norme att. c.p.p."),
    ("norme attuazione procedura penale", "norme att. c.p.p."),
    ("disposizioni attuazione penale", "norme att. c.p.p."),
    ("codice penale militare di pace", "c.p.m.p."),
    ("codice penale militare di guerra", "c.p.m.g."),
    ("codice penale militare", "c.p.m.p."),
    ("codice della navigazione", "cod. nav."),
    ("navigazione marittima", "cod. nav."),
    ("navigazione aerea", "cod. nav."),
    ("codice penale", "c.p."),
    ("codice civile", "c.c."),
    ("codice di procedura civile", "c.p.c."),
    ("codice di procedura penale", "c.p.p. 1988"),
    ("codice della strada", "c.d.s."),
    ("codice postale", "cod. post."),
    ("codice delle telecomunicazioni", "cod. post."),
    ("telecomunicazioni", "cod. post."),
    ("bancoposta", "cod. post."),
    ("ordinamento militare", "c.o.m."),
    ("codice ordinamento militare", "c.o.m."),
    ("codice di giustizia contabile", "c.g.c."),
    ("giustizia contabile", "c.g.c."),
    ("proprieta industriale", "c.p.i."),
    ("codice proprieta industriale", "c.p.i."),
    ("amministrazione digitale", "c.a.d."),
    ("codice amministrazione digitale", "c.a.d."),
    ("codice del consumo", "cod. consumo"),
    ("consumo", "cod. consumo"),
    ("codice delle assicurazioni", "cod. ass."),
    ("assicurazioni private", "cod. ass."),
    ("codice della nautica", "cod. nautica"),
    ("nautica da diporto", "cod. nautica"),
    ("privacy", "cod. privacy"),
    ("protezione dei dati", "cod. privacy"),
    ("codice in materia di dati personali", "cod. privacy"),
    ("beni culturali e del paesaggio", "cod. beni cult."),
    ("codice dei beni culturali", "cod. beni cult."),
    ("beni culturali", "cod. beni cult."),
    ("paesaggio", "cod. beni cult."),
    ("processo tributario", "d.lgs. 546/92"),
    ("contenzioso tributario", "d.lgs. 546/92"),
    ("regolamento codice della strada", "reg. c.d.s."),
    ("comunicazioni elettroniche", "c.c.e."),
    ("codice delle comunicazioni", "c.c.e."),
    ("processo amministrativo", "c.p.a."),
    ("codice del processo amministrativo", "c.p.a."),
    ("ricorso al tar", "c.p.a."),
    ("terzo settore", "cod. terzo set."),
    ("codice del terzo settore", "cod. terzo set."),
    ("protezione civile", "cod. prot. civ."),
    ("codice della protezione civile", "cod. prot. civ."),
    ("crisi d'impresa", "cod. crisi imp."),
    ("crisi di impresa", "cod. crisi imp."),
    ("insolvenza", "cod. crisi imp."),
    ("codice antimafia", "cod. antimafia"),
    ("leggi antimafia", "cod. antimafia"),
    ("misure di prevenzione", "cod. antimafia"),
    ("codice del turismo", "cod. turismo"),
    ("turismo", "cod. turismo"),
    ("pari opportunita", "cod. pari opp."),
    ("codice delle pari opportunita", "cod. pari opp."),
    ("ambiente", "cod. amb."),
    ("codice dell'ambiente", "cod. amb."),
    ("norme in materia ambientale", "cod. amb."),
    (r"codice dei contratti pubblici\s*\(abrogato\s*2006\)", "cod. appalti 2006"),
    (r"codice dei contratti pubblici\s*abrogato\s*2006", "cod. appalti 2006"),
    ("codice dei contratti pubblici 2006", "cod. appalti 2006"),
    ("codice appalti 2006", "cod. appalti 2006"),
    ("codice merloni", "cod. appalti 2006"),
    (r"codice dei contratti pubblici\s*\(abrogato\s*2016\)", "cod. appalti 2016"),
    (r"codice dei contratti pubblici\s*abrogato\s*2016", "cod. appalti 2016"),
    ("codice dei contratti pubblici 2016", "cod. appalti 2016"),
    ("codice appalti 2016", "cod. appalti 2016"),
    (r"codice dei contratti pubblici\s*\(vigente\)", "cod. contr. pubbl. 2023"),
    ("codice dei contratti pubblici 2023", "cod. contr. pubbl. 2023"),
    ("nuovo codice degli appalti", "cod. contr. pubbl. 2023"),
    ("codice appalti 2023", "cod. contr. pubbl. 2023"),
    ("codice dei contratti pubblici", "cod. contr. pubbl. 2023"),
    ("contratti pubblici", "cod. contr. pubbl. 2023"),
    ("appalti pubblici", "cod. contr. pubbl. 2023"),
    ("appalti", "cod. contr. pubbl. 2023"),
    ("codice medico", "cod. medico"),
    ("decreto 33", "d.m. 33/2010"),
    ("d.m. 33", "d.m. 33/2010"),
    ("decreto 334", "d.m. 334/1989"),
    ("d.m. 334", "d.m. 334/1989"),
)

# Words that ask for the law in force (found anywhere, inside longer words too), for the literal text, for a history.
NOW_WORDS = ("vigente", "oggi", "attuale", "corrente", "attualmente", "in vigore", "adesso", "ora", "correntemente", "al momento")
TEXT_WORDS = ("testo", "cosa dice", "cosa prevede", "riporta", "trascrivi", "copia", "letteralmente", "testualmente", "come recita", "dispone")
HISTORY_WORDS = (
    "come è cambiato", "come è cambiata", "come è evoluto", "come è evoluta", "come si è evoluta", "come si è evoluto", "come è mutato", "come è mutata",
    "come ha cambiato", "come è variato", "come è variata", "evoluzione", "storia delle modifiche", "ha subito modifiche", "dalla sua emanazione",
    "dalla riforma", "nel corso degli anni", "quante versioni", "storia di", "modifiche nel tempo", "nel tempo",
)
HISTORY_FORMS = (r"come\s+(?:era|è|e')\s+(?:disciplinat|regolat|previst).+\s+(?:nel\s+tempo|dal\s+\d{4}|nel\s+corso)", r"come\s+(?:è|e')\s+evolu")

# Words of answers that speak of amending laws and of earlier versions, and the mark of an answer without sources.
LAW_WORDS = ("modificat", "sostitu", "abrocat", "novell", "riformat")
VERSION_WORDS = ("vigente dal", "fino al", "versione", "storico", "precedente")
NO_SOURCES = "FONTI_NON_SUFFICIENTI"

# Words without a theme.
STOP_WORDS = (
    "come", "era", "la", "il", "lo", "le", "i", "gli", "una", "uno", "un", "nel", "nella", "nei", "nelle", "del", "della", "dei", "delle",
    "dal", "dalla", "dai", "dalle", "al", "alla", "ai", "alle", "di", "da", "in", "su", "per", "con", "tra", "fra", "che", "ad", "ed",
    "questo", "questa", "questi", "queste", "quello", "quella", "agli", "degli", "sulle", "sullo", "sul", "nello",
    "regolata", "disciplinata", "cambiato", "cambiata", "evoluta", "evoluto", "prima", "dopo", "tempo", "oggi", "sino", "fino", "corso", "anni",
    "testo", "originario", "originale", "vigente", "qual", "sono", "stato", "stata", "stati", "state", "essere", "avere", "fare",
)

# Time windows in a lower-cased question, in the order they are tried: pattern, start, end ({n}: its n-th year, {n-}: the year before).
ORIGINAL, CURRENT = "ORIGINALE", "IS_CURRENT"
OPEN_START, OPEN_END = "19000101", "99991231"
WINDOWS = (
    (r"(?:norm|test[oa]|version[ei]|formulazion[ei]|testo)\s+original(?:e|i|ia|ario)", ORIGINAL, ORIGINAL),
    (r"original(?:e|io|ari[ao])\s+del\s+\d{4}", ORIGINAL, ORIGINAL),
    (r"(?:nel\s+)?testo\s+originari[oa]", ORIGINAL, ORIGINAL),
    (r"prima\s+della?\s+(?:riforma|novella|modifica|revisione|legge)\s+(?:del\s+)?(\d{4})", OPEN_START, "{1-}1231"),
    (r"(?:previgente|ante[- ]riforma)\s+(?:al?|del)?\s*(\d{4})", OPEN_START, "{1-}1231"),
    (r"(?:tra\s+(?:il\s+)?|dal?\s+)(\d{4})\s+(?:e\s+(?:il\s+)?|al?\s+)(\d{4})", "{1}0101", "{2}1231"),
    (r"dal?\s+(\d{4})\s+(?:ad?\s+oggi|fino\s+ad?\s+oggi|a\s+oggi)", "{1}0101", OPEN_END),
    (r"(?:dopo\s+il|successiv[oa]\s+al?|a\s+partire\s+dal?|dal?)\s+(\d{4})", "{1}0101", OPEN_END),
    (r"nel(?:l['\s]+anno|\s+corso\s+del)?\s+(\d{4})", "{1}0101", "{1}1231"),
    (r"(?:prima\s+del|anteriore\s+al?|fino\s+al?|antecedente\s+al?|sino\s+al?)\s+(\d{4})", OPEN_START, "{1-}1231"),
    (r"(?:entrata\s+in\s+vigore|promulgazione|emanazione).*?(\d{4})", "{1}0101", "{1}1231"),
)
YEARS = r"(?:nel|da[l]?|de[l]|a[l]|prima\s+del|dopo\s+il|fino\s+al|sino\s+al)\s+(\d{4})"
ARTICLE_ASKED = r"art(?:icolo)?\s*\.?\s*(\d+(?:[\-](?:bis|ter|quater|quinquies|sexies|septies|octies))?)"
NUMBER_TAG = r"(?i)(\d+(?:[\-\s](?:bis|ter|quater|quinquies|sexies|septies|octies))?)"
CODE_NAME = r"(?i)\bcodice\s+\w+(?:\s+(?:civile|penale|procedura|strada|navigazione))?\b"


def code_patterns(plain: bool = False) -> list[tuple[str, str]]:
    """All names of codes as patterns, in order; abbreviations stand between signs that are in no word of any script.

    ``plain``: the same for engines without look-around, with ASCII words only.
    """
    edges = (r"(?:^|[^\w])", r"(?:$|[^\w])") if plain else (r"(?U)(?<![\w])", r"(?![\w])")
    return [(edges[0] + p + edges[1], code) for p, code in ABBREVIATIONS] + list(NAMES)

# Parts of annexes by their ids, and kinds of modification.
ANNEX_PART = r"_(art|art\.|preambolo|par|sez|comma)_"
ANNEX_PART_TAIL = r"_(art|art\.|preambolo|par|sez|comma)_?[0-9a-zA-Z._-]+$"
MODIFICATION_KINDS = (("insertion", "inserimento"), ("substitution", "sostituzione"), ("repeal", "abrogazione"))
RECEIVED_WORDS = (("abrogat", "abrogazione"), ("soppresso", "soppressione"))
MADE_WORDS = (*RECEIVED_WORDS, ("sostituito", "sostituzione"), ("aggiunto", "inserimento"))

# Forms of references.
URN = r"^(urn:nir:[^:]+):([^:]+):([^;]+);(.+)$"
AKN = r"^/akn/[^/]+/act/([^/]+)/([^/]+)/([0-9]{4}(?:-[0-9]{2}-[0-9]{2})?)/([^/!#]+)(?:[/!](.+))?$"
LAW_HREF = r"/akn/it/act/([^/]+)/([^/]+)/([0-9]{4}-[0-9]{2}-[0-9]{2})/([^/]+)/!main"
FRAGMENT_ARTICLE = r"art(?:icolo)?[\._]?\s*([0-9]+(?:[_\.\-][a-z0-9]+)?)"
FRAGMENT_ANNEX = r"allegat[oa]?[\._\s]?([0-9a-z._\-]*)"
REPEALED_MARK = "[NORMA ABROGATA] "
# Types in the names of graph columns, and a column by its later name.
COLUMN_TYPE = r"(:DATE|:INT|:ID\([^)]+\))$"
COLUMN_NAMES = {"stato_temporale": "stato_vigenza"}
