"""Short rows of our own that reach every branch of the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEXTS = (
    "Testo nella prima stesura.",
    "(abrogato)",
    "Articolo abrogato dalla legge seguente",
    "Il comma 3 è stato abrogato.",
    "Capo abrogato; comma 2 abrogato di recente",
    "La lettera b) è soppressa.",
    "((Il nuovo testo vale da domani))",
    "Dopo il primo comma è aggiunto il seguente.",
    "In deroga a quanto detto sopra si procede.",
    "Il termine di cui sopra è prorogato di un anno.",
    "L'efficacia resta sospesa.",
    "La norma si interpreta nel senso che vale per tutti.",
    "Le regole si applicano anche alle isole.",
    "Vedi artt. 3, 4 e 12 e l'articolo 7 oltre a art. 3.",
)
QUESTIONS = (
    "Qual era il testo originale dell'art. 5 del codice civile?",
    "Versione originaria del 1942 della norma",
    "Cosa diceva nel testo originario?",
    "Come era prima della riforma del 1975 la famiglia?",
    "Testo previgente al 1990 sulle locazioni",
    "Che cosa valeva tra il 1950 e il 1960 per i marittimi?",
    "Come vale l'articolo 12-bis c.p. dal 1970 ad oggi?",
    "Che regole dopo il 1980 per il codice della strada?",
    "Quale pena nel 1931 secondo il codice penale?",
    "Che valeva fino al 1990 nel codice della navigazione?",
    "Testo alla entrata in vigore nel lontano 1865",
    "Cosa prevede oggi l'art. 2043 c.c.?",
    "Non è ancora chiaro chi risponde",
    "Come è cambiato l'art. 3 nel tempo?",
    "Come era disciplinata la locazione dal 1978?",
    "Riporta il testo dell'art. 1950 nel 1950",
    "Che dice il codice dei contratti pubblici (abrogato 2006) sugli appalti?",
)
ANSWERS = (
    "L'Art. 5 dice questo, l'art. 99-bis altro; versione vigente dal 1990.",
    "Norma modificata dalla legge; art. 7 e art. 12.",
    "FONTI_NON_SUFFICIENTI",
    "Si consiglia di verificare la fonte.",
)
SOURCES = (("5", "Art. 5", "Il testo parla dell'articolo 12."), ("8", "Art. 8", "Altro testo."))
FILES = (
    "/a/X_ORIGINALE_.xml", "/a/X_VIGENZA_1995-01-01_V2.xml", "/a/X_VIGENZA_1996-03-01_V3.xml", "/a/X_VIGENZA_1996-03-01_V10.xml", "/b/X_VIGENZA_1996-03-01_V3.xml", "/a/rotto.xml",
)
FOLDERS = ("REGIO DECRETO_19420316_262", "Decreto_Legislativo_20050307_82", "LEGGE_19900807_241", "LEGGE_19901307_241", "senza numero")


def values(rows, numbered: bool = False) -> str:
    """The rows for a VALUES list; numbered from -1 downwards."""
    quoted = ["'" + r.replace("'", "''") + "'" for r in rows]
    return ", ".join(f"(-{i}, {q})" if numbered else f"({q})" for i, q in enumerate(quoted, 1))


def frame(spark: SparkSession, rows, name: str, numbered: bool = False) -> DataFrame:
    if numbered:
        return spark.createDataFrame([(-i, r) for i, r in enumerate(rows, 1)], f"id long, {name} string")
    return spark.createDataFrame([(r,) for r in rows], f"{name} string")
