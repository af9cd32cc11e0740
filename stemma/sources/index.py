"""Search documents from version records, and the full and current tables they go to."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.functions import patterns as P
from stemma.functions.text import embedding_text, first_filled, int_date, number_tag, partition_of
from stemma.operators.temporal import FAR_INTS

#: Columns of a record; missing ones are empty.
RECORD = (
    "versione_id", "partizione_id", "URN_base", "num_versione", "numero", "titolo_atto", "nome_comune_atto", "codice_breve_atto", "denominazione_comune", "alias_codice",
    "atto_appartenenza", "stato_vigenza", "stato_norma", "tipo_modifica", "testo_puro", "valido_dal", "valido_al",
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, or JSON lines whose record may stand in ``v``; all columns as strings."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    x = spark.read.option("primitivesAsString", True).json(path)
    if "v" not in x.columns:
        return x
    inner = x.schema["v"].dataType.names
    return x.select(*[F.coalesce(F.col(f"v.`{n}`"), F.col(f"`{n}`")) if n in x.columns else F.col(f"v.`{n}`").alias(n) for n in inner], *[c for c in x.columns if c != "v" and c not in inner])


def clean_columns(df: DataFrame) -> DataFrame:
    """Column names of the graph's CSV without their types, by their later names; ``stato_vigenza`` is there in any case."""
    names = [re.sub(P.COLUMN_TYPE, "", c) for c in df.columns]
    out = df.toDF(*[P.COLUMN_NAMES.get(c, c) for c in names])
    return out if "stato_vigenza" in out.columns else out.withColumn("stato_vigenza", F.lit(None).cast("string"))


def write_graph(tables: dict[str, DataFrame], path: str) -> list[str]:
    """Each table as CSV in a folder of its name; empty ones are left out, and named in the result."""
    empty = []
    for name, df in tables.items():
        held = df.persist()
        try:
            if held.isEmpty():
                empty.append(name)
            else:
                write_csv(held, f"{path}/{name}")
        finally:
            held.unpersist()
    return empty


def write_partial(rows: DataFrame, path: str, by: str = "act") -> None:
    """A table in parts, one folder an act; a part that is written again replaces its own folder only."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


QUESTIONS = "domanda string, tipo string, rilevanti array<struct<numero_puro string, codice_breve_atto string, grado int, valido_dal_raw int, valido_al_raw int, min_versioni int>>"


def read_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Question sets (JSON arrays) as (file, qid, question, kind) and their criteria (file, qid, number, code, grade, from, to, versions); qid counts from 1 in each file."""
    x = spark.read.schema(f"{QUESTIONS}").option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    # a file is read by one task in order, so the rows' growing numbers keep its order
    w = Window.partitionBy("file").orderBy("__at")
    x = x.withColumn("__at", F.monotonically_increasing_id()).withColumn("qid", F.row_number().over(w)).drop("__at")
    c = x.select("file", "qid", F.explode("rilevanti").alias("c"))
    criteria = c.select("file", "qid", F.col("c.numero_puro").alias("number"), F.col("c.codice_breve_atto").alias("code"), F.col("c.grado").alias("grade"), F.col("c.valido_dal_raw").alias("from"), F.col("c.valido_al_raw").alias("to"), F.col("c.min_versioni").alias("versions"))
    return x.select("file", "qid", F.col("domanda").alias("question"), F.col("tipo").alias("kind")), criteria


def create_table(spark: SparkSession, path: str, like: DataFrame, force: bool = False) -> bool:
    """An empty table with the columns of another; one that is there stays unless forced. True if it was made."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not force and there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return False
    like.limit(0).write.mode("overwrite").parquet(path)
    return True


def read_partials(spark: SparkSession, paths: list[str], key: str | None = None) -> DataFrame:
    """CSV tables joined by column name, missing columns null; one row a key (or each row once)."""
    out: DataFrame | None = None
    for p in paths:
        x = spark.read.option("header", True).csv(p)
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out.dropDuplicates([key] if key else None)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("nullValue", "").option("emptyValue", "").csv(path)


def documents(records: DataFrame, embed: Column | None = None) -> DataFrame:
    """The search documents of the records; those without a version id are left out.

    ``embed`` is the vector column of a model; by default there is none.
    """
    have = {c.lower(): c for c in records.columns}
    c = {n: F.coalesce(F.col(f"`{have[n.lower()]}`").cast("string"), F.lit("")) if n.lower() in have else F.lit("") for n in RECORD}
    name = first_filled(*[c[n] for n in ("codice_breve_atto", "alias_codice", "nome_comune_atto", "denominazione_comune", "titolo_atto")])
    aliases = F.array_sort(F.array_distinct(F.filter(F.array(c["alias_codice"], c["denominazione_comune"], c["nome_comune_atto"]), lambda x: x != "")))
    out = {
        "versione_id": c["versione_id"],
        "partizione_id": first_filled(c["URN_base"], c["partizione_id"], partition_of(c["versione_id"])),
        "num_versione": F.coalesce(F.expr("try_cast(`num_versione` as int)"), F.lit(0)) if "num_versione" in have else F.lit(0),
        "numero": c["numero"],
        "numero_puro": number_tag(c["numero"]),
        "title": F.trim(F.concat_ws(" ", c["numero"], name)),
        "titolo_atto": c["titolo_atto"],
        "nome_comune_atto": c["nome_comune_atto"],
        "codice_breve_atto": c["codice_breve_atto"],
        "denominazione_comune": c["denominazione_comune"],
        "atto_appartenenza": c["atto_appartenenza"],
        "stato_vigenza": c["stato_vigenza"],
        "stato_norma": c["stato_norma"],
        "tipo_modifica": c["tipo_modifica"],
        "testo_puro": c["testo_puro"],
        "aliases": aliases,
        "valido_dal_raw": int_date(c["valido_dal"]),
        "valido_al_raw": F.coalesce(int_date(c["valido_al"]), F.lit(FAR_INTS[0])),
        "is_current": c["stato_vigenza"] == "VIGENTE",
        "embedding_text": embedding_text(*[c[n] for n in ("numero", "codice_breve_atto", "nome_comune_atto", "denominazione_comune", "alias_codice", "titolo_atto", "valido_dal", "valido_al", "tipo_modifica", "stato_vigenza", "testo_puro")]),
        "embedding": F.lit(None).cast("array<float>") if embed is None else embed,
    }
    return records.select(*[v.alias(k) for k, v in out.items()]).where("versione_id <> ''")


def with_current(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.withColumn("is_current", F.col(status) == "VIGENTE")


def split_current(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows, and those in force."""
    return rows, rows.where("is_current")


def upserted(old: DataFrame, new: DataFrame, key: str = "versione_id") -> DataFrame:
    """The old rows with new ones in place of those of equal key."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def write_dual(rows: DataFrame, all_path: str, current_path: str, mode: str = "errorifexists") -> None:
    """All rows to one table, split by ``is_current`` so that either is read alone, and those in force to another."""
    whole, now = split_current(rows)
    whole.write.mode(mode).partitionBy("is_current").parquet(all_path)
    # from the table just written, so that the rows aren't made twice
    written = rows.sparkSession.read.schema(rows.schema).parquet(all_path) if mode != "append" else now
    written.where("is_current").select(*rows.columns).write.mode(mode).parquet(current_path)
