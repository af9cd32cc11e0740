"""Pieces that the training-data operators share.

Rows go through Python by ``map_rows`` only: Arrow batches in, the kept columns
and the new ones out, no shuffle. An input column named like a new one (case
aside) gives way to it.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that are worked on at once in Python; Spark's own batches may hold more of them.
BATCH_ROWS = 1000
#: Links of a node beyond which it is a hub, and the share of all ends of links that makes one: there are under 1 / HUB_SHARE hubs.
HUB_LINKS, HUB_SHARE = 10_000, 1e-3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_bytes(name: str = "text") -> Column:
    """A text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(col(name), F.lit("")).cast("binary")


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold kept from training: crc32 of the id as text, modulo 5, is 0 (a null id: false)."""
    return F.coalesce(F.crc32(col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def without(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The columns of df that none of the names hides."""
    taken = {x.lower() for x in names}
    return [c for c in df.columns if c.lower() not in taken]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, without empty ones."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(
    df: DataFrame,
    inputs: dict[str, Column],
    outputs: Sequence[T.StructField],
    make: Callable[[], Callable[..., tuple[Sequence, ...]]],
    keep: Sequence[str] | None = None,
    where: str | None = None,
) -> DataFrame:
    """Append columns computed from Arrow arrays.

    ``make`` is called once a partition and gives a function from the input
    arrays to one sequence an output column. ``where`` names a boolean output
    that filters the rows and isn't returned itself.
    """
    kept = without(df, [f.name for f in outputs if f.name != where]) if keep is None else list(keep)
    names = [f"i{n}" for n in range(len(inputs))]
    # plain names inside: mapInArrow looks columns up by name, and theirs may hold dots
    src = df.select(*[col(c).alias(f"k{n}") for n, c in enumerate(kept)], *[x.alias(n) for n, x in zip(names, inputs.values(), strict=True)])
    shown = [f for f in outputs if f.name != where]
    inner = T.StructType([src.schema[f"k{n}"] for n in range(len(kept))] + [T.StructField(f"o{n}", f.dataType, f.nullable) for n, f in enumerate(shown)])
    n_kept = len(kept)
    order = [f.name for f in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        fn = make()
        kinds = {f.name: to_arrow_type(f.dataType) for f in outputs}
        for batch in sliced(batches):
            new = dict(zip(order, fn(*[batch.column(n_kept + i) for i in range(len(names))]), strict=True))
            arrays = [batch.column(i) for i in range(n_kept)] + [pa.array(new[f.name], kinds[f.name]) for f in shown]
            out = pa.RecordBatch.from_arrays(arrays, inner.names)
            if where:
                out = out.filter(pa.array(new[where], pa.bool_()))
            yield out

    return src.mapInArrow(run, inner).toDF(*kept, *[f.name for f in shown])


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local master may leave it unset; then it is a folder of our own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or "/tmp/checkpoints").rstrip("/")


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the folder that all executors share."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if not sc.getConf().get("spark.checkpoint.dir") and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"{folder}/{uuid.uuid4().hex}")
    return df.checkpoint(eager=True)


def shared_table(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """The same as a Parquet table in that folder: smaller than a checkpoint, for wide rows.

    The shuffles that made the table are removed as soon as it stands.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with _without_old_shuffles(spark):
        # small row groups, so that writers of wide rows hold little
        df.write.option("compression", codec).option("parquet.block.size", str(32 << 20)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove a table of ``shared_table`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def _without_old_shuffles(spark: SparkSession) -> Iterator[None]:
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", hub_links: int = HUB_LINKS) -> DataFrame:
    """(node, root): for each node of a link its component's smallest node.

    Alternates large-star and small-star steps until nothing changes, so rounds
    stay logarithmic. A hub never gathers its links in one place: its smallest
    neighbour is found by partial minima and goes to its links by broadcast
    (hubs have at least HUB_SHARE of all ends of links each, so there are few).
    Links with a null end or to themselves are left out.
    """
    x, y = col(a), col(b)
    star = edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    star = shared_checkpoint(star)
    sign = lambda d: tuple(d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = sign(star)
    while before[0]:
        most = max(hub_links, int(2 * before[0] * HUB_SHARE))
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if before[0] <= most:  # no node can be a hub; in one partition no step shuffles, and each exchange costs the driver a thread and memory that it keeps
            both, most = both.coalesce(1), 0
        large = _with_least(both, most).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        near = _with_least(large, most)
        small = near.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        star = shared_checkpoint(small.where("u != v").distinct())
        now = sign(star)
        if now == before:
            break
        before = now
    roots = star.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _with_least(links: DataFrame, most: int) -> DataFrame:
    """The links (u, v) with ``m``, the smallest v of each u; those of hubs (of more than ``most`` links, if that isn't 0) stay where they are."""
    if not most:
        return links.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > most).select("u", "m"))
    marked = links.join(hubs.withColumnRenamed("m", "hub"), "u", "left")
    rest = marked.where("hub is null").select("u", "v").join(least.where(F.col("n") <= most).select("u", "m"), "u")
    return marked.where("hub is not null").select("u", "v", F.col("hub").alias("m")).unionByName(rest)
