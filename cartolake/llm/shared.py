"""What several operators need: tables in the cluster's shared folder, and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words, as the contracts define them.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
#: Rows of whole texts in an Arrow batch, where an operator sets it.
TEXTS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local master falls back on /tmp/checkpoints; a cluster has to set it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/cartolake"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, label: str, batch: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    With batch, Arrow batches hold at most so many rows while it is written, which bounds what a task has in memory beside its heap.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(_BATCH)
    if batch and not 0 < int(before) <= batch:
        spark.conf.set(_BATCH, batch)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    written = spark.read.schema(df.schema).parquet(path)
    written.shared_path = path  # for discard()
    return written


def discard(*written: DataFrame) -> None:
    """Remove tables of materialize() that nothing reads any more."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.shared_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def refuse(df: DataFrame, names: set[str] | list[str]) -> None:
    """Raise ValueError if df has a column of one of these names in any case: an operator's own columns would clash with it."""
    if taken := sorted({n.lower() for n in names} & {c.lower() for c in df.columns}):
        raise ValueError(f"rename the columns {taken} first")


def n_words(text: Column) -> Column:
    """Number of words; a null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Nodes of edges (u long, v long) with the smallest node of their component, as (u, root).

    Alternating large and small stars. Each round is a written table, so that its plan stays small and a lost executor costs one
    round; a node with many neighbours is the streamed side of an equi-join, which AQE splits. Nothing but two numbers a round goes
    to the driver. Self-loops and repeated edges are allowed; no edges give no rows.
    """
    def low(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    current = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    before = digest(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(low(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = low(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).distinct()
        current, old = materialize(small, label), current
        discard(old)
        after = digest(current)
        if after == before:
            break
        before = after
    return current.withColumnRenamed("v", "root").unionByName(current.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
