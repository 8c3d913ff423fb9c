"""Small shared helpers: durable intermediate tables and input handling."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: ``spark.checkpoint.dir``.

    Only a session on one machine (a test) that has none gets a temporary folder; elsewhere that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_SWEPT: set[str] = set()


def _own_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/strandlake/{spark.sparkContext.applicationId}"
    if path not in _SWEPT:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
        _SWEPT.add(path)
    return path


def materialise(df: DataFrame, tag: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts lineage and survives lost executors: later stages reread files, not recompute Python.
    narrow: rows of a few numbers, which are first rebalanced to files of a useful size.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{uuid.uuid4().hex}/{tag}"
    held = spark.conf.get(_BATCH, None)
    # Texts are long: small Arrow batches bound the memory outside the heap.
    spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        (df.hint("rebalance") if narrow else df).write.parquet(path)
    finally:
        spark.conf.set(_BATCH, held) if held else spark.conf.unset(_BATCH)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark whatever the file system is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under names that no other column of the input can clash with."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def crc_bucket(col, modulus: int):
    """crc32 of the id as decimal text, modulo ``modulus``."""
    return F.crc32(col.cast("string").cast("binary")) % modulus
