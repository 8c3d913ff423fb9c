"""A run as a stream: ranges of fragment ordinals come in, their reads are appended.

Draws are stateless, so a micro-batch needs no state store, batches may come in any order or size, and a
batch that is run again (after a lost executor or driver) writes the same rows to the same place: each
batch owns one folder, named by its id and replaced as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

RANGE = "first long, last long"


def split_ranges(spark: SparkSession, total: int, size: int) -> DataFrame:
    """(first, last) of consecutive ranges that cover 0..total-1."""
    starts = spark.range(0, total, size)
    return starts.select(F.col("id").alias("first"), F.least(F.col("id") + size - 1, F.lit(total - 1)).alias("last"))


def run(spark: SparkSession, ranges: str, reads: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 1) -> StreamingQuery:
    """Read range files as they arrive; ``reads`` turns the ordinals of a batch into its rows.

    ``files_per_batch`` bounds what is in flight.  The stream ends when nothing is left (available now).
    """
    stream = spark.readStream.schema(RANGE).option("maxFilesPerTrigger", files_per_batch).parquet(ranges)
    ordinals = stream.select(F.explode(F.sequence("first", "last")).alias("ordinal"))

    def write(batch: DataFrame, batch_id: int) -> None:
        reads(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return ordinals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
