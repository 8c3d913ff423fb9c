"""Cutting lineage between rounds of a loop."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(rows: DataFrame) -> DataFrame:
    """``rows``, written once to the folder named by ``spark.checkpoint.dir``, which all executors share.

    Only a session on one machine (a test) without that setting gets a temporary folder; elsewhere it is an error.
    """
    spark = rows.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            found = tempfile.mkdtemp(prefix="strandlake-")
        context.setCheckpointDir(found)
    return rows.checkpoint()
