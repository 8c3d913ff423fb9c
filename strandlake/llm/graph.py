"""Connected components by distributed contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the smallest node that it reaches.

    Each round points every node at its smallest neighbour, follows the pointers once more, and relabels
    the edges by them; edges within a label go.  Every component at least halves in a round, so there are
    logarithmically many.  Aggregates combine before they shuffle; the joins on a label that many nodes
    point at are sort-merge joins, whose large partitions adaptive execution splits.
    """
    spark = edges.sparkSession
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", narrow=True)
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "point", narrow=True)
        hop = point.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        point = materialise(point.join(hop, "to").select("node", F.col("to2").alias("to")), "hop", narrow=True)
        maps.append(point)
        left = point.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = point.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(left, "a").join(right, "b").where("ta <> tb")
        edges = materialise(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges", narrow=True)
    if not maps:
        return spark.createDataFrame([], "node long, comp long")
    out = maps[0].select("node", F.col("to").alias("comp"))
    for later in maps[1:]:
        step = later.select(F.col("node").alias("comp"), F.col("to").alias("next"))
        out = out.join(step, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp"))
    return materialise(out, "components", narrow=True)
