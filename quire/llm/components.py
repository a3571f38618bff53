"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


#: Bytes of an edge.
EDGE = 16


def connected_components(edges: DataFrame, folder: str, most: int = 60, rows: int | None = None) -> DataFrame:
    """edges: columns a, b (long, any order, no nulls). Returns node, component (its smallest node) for every node with an edge.

    Large-star hangs each larger neighbour of a node onto the smallest node near it, small-star the
    smaller ones; they alternate until nothing changes, when every node hangs onto its component's
    smallest. A hot node is one key of a join whose other side has one row for it, which Spark
    splits, and of an aggregation that sums up before it shuffles. Each round is written to the
    shared folder; only its count and checksum go to the driver. rows: a bound of the edges, if known.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, at, before = written(now, folder, "edges-0", rows and rows * EDGE), 0, None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        if at == most:
            raise RuntimeError(f"components did not settle in {most} rounds")
        before, at = state, at + 1
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        now = written(small.distinct(), folder, f"edges-{at}", 2 * state[0] * EDGE)
        if at > 1:
            remove(now.sparkSession, f"{folder}/edges-{at - 2}")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
