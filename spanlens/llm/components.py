"""Connected components of links, by star contractions over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b: bigint); ``root`` is the smallest node reachable.

    Alternates two steps until nothing changes: each node hands its larger neighbours to the smallest one it
    sees, then each node ties its smaller neighbours and itself to the smallest. The number of rounds grows
    with the logarithm of the longest chain. The smallest neighbour is a partial aggregate and comes back by a
    join on the node, so a hub is split like any skewed join. Every round is written, nothing is collected but
    one row with the number of edges and a checksum. Self links make single nodes; no links give no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    alone = edges.where("u = v").select(F.col("u").alias("node"))
    edges = staged(edges.where("u <> v").distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("w"), F.least("u", "low").alias("low"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low")).withColumnRenamed("u", "w")
        small = large.join(low, F.col("u") == F.col("w"))
        tied = small.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = staged(tied.unionByName(low.select(F.col("w").alias("u"), F.col("low").alias("v"))).distinct(), "edges")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")))
    found = found.unionByName(alone.select("node", F.col("node").alias("root")))
    return found.groupBy("node").agg(F.min("root").alias("root"))
