"""Connected components by alternating star rounds, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsmith.llm.common import drop_table, write_table


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, component), the component being its least node.

    Every round hangs larger neighbours, then smaller ones, on the least neighbour of a node, until the edges are
    stars. Least neighbours are map-side combined; they are written before they are joined, so that both sides of the
    join are plain shuffles and Spark can split a node that has a large share of all edges. Nothing but a count and a
    checksum reaches the driver. Edges with a null end and loops are left out; nodes without other edges aren't returned.
    """
    current = write_table(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    seen = None
    while True:
        state = current.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = write_table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = write_table(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
                            "large")
        low = write_table(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        hung = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                                             F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        following = write_table(hung.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        for table in (current, least, large, low):
            drop_table(table)
        current = following
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
