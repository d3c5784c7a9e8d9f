"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlens.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): for each id in an edge (a, b) the smallest id it can reach.

    A step hangs every id below the smallest neighbour it has. Per id only a minimum is gathered, which partial
    aggregation shrinks first; the joins send single rows back, so the centre of a star may have any degree. Each step is
    written to the shared folder; the driver sees one row, a count and a checksum.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    pairs = scratch.table(edges.where("a <> b").select(high.alias("u"), low.alias("v")).distinct(), "edges-0")
    seen, step = None, 0
    while True:
        mark = pairs.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(mark) == seen:
            break
        seen, step = tuple(mark), step + 1
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(smallest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: neighbours below u, and u itself, hang below the smallest of them.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = scratch.table(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), f"edges-{step}")
        scratch.drop(f"edges-{step - 1}")
    roots = pairs.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
