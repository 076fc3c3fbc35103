"""Connected components of an edge table by joins, with alternating hooking and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.storage import Scratch, write_table


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node of its component.

    Each round links every node's larger neighbours to its smallest one, then every node's smaller neighbours to its
    smallest one, until nothing changes; the number of rounds grows with the logarithm of the number of nodes. A
    node's neighbours are never gathered: both steps are a minimum for each node, joined back to the edges. The minima
    are written before they are joined: Spark then broadcasts them while their files are small, and beyond that
    splits a node of very many edges over tasks, which it can't do with an aggregate still in the join's own stage.
    Edges with a null end and loops tell nothing. Each round is written to the shared folder; what a later round has replaced is deleted.
    """
    rows = edges.where("u IS NOT NULL AND v IS NOT NULL AND u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    with Scratch(edges.sparkSession) as scratch:
        rows = scratch.write(rows, "components")
        seen = None
        for _ in range(max_rounds):
            # large step: neighbours above a node go to the smallest of its neighbours and itself
            both = rows.select("u", "v").unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "components")
            large = scratch.write(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "components")
            # small step: a node and its smaller neighbours go to the smallest of these
            lowest = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), "components")
            small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            rows = scratch.write(small.select("e.*").where("u != v").distinct(), "components")
            # the edges' number and two sums of their hashes: equal when a round has changed nothing
            sums = [F.sum(F.xxhash64(F.lit(k), "u", "v").cast("decimal(38,0)")) for k in (0, 1)]
            before, seen = seen, rows.agg(F.count("*"), *sums).first()
            if seen == before:
                break
            scratch.drop(keep=1)
        else:
            raise RuntimeError("components did not settle")
        roots = rows.select("v").distinct()
        return write_table(rows.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root"))), "roots")
