"""Connected components of an edge table, by hooking and pointer jumping on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Columns u, v in; node, root out: for every node of an edge, the smallest node it can reach.

    Each round hooks every node to its smallest neighbour, shortens the resulting trees to their
    roots by pointer jumping, and contracts the edges to roots. Nodes at least halve per round.
    Minima are combined before the shuffle, and joins are by unique keys on one side, so a hub of
    any degree is split by adaptive execution. Null ends and loops are ignored.
    """
    live = edges.filter("u is not null and v is not null and u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    live = scratch.save(live, "edges")
    total: DataFrame | None = None
    while live.limit(1).count():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        tree = scratch.save(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")), "tree")
        while True:
            up = tree.select(F.col("u").alias("p"), F.col("p").alias("q"))
            jumped = scratch.save(tree.join(up, "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "jump")
            moved = jumped.filter("moved").limit(1).count()
            scratch.drop(tree)
            tree = jumped
            if not moved:
                break
        tree = tree.select("u", "p")
        if total is None:
            new_total = tree.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            new_total = total.join(tree.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        new_total = scratch.save(new_total, "roots")
        a, b = tree.select("u", F.col("p").alias("a")), tree.select(F.col("u").alias("v"), F.col("p").alias("b"))
        new_live = live.join(a, "u").join(b, "v").filter("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        new_live = scratch.save(new_live, "edges")
        scratch.drop(jumped, live, *([total] if total is not None else []))
        live, total = new_live, new_total
    if total is None:
        total = live.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return total
