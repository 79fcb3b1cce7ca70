"""Connected components of an edge table, by rounds of large-star and small-star steps.

Each round every node's larger neighbours, then its smaller ones, move to its smallest neighbour, so
the edges turn into stars whose centre is the smallest node; rounds grow with the logarithm of the
longest path. A node's smallest neighbour is aggregated before the shuffle and written to the shared
folder, so that the join back to the edges is a plain one that adaptive execution splits where one
node has a third of all edges. Nothing is collected but the counts that tell when to stop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Stage


def _star(edges: DataFrame, stage: Stage, name: str, large: bool) -> DataFrame:
    """Edges (a > b) after one step, not distinct."""
    around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        around = around.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = stage.keep(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
    moved = around.filter("v > u") if large else around
    moved = moved.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a <> b")


def components(edges: DataFrame, stage: Stage, name: str = "cc") -> DataFrame:
    """(node, root) of every node of the edges (columns a, b, of one orderable type, either way round).

    root is the smallest node of the component; a root's own row is there too. Null ends and loops
    are ignored.
    """
    now = stage.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    k = 0
    while True:
        k += 1
        wide = stage.keep(_star(now, stage, f"{name}-l{k}", True).distinct(), f"{name}-w{k}")
        after = stage.keep(_star(wide, stage, f"{name}-s{k}", False).distinct(), f"{name}-{k}")
        # stars: no centre is itself a leaf, and no leaf has two centres
        if after.select("b").distinct().join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty() and after.groupBy("a").count().filter("count > 1").isEmpty():
            break
        for old in (f"{name}-l{k}", f"{name}-w{k}", f"{name}-s{k}", f"{name}-{k - 1}"):
            stage.drop(old)
        now = after
    roots = after.select(F.col("b").alias("node")).distinct()
    return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
