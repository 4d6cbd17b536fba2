"""Connected components of a graph whose edges stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import dropped, staged


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the component's smallest node.

    Each round every node picks its smallest neighbour; of two that pick each other the smaller is a
    root (longer circles can't be), pointers are followed up to the roots by doubling, and the edges
    are drawn anew between the roots. A round at least halves the nodes that have edges, and the
    smallest node of a component stays the root of its tree. Minima are aggregated before they are
    shuffled; all joins are of a table with one row per node, and none is followed by an aggregate on
    its own key, so that the rows of a node with many edges can be split. Each step's table is written
    to the shared folder and deleted after its last reader.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    e = staged(e, "components-edges")
    labels = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pick = staged(both.groupBy("u").agg(F.min("v").alias("p")), "components-picks")
        back = pick.select(F.col("u").alias("p"), F.col("p").alias("theirs"))
        root = F.when((F.col("theirs") == F.col("u")) & (F.col("u") < F.col("p")), F.col("u")).otherwise(F.col("p"))
        up = staged(pick.join(back, "p").select("u", root.alias("r")), "components-up")
        dropped(pick)
        while True:
            above = up.select(F.col("u").alias("r"), F.col("r").alias("r2"))
            twice = above.join(above.select(F.col("r").alias("r2"), F.col("r2").alias("r4")), "r2").select("r", "r4")
            higher = staged(up.join(twice, "r").select("u", F.col("r4").alias("r"), (F.col("r") != F.col("r4")).alias("moved")), "components-up")
            dropped(up)
            up = higher.select("u", "r")
            if higher.filter("moved").isEmpty():
                break
        if labels is None:
            new = staged(up.select(F.col("u").alias("node"), F.col("r").alias("root")), "components")
        else:
            to = up.select(F.col("u").alias("root"), "r")
            new = staged(labels.join(to, "root", "left").select("node", F.coalesce("r", "root").alias("root")), "components")
            dropped(labels)
        labels = new
        drawn = e.join(up.withColumnRenamed("r", "ru"), "u").join(up.select(F.col("u").alias("v"), F.col("r").alias("rv")), "v")
        drawn = drawn.select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v")).filter("u > v").distinct()
        rest = staged(drawn, "components-edges")
        dropped(up)
        dropped(e)
        e = rest
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")) if labels is None else labels
