"""Connected components of an edge table, by hooking to smaller neighbours and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, root being its component's smallest node.

    Each round hooks every node to its smallest neighbour, follows pointers until they are
    flat and contracts the edges; every component with an edge at least halves, so rounds
    are logarithmic. All tables are distributed and checkpointed, and none is ever broadcast: the
    planner would judge them by estimates. Loops and null ends are ignored.
    """
    pairs = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    pairs = checkpointed(pairs.filter("u < v").distinct())
    labels = None
    while not pairs.isEmpty():
        both = pairs.select(F.col("u").alias("node"), F.col("v").alias("near")).union(pairs.select("v", "u"))
        hooks = both.groupBy("node").agg(F.min("near").alias("near"))
        up = checkpointed(hooks.select("node", F.least("node", "near").alias("root")))
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            up = checkpointed(up.join(above.hint("merge"), "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.coalesce("above", "root") < F.col("root")).alias("moved")))
            moved = not up.filter("moved").isEmpty()
            up = up.drop("moved")
            if not moved:
                break
        to = up.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        tv = up.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        next_pairs = pairs.join(to.hint("merge"), "u").join(tv.hint("merge"), "v").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
        pairs = checkpointed(next_pairs.filter("u < v").distinct())
        if labels is None:
            labels = up
        else:
            step = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            labels = checkpointed(labels.join(step.hint("merge"), "root", "left").select("node", F.coalesce("above", "root").alias("root")))
    if labels is None:
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels
