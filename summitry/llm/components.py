"""Connected components of a link table by contraction, without any driver-side graph.

Each round points every node at its least neighbour, follows the pointers to
their roots, and contracts the links to links between roots; the number of nodes
with links at least halves.  Tables go through the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node with a link; root is the least node of its component.

    ``links`` has the long columns a and b; self-links and repeats do no harm.
    """
    edges = scratch.gather(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{name}-edges-0")
    maps: list[DataFrame] = []
    step = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root"))
        up = scratch.gather(up, f"{name}-up-{step}-0")
        jump = 0
        while True:
            higher = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            new = up.join(higher, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.coalesce("above", "root") != F.col("root")).alias("moved"))
            jump += 1
            new = scratch.gather(new, f"{name}-up-{step}-{jump}")
            moved = not new.where("moved").isEmpty()
            up = new.drop("moved")
            if not moved:
                break
        maps.append(up)
        step += 1
        at = lambda side: up.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))  # noqa: B023, E731
        edges = edges.join(at("a"), "a").join(at("b"), "b").select(F.col("root_a"), F.col("root_b")).where("root_a <> root_b")
        edges = scratch.gather(edges.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), f"{name}-edges-{step}")
    if not maps:
        return links.sparkSession.createDataFrame([], "node long, root long")
    found = maps[0]
    for later in maps[1:]:
        found = found.join(later.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return scratch.gather(found, f"{name}-found")
