"""Connected components of a table of links, by contraction.

Every node that has a smaller neighbour hooks on its smallest one; following these pointers, doubled
in every step, leads to the local minima. Links are then drawn between those and the next round
starts with what is left of the graph. A path of n nodes needs log2(n) joins, no component is ever
gathered, and every step is written to the staging folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histloom.operators.staging import stage


def _roots(pointers: DataFrame) -> DataFrame:
    """(node, root) from (node, parent), whose parents are smaller than their nodes."""
    while True:
        up = pointers.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        doubled = pointers.join(up, "parent", "left")
        moved = F.col("above").isNotNull()
        pointers = stage(
            doubled.select("node", F.coalesce("above", "parent").alias("parent"), moved.alias("moved")),
            "pointers",
        )
        if pointers.filter("moved").isEmpty():
            return pointers.select("node", F.col("parent").alias("root"))
        pointers = pointers.drop("moved")


def _drawn(links: DataFrame) -> DataFrame:
    """Distinct links from the larger to the smaller end, without loops."""
    ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return ends.filter("a > b").distinct()


def _renamed(links: DataFrame, roots: DataFrame, end: str) -> DataFrame:
    named = roots.select(F.col("node").alias(end), "root")
    joined = links.join(named, end, "left")
    return joined.withColumn(end, F.coalesce("root", end)).drop("root")


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of ``links`` (a, b) with the smallest node of its component."""
    links = stage(_drawn(links), "links")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    found = nodes.withColumn("root", F.col("node"))
    while not links.isEmpty():
        hooks = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        roots = _roots(stage(hooks, "hooks"))
        links = stage(_drawn(_renamed(_renamed(links, roots, "a"), roots, "b")), "links")
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
        joined = found.join(up, "root", "left")
        found = stage(joined.select("node", F.coalesce("above", "root").alias("root")), "roots")
    return found
