"""Connected components of a link table, in a number of rounds logarithmic in their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histloom.llm.common import stage


def _both_ways(links: DataFrame) -> DataFrame:
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return links.unionByName(turned)


def _stars(links: DataFrame) -> DataFrame:
    """Hang every node on the smallest node it sees: first larger neighbours, then smaller ones."""
    near = _both_ways(links)
    low = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    larger = (
        near.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    )
    larger = larger.filter("a > b").distinct()
    lowest = larger.groupBy("a").agg(F.min("b").alias("low"))
    hung = larger.join(lowest, "a").select(
        F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"),
        F.col("low").alias("b"),
    )
    return hung.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b): every linked node but the smallest of its component, with that smallest node.

    ``links`` holds pairs of comparable ids in columns a and b, in any direction. No component is
    gathered anywhere; each round is written to the staging folder, so a lost executor costs tasks.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = stage(pairs.filter("a > b").distinct(), "links")
    seen = None
    while True:
        # Equal sums of row hashes two times running: nothing moved any more.
        mark = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
        ).first()
        if mark[0] == 0 or mark == seen:
            return links
        seen = mark
        links = stage(_stars(links), "links")
