"""Roots of a forest by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeloom.session import cut


def roots(forest: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root) of every node. parent: null at a root. Takes the logarithm of the depth in rounds.

    A parent that is no node raises an error.
    """
    now = forest.select(F.col(node).alias("node"), F.coalesce(parent, node).alias("root"))
    now = cut(now)
    lost = now.join(now.select(F.col("node").alias("root")), "root", "left_anti")
    if not lost.isEmpty():
        raise ValueError(f"the parent {lost.first().root} is not in the table")
    while True:
        above = now.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        now = cut(now.join(above, "root").select("node", F.col("higher").alias("root"), (F.col("root") != F.col("higher")).alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("node", "root")
        now = now.drop("moved")
