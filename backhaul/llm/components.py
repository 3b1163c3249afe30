"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backhaul.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Columns ``node`` and ``root`` for every node of ``edges`` (columns a and b).

    Two nodes have the same root if a path of edges joins them; the root is one of the nodes.
    Each round points every node at the neighbour, or itself, that comes first in one fixed
    random order, and moves the edges to where their ends point. Chains and stars both shrink by
    a factor a round. A hub's edges meet in a join that adaptive execution splits, and its
    minimum is taken in parts. Nothing but a count per round reaches the driver.
    """
    steps: list[DataFrame] = []
    current = scratch.keep(edges.select("a", "b").filter("a <> b").distinct())
    while not current.isEmpty():
        def rank(column: str):
            return F.struct(F.xxhash64(column).alias("rank"), F.col(column).alias("node"))

        ends = current.select("a", "b").union(current.select(F.col("b"), F.col("a")))
        step = scratch.keep(
            ends.groupBy(F.col("a").alias("node"))
            .agg(F.min(rank("b")).alias("first"))
            .select("node", F.least(F.col("first"), rank("node"))["node"].alias("root")))
        steps.append(step)

        def moved(column: str) -> DataFrame:
            return step.select(F.col("node").alias(column), F.col("root").alias(f"{column}_root"))

        following = scratch.keep(
            current.join(moved("a"), "a").select("a_root", "b").distinct()
            .join(moved("b"), "b")
            .filter("a_root <> b_root")
            .select(F.least("a_root", "b_root").alias("a"),
                    F.greatest("a_root", "b_root").alias("b")).distinct())
        scratch.drop(current)
        current = following
    if not steps:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    result = steps[-1]
    for step in reversed(steps[:-1]):
        later = result.select(F.col("node").alias("root"), F.col("root").alias("final"))
        result = (step.join(later, "root", "left")
                  .select("node", F.coalesce("final", "root").alias("root")))
    final = scratch.keep(result)
    scratch.drop(*steps)
    return final
