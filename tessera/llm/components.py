"""Connected components of a graph given as edges, by label passing with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, own: Scratch, label: str = "components") -> DataFrame:
    """node, component (its smallest node) for every node of the edges (a, b); a table of ``own``.

    A round gives each node the smallest label beside it, then its label's label; the
    rounds grow with the logarithm of the longest path in practice. Each round is a
    written table, and the one before is deleted."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = own.table(both, f"{label}-edges", gather=True)
    now = own.table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), f"{label}-0", gather=True)
    n = 0
    while True:
        n += 1
        beside = both.join(now, both["b"] == now["node"]).groupBy("a").agg(F.min("component").alias("beside"))
        step = now.join(beside, now["node"] == beside["a"], "left").select("node", F.col("component").alias("was"), F.least("component", "beside").alias("component"))
        jump = now.select(F.col("node").alias("via"), F.col("component").alias("further"))
        new = step.join(jump, step["component"] == jump["via"], "left").select("node", "was", F.least("component", "further").alias("component"))
        new = own.table(new, f"{label}-{n}", gather=True)
        moved = new.where("component <> was").limit(1).count()
        own.drop(f"{label}-{n - 1}")
        now = new.select("node", "component")
        if not moved:
            own.drop(f"{label}-edges")
            return now
