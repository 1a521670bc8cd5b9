"""The property graph: merging emissions, counting, neighbourhoods, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .snapshot import first_by

ORDER = ["pass_seq", "file_seq", "pos"]


def merge_nodes(emitted: DataFrame) -> DataFrame:
    """One row an id: the first emission wins; later ones fill in meta keys it lacks.

    emitted has ``pass_seq``, ``file_seq`` (the path that was read) and ``pos`` besides."""
    seq = F.struct(*ORDER)
    head = emitted.groupBy("id").agg(F.min_by(F.struct("kind", "label", "path"), seq).alias("head"))
    keys = emitted.select("id", *ORDER, F.explode("meta").alias("key", "value")).groupBy("id", "key").agg(F.min_by("value", seq).alias("value"))
    meta = keys.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("meta"))
    return head.join(meta, "id", "left").select("id", "head.kind", "head.label", "head.path", "meta")


def dedupe_edges(emitted: DataFrame) -> DataFrame:
    """One row a (kind, src, dst), with the first provenance."""
    return emitted.groupBy("kind", "src", "dst").agg(F.min_by("provenance", F.struct(*ORDER)).alias("provenance"))


def counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def sides(edges: DataFrame) -> DataFrame:
    """Each edge from both ends: node, other."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("s")).select("s.node", "s.other")


def neighbours(edges: DataFrame) -> DataFrame:
    """node, other without repetition."""
    return sides(edges).distinct()


def degree(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Ends of edges at each node; a loop counts twice.

    Ends go to their nodes' tasks uncounted: tasks that make edges distinct hold those already, and
    counting there would hold nearly every end of theirs besides. ``tasks`` says how many tasks count;
    without it that is the session's number, however many ends there are."""
    ends = sides(edges).select("node")
    return (ends.repartition(tasks, "node") if tasks else ends.repartition("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def diff_nodes(base: DataFrame, current: DataFrame) -> DataFrame:
    """Nodes by id: what was added or removed (labels and meta don't count)."""
    gone = base.join(current.select("id"), "id", "left_anti").select(F.lit("removed").alias("change"), "id", "kind")
    new = current.join(base.select("id"), "id", "left_anti").select(F.lit("added").alias("change"), "id", "kind")
    return new.unionByName(gone)


def compared(base: DataFrame, current: DataFrame) -> DataFrame:
    """kind, src, dst of the edges of both, each once; sides is 1 (only in the base), 2 (only in the current graph) or 3."""
    key = ["kind", "src", "dst"]
    rows = base.select(*key, F.lit(1).alias("side")).unionByName(current.select(*key, F.lit(2).alias("side")))
    return rows.groupBy(*key).agg(F.bit_or("side").alias("sides"))


def diff_edges(base: DataFrame, current: DataFrame) -> DataFrame:
    """Edges by kind and ends. One aggregate gives both directions."""
    return compared(base, current).where("sides <> 3").select(F.when(F.col("sides") == 2, "added").otherwise("removed").alias("change"), "kind", "src", "dst")


def build(passes: list[tuple[DataFrame | None, DataFrame | None]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of passes in order."""
    nodes = edges = None
    for n, (some_nodes, some_edges) in enumerate(passes):
        if some_nodes is not None:
            some_nodes = some_nodes.withColumn("pass_seq", F.lit(n))
            nodes = some_nodes if nodes is None else nodes.unionByName(some_nodes)
        if some_edges is not None:
            some_edges = some_edges.withColumn("pass_seq", F.lit(n))
            edges = some_edges if edges is None else edges.unionByName(some_edges)
    return merge_nodes(nodes), dedupe_edges(edges)


__all__ = ["build", "compared", "counts", "dedupe_edges", "degree", "diff_edges", "diff_nodes", "first_by", "merge_nodes", "neighbours", "sides"]
