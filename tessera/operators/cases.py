"""Many mutated repositories in one plan: each case is an edit of the same files, told apart by case_id.

Only what an edit touches is kept for a case; the rest is the shared base, so thousands of cases cost
their edits and not as many repositories. Cycles of cases carry their state in tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import matches_any
from . import evaluation as E
from . import snapshot as S
from .storage import keep

EDITS = "case_id string, operation string, path string, old string, new string, text string, new_path string, content string"
PIECES = "array<struct<path:string,body:string>>"


def mutate(files: DataFrame, edits: DataFrame) -> DataFrame:
    """case_id, path, body of the files (path, body) that the edits touch; a null body: the file is gone.

    An edit of a file that isn't there does nothing, except adding it. What is added, and the new name of a
    file, replace a file of that path. A case has at most one edit of a path. Unknown operations are errors."""
    rows = edits.join(files.select("path", "body"), "path", "left")
    body, here = F.col("body"), F.col("body").isNotNull()
    at = F.expr("locate(old, body)")
    once = F.when(at > 0, F.concat(F.substring(body, F.lit(1), at - 1), "new", F.substring(body, at + F.length("old"), F.length(body)))).otherwise(body)
    kept = F.array_join(F.filter(F.split(body, "\n", -1), lambda x: ~F.contains(x, F.col("text"))), "\n")
    one = lambda path, text: F.array(F.struct(path.alias("path"), text.alias("body")))
    path, gone, none = F.col("path"), F.lit(None).cast("string"), F.array().cast(PIECES)
    op = F.col("operation")
    touched = (
        F.when(op == "add_file", one(path, F.col("content")))
        .when(~op.isin("replace_text", "append_text", "remove_file", "rename_file", "remove_line_containing"), F.raise_error(F.concat(F.lit("unknown operation "), op)).cast(PIECES))
        .when(~here, none)
        .when(op == "replace_text", one(path, once))
        .when(op == "append_text", one(path, F.concat(body, "text")))
        .when(op == "remove_file", one(path, gone))
        .when(op == "rename_file", F.when(path == F.col("new_path"), none).otherwise(F.concat(one(path, gone), one(F.col("new_path"), body))))
        .otherwise(one(path, kept))
    )
    return rows.select("case_id", F.explode(touched).alias("t")).select("case_id", "t.path", "t.body")


def changes(base: DataFrame, touched: DataFrame) -> DataFrame:
    """case_id, path, kind, change_type against the snapshot of the files before."""
    now = S.take(touched, keys=["case_id"])
    was = base.select("path", F.col("kind").alias("was_kind"), F.col("content_hash").alias("b_content"), F.col("semantic_hash").alias("b_semantic"))
    change = (
        F.when(F.col("b_content").isNull() & F.col("content_hash").isNotNull(), "added")
        .when(F.col("content_hash").isNull() & F.col("b_content").isNotNull(), "removed")
        .when(F.col("b_semantic") != F.col("semantic_hash"), "semantic_changed")
        .when(F.col("b_content") != F.col("content_hash"), "semantic_noop")
    )
    rows = now.join(was, "path", "left").withColumn("change_type", change)
    return rows.where("change_type IS NOT NULL").select("case_id", "path", F.coalesce("was_kind", "kind").alias("kind"), "change_type")


def broken_rules(changed: DataFrame, rules: list[dict]) -> DataFrame:
    """case_id, broken: how many rules fire on the changed files (case_id, path) of each case."""
    if not rules:
        return changed.select("case_id").distinct().withColumn("broken", F.lit(0).cast("long"))
    path = F.col("path")
    tests = [F.struct(F.lit(k).alias("k"), matches_any(path, r["when"]).alias("starts"), matches_any(path, r["expect_any"]).alias("meets")) for k, r in enumerate(rules)]
    hits = changed.select("case_id", F.explode(F.array(*tests)).alias("t")).where("t.starts OR t.meets")
    fired = hits.groupBy("case_id", "t.k").agg((F.bool_or("t.starts") & ~F.bool_or("t.meets")).alias("fired"))
    return fired.groupBy("case_id").agg(F.count_if("fired").alias("broken"))


def meters(base: DataFrame, edits: DataFrame, changed: DataFrame, rules: list[dict]) -> DataFrame:
    """One row a case, those without an effect included: counts of changes, semantic movement of Markdown, broken
    rules, and the active meters among the two."""
    total = base.agg(F.count_if(F.col("kind") == "markdown").alias("before"))
    is_md = F.col("kind") == "markdown"
    kinds = ["added", "removed", "semantic_changed", "semantic_noop"]
    per = changed.groupBy("case_id").agg(
        *[F.count_if(F.col("change_type") == k).alias(k) for k in kinds],
        F.sum(F.when(is_md & (F.col("change_type") == "added"), 1).when(is_md & (F.col("change_type") == "removed"), -1).otherwise(0)).alias("more"),
        F.count_if(is_md & F.col("change_type").isin("added", "semantic_changed")).alias("semantic"),
    )
    out = edits.select("case_id").distinct().join(per, "case_id", "left").join(broken_rules(changed, rules), "case_id", "left").join(F.broadcast(total))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = out.select("case_id", *[zero(F.col(k)).alias(k) for k in kinds], (F.col("before") + zero(F.col("more"))).alias("documents"), zero(F.col("semantic")).alias("semantic"), zero(F.col("broken")).alias("broken"))
    out = out.withColumn("semantic_score", E.ratio("semantic", "documents"))
    active = F.array(F.when(F.col("semantic_score") > 0, "semantic_movement"), F.when(F.col("broken") > 0, "required_edge_breakage"))
    return out.withColumn("active", F.array_compact(active))


def evaluate(files: DataFrame, edits: DataFrame, rules: list[dict]) -> DataFrame:
    """``meters`` of all cases: files and their snapshot are read once for all of them."""
    base = keep(S.take(files), "base")
    changed = keep(changes(base, mutate(files, edits)), "case-changes")
    return meters(base, edits, changed, rules)


def reorder(specs: DataFrame, clusters: DataFrame, results: DataFrame, iterations: int) -> DataFrame:
    """The specs (mutation_id, place) with the places of the next cycle, from 0.

    First the mutations of the clusters (key, n, mutations), largest cluster first; then what was skipped or
    errored, in the order of the results (mutation_id, classification, place); then the others as they were. If
    there is neither, the specs rotate, so that a short cycle begins where the last one stopped."""
    place = lambda *c: F.struct(*[F.lit(x).cast("long").alias(f"k{i}") if isinstance(x, int) else x.alias(f"k{i}") for i, x in enumerate(c)])
    of = clusters.select("key", "n", F.posexplode("mutations").alias("nth", "mutation_id"))
    hot = of.select("mutation_id", place(0, -F.col("n"), F.lit(0).cast("long")).alias("turn"), "key", F.col("nth").cast("long").alias("nth"))
    odd = results.where(F.col("classification").isin("skipped", "errored")).select("mutation_id", place(1, F.col("place").cast("long"), F.lit(0).cast("long")).alias("turn"), F.lit("").alias("key"), F.lit(0).cast("long").alias("nth"))
    first = hot.unionByName(odd).groupBy("mutation_id").agg(F.min(F.struct("turn", "key", "nth")).alias("first"))
    rows = specs.select("mutation_id", "place").join(first, "mutation_id", "left")
    size = rows.agg(F.count(F.lit(1)).alias("size"), F.count("first").alias("taken"))
    rows = rows.join(F.broadcast(size))
    rest = F.when(F.col("taken") == 0, F.pmod(F.col("place") - F.lit(iterations), F.col("size"))).otherwise(F.col("place")).cast("long")
    late = F.struct(place(2, rest, F.lit(0).cast("long")).alias("turn"), F.lit("").alias("key"), F.lit(0).cast("long").alias("nth"))
    ordered = rows.select("mutation_id", F.coalesce("first", late).alias("at"))
    # a list of specs is small: their order is numbered in one task
    return ordered.select("mutation_id", (F.row_number().over(Window.orderBy("at", "mutation_id")) - 1).cast("long").alias("place"))


def cycles(specs: DataFrame, run: Callable[[DataFrame, int], DataFrame], many: int, iterations: int) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """``many`` cycles of up to ``iterations`` specs each: (order, results, clusters) of each, as written tables.

    ``run`` gets the specs (mutation_id, place) of a cycle and its number, and gives the results of all of them
    at once, with the columns that ``evaluation.clusters`` reads."""
    order, out = keep(specs.select("mutation_id", F.col("place").cast("long").alias("place")), "order"), []
    for number in range(many):
        if out:
            last = out[-1]
            order = keep(reorder(order, last[2], last[1], iterations), "order")
        chosen = order.where(F.col("place") < iterations)
        results = run(chosen, number)
        results = keep(results.drop("place").join(chosen, "mutation_id"), "results")
        out.append((order, results, keep(E.clusters(results), "clusters")))
    return out
