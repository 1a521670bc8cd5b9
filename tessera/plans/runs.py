"""Index a repository, compare it with a baseline, gate a change set."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import explain, extract, golang, meters, rules, snapshot, verdict
from ..operators.graph import diff_edges, diff_nodes
from ..operators.storage import keep

#: The figures of a report that are numbers of items.
COUNTED = {
    "required_edge_breakage": "broken_rules", "trace_coverage": "uncovered_stories", "newly_orphaned_concept": "newly_orphaned_concepts", "newly_unsupported_claim": "newly_unsupported_claims",
    "newly_uncovered_story": "newly_uncovered_stories", "newly_orphaned_endpoint": "newly_orphaned_endpoints", "stale_decision_links": "stale_decisions", "broken_implements_chains": "broken_chains",
    "dependency_cycles": "cycles", "orphan_endpoints": "orphan_endpoints", "unimplemented_stories": "unimplemented", "broken_links": "broken_links", "unknown_id_references": "unknown_ids",
    "stale_tests": "stale_tests", "truth_alignment": "truth_conflicts", "orphaned_metric_aliases": "orphaned_aliases", "dangling_imports": "dangling_imports",
}


@dataclass
class State:
    """A repository at one time."""

    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    snapshot: DataFrame


def index(files: DataFrame, rule_list: list[dict] | None = None, commands: list[str] | None = None) -> State:
    """Graph and snapshot of files (path, body), each written once and reused by all meters."""
    files = keep(files.select("path", "body"), "files")
    nodes, edges = extract.build_graph(files, rule_list, commands)
    return State(files, keep(nodes, "nodes"), keep(edges, "edges"), keep(snapshot.take(files), "snapshot"))


def compare(base: State, current: State) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, nodes and edges that changed."""
    return snapshot.diff(base.snapshot, current.snapshot), diff_nodes(base.nodes, current.nodes), diff_edges(base.edges, current.edges)


def _beside(parts: list[DataFrame]) -> DataFrame:
    """One-row tables side by side."""
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)


def drift(current: State, base: State | None, changed: DataFrame, rule_list: list[dict], commits: DataFrame, now: datetime, findings: DataFrame | None = None, calls: bool = False, dead: bool = False) -> tuple[DataFrame, DataFrame]:
    """The judged report (one row, with explanations and actions) and the regressions.

    What the meters found is written once, as items; numbers and first items of all meters come from that table."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    stories = meters.trace_state(current.nodes, current.edges)
    reached = keep(meters.supported(current.nodes, current.edges), "reached")
    concepts, claims = (meters.support_state(current.nodes, reached, k) for k in ("concept", "claim"))
    endpoints = meters.endpoint_state(current.nodes, current.edges)
    base_stories = base_concepts = base_claims = base_endpoints = None
    if base is not None:
        base_reached = keep(meters.supported(base.nodes, base.edges), "base-reached")
        base_stories = meters.trace_state(base.nodes, base.edges)
        base_concepts, base_claims = (meters.support_state(base.nodes, base_reached, k) for k in ("concept", "claim"))
        base_endpoints = meters.endpoint_state(base.nodes, base.edges)
    moved = {
        "newly_orphaned_concept": meters.transitions(base_concepts, concepts),
        "newly_unsupported_claim": meters.transitions(base_claims, claims),
        "newly_uncovered_story": meters.transitions(base_stories, stories),
        "newly_orphaned_endpoint": meters.transitions(base_endpoints, endpoints),
    }
    fired = rules.evaluate(changed, rule_list)
    stale = keep(meters.staleness_rows(current.files, commits, current.edges, now), "staleness")
    bad = lambda state: state.where(~F.col("good"))
    found = {kind: rows.where("change = 'newly_bad'") for kind, rows in moved.items()} | {
        "required_edge_breakage": fired, "trace_coverage": bad(stories), "path_loss": bad(concepts), "claim_support": bad(claims), "orphan_endpoints": bad(endpoints),
        "stale_decision_links": meters.stale_decisions(current.edges), "broken_implements_chains": meters.broken_chains(current.edges), "dependency_cycles": meters.dependency_cycles(current.edges),
        "unimplemented_stories": meters.unimplemented(current.nodes, current.edges), "broken_links": meters.broken_links(current.files), "unknown_id_references": meters.unknown_ids(current.files, current.nodes),
        "dangling_imports": meters.dangling_imports(current.files), "staleness": stale.where("stale"),
    }
    parts = [
        stories.agg(F.count(F.lit(1)).alias("stories")),
        meters.loss(concepts, base_concepts).select(F.col("total").alias("concepts"), F.col("score").alias("path_loss_score"), F.col("convention").alias("path_loss_convention")),
        meters.loss(claims, base_claims).select(F.col("total").alias("claims"), F.col("score").alias("claim_score"), F.col("convention").alias("claim_convention")),
        meters.staleness(stale).select("files", F.col("stale").alias("stale_files"), F.col("score").alias("staleness_score")),
        meters.has_kind("verifies", current.edges).select(F.col("convention").alias("endpoint_convention")),
        meters.has_kind("implements", current.edges, base.edges if base else None).select(F.col("convention").alias("implements_convention")),
        stories.sparkSession.createDataFrame([(base is not None, len(rule_list), findings is not None)], "base_available boolean, rules int, reviewed boolean"),
    ]
    if findings is not None:
        parts.append(meters.contradiction(findings).select(F.col("score").alias("contradictions"), "candidates"))
    if base is not None:
        per, blast = meters.blast(base.edges, current.edges)
        change = lambda what: F.count_if(F.col("change") == what)
        parts += [
            meters.neighborhood(base.nodes, base.edges, current.nodes, current.edges).select(F.col("score").alias("neighborhood_score"), "nodes_added", "nodes_removed"),
            diff_edges(base.edges, current.edges).agg(change("added").alias("edges_added"), change("removed").alias("edges_removed")),
            meters.semantic_movement(base.snapshot, current.snapshot).select(F.col("score").alias("semantic_score"), F.col("total").alias("documents"), F.col("semantic").alias("semantic_edits"), F.col("noop").alias("noop_edits")),
            blast.select(F.col("score").alias("blast_score"), "touched"),
        ]
        found |= {
            "stale_tests": meters.stale_tests(current.edges, base.snapshot, current.snapshot), "truth_alignment": meters.truth_alignment(current.nodes, current.edges, base.snapshot, current.snapshot),
            "orphaned_metric_aliases": meters.orphaned_aliases(base.nodes, current.nodes, current.files), "blast_radius": per.where("impact >= 1"),
        }
    if calls or dead:
        defs, call_rows = golang.call_graph(current.files)
        if dead:
            parts.append(n(golang.dead_code(defs, call_rows), "dead_code"))
        if calls and base is not None:
            per_function = golang.callers(meters.changed_functions(base.snapshot, current.snapshot, defs), call_rows)
            parts.append(per_function.agg(F.coalesce(F.max("direct_production"), F.lit(0)).alias("callsite_score")))
    lists = keep(explain.shortlist(keep(explain.items(found), "items")), "found")
    number = lambda meter: F.coalesce(F.max(F.when(F.col("meter") == meter, F.col("n"))), F.lit(0)).alias(COUNTED[meter])
    parts.append(lists.agg(*[number(meter) for meter in COUNTED]))
    judged = verdict.judge(_beside(parts))
    return explain.explain(explain.attach(judged, lists)), verdict.regressions(moved)


def review(changed: DataFrame, files: DataFrame, rule_list: list[dict], added: DataFrame | None = None, extra: DataFrame | None = None) -> DataFrame:
    """All findings: rules, unknown ids in added lines (path, text), and findings from elsewhere."""
    out = rules.evaluate(changed, rule_list)
    if added is not None:
        out = out.unionByName(rules.scan_ids(added, rules.known_ids(files)))
    return out if extra is None else out.unionByName(extra, allowMissingColumns=True)


def status(nodes: DataFrame, edges: DataFrame, findings: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row a figure: what, name, n."""
    rows = [
        nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("what"), F.col("kind").alias("name"), "n"),
        edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("what"), F.col("kind").alias("name"), "n"),
        findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).select(F.lit("findings").alias("what"), F.col("severity").alias("name"), "n"),
    ]
    if runs is not None:
        rows.append(runs.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).select(F.lit("runs").alias("what"), F.col("verdict").alias("name"), "n"))
    return reduce(DataFrame.unionByName, rows)
