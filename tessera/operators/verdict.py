"""From meter scores, in one row, to the verdict, what is active, what regressed, and the outcome."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import MOVEMENT_METERS

#: The floors of the meters.
FLOORS = {"neighborhood_drift": 2.0, "semantic_movement": 0.05, "path_loss": 0.5, "claim_support": 0.5, "blast_radius": 10, "staleness": 0.25}

#: The scores that a report row has, with what they are when nothing was measured.
DEFAULTS = {
    "base_available": True, "broken_rules": 0, "stories": 0, "uncovered_stories": 0, "contradictions": 0, "neighborhood_score": 0.0, "semantic_score": 0.0,
    "concepts": 0, "path_loss_score": 0.0, "path_loss_convention": False, "newly_orphaned_concepts": 0, "blast_score": 0, "files": 0, "staleness_score": 0.0,
    "claims": 0, "claim_score": 0.0, "claim_convention": False, "newly_unsupported_claims": 0, "stale_decisions": 0, "broken_chains": 0, "cycles": 0,
    "orphan_endpoints": 0, "endpoint_convention": False, "newly_orphaned_endpoints": 0, "newly_uncovered_stories": 0, "unimplemented": 0, "implements_convention": False,
    "broken_links": 0, "unknown_ids": 0, "stale_tests": 0, "truth_conflicts": 0, "orphaned_aliases": 0, "dangling_imports": 0, "callsite_score": 0, "dead_code": 0,
}

#: In order: the verdict of the first condition that holds.
VERDICTS = [
    ("warn", "broken_rules > 0"), ("warn", "stories > 0 AND uncovered_stories > 0"), ("warn", "contradictions > 0"),
    ("telemetry", "base_available AND neighborhood_score >= 2.0"), ("telemetry", "base_available AND semantic_score >= 0.05"),
    ("telemetry", "concepts > 0 AND path_loss_convention AND path_loss_score >= 0.5"), ("telemetry", "newly_orphaned_concepts > 0"),
    ("telemetry", "base_available AND blast_score >= 10"), ("telemetry", "files > 0 AND staleness_score >= 0.25"),
    ("telemetry", "claims > 0 AND claim_convention AND claim_score >= 0.5"), ("telemetry", "newly_unsupported_claims > 0"),
    ("telemetry", "stale_decisions > 0"), ("telemetry", "broken_chains > 0"), ("warn", "cycles > 0"),
    ("telemetry", "endpoint_convention AND orphan_endpoints > 0"), ("telemetry", "newly_orphaned_endpoints > 0"),
    ("telemetry", "implements_convention AND unimplemented > 0"), ("telemetry", "broken_links > 0"), ("telemetry", "unknown_ids > 0"),
    ("telemetry", "stale_tests > 0"), ("telemetry", "truth_conflicts > 0"), ("telemetry", "orphaned_aliases > 0"), ("warn", "dangling_imports > 0"),
]

ACTIVE = {
    "required_edge_breakage": "broken_rules > 0", "trace_coverage": "stories > 0 AND uncovered_stories > 0",
    "neighborhood_drift": "base_available AND neighborhood_score >= 2.0", "semantic_movement": "base_available AND semantic_score >= 0.05",
    "path_loss": "(concepts > 0 AND path_loss_convention AND path_loss_score >= 0.5) OR newly_orphaned_concepts > 0",
    "blast_radius": "base_available AND blast_score >= 10", "staleness": "files > 0 AND staleness_score >= 0.25",
    "claim_support": "(claims > 0 AND claim_convention AND claim_score >= 0.5) OR newly_unsupported_claims > 0",
    "contradiction": "contradictions > 0", "stale_decision_links": "stale_decisions > 0", "broken_implements_chains": "broken_chains > 0", "dependency_cycles": "cycles > 0",
    "orphan_endpoints": "(endpoint_convention AND orphan_endpoints > 0) OR newly_orphaned_endpoints > 0", "unimplemented_stories": "implements_convention AND unimplemented > 0",
    "broken_links": "broken_links > 0", "unknown_id_references": "unknown_ids > 0", "stale_tests": "stale_tests > 0", "truth_alignment": "truth_conflicts > 0",
    "orphaned_metric_aliases": "orphaned_aliases > 0", "dangling_imports": "dangling_imports > 0", "callsite_blast_radius": "callsite_score > 0", "dead_code": "dead_code > 0",
}

SILENCED = {
    "path_loss": "concepts > 0 AND NOT path_loss_convention AND path_loss_score >= 0.5",
    "claim_support": "claims > 0 AND NOT claim_convention AND claim_score >= 0.5",
    "orphan_endpoints": "orphan_endpoints > 0 AND NOT endpoint_convention",
}

REGRESSIONS = {
    "newly_orphaned_concept": "restore a support path to %s (add/restore the test, evidence, or implements link that backed it)",
    "newly_unsupported_claim": "restore backing for %s (add an evidence packet or restore the verifying test/code)",
    "newly_uncovered_story": "re-link %s from a spec, README, or evidence packet so the trace coverage holds",
    "newly_orphaned_endpoint": "add or restore a test that verifies the source file defining %s",
}


def filled(report: DataFrame) -> DataFrame:
    """The report with every score, absent ones at their defaults."""
    return report.select(*[F.coalesce(F.col(k), F.lit(v)).alias(k) if k in report.columns else F.lit(v).alias(k) for k, v in DEFAULTS.items()], *[c for c in report.columns if c not in DEFAULTS])


def verdict() -> Column:
    out = None
    for name, condition in VERDICTS:
        out = F.when(F.expr(condition), name) if out is None else out.when(F.expr(condition), name)
    return out.otherwise("clean")


def _named(conditions: dict[str, str]) -> Column:
    return F.filter(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in conditions.items()]), lambda x: x.isNotNull())


def judge(report: DataFrame) -> DataFrame:
    return filled(report).withColumns({"verdict": verdict(), "active_meters": _named(ACTIVE), "silenced_meters": _named(SILENCED)})


def strict(judged: DataFrame) -> DataFrame:
    """Active meters apart: those that only say that something moved, and the others."""
    movement = F.array(*[F.lit(m) for m in MOVEMENT_METERS])
    return judged.withColumns({"movement": F.array_intersect("active_meters", movement), "substantive": F.array_except("active_meters", movement)})


def regressions(parts: dict[str, DataFrame]) -> DataFrame:
    """kind, id, suggested_action; parts: by kind the transitions (id, change)."""
    rows = [df.where("change = 'newly_bad'").select(F.lit(kind).alias("kind"), "id", F.format_string(REGRESSIONS[kind], "id").alias("suggested_action")) for kind, df in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def outcome(facts: DataFrame, *keys: str) -> DataFrame:
    """The contract for a caller, a row for each row of facts: subcommand, errors, warns, staged, dirty, untracked,
    include_untracked, drift_verdict, regressions, truth_clarification, baseline_missing."""
    worktree = F.when(F.expr("dirty + untracked = 0"), "clean").otherwise("dirty")
    excluded = F.expr("NOT include_untracked AND untracked > 0")
    stranded = F.expr("subcommand = 'scan' AND staged = 0") & (worktree == "dirty")
    telemetry = F.expr("drift_verdict = 'telemetry'")
    review = F.expr("warns > 0 OR drift_verdict = 'warn' OR truth_clarification") | excluded | stranded | (telemetry & F.expr("regressions > 0"))
    command = (
        F.when(stranded, "review --base=HEAD --worktree --json")
        .when(F.expr("subcommand = 'check'") & excluded, "review --base=HEAD --worktree --json")
        .when(F.expr("baseline_missing"), "index")
        .when((telemetry & F.expr("regressions > 0")) | F.expr("truth_clarification"), "drift --json")
        .otherwise("")
    )
    return facts.select(
        *keys, F.expr("errors > 0").alias("blocking_error"), F.expr("errors = 0").alias("safe_to_commit"), review.alias("review_recommended"),
        F.when(F.expr("staged = 0"), "clean").otherwise("dirty").alias("staged_state"), worktree.alias("worktree_state"), excluded.alias("untracked_excluded"),
        (telemetry & ~F.expr("truth_clarification")).alias("telemetry_only"), command.alias("next_command"), "drift_verdict",
    )
