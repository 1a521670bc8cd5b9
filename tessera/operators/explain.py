"""A judged report in words: a line for each meter that has something to say, and what to do about it.

What the meters found comes as one table of items however many there are. Of each meter only the
number of its items and the first few reach the report, so the words stay short at every size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extract import suggest_test
from .verdict import DEFAULTS

#: Items of a meter that a report keeps; no line shows more.
MOST = 5

#: Figures that only the words need, with what they are when nothing was measured.
DETAILS = {
    "rules": 0, "edges_added": 0, "edges_removed": 0, "nodes_added": 0, "nodes_removed": 0, "documents": 0, "semantic_edits": 0, "noop_edits": 0,
    "touched": 0, "stale_files": 0, "stale_days": 90, "candidates": 0, "reviewed": False,
}

#: What the items of a meter look like, over the columns of what it found.
ITEMS = {
    "required_edge_breakage": "rule", "trace_coverage": "id", "newly_uncovered_story": "id", "path_loss": "id", "newly_orphaned_concept": "id", "claim_support": "id",
    "newly_unsupported_claim": "id", "newly_orphaned_endpoint": "id", "stale_decision_links": "old", "broken_implements_chains": "dst", "unimplemented_stories": "id",
    "dependency_cycles": "array_join(ring, ' → ')", "broken_links": "concat(source, '→', target)", "unknown_id_references": "id", "stale_tests": "concat(test, '→', source)",
    "truth_alignment": "concat(direction, ':', authority_doc, '→', artifact)", "orphaned_metric_aliases": "name", "dangling_imports": "concat(source, '→', spec)",
    "blast_radius": "node", "staleness": "path", "orphan_endpoints": "id",
}

#: What comes first where that isn't the order of the items' texts.
ORDER = {"blast_radius": "-impact", "staleness": "-age_days"}


def items(found: dict[str, DataFrame], *keys: str) -> DataFrame:
    """keys, meter, position, item of all that the meters found (by meter, or by kind of regression)."""
    rows = [df.select(*keys, F.lit(m).alias("meter"), F.expr(ORDER.get(m, "0")).cast("double").alias("position"), F.expr(ITEMS[m]).alias("item")) for m, df in found.items()]
    if "orphan_endpoints" in found:  # the route and the test that it should have
        ends = found["orphan_endpoints"]
        place = F.when(suggest_test("source") != "", F.concat(F.lit(" (add "), suggest_test("source"), F.lit(")"))).otherwise(F.concat(F.lit(" (in "), "source", F.lit(")")))
        rows.append(ends.select(*keys, F.lit("orphan_endpoint_tests").alias("meter"), F.lit(0.0).alias("position"), F.concat("id", F.when(F.coalesce("source", F.lit("")) == "", "").otherwise(place)).alias("item")))
    return reduce(DataFrame.unionByName, rows)


def shortlist(found: DataFrame, *keys: str, most: int = MOST) -> DataFrame:
    """keys, meter, n, first: how many items, and the first of them by position and text.

    Counts combine before the shuffle and so does the ranking (a limit per group), so one meter of
    one key may hold nearly all items. ``found`` is read twice, so give it as a written table where
    it is dear to compute. A null item counts and comes first."""
    by = [*keys, "meter"]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("position", "item"))).where(F.col("rank") <= most)
    counted = found.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    both = counted.select(*by, "n", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("item")).unionByName(ranked.select(*by, F.lit(0).cast("long").alias("n"), "rank", "item"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "item"))))
    return both.groupBy(*by).agg(F.sum("n").alias("n"), F.transform(pairs, lambda x: x["item"]).alias("first"))


def attach(report: DataFrame, lists: DataFrame, *keys: str) -> DataFrame:
    """The report with ``found``, a map from meter to its number and first items (at most a few dozen entries a row)."""
    entry = F.struct("meter", F.struct("n", "first").alias("value"))
    per = lists.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("found"))
    return report.join(per, list(keys), "left") if keys else report.join(F.broadcast(per))


def _n(meter: str) -> Column:
    return F.coalesce(F.col("found")[meter]["n"], F.lit(0).cast("long"))


def _short(meter: str, most: int) -> Column:
    first, n = F.coalesce(F.col("found")[meter]["first"], F.array().cast("array<string>")), _n(meter)
    shown = F.array_join(F.slice(first, 1, most), ", ")
    return F.when(n > most, F.format_string("%s (+%d more)", shown, n - most)).otherwise(shown)


def _line(meter: str, condition: Column, text: str, *args: Column | str) -> Column:
    """A line of a meter; null where it has nothing to say."""
    return F.when(condition, F.struct(F.lit(meter).alias("meter"), F.format_string(text, *[F.col(a) if isinstance(a, str) else a for a in args]).alias("line")))


def _unless(convention: str, why: str) -> Column:
    return F.when(F.col(convention), "").otherwise(f" ({why}, so the verdict leaves it out)")


def _lines() -> list[Column]:
    e = F.expr
    two = F.round
    return [
        _line("required_edge_breakage", e("broken_rules > 0"), "%d of %d rule(s) fire on the changed files: %s", "broken_rules", "rules", _short("required_edge_breakage", MOST)),
        _line("trace_coverage", e("stories > 0"), "%d of %d user stories are mentioned; not mentioned: %s", e("stories - uncovered_stories"), "stories", _short("trace_coverage", 4)),
        _line("neighborhood_drift", e("base_available"), "the graph moved by %s (edges +%d/-%d, nodes +%d/-%d)%s", two("neighborhood_score", 2).cast("string"), "edges_added", "edges_removed", "nodes_added", "nodes_removed", F.when(e("neighborhood_score >= 100"), "; the baseline looks old, index again").otherwise("")),
        _line("neighborhood_drift", e("NOT base_available"), "there is no baseline to compare with"),
        _line("semantic_movement", e("base_available"), "%d of %d Markdown files changed in meaning, %d in form only", "semantic_edits", "documents", "noop_edits"),
        _line("path_loss", e("concepts > 0"), "%d of %d concepts reach no support%s: %s", _n("path_loss"), "concepts", _unless("path_loss_convention", "no concept here is supported"), _short("path_loss", 4)),
        _line("path_loss", _n("newly_orphaned_concept") > 0, "%d concepts lost their support since the baseline: %s", _n("newly_orphaned_concept"), _short("newly_orphaned_concept", 4)),
        _line("blast_radius", e("base_available"), "%d changed nodes have %d neighbours that did not change", "touched", "blast_score"),
        _line("staleness", e("files > 0"), "%d of %d files were not touched for %d days", "stale_files", "files", "stale_days"),
        _line("claim_support", e("claims > 0"), "%d of %d claims have no backing%s: %s", _n("claim_support"), "claims", _unless("claim_convention", "no claim here is backed"), _short("claim_support", 4)),
        _line("claim_support", _n("newly_unsupported_claim") > 0, "%d claims lost their backing since the baseline: %s", _n("newly_unsupported_claim"), _short("newly_unsupported_claim", 4)),
        _line("contradiction", e("reviewed"), "the review found %d contradictions in %d files", "contradictions", "candidates"),
        _line("stale_decision_links", _n("stale_decision_links") > 0, "%d documents cite a superseded decision and not the new one: %s", _n("stale_decision_links"), _short("stale_decision_links", 4)),
        _line("broken_implements_chains", _n("broken_implements_chains") > 0, "%d symbols implement what no evidence supports: %s", _n("broken_implements_chains"), _short("broken_implements_chains", 4)),
        _line("dependency_cycles", _n("dependency_cycles") > 0, "%d import cycles, first %s", _n("dependency_cycles"), F.coalesce(F.col("found")["dependency_cycles"]["first"][0], F.lit(""))),
        _line("orphan_endpoints", _n("orphan_endpoints") > 0, "%d routes are defined in files without a test%s: %s", _n("orphan_endpoints"), _unless("endpoint_convention", "no test here is paired with a file"), _short("orphan_endpoints", 4)),
        _line("unimplemented_stories", e("implements_convention") & (_n("unimplemented_stories") > 0), "%d user stories are implemented by nothing: %s", _n("unimplemented_stories"), _short("unimplemented_stories", 4)),
        _line("broken_links", _n("broken_links") > 0, "%d links lead to files that are not there: %s", _n("broken_links"), _short("broken_links", 3)),
        _line("unknown_id_references", _n("unknown_id_references") > 0, "%d ids in code are defined nowhere: %s", _n("unknown_id_references"), _short("unknown_id_references", 4)),
        _line("stale_tests", _n("stale_tests") > 0, "%d tests stayed as they were while their source changed: %s", _n("stale_tests"), _short("stale_tests", 3)),
        _line("truth_alignment", _n("truth_alignment") > 0, "%d pairs of document and code changed on one side only: %s", _n("truth_alignment"), _short("truth_alignment", 3)),
        _line("orphaned_metric_aliases", _n("orphaned_metric_aliases") > 0, "%d uses of metrics that are gone: %s", _n("orphaned_metric_aliases"), _short("orphaned_metric_aliases", 4)),
        _line("dangling_imports", _n("dangling_imports") > 0, "%d imports lead nowhere: %s", _n("dangling_imports"), _short("dangling_imports", 3)),
    ]


def _steps() -> list[Column]:
    e = F.expr
    return [
        _line("required_edge_breakage", e("broken_rules > 0"), "review the changed files against the rules that fire"),
        _line("trace_coverage", e("stories > 0 AND uncovered_stories > 0"), "mention the stories without coverage in a spec or an evidence packet"),
        _line("trace_coverage", _n("newly_uncovered_story") > 0, "mention again the stories that were covered before: %s", _short("newly_uncovered_story", 3)),
        _line("neighborhood_drift", e("base_available AND neighborhood_score >= 2.0"), "look at the graph's diff"),
        _line("neighborhood_drift", e("NOT base_available"), "index the repository, to have a baseline"),
        _line("path_loss", e("concepts > 0 AND path_loss_convention AND path_loss_score >= 0.5"), "link the concepts without support from a supporting document, or accept that they stand alone"),
        _line("path_loss", _n("newly_orphaned_concept") > 0, "bring back the support of: %s", _short("newly_orphaned_concept", 3)),
        _line("blast_radius", e("base_available AND blast_score >= 10"), "look at what is next to the most connected changes: %s", _short("blast_radius", 3)),
        _line("staleness", e("files > 0 AND staleness_score >= 0.25"), "read again or retire the oldest files: %s", _short("staleness", 3)),
        _line("claim_support", e("claims > 0 AND claim_convention AND claim_score >= 0.5"), "back the claims by a document or an evidence packet"),
        _line("claim_support", _n("newly_unsupported_claim") > 0, "bring back the backing of: %s", _short("newly_unsupported_claim", 3)),
        _line("contradiction", e("reviewed AND contradictions > 0"), "look into the contradictions that the review cites"),
        _line("stale_decision_links", _n("stale_decision_links") > 0, "cite the successors of: %s", _short("stale_decision_links", 3)),
        _line("broken_implements_chains", _n("broken_implements_chains") > 0, "add evidence for what code says it implements, or take the statement back: %s", _short("broken_implements_chains", 3)),
        _line("dependency_cycles", _n("dependency_cycles") > 0, "break the import cycle by moving what both sides share to a third place"),
        _line("orphan_endpoints", _n("orphan_endpoints") > 0, "test the files of the routes: %s", _short("orphan_endpoint_tests", 3)),
        _line("orphan_endpoints", _n("newly_orphaned_endpoint") > 0, "test again the routes that were tested before: %s", _short("newly_orphaned_endpoint", 3)),
        _line("unimplemented_stories", e("implements_convention") & (_n("unimplemented_stories") > 0), "say in code what implements these stories, or close them: %s", _short("unimplemented_stories", 3)),
        _line("broken_links", _n("broken_links") > 0, "correct or remove the links: %s", _short("broken_links", 3)),
        _line("unknown_id_references", _n("unknown_id_references") > 0, "write the records of these ids, or remove them from code: %s", _short("unknown_id_references", 3)),
        _line("stale_tests", _n("stale_tests") > 0, "bring the tests up to their sources, or accept that the pairs are wrong: %s", _short("stale_tests", 3)),
        _line("truth_alignment", _n("truth_alignment") > 0, "ask whether document or code is meant, and change the other: %s", _short("truth_alignment", 3)),
        _line("orphaned_metric_aliases", _n("orphaned_metric_aliases") > 0, "use the new names, or define the old ones again: %s", _short("orphaned_metric_aliases", 3)),
        _line("dangling_imports", _n("dangling_imports") > 0, "correct the import paths, or bring back the modules: %s", _short("dangling_imports", 3)),
    ]


def _said(lines: list[Column]) -> Column:
    return F.filter(F.array(*lines), lambda x: x.isNotNull())


def explain(judged: DataFrame) -> DataFrame:
    """The judged report (with ``found`` from ``attach``; a report without it is one that found nothing)
    with ``explanations`` and ``actions``, arrays of (meter, line) in the order of the meters, and ``headline``.

    With nothing to do, meters that are left out for want of a convention are named, or else it
    says that there is nothing to do. Absent or null figures count as nothing."""
    if "found" not in judged.columns:
        judged = judged.withColumn("found", F.lit(None).cast("map<string,struct<n:bigint,first:array<string>>>"))
    rows = judged.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in judged.columns else F.lit(v) for k, v in (DEFAULTS | DETAILS).items()})
    rows = rows.withColumns({"explanations": _said(_lines()), "actions": _said(_steps())})
    silent = F.struct(F.lit("silenced").alias("meter"), F.concat(F.lit("to hear of "), F.array_join("silenced_meters", ", "), F.lit(": tie a concept, claim or endpoint to a test, to evidence or to code")).alias("line"))
    idle = F.struct(F.lit("none").alias("meter"), F.lit("nothing to do").alias("line"))
    actions = F.when(F.size("actions") > 0, F.col("actions")).otherwise(F.array(F.when(F.size("silenced_meters") > 0, silent).otherwise(idle)))
    newly = sum((_n(k) for k in ("newly_orphaned_concept", "newly_unsupported_claim", "newly_uncovered_story", "newly_orphaned_endpoint")), F.lit(0))
    part = lambda some, text: F.when(some, text).otherwise("")
    head = F.concat(
        F.lit("drift: "), "verdict", part(newly > 0, F.format_string(", %d regression(s)", newly)),
        part(F.size("active_meters") > 0, F.concat(F.lit("; active: "), F.array_join("active_meters", ", "))),
        part(F.size("silenced_meters") > 0, F.concat(F.lit("; silenced: "), F.array_join("silenced_meters", ", "))),
    )
    return rows.withColumns({"actions": actions, "headline": head})


def spoken(explained: DataFrame, *keys: str) -> DataFrame:
    """keys, part (explanation or action), position, meter, line: a row for each line."""
    part = lambda name: F.transform(name, lambda x, i: F.struct(F.lit(name[:-1]).alias("part"), i.alias("position"), x["meter"].alias("meter"), x["line"].alias("line")))
    return explained.select(*keys, F.inline(F.concat(part("explanations"), part("actions"))))
