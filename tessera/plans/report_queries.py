"""Queries over reports: documents, run logs, specs, what a review is given."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import globs
from ..operators import evaluation as E
from ..operators import explain, meters
from ..operators import cases, review, rules, specs
from ..operators import verdict as V
from ..operators.storage import folder, keep
from ..schema import EDGES, NODES
from ..sources import documents, runlog
from .file_queries import FIRED, MD, RULES, repo
from .graph_queries import _HOLDS, BRANCHES, query
from .virtual import expand, frame


@query("document_round_trip", "SELECT 'nodes' AS what, kind, count(*) AS n, min(id) AS first FROM {nodes_current} GROUP BY kind UNION ALL SELECT 'edges', kind, count(*), min(concat(src, ' ', dst)) FROM (SELECT DISTINCT kind, src, dst FROM {edges_current}) GROUP BY kind")
def document_round_trip(spark, d):
    """The whole graph written as one JSON document and read back."""
    path = folder(spark, "graph-document")
    nodes, edges = frame(spark, d, "nodes_current"), frame(spark, d, "edges_current").select("kind", "src", "dst").distinct()
    documents.write(path, "graph", {"nodes": nodes, "edges": edges}, {"generated_at": None})
    read = documents.read(spark, path, "graph", {"nodes": NODES, "edges": EDGES})[1]
    ids = {"nodes": F.col("id"), "edges": F.concat("src", F.lit(" "), "dst")}
    counts = [rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min(ids[name]).alias("first")).select(F.lit(name).alias("what"), "kind", "n", "first") for name, rows in read.items()]
    return counts[0].unionByName(counts[1])


@query("run_series", """WITH p AS (SELECT l_returnflag AS series, concat(l_linestatus, l_linenumber) AS key, strftime(l_shipdate, '%Y-%m-%d') AS run_id, count(*) AS total, count(*) FILTER (l_quantity > 25) AS hits FROM lineitem GROUP BY 1, 2, 3)
SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY series, key ORDER BY run_id DESC) <= 200""")
def run_series(spark, d):
    """Days of lineitem as runs: three appends, one of them twice, a compaction, and the last 200 points of each series."""
    points = frame(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("series"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("key"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("run_id")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_quantity") > 25).alias("hits"))
    none = F.lit(0).cast("long")
    points = points.select("series", "key", "run_id", F.to_timestamp("run_id").alias("generated_at"), "total", "hits", none.alias("false_negatives"), none.alias("false_positives"), none.alias("skipped"), none.alias("errored"))
    log = folder(spark, "run-log")
    for name, days in (("early", "run_id < '1995'"), ("middle", "run_id >= '1995' AND run_id < '1997'"), ("late", "run_id >= '1997'")):
        runlog.append(points.where(days), log, name)
        if name == "middle":
            runlog.compact(spark, log)
            runlog.append(points.where(days), log, name)
    return runlog.read(spark, log).select("series", "key", "run_id", "total", "hits")


OPERATIONS = ["replace_text", "append_text", "rename_file", "teleport", "add_file"]


@query("spec_violations", f"""WITH s AS (SELECT p_partkey AS part, CASE WHEN p_size = 50 THEN '' WHEN p_size < 5 THEN concat('m', p_partkey // 2) ELSE concat('m', p_partkey, 'x') END AS id, {OPERATIONS}[p_partkey % 5 + 1] AS op,
  CASE WHEN p_size % 9 = 0 THEN 'galaxy' ELSE 'file' END AS target, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'old' END AS old, CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN '../' || p_name WHEN 2 THEN 'a/../.git/' || p_name ELSE 'a/' || p_name END AS path FROM part),
n AS (SELECT *, count(*) OVER (PARTITION BY id) AS same FROM s)
SELECT part, concat_ws(',', CASE WHEN id = '' THEN 'missing_id' END, CASE WHEN id <> '' AND same > 1 THEN concat('duplicate_id:', id) END, CASE WHEN op = 'teleport' THEN 'operation:teleport' END, CASE WHEN target <> 'file' THEN 'target_kind:galaxy' END,
  CASE WHEN path LIKE '../%' OR path LIKE 'a/../%' THEN concat('edit_path:', path) END, CASE WHEN op = 'replace_text' AND old = '' THEN 'no_edit_old' END, CASE WHEN op = 'append_text' THEN 'no_edit_text' END, CASE WHEN op = 'rename_file' THEN 'no_edit_new_path' END, CASE WHEN op = 'add_file' AND path = '' THEN 'no_edit_path' END) AS violations FROM n""")
def spec_violations(spark, d):
    """A mutation spec for each part, with all its violations."""
    part, size = frame(spark, d, "part"), F.col("p_size")
    key = F.col("p_partkey").cast("string")
    name = F.when(size == 50, "").when(size < 5, F.concat(F.lit("m"), F.floor(F.col("p_partkey") / 2).cast("string"))).otherwise(F.concat(F.lit("m"), key, F.lit("x")))
    path = F.when(size % 6 == 0, "").when(size % 6 == 1, F.concat(F.lit("../"), "p_name")).when(size % 6 == 2, F.concat(F.lit("a/../.git/"), "p_name")).otherwise(F.concat(F.lit("a/"), "p_name"))
    text, texts = F.lit(None).cast("string"), F.array().cast("array<string>")
    rows = part.select(
        F.col("p_partkey").alias("part"),
        name.alias("id"),
        F.element_at(F.array(*map(F.lit, OPERATIONS)), (F.col("p_partkey") % 5 + 1).cast("int")).alias("operation"),
        F.array(F.when(size % 9 == 0, "galaxy").otherwise("file")).alias("target_kinds"),
        F.array(F.lit("path_loss")).alias("expected_meters"),
        texts.alias("allowed_side_effect_meters"),
        F.struct(F.array(F.lit(".md")).alias("extensions"), F.lit("mentions").alias("has_incoming_edge"), text.alias("has_outgoing_edge")).alias("selector"),
        F.struct(path.alias("path"), text.alias("new_path"), F.when(size % 3 == 0, "").otherwise("old").alias("old"), text.alias("text"), text.alias("line_contains")).alias("edit"),
        F.struct(texts.alias("require_env"), texts.alias("require_files"), texts.alias("require_optional_engines")).alias("skip_conditions"),
    )
    return specs.violations(rows).select("part", F.array_join("violations", ",").alias("violations"))


@query("cited_targets", f"""WITH l AS (SELECT path, unnest(regexp_extract_all(body, '\\[[^\\]]*\\]\\(([^)\\s#]+)(?:#[^)]*)?\\)', 1)) AS raw, generate_subscripts(regexp_extract_all(body, '\\[[^\\]]*\\]\\(([^)\\s#]+)(?:#[^)]*)?\\)', 1), 1) AS i FROM {{repo}} WHERE {MD}),
t AS (SELECT path, i, CASE WHEN raw LIKE '../%' THEN concat('docs/', substring(raw, 4)) WHEN raw LIKE 'docs/%' THEN raw ELSE concat(regexp_replace(path, '/[^/]*$', ''), '/', ltrim(raw, '/')) END AS target FROM l WHERE NOT regexp_matches(raw, '^[a-zA-Z][a-zA-Z0-9+.-]*:')),
u AS (SELECT path, target, min(i) AS i FROM t WHERE target LIKE '%.md' GROUP BY path, target)
SELECT path, target FROM u QUALIFY row_number() OVER (PARTITION BY path ORDER BY i) <= 2""")
def cited_targets(spark, d):
    """Every Markdown file as one added hunk: the first two documents that it cites."""
    docs = repo(spark, d).where(P.lower_ext("path").isin(".md", ".markdown"))
    hunk = F.concat(F.lit("+"), F.replace("body", F.lit("\n"), F.lit("\n+")))
    return docs.select("path", F.explode(review.cited_targets(F.col("path"), hunk)).alias("target"))


@query("cut_names", "SELECT p_partkey AS part, CASE WHEN strlen(p_name) <= 20 THEN p_name ELSE concat(substring(p_name, 1, 19), '…') END AS name FROM part")
def cut_names(spark, d):
    return frame(spark, d, "part").select(F.col("p_partkey").alias("part"), P.cut_bytes("p_name", 20).alias("name"))


@query("template_shape", "SELECT CASE WHEN bool_or(path IN ('pnpm-workspace.yaml', 'turbo.json', 'nx.json')) OR (bool_or(path LIKE 'packages/%') AND bool_or(path LIKE 'apps/%')) THEN 'monorepo' WHEN bool_or(path = 'package.json') AND (bool_or(path = 'tsconfig.json') OR bool_or(path LIKE 'src/%')) THEN 'typescript-app' WHEN bool_or(path = 'go.mod') THEN 'go-cli' WHEN bool_or(path IN ('pyproject.toml', 'setup.py')) THEN 'python-package' WHEN bool_or(path = 'dbt_project.yml' OR path LIKE 'migrations/%' OR path LIKE 'rill/%') THEN 'data-pipeline' WHEN bool_or(path LIKE 'terraform/%' OR (path LIKE '%.tf' AND path NOT LIKE '%/%')) THEN 'infra-terraform' WHEN bool_or(path LIKE 'docs/%') AND count(*) FILTER (path NOT LIKE '%/%' AND lower(path) LIKE '%.md') >= 5 THEN 'docs-site' WHEN bool_or(path LIKE '.agents/%' OR path LIKE 'agents/%') THEN 'agent-repo' ELSE 'generic' END AS template FROM {repo}")
def template_shape(spark, d):
    return E.template_shape(repo(spark, d))


@query("case_meters", """WITH f AS (SELECT path, doc_id, doc_id % 4 AS r FROM {files_base}), t AS (SELECT count(*) FILTER (r = 0) AS before FROM f)
SELECT concat('c', doc_id) AS case_id, CASE WHEN r = 3 THEN 1 ELSE 0 END AS added, CASE WHEN r >= 2 THEN 1 ELSE 0 END AS removed, CASE WHEN r = 0 THEN 1 ELSE 0 END AS semantic_changed, CASE WHEN r = 1 THEN 1 ELSE 0 END AS semantic_noop,
  before + CASE WHEN r = 3 THEN 1 ELSE 0 END AS documents, CASE WHEN r = 0 THEN round(1 / before, 9) WHEN r = 3 THEN round(1 / (before + 1), 9) ELSE 0 END AS score, 0 AS broken FROM f, t""")
def case_meters(spark, d):
    """A mutated repository for each file, all in one plan: what changed, and how far the documents moved."""
    files = frame(spark, d, "files_base")
    r, none = F.col("doc_id") % 4, F.lit(None).cast("string")
    edits = files.select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("case_id"),
        F.when(r <= 1, "append_text").when(r == 2, "remove_file").otherwise("rename_file").alias("operation"),
        "path", none.alias("old"), none.alias("new"),
        F.when(r == 0, "\n# More cases").otherwise("\n// a note").alias("text"),
        F.concat("path", F.lit(".md")).alias("new_path"), none.alias("content"),
    )
    out = cases.evaluate(files.select("path", "body"), edits, RULES)
    return out.select("case_id", "added", "removed", "semantic_changed", "semantic_noop", "documents", F.round("semantic_score", 9).alias("score"), "broken")


def _few(n: int, item: str, most: int, order: str = "") -> str:
    """SQL: the first items of the lines with number ``n``, and how many more."""
    listed = f"coalesce(array_to_string((list({item} ORDER BY {order or item}) FILTER (l_linenumber = {n}))[1:{most}], ', '), '')"
    count = f"count(*) FILTER (l_linenumber = {n})"
    return f"concat({listed}, CASE WHEN {count} > {most} THEN concat(' (+', {count} - {most}, ' more)') ELSE '' END)"


_S = "concat('s', l_suppkey)"
_TEST = "concat('e', l_suppkey, ' (add web/', l_suppkey, '.test.ts)')"
SPOKEN = f"""WITH r AS (SELECT l_partkey AS part_id, l_partkey % 2 = 0 AS base, l_partkey % 3 <> 0 AS conv, l_partkey % 4 AS broken, l_partkey % 5 <> 0 AS tested, (l_partkey % 7) * 20.5 AS moved, count(*) AS total,
  {", ".join(f"count(*) FILTER (l_linenumber = {i}) AS n{i}" for i in range(1, 8))}, {_few(1, _S, 4)} AS s1, {_few(2, _S, 4)} AS s2, {_few(3, _S, 4)} AS s3, {_few(3, _S, 3)} AS a3, {_few(4, "concat('e', l_suppkey)", 4)} AS s4, {_few(4, _TEST, 3)} AS a4,
  {_few(5, "concat('d', l_orderkey, '→', l_suppkey)", 3)} AS s5, {_few(6, _S, 4)} AS s6, {_few(6, _S, 3)} AS a6, {_few(7, _S, 3, f"l_quantity DESC, {_S}")} AS a7 FROM lineitem GROUP BY l_partkey),
said AS (SELECT part_id, 'explanation' AS part, 1 AS k, 'required_edge_breakage' AS meter, concat(broken, ' of 3 rule(s) fire on the changed files: ') AS line FROM r WHERE broken > 0
  UNION ALL SELECT part_id, 'explanation', 2, 'trace_coverage', concat(total - n1, ' of ', total, ' user stories are mentioned; not mentioned: ', s1) FROM r
  UNION ALL SELECT part_id, 'explanation', 3, 'neighborhood_drift', CASE WHEN base THEN concat('the graph moved by ', CAST(CAST(moved AS DOUBLE) AS VARCHAR), ' (edges +0/-0, nodes +0/-0)', CASE WHEN moved >= 100 THEN '; the baseline looks old, index again' ELSE '' END) ELSE 'there is no baseline to compare with' END FROM r
  UNION ALL SELECT part_id, 'explanation', 4, 'semantic_movement', '0 of 0 Markdown files changed in meaning, 0 in form only' FROM r WHERE base
  UNION ALL SELECT part_id, 'explanation', 5, 'path_loss', concat(n2, ' of ', total, ' concepts reach no support', CASE WHEN conv THEN '' ELSE ' (no concept here is supported, so the verdict leaves it out)' END, ': ', s2) FROM r
  UNION ALL SELECT part_id, 'explanation', 6, 'path_loss', concat(n3, ' concepts lost their support since the baseline: ', s3) FROM r WHERE n3 > 0
  UNION ALL SELECT part_id, 'explanation', 7, 'blast_radius', '0 changed nodes have 0 neighbours that did not change' FROM r WHERE base
  UNION ALL SELECT part_id, 'explanation', 8, 'staleness', concat(n7, ' of ', total, ' files were not touched for 90 days') FROM r
  UNION ALL SELECT part_id, 'explanation', 9, 'orphan_endpoints', concat(n4, ' routes are defined in files without a test', CASE WHEN tested THEN '' ELSE ' (no test here is paired with a file, so the verdict leaves it out)' END, ': ', s4) FROM r WHERE n4 > 0
  UNION ALL SELECT part_id, 'explanation', 10, 'broken_links', concat(n5, ' links lead to files that are not there: ', s5) FROM r WHERE n5 > 0
  UNION ALL SELECT part_id, 'explanation', 11, 'unknown_id_references', concat(n6, ' ids in code are defined nowhere: ', s6) FROM r WHERE n6 > 0
  UNION ALL SELECT part_id, 'action', 1, 'required_edge_breakage', 'review the changed files against the rules that fire' FROM r WHERE broken > 0
  UNION ALL SELECT part_id, 'action', 2, 'trace_coverage', 'mention the stories without coverage in a spec or an evidence packet' FROM r WHERE n1 > 0
  UNION ALL SELECT part_id, 'action', 3, 'neighborhood_drift', CASE WHEN base THEN 'look at the graph''s diff' ELSE 'index the repository, to have a baseline' END FROM r WHERE NOT base OR moved >= 2
  UNION ALL SELECT part_id, 'action', 4, 'path_loss', 'link the concepts without support from a supporting document, or accept that they stand alone' FROM r WHERE conv AND 2 * n2 >= total
  UNION ALL SELECT part_id, 'action', 5, 'path_loss', concat('bring back the support of: ', a3) FROM r WHERE n3 > 0
  UNION ALL SELECT part_id, 'action', 6, 'staleness', concat('read again or retire the oldest files: ', a7) FROM r WHERE 4 * n7 >= total
  UNION ALL SELECT part_id, 'action', 7, 'orphan_endpoints', concat('test the files of the routes: ', a4) FROM r WHERE n4 > 0
  UNION ALL SELECT part_id, 'action', 8, 'broken_links', concat('correct or remove the links: ', s5) FROM r WHERE n5 > 0
  UNION ALL SELECT part_id, 'action', 9, 'unknown_id_references', concat('write the records of these ids, or remove them from code: ', a6) FROM r WHERE n6 > 0),
idle AS (SELECT part_id, 'action' AS part, 10 AS k, CASE WHEN NOT conv AND 2 * n2 >= total THEN 'silenced' ELSE 'none' END AS meter,
  CASE WHEN NOT conv AND 2 * n2 >= total THEN 'to hear of path_loss: tie a concept, claim or endpoint to a test, to evidence or to code' ELSE 'nothing to do' END AS line FROM r WHERE part_id NOT IN (SELECT part_id FROM said WHERE part = 'action'))
SELECT part_id, part, row_number() OVER (PARTITION BY part_id, part ORDER BY k) - 1 AS position, meter, line FROM (SELECT * FROM said UNION ALL SELECT * FROM idle)"""


@query("meter_explanations", SPOKEN)
def meter_explanations(spark, d):
    """Each part as a repository whose lines are what the meters found: the report in words."""
    lines = frame(spark, d, "lineitem").select(F.col("l_partkey").alias("part_id"), "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    of = lambda n, **columns: lines.where(F.col("l_linenumber") == n).select("part_id", *[F.expr(c).alias(k) for k, c in columns.items()])
    name = "concat('s', l_suppkey)"
    found = {
        "trace_coverage": of(1, id=name), "path_loss": of(2, id=name), "newly_orphaned_concept": of(3, id=name), "orphan_endpoints": of(4, id="concat('e', l_suppkey)", source="concat('web/', l_suppkey, '.ts')"),
        "broken_links": of(5, source="concat('d', l_orderkey)", target="string(l_suppkey)"), "unknown_id_references": of(6, id=name), "staleness": of(7, path=name, age_days="l_quantity"),
    }
    n = lambda k: F.count_if(F.col("l_linenumber") == k)
    key, total = F.col("part_id"), F.count(F.lit(1))
    report = lines.groupBy("part_id").agg(
        total.alias("stories"), total.alias("concepts"), total.alias("files"), n(1).alias("uncovered_stories"), (n(2) / total).alias("path_loss_score"), n(3).alias("newly_orphaned_concepts"),
        n(4).alias("orphan_endpoints"), n(5).alias("broken_links"), n(6).alias("unknown_ids"), n(7).alias("stale_files"), (n(7) / total).alias("staleness_score"),
    )
    report = report.withColumns({
        "base_available": key % 2 == 0, "path_loss_convention": key % 3 != 0, "broken_rules": key % 4, "rules": F.lit(3), "endpoint_convention": key % 5 != 0, "neighborhood_score": (key % 7) * F.lit(20.5),
    })
    lists = explain.shortlist(keep(explain.items(found, "part_id"), "items"), "part_id")
    return explain.spoken(explain.explain(explain.attach(V.judge(report), lists, "part_id")), "part_id")


GLOBS = ["docs/**/*.md", "none/**", "web/*.ts", "**/*_test.*", "web/**/*.test.ts", "sql/*.[sp]*", "?ocs/*"]
_GLOB_SQL = ["^docs/(.*/)?[^/]*\\.md$", "^none/.*$", "^web/[^/]*\\.ts$", "^(.*/)?[^/]*_test\\.[^/]*$", "^web/(.*/)?[^/]*\\.test\\.ts$", "^sql/[^/]*\\.[sp][^/]*$", "^[^/]ocs/[^/]*$"]


@query("triggered_globs", " UNION ALL ".join(f"SELECT DISTINCT split_part(path, '/', 1) AS top, {i} AS position, '{g}' AS glob FROM {{repo}} WHERE regexp_matches(path, '{_GLOB_SQL[i]}')" for i, g in enumerate(GLOBS)))
def triggered_globs(spark, d):
    """For each top folder the globs that one of its files matches."""
    paths = repo(spark, d).select("path", F.substring_index("path", "/", 1).alias("top"))
    return globs.triggered(paths, GLOBS, "top").select("top", "position", "glob")


@query("command_order", f"SELECT command, row_number() OVER (ORDER BY k) - 1 AS position FROM (SELECT command, min(CASE rule WHEN 'met' THEN 1 WHEN 'docs' THEN 2 ELSE 3 END) AS k FROM ({FIRED}) GROUP BY command)")
def command_order(spark, d):
    """What the fired rules suggest, in the order of a rule list that starts with the last rules."""
    return rules.suggested_in_order(rules.evaluate(repo(spark, d), RULES), [RULES[2], RULES[0], RULES[1]])


@query("gate", f"SELECT count(DISTINCT rule) AS findings, CASE WHEN bool_or(severity = 'error') THEN 'error' WHEN count(*) > 0 THEN 'warn' END AS severity, CASE WHEN bool_or(severity = 'error') THEN 1 ELSE 0 END AS exit_code FROM ({FIRED})")
def gate(spark, d):
    """The whole gate over a change set of all files: rules, then the worst finding."""
    from .runs import review as review_all

    files = repo(spark, d)
    found = review_all(files, files, RULES)
    return found.agg(F.count(F.lit(1)).alias("findings")).join(F.broadcast(rules.worst(found)))


@query("strict_promotion", f"""SELECT id, concat_ws(',', CASE WHEN a3 THEN 'neighborhood_drift' END, CASE WHEN a4 THEN 'semantic_movement' END, CASE WHEN a7 THEN 'blast_radius' END, CASE WHEN a8 THEN 'staleness' END) AS movement,
concat_ws(',', CASE WHEN broken_rules > 0 THEN 'required_edge_breakage' END, CASE WHEN a1 THEN 'trace_coverage' END, CASE WHEN a5 OR newly_orphaned_concepts > 0 THEN 'path_loss' END, CASE WHEN a9 OR newly_unsupported_claims > 0 THEN 'claim_support' END,
CASE WHEN contradictions > 0 THEN 'contradiction' END, CASE WHEN stale_decisions > 0 THEN 'stale_decision_links' END, CASE WHEN broken_chains > 0 THEN 'broken_implements_chains' END, CASE WHEN cycles > 0 THEN 'dependency_cycles' END,
CASE WHEN a14 OR newly_orphaned_endpoints > 0 THEN 'orphan_endpoints' END, CASE WHEN a16 THEN 'unimplemented_stories' END, CASE WHEN broken_links > 0 THEN 'broken_links' END, CASE WHEN unknown_ids > 0 THEN 'unknown_id_references' END,
CASE WHEN stale_tests > 0 THEN 'stale_tests' END, CASE WHEN truth_conflicts > 0 THEN 'truth_alignment' END, CASE WHEN orphaned_aliases > 0 THEN 'orphaned_metric_aliases' END, CASE WHEN dangling_imports > 0 THEN 'dangling_imports' END, CASE WHEN callsite_score > 0 THEN 'callsite_blast_radius' END, CASE WHEN dead_code > 0 THEN 'dead_code' END) AS substantive
FROM (SELECT *, {_HOLDS} FROM ({BRANCHES}))""")
def strict_promotion(spark, d):
    """Active meters that only say that something moved, apart from the others."""
    facts = spark.sql(expand(BRANCHES, lambda t: f"parquet.`{d}/{t}.parquet`"))
    return V.strict(V.judge(facts)).select("id", F.array_join("movement", ",").alias("movement"), F.array_join("substantive", ",").alias("substantive"))


@query("contradictions", "SELECT count(*) FILTER (o_orderpriority = '1-URGENT') AS score, (SELECT count(*) FROM (SELECT o_custkey FROM orders UNION SELECT -1 - o_orderkey // 8 FROM orders)) AS candidates FROM orders")
def contradictions(spark, d):
    """Orders as findings of a review: how many contradict, over how many files."""
    rule = F.when(F.col("o_orderpriority") == "1-URGENT", "llm-contradiction").otherwise("llm-note")
    files = F.array(F.col("o_custkey").cast("string"), F.expr("string(-1 - o_orderkey div 8)"))
    return meters.contradiction(frame(spark, d, "orders").select(rule.alias("rule"), files.alias("triggered_by")))


@query("outcome_contract", """WITH f AS (SELECT o_orderkey AS id, ['scan', 'check', 'review'][o_orderkey % 3 + 1] AS sub, CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 0 END AS errors, CASE WHEN o_custkey % 5 = 0 THEN 2 ELSE 0 END AS warns, o_custkey % 3 AS staged, o_custkey % 2 AS dirty,
  o_orderkey % 4 AS untracked, o_custkey % 7 > 3 AS incl, ['clean', 'telemetry', 'warn'][o_custkey % 3 + 1] AS drift, CASE WHEN o_orderkey % 5 = 1 THEN 1 ELSE 0 END AS regr, o_orderkey % 11 = 0 AS truth, o_custkey % 13 = 0 AS missing FROM orders),
g AS (SELECT *, NOT incl AND untracked > 0 AS excl, sub = 'scan' AND staged = 0 AND dirty + untracked > 0 AS stranded, drift = 'telemetry' AND regr > 0 AS slid FROM f)
SELECT id, errors > 0 AS blocking_error, errors = 0 AS safe_to_commit, warns > 0 OR drift = 'warn' OR truth OR excl OR stranded OR slid AS review_recommended, CASE WHEN staged = 0 THEN 'clean' ELSE 'dirty' END AS staged_state,
  CASE WHEN dirty + untracked = 0 THEN 'clean' ELSE 'dirty' END AS worktree_state, excl AS untracked_excluded, drift = 'telemetry' AND NOT truth AS telemetry_only,
  CASE WHEN stranded OR (sub = 'check' AND excl) THEN 'review --base=HEAD --worktree --json' WHEN missing THEN 'index' WHEN slid OR truth THEN 'drift --json' ELSE '' END AS next_command, drift AS drift_verdict FROM g""")
def outcome_contract(spark, d):
    """Every field of the outcome, each order a run with facts of its own."""
    e = F.expr
    rows = frame(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), e("element_at(array('scan', 'check', 'review'), int(o_orderkey % 3) + 1)").alias("subcommand"), e("int(o_orderkey % 8 = 0)").alias("errors"), e("2 * int(o_custkey % 5 = 0)").alias("warns"),
        e("o_custkey % 3").alias("staged"), e("o_custkey % 2").alias("dirty"), e("o_orderkey % 4").alias("untracked"), e("o_custkey % 7 > 3").alias("include_untracked"),
        e("element_at(array('clean', 'telemetry', 'warn'), int(o_custkey % 3) + 1)").alias("drift_verdict"), e("int(o_orderkey % 5 = 1)").alias("regressions"), e("o_orderkey % 11 = 0").alias("truth_clarification"), e("o_custkey % 13 = 0").alias("baseline_missing"),
    )
    return V.outcome(rows, "id")
