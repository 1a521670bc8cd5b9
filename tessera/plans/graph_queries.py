"""Queries over the virtual graph: merging, differences, meters, traversals, verdict."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import meters as M
from ..operators import traverse as T
from ..operators import verdict as V
from .virtual import dealt, duckdb_sql, frame, repeated, sided

QUERIES, SQL = {}, {}
NOW = datetime(2001, 8, 2)
SUPPORT = "('mentions', 'defines', 'describes', 'verifies', 'supports', 'generates', 'expects', 'implements', 'depends_on')"


def query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = duckdb_sql(sql)
        return f

    return register


def _now(spark, d):
    return frame(spark, d, "nodes_current"), frame(spark, d, "edges_current")


def _base(spark, d):
    return frame(spark, d, "nodes_base"), frame(spark, d, "edges_base")


def _endpoints(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("kind", F.regexp_replace("kind", "_$", ""))


@query("node_counts_by_kind", "SELECT kind, count(*) AS n FROM {nodes_current} GROUP BY kind")
def node_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.counts(_now(spark, d)[0])


@query("edge_counts_by_kind", "SELECT kind, count(*) AS n FROM {edges_current} GROUP BY kind")
def edge_counts(spark, d):
    return G.counts(_now(spark, d)[1])


@query(
    "node_merge_first_wins",
    """SELECT id, kind, label FROM (SELECT concat('n', CAST(l_partkey AS VARCHAR)) AS id, l_returnflag AS kind, l_linestatus AS label, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber, l_orderkey, l_suppkey, l_returnflag, l_linestatus) AS r FROM lineitem) WHERE r = 1""",
)
def node_merge(spark, d):
    rows = frame(spark, d, "lineitem")
    emitted = rows.select(
        F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("id"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("label"), F.lit("").alias("path"),
        F.create_map(F.lit("mode"), F.col("l_linestatus")).alias("meta"), F.col("l_linenumber").alias("pass_seq"), F.format_string("%020d", "l_orderkey").alias("file_seq"),
        F.struct("l_suppkey", "l_returnflag", "l_linestatus").alias("pos"),
    )
    return G.merge_nodes(emitted).select("id", "kind", "label")


@query("edge_dedupe", "SELECT src, dst, provenance FROM (SELECT l_orderkey AS src, l_suppkey AS dst, l_linenumber AS provenance, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) AS r FROM lineitem) WHERE r = 1")
def edge_dedupe(spark, d):
    rows = frame(spark, d, "lineitem").select(F.lit("e").alias("kind"), F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_linenumber").alias("provenance"), F.col("l_linenumber").alias("pass_seq"), F.lit("").alias("file_seq"), F.lit(0).alias("pos"))
    return G.dedupe_edges(rows).select("src", "dst", "provenance")


DIFF = """SELECT 'added' AS change, kind, src, dst FROM (SELECT kind, src, dst FROM {edges_current} EXCEPT SELECT kind, src, dst FROM {edges_base})
UNION ALL SELECT 'removed', kind, src, dst FROM (SELECT kind, src, dst FROM {edges_base} EXCEPT SELECT kind, src, dst FROM {edges_current})"""


@query("graph_diff", DIFF)
def graph_diff(spark, d):
    return G.diff_edges(_base(spark, d)[1], _now(spark, d)[1])


@query("node_diff", "SELECT 'added' AS change, id, kind FROM {nodes_current} WHERE id NOT IN (SELECT id FROM {nodes_base}) UNION ALL SELECT 'removed', id, kind FROM {nodes_base} WHERE id NOT IN (SELECT id FROM {nodes_current})")
def node_diff(spark, d):
    return G.diff_nodes(_base(spark, d)[0], _now(spark, d)[0])


@query("degree", "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {edges_current} UNION ALL SELECT dst FROM {edges_current}) GROUP BY node")
def degree(spark, d):
    return G.degree(*dealt(spark, d, "edges_current", "src", "dst"))


TRACE = """SELECT s.id, s.id IN (SELECT dst FROM {%s} WHERE kind = 'defines' AND src IN (SELECT dst FROM {%s} WHERE kind = 'mentions')) AS good FROM {%s} s WHERE s.kind = 'user_story'"""


@query("trace_coverage", TRACE % ("edges_current", "edges_current", "nodes_current"))
def trace_coverage(spark, d):
    return M.trace_state(*_now(spark, d))


@query("trace_coverage_score", f"SELECT count(*) AS total, count(*) FILTER (good) AS good, CASE WHEN count(*) = 0 THEN 1.0 ELSE round(count(*) FILTER (good) / count(*), 6) END AS score FROM ({TRACE % ('edges_current', 'edges_current', 'nodes_current')})")
def trace_score(spark, d):
    return M.coverage(M.trace_state(*_now(spark, d))).withColumn("score", F.round("score", 6))


@query("trace_transitions", f"SELECT c.id, CASE WHEN c.good THEN 'newly_good' ELSE 'newly_bad' END AS change FROM ({TRACE % ('edges_current', 'edges_current', 'nodes_current')}) c JOIN ({TRACE % ('edges_base', 'edges_base', 'nodes_base')}) b ON c.id = b.id WHERE b.good <> c.good")
def trace_transitions(spark, d):
    return M.transitions(M.trace_state(*_base(spark, d)), M.trace_state(*_now(spark, d)))


WEIGHT = "CASE kind WHEN 'contains' THEN 0.5 WHEN 'mentions' THEN 1.0 WHEN 'defines' THEN 3.0 WHEN 'suggests' THEN 1.0 ELSE 0.0 END"


@query(
    "neighborhood_drift",
    f"""WITH e AS ({DIFF}), a AS (SELECT count(*) AS n FROM {{nodes_current}} WHERE id NOT IN (SELECT id FROM {{nodes_base}})), r AS (SELECT count(*) AS n FROM {{nodes_base}} WHERE id NOT IN (SELECT id FROM {{nodes_current}}))
SELECT CAST(coalesce(sum(CASE change WHEN 'removed' THEN {WEIGHT} ELSE 0.5 * ({WEIGHT}) END), 0) + 0.25 * any_value(a.n) + 0.5 * any_value(r.n) AS DOUBLE) AS score, any_value(a.n) AS nodes_added, any_value(r.n) AS nodes_removed FROM e, a, r""",
)
def neighborhood(spark, d):
    return M.neighborhood(*_base(spark, d), *_now(spark, d))


def _reach(edges: str, nodes: str, kinds: str = "('test', 'evidence', 'endpoint', 'generated_artifact')") -> str:
    return f"""WITH RECURSIVE u AS MATERIALIZED (SELECT src AS a, dst AS b FROM {{{edges}}} WHERE kind IN {SUPPORT} UNION SELECT dst, src FROM {{{edges}}} WHERE kind IN {SUPPORT}),
r(node) AS (SELECT id FROM {{{nodes}}} WHERE kind IN {kinds} UNION SELECT u.b FROM r JOIN u ON r.node = u.a) """


@query("reachability", _reach("edges_current", "nodes_current") + "SELECT node FROM r")
def reachability(spark, d):
    return M.supported(frame(spark, d, "nodes_current"), repeated(spark, d, "edges_current"))


def _supported(spark, d, kind: str) -> DataFrame:
    nodes = frame(spark, d, "nodes_current")
    return M.support_state(nodes, M.supported(nodes, repeated(spark, d, "edges_current"), kind), kind)


@query("path_loss", _reach("edges_current", "nodes_current") + "SELECT id, id IN (SELECT node FROM r) AS good FROM {nodes_current} WHERE kind = 'concept'")
def path_loss(spark, d):
    return _supported(spark, d, "concept")


@query("path_loss_score", _reach("edges_current", "nodes_current") + "SELECT count(*) AS total, count(*) FILTER (NOT good) AS lost, round(count(*) FILTER (NOT good) / count(*), 6) AS score, bool_or(good) AS convention FROM (SELECT id IN (SELECT node FROM r) AS good FROM {nodes_current} WHERE kind = 'concept')")
def path_loss_score(spark, d):
    return M.loss(_supported(spark, d, "concept")).withColumn("score", F.round("score", 6))


@query("claim_support", _reach("edges_current", "nodes_current") + "SELECT id, id IN (SELECT node FROM r) AS good FROM {nodes_current} WHERE kind = 'claim'")
def claim_support(spark, d):
    return _supported(spark, d, "claim")


TOUCHED = f"t AS (SELECT src AS node FROM ({DIFF}) UNION SELECT dst FROM ({DIFF})), u AS (SELECT src AS node, dst AS other FROM {{edges_current}} UNION SELECT dst, src FROM {{edges_current}})"


@query("blast_radius", f"WITH {TOUCHED} SELECT (SELECT count(DISTINCT other) FROM u WHERE node IN (SELECT node FROM t) AND other NOT IN (SELECT node FROM t)) AS score, (SELECT count(*) FROM u WHERE node IN (SELECT node FROM t)) AS centrality, (SELECT count(*) FROM t) AS touched")
def blast_radius(spark, d):
    return M.blast_sides(sided(spark, d, "edges_base", "edges_current"))[1]


@query("blast_top5", f"WITH {TOUCHED} SELECT node, count(*) FILTER (other NOT IN (SELECT node FROM t)) AS impact FROM u WHERE node IN (SELECT node FROM t) GROUP BY node HAVING impact >= 1 ORDER BY impact DESC, node LIMIT 5")
def blast_top5(spark, d):
    return M.blast_top(M.blast_sides(sided(spark, d, "edges_base", "edges_current"))[0])


STALE = """WITH fame AS (SELECT dst, count(*) AS n FROM {describes} GROUP BY dst), w AS (SELECT replace(src, 'doc:', '') AS path, max(n) AS weight FROM {describes} JOIN fame USING (dst) GROUP BY 1), l AS (SELECT path, max(ts) AS ts FROM {commits} GROUP BY path),
rows AS (SELECT f.path, coalesce(w.weight, 1)::BIGINT AS weight, floor((epoch(TIMESTAMP '2001-08-02') - epoch(l.ts)) / 86400)::BIGINT AS age_days, coalesce(epoch(TIMESTAMP '2001-08-02') - epoch(l.ts) >= 90 * 86400, false) AS stale FROM {commit_files} f LEFT JOIN l ON f.path = l.path LEFT JOIN w ON f.path = w.path) """


def _stale(spark, d):
    return M.staleness_rows(frame(spark, d, "commit_files"), frame(spark, d, "commits"), frame(spark, d, "describes"), NOW)


@query("staleness", STALE + "SELECT * FROM rows")
def staleness(spark, d):
    return _stale(spark, d)


@query("staleness_score", STALE + "SELECT count(*) AS files, count(*) FILTER (stale) AS stale, round(coalesce(sum(weight) FILTER (stale), 0) / sum(weight), 6) AS score FROM rows")
def staleness_score(spark, d):
    return M.staleness(_stale(spark, d)).withColumn("score", F.round("score", 6))


@query("staleness_top5", STALE + "SELECT path, age_days FROM rows WHERE stale ORDER BY age_days DESC, path LIMIT 5")
def stalest(spark, d):
    return M.stalest(_stale(spark, d))


@query(
    "stale_decisions",
    """WITH e AS (SELECT * FROM {edges_current}), cites AS (SELECT DISTINCT m.src AS doc, f.dst AS id FROM e m JOIN e f ON m.dst = f.src WHERE m.kind = 'mentions' AND f.kind = 'defines'), fine AS (SELECT doc, id FROM cites UNION SELECT src, dst FROM e WHERE kind = 'defines')
SELECT DISTINCT c.doc, s.dst AS old, s.src AS new FROM e s JOIN cites c ON c.id = s.dst WHERE s.kind = 'supersedes' AND NOT EXISTS (SELECT 1 FROM fine WHERE fine.doc = c.doc AND fine.id = s.src)""",
)
def stale_decisions(spark, d):
    return M.stale_decisions(_now(spark, d)[1])


@query("broken_chains", "SELECT DISTINCT src, dst FROM {edges_current} WHERE kind = 'implements' AND dst NOT IN (SELECT dst FROM {edges_current} WHERE kind = 'supports')")
def broken_chains(spark, d):
    return M.broken_chains(_now(spark, d)[1])


CYCLES = "WITH RECURSIVE arcs AS MATERIALIZED (SELECT DISTINCT concat('dir:', regexp_replace(substring(src, 6), '/[^/]*$', '')) AS src, dst FROM {arcs}), p(a, b) AS (SELECT src, dst FROM arcs UNION SELECT p.a, arcs.dst FROM p JOIN arcs ON p.b = arcs.src) SELECT a AS node FROM p WHERE a = b"


@query("cycle_nodes", CYCLES)
def cycle_nodes(spark, d):
    return T.on_cycles(M.directory_arcs(frame(spark, d, "arcs")))


ARCS = "arcs AS MATERIALIZED (SELECT DISTINCT concat('dir:', regexp_replace(substring(src, 6), '/[^/]*$', '')) AS src, dst FROM {arcs})"


@query("strong_components", f"WITH RECURSIVE {ARCS}, p(a, b) AS (SELECT src, dst FROM arcs UNION SELECT p.a, arcs.dst FROM p JOIN arcs ON p.b = arcs.src), m AS (SELECT src AS node FROM arcs UNION SELECT dst FROM arcs) SELECT node, least(node, coalesce(min(x.b), node)) AS component FROM m LEFT JOIN p x ON x.a = node AND EXISTS (SELECT 1 FROM p y WHERE y.a = x.b AND y.b = x.a) GROUP BY node")
def strong_components(spark, d):
    return T.strong_components(M.directory_arcs(frame(spark, d, "arcs")))


# the walk as a machine: a row for each connected part, a step for each arc looked at
@query(
    "dependency_cycles",
    f"""WITH RECURSIVE {ARCS}, near AS (SELECT src AS a, dst AS b FROM arcs UNION SELECT dst, src FROM arcs), c(node, other) AS (SELECT a, a FROM near UNION SELECT c.node, near.b FROM c JOIN near ON c.other = near.a),
part AS (SELECT node, min(other) AS part FROM c GROUP BY node), follow AS (SELECT part, list(src ORDER BY src) AS roots FROM (SELECT DISTINCT part, src FROM arcs JOIN part ON node = src) GROUP BY part),
after AS (SELECT part, map_from_entries(list((src, kids))) AS kids FROM (SELECT part, src, list(dst ORDER BY dst) AS kids FROM arcs JOIN part ON node = src GROUP BY part, src) GROUP BY part),
w(part, roots, stack, places, done, ring, step) AS (
  SELECT part, roots, CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR[]), 0 FROM follow
  UNION ALL
  SELECT part, CASE WHEN len(stack) = 0 THEN roots[2:] ELSE roots END,
         CASE WHEN len(stack) = 0 THEN CASE WHEN list_contains(done, roots[1]) THEN stack ELSE [roots[1]] END WHEN nxt IS NULL THEN stack[:-2] WHEN list_contains(stack, nxt) OR list_contains(done, nxt) THEN stack ELSE list_append(stack, nxt) END,
         CASE WHEN len(stack) = 0 THEN CASE WHEN list_contains(done, roots[1]) THEN places ELSE [CAST(0 AS BIGINT)] END WHEN nxt IS NULL THEN places[:-2] WHEN list_contains(stack, nxt) OR list_contains(done, nxt) THEN list_append(places[:-2], places[-1] + 1) ELSE list_append(list_append(places[:-2], places[-1] + 1), CAST(0 AS BIGINT)) END,
         CASE WHEN len(stack) > 0 AND nxt IS NULL THEN list_append(done, stack[-1]) ELSE done END,
         CASE WHEN len(stack) > 0 AND list_contains(stack, nxt) THEN stack[list_position(stack, nxt):] END, step + 1
  FROM (SELECT w.*, coalesce(kids[stack[-1]], CAST([] AS VARCHAR[]))[places[-1] + 1] AS nxt FROM w JOIN after USING (part) WHERE len(stack) > 0 OR len(roots) > 0)),
r AS (SELECT part, ring, step, list_position(ring, list_min(ring)) AS k FROM w WHERE ring IS NOT NULL)
SELECT array_to_string(arg_min(ring, step), ',') AS ring, len(any_value(ring))::INTEGER AS n FROM r GROUP BY part, list_concat(ring[k:], ring[:k - 1])""",
)
def dependency_cycles(spark, d):
    """The rings as the walk meets them: their directories in order, joined."""
    return M.dependency_cycles(frame(spark, d, "arcs")).select(F.array_join("ring", ",").alias("ring"), F.size("ring").alias("n"))


ENDPOINTS = "SELECT n.id, x.source, x.source IN (SELECT dst FROM {edges_current} WHERE kind = 'verifies') AS good FROM {nodes_current} n JOIN (SELECT dst, max(src) AS source FROM {edges_current} WHERE kind = 'defines' GROUP BY dst) x ON n.id = x.dst WHERE n.kind = 'endpoint_'"


@query("orphan_endpoints", ENDPOINTS)
def orphan_endpoints(spark, d):
    nodes, edges = _now(spark, d)
    return M.endpoint_state(_endpoints(nodes), edges)


@query("unimplemented", "SELECT id FROM {nodes_current} WHERE kind = 'user_story' AND id NOT IN (SELECT dst FROM {edges_current} WHERE kind = 'implements')")
def unimplemented(spark, d):
    return M.unimplemented(*_now(spark, d))


@query("conventions", "SELECT count(*) > 0 AS convention FROM (SELECT * FROM {edges_current} UNION ALL SELECT * FROM {edges_base}) WHERE kind = 'implements'")
def conventions(spark, d):
    return M.has_kind("implements", _now(spark, d)[1], _base(spark, d)[1])


@query(
    "callers_khop",
    """WITH RECURSIVE c AS MATERIALIZED (SELECT to_func AS src, from_func AS dst FROM {calls}), s AS (SELECT DISTINCT to_func AS node FROM {calls}), h(node, place, level) AS (SELECT node, node, 0 FROM s UNION SELECT h.node, c.dst, h.level + 1 FROM h JOIN c ON h.place = c.src WHERE h.level < 2)
SELECT node, place AS target, min(level)::INT AS level FROM h WHERE level > 0 GROUP BY node, place""",
)
def callers_khop(spark, d):
    calls = frame(spark, d, "calls").select(F.col("to_func").alias("src"), F.col("from_func").alias("dst"))
    return T.hops(calls.select(F.col("src").alias("node")).distinct(), calls, 2)


_SITES = """a AS MATERIALIZED (SELECT concat('p.', to_func) AS src, concat('p.', from_func) AS caller, file, line FROM {call_sites}), ch AS (SELECT concat('p.f', p_partkey) AS symbol, concat('m', p_partkey % 5, '.go') AS file FROM part WHERE p_size % 5 = 0),
d AS (SELECT src AS symbol, count(*) AS direct_callers, count(*) FILTER (NOT ends_with(file, '_test.go')) AS direct_production FROM a GROUP BY src)"""


@query(
    "callsites",
    f"""WITH {_SITES}, t AS (SELECT src AS symbol, string_agg(concat(caller, '@', file, ':', line), ',' ORDER BY n) AS top FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY file, line, caller) AS n FROM a) WHERE n <= 10 GROUP BY src),
s AS MATERIALIZED (SELECT src, caller, min({{{{'line': line, 'file': file}}}}).file AS file FROM a WHERE NOT ends_with(file, '_test.go') GROUP BY src, caller), r1 AS (SELECT symbol, caller, min(s.file) AS file FROM ch JOIN s ON src = symbol GROUP BY ALL),
r2 AS (SELECT symbol, s.caller, min(s.file) AS file FROM r1 JOIN s ON src = r1.caller GROUP BY ALL), r AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 ANTI JOIN r1 USING (symbol, caller)), f AS (SELECT symbol, count(*) AS transitive_callers, count(DISTINCT file) AS transitive_files FROM r GROUP BY symbol)
SELECT symbol, file, coalesce(direct_callers, 0) AS direct_callers, coalesce(direct_production, 0) AS direct_production, coalesce(transitive_callers, 0) AS transitive_callers, coalesce(transitive_files, 0) AS transitive_files, coalesce(top, '') AS top FROM ch LEFT JOIN d USING (symbol) LEFT JOIN t USING (symbol) LEFT JOIN f USING (symbol)""".replace("{{", "{").replace("}}", "}"),
)
def callsites(spark, d):
    """Every changed function: its callers, theirs, the files, and the first ten call sites."""
    from ..operators.golang import callers

    changed, calls = _sites(spark, d)
    top = F.array_join(F.transform("top_callers", lambda x: F.concat(x["caller"], F.lit("@"), x["file"], F.lit(":"), x["line"].cast("string"))), ",")
    return callers(changed, calls, most=None).withColumn("top_callers", top).withColumnRenamed("top_callers", "top")


def _sites(spark, d):
    changed = frame(spark, d, "part").where("p_size % 5 = 0").select(F.lit("p").alias("pkg"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit("m"), (F.col("p_partkey") % 5).cast("string"), F.lit(".go")).alias("file"))
    return changed, frame(spark, d, "call_sites").select(F.lit("p").alias("from_pkg"), "from_func", F.lit("p").alias("to_pkg"), "to_func", "file", "line")


@query(
    "callsite_blast",
    f"""WITH {_SITES}, k AS (SELECT *, row_number() OVER (ORDER BY file, symbol) AS n FROM ch), p AS (SELECT k.symbol, k.file, coalesce(direct_production, 0) AS m FROM k LEFT JOIN d USING (symbol) WHERE n <= 50), b AS (SELECT * FROM p WHERE m > 0 ORDER BY m DESC, file, symbol LIMIT 5)
SELECT coalesce((SELECT max(m) FROM b), 0) AS score, (SELECT string_agg(symbol, ',' ORDER BY m DESC, file, symbol) FROM b) AS top, (SELECT string_agg(symbol, ',' ORDER BY symbol) FROM p) AS changed, CASE WHEN (SELECT count(*) FROM ch) > 50 THEN 1 ELSE 0 END AS warnings""",
)
def callsite_blast(spark, d):
    """The meter as it is reported: at most fifty changed functions (its documented bound), the top five."""
    from ..operators.golang import callsite_blast as blast

    return blast(*_sites(spark, d)).select("score", F.array_join("top_symbols", ",").alias("top"), F.array_join("changed_symbols", ",").alias("changed"), F.size("warnings").alias("warnings"))


@query(
    "go_in_build",
    """SELECT path FROM {go_builds} WHERE CASE ending WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE true END AND CASE form WHEN 1 THEN false WHEN 3 THEN true WHEN 5 THEN false ELSE true END""",
)
def go_in_build(spark, d):
    """Go files that a build for linux on amd64 compiles."""
    from ..operators.golang import in_build

    return in_build(frame(spark, d, "go_builds")).select("path")


@query("dead_code", "SELECT name FROM {defs} WHERE NOT method AND NOT regexp_matches(name, '^[A-Z]') AND name NOT IN (SELECT to_func FROM {calls}) ORDER BY file, line, name LIMIT 50")
def dead_code(spark, d):
    from ..operators.golang import dead_code as unused

    calls = frame(spark, d, "calls").select(F.lit("p").alias("to_pkg"), "to_func")
    return unused(frame(spark, d, "defs").withColumn("pkg", F.lit("p")), calls).select(F.regexp_replace("symbol", r"^p\.", "").alias("name"))


@query("impact_predict", "WITH s AS (SELECT concat('src/', CAST(o_orderkey AS VARCHAR), '.py') AS path, concat('file:', CAST(o_orderkey AS VARCHAR)) AS node FROM orders WHERE o_orderkey % 100 = 0), u AS (SELECT src AS a, dst AS b FROM {edges_current} UNION SELECT dst, src FROM {edges_current}) SELECT DISTINCT n.path FROM s JOIN u ON u.a = s.node JOIN {nodes_current} n ON n.id = u.b WHERE n.path <> '' AND n.kind <> 'directory' AND n.path NOT IN (SELECT path FROM s)")
def impact_predict(spark, d):
    seeds = frame(spark, d, "orders").where("o_orderkey % 100 = 0").select(F.concat(F.lit("src/"), F.col("o_orderkey").cast("string"), F.lit(".py")).alias("path"))
    nodes, edges = _now(spark, d)
    # in this graph a file's id has its number, not its path
    ids = seeds.select("path", F.concat(F.lit("file:"), F.regexp_extract("path", "([0-9]+)", 1)).alias("id"))
    return impact_by_id(ids, nodes, edges)


def impact_by_id(ids: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """As ``impact``, where ids (path, id) say which node is a seed's file. Edges keep their names: the seeds' names are looked for."""
    from ..operators.evaluation import beside, seed_nodes

    return beside(ids.select("path"), seed_nodes(ids).unionByName(ids.select(F.col("id").alias("node"))), nodes, edges)


@query(
    "weighted_pick",
    """WITH g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {edges_current} UNION ALL SELECT dst FROM {edges_current}) GROUP BY node), w AS (SELECT n.id, coalesce(g.degree, 0) AS degree FROM {nodes_current} n LEFT JOIN g ON n.id = g.node),
c AS (SELECT id, degree, sum(degree + 1) OVER (ORDER BY degree DESC, id ROWS UNBOUNDED PRECEDING) AS upto, sum(degree + 1) OVER () AS total FROM w) SELECT id, degree FROM c WHERE 0.37 * total < upto AND 0.37 * total >= upto - degree - 1""",
)
def weighted_pick(spark, d):
    from ..operators.evaluation import weighted_pick as pick

    edges, tasks = dealt(spark, d, "edges_current", "src", "dst")
    return pick(dealt(spark, d, "nodes_current", "id")[0], edges, 0.37, tasks)


def _report(spark, d, now=_now, base=_base, both: DataFrame | None = None) -> DataFrame:
    """Scores of the virtual graph, side by side. With ``both``, the edges with their sides, tables are read again where they are used."""
    from ..operators.storage import keep

    (nodes, edges), (base_nodes, base_edges) = now(spark, d), base(spark, d)
    if both is None:
        nodes, edges, base_nodes, base_edges = (keep(x, "graph") for x in (nodes, edges, base_nodes, base_edges))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    concepts = M.support_state(nodes, M.supported(nodes, edges, "concept"), "concept")
    loss = M.loss(concepts).select(F.col("total").alias("concepts"), F.round("score", 6).alias("path_loss_score"), F.col("convention").alias("path_loss_convention"))
    parts = [
        (M.blast(base_edges, edges) if both is None else M.blast_sides(both))[1].select(F.col("score").alias("blast_score")), M.neighborhood(base_nodes, base_edges, nodes, edges).select(F.col("score").alias("neighborhood_score")),
        n(M.broken_chains(edges), "broken_chains"), n(M.stale_decisions(edges), "stale_decisions"),
    ]
    for p in parts:
        loss = loss.join(F.broadcast(p))
    return loss


def _judged(report: DataFrame) -> DataFrame:
    return V.judge(report).select("concepts", "path_loss_score", "path_loss_convention", "blast_score", "neighborhood_score", "broken_chains", "stale_decisions", "verdict", F.array_join("active_meters", ",").alias("active"), F.array_join("silenced_meters", ",").alias("silenced"))


@query("flagship", None)
def flagship(spark, d):
    """Path loss, blast radius and the verdict.

    Edges are neither made distinct nor written first: each meter takes equal edges as one."""
    return _judged(_report(spark, d, _repeated("current"), _repeated("base"), sided(spark, d, "edges_base", "edges_current")))


def _repeated(side: str):
    return lambda spark, d: (frame(spark, d, f"nodes_{side}"), repeated(spark, d, f"edges_{side}"))


FACTS = "SELECT p_partkey AS id, p_size % 3 = 0 AS base_available, p_size % 7 - 5 AS broken_rules, p_size % 2 AS stories, p_size % 5 - 3 AS uncovered_stories, p_size % 11 - 9 AS contradictions, CAST(p_size % 9 AS DOUBLE) / 3 AS neighborhood_score, p_size % 6 AS concepts, CAST(p_size % 10 AS DOUBLE) / 10 AS path_loss_score, p_partkey % 3 = 1 AS path_loss_convention, p_partkey % 13 - 11 AS newly_orphaned_concepts, p_partkey % 23 AS blast_score, p_partkey % 31 - 29 AS stale_decisions, p_partkey % 17 - 15 AS cycles, p_partkey % 8 - 6 AS broken_links, p_partkey % 5 - 3 AS dangling_imports FROM {part}"


@query(
    "verdict",
    f"""SELECT id, CASE WHEN broken_rules > 0 THEN 'warn' WHEN stories > 0 AND uncovered_stories > 0 THEN 'warn' WHEN contradictions > 0 THEN 'warn' WHEN base_available AND neighborhood_score >= 2 THEN 'telemetry'
WHEN concepts > 0 AND path_loss_convention AND path_loss_score >= 0.5 THEN 'telemetry' WHEN newly_orphaned_concepts > 0 THEN 'telemetry' WHEN base_available AND blast_score >= 10 THEN 'telemetry' WHEN stale_decisions > 0 THEN 'telemetry'
WHEN cycles > 0 THEN 'warn' WHEN broken_links > 0 THEN 'telemetry' WHEN dangling_imports > 0 THEN 'warn' ELSE 'clean' END AS verdict,
concat_ws(',', CASE WHEN broken_rules > 0 THEN 'required_edge_breakage' END, CASE WHEN stories > 0 AND uncovered_stories > 0 THEN 'trace_coverage' END, CASE WHEN base_available AND neighborhood_score >= 2 THEN 'neighborhood_drift' END,
CASE WHEN (concepts > 0 AND path_loss_convention AND path_loss_score >= 0.5) OR newly_orphaned_concepts > 0 THEN 'path_loss' END, CASE WHEN base_available AND blast_score >= 10 THEN 'blast_radius' END, CASE WHEN contradictions > 0 THEN 'contradiction' END,
CASE WHEN stale_decisions > 0 THEN 'stale_decision_links' END, CASE WHEN cycles > 0 THEN 'dependency_cycles' END, CASE WHEN broken_links > 0 THEN 'broken_links' END, CASE WHEN dangling_imports > 0 THEN 'dangling_imports' END) AS active FROM ({FACTS})""",
)
def verdicts(spark, d):
    from .virtual import expand

    facts = spark.sql(expand(FACTS, lambda t: f"parquet.`{d}/{t}.parquet`"))
    return V.judge(facts).select("id", "verdict", F.array_join("active_meters", ",").alias("active"))


# each branch of the verdict holds for some parts and, with another one, for others
_FLAG = "(p_partkey % 25 = {0} OR p_size % 25 = {0})"
_COUNTS = {"broken_rules": 0, "uncovered_stories": 1, "contradictions": 2, "newly_orphaned_concepts": 6, "newly_unsupported_claims": 10, "stale_decisions": 11, "broken_chains": 12, "cycles": 13, "orphan_endpoints": 14, "newly_orphaned_endpoints": 15, "unimplemented": 16, "broken_links": 17, "unknown_ids": 18, "stale_tests": 19, "truth_conflicts": 20, "orphaned_aliases": 21, "dangling_imports": 22, "callsite_score": 23, "dead_code": 24}
_SCORES = {"neighborhood_score": (3, 2.0), "semantic_score": (4, 0.05), "path_loss_score": (5, 0.5), "blast_score": (7, 10.0), "staleness_score": (8, 0.25), "claim_score": (9, 0.5)}
BRANCHES = (
    "SELECT p_partkey AS id, p_partkey % 4 <> 0 AS base_available, p_size % 2 AS stories, p_size % 3 AS concepts, p_size % 4 AS files, p_partkey % 3 AS claims, p_partkey % 2 = 0 AS path_loss_convention, p_partkey % 7 > 3 AS claim_convention, p_size % 5 > 1 AS endpoint_convention, p_size % 6 > 1 AS implements_convention, "
    + ", ".join([f"CASE WHEN {_FLAG.format(i)} THEN 1 ELSE 0 END AS {n}" for n, i in _COUNTS.items()] + [f"CASE WHEN {_FLAG.format(i)} THEN CAST({v} AS DOUBLE) ELSE CAST({v} AS DOUBLE) - 0.01 END AS {n}" for n, (i, v) in _SCORES.items()])
    + " FROM {part}"
)
_HOLDS = """base_available AND neighborhood_score >= 2 AS a3, base_available AND semantic_score >= 0.05 AS a4, concepts > 0 AND path_loss_convention AND path_loss_score >= 0.5 AS a5, base_available AND blast_score >= 10 AS a7, files > 0 AND staleness_score >= 0.25 AS a8,
claims > 0 AND claim_convention AND claim_score >= 0.5 AS a9, stories > 0 AND uncovered_stories > 0 AS a1, endpoint_convention AND orphan_endpoints > 0 AS a14, implements_convention AND unimplemented > 0 AS a16"""


@query(
    "verdict_branches",
    f"""SELECT id, CASE WHEN broken_rules > 0 OR a1 OR contradictions > 0 THEN 'warn' WHEN a3 OR a4 OR a5 OR newly_orphaned_concepts > 0 OR a7 OR a8 OR a9 OR newly_unsupported_claims > 0 OR stale_decisions > 0 OR broken_chains > 0 THEN 'telemetry' WHEN cycles > 0 THEN 'warn'
WHEN a14 OR newly_orphaned_endpoints > 0 OR a16 OR broken_links > 0 OR unknown_ids > 0 OR stale_tests > 0 OR truth_conflicts > 0 OR orphaned_aliases > 0 THEN 'telemetry' WHEN dangling_imports > 0 THEN 'warn' ELSE 'clean' END AS verdict,
concat_ws(',', CASE WHEN broken_rules > 0 THEN 'required_edge_breakage' END, CASE WHEN a1 THEN 'trace_coverage' END, CASE WHEN a3 THEN 'neighborhood_drift' END, CASE WHEN a4 THEN 'semantic_movement' END, CASE WHEN a5 OR newly_orphaned_concepts > 0 THEN 'path_loss' END, CASE WHEN a7 THEN 'blast_radius' END, CASE WHEN a8 THEN 'staleness' END,
CASE WHEN a9 OR newly_unsupported_claims > 0 THEN 'claim_support' END, CASE WHEN contradictions > 0 THEN 'contradiction' END, CASE WHEN stale_decisions > 0 THEN 'stale_decision_links' END, CASE WHEN broken_chains > 0 THEN 'broken_implements_chains' END, CASE WHEN cycles > 0 THEN 'dependency_cycles' END, CASE WHEN a14 OR newly_orphaned_endpoints > 0 THEN 'orphan_endpoints' END, CASE WHEN a16 THEN 'unimplemented_stories' END,
CASE WHEN broken_links > 0 THEN 'broken_links' END, CASE WHEN unknown_ids > 0 THEN 'unknown_id_references' END, CASE WHEN stale_tests > 0 THEN 'stale_tests' END, CASE WHEN truth_conflicts > 0 THEN 'truth_alignment' END, CASE WHEN orphaned_aliases > 0 THEN 'orphaned_metric_aliases' END, CASE WHEN dangling_imports > 0 THEN 'dangling_imports' END, CASE WHEN callsite_score > 0 THEN 'callsite_blast_radius' END, CASE WHEN dead_code > 0 THEN 'dead_code' END) AS active,
concat_ws(',', CASE WHEN concepts > 0 AND NOT path_loss_convention AND path_loss_score >= 0.5 THEN 'path_loss' END, CASE WHEN claims > 0 AND NOT claim_convention AND claim_score >= 0.5 THEN 'claim_support' END, CASE WHEN orphan_endpoints > 0 AND NOT endpoint_convention THEN 'orphan_endpoints' END) AS silenced
FROM (SELECT *, {_HOLDS} FROM ({BRANCHES}))""",
)
def verdict_branches(spark, d):
    from .virtual import expand

    facts = spark.sql(expand(BRANCHES, lambda t: f"parquet.`{d}/{t}.parquet`"))
    return V.judge(facts).select("id", "verdict", F.array_join("active_meters", ",").alias("active"), F.array_join("silenced_meters", ",").alias("silenced"))


@query("regressions", f"SELECT 'newly_uncovered_story' AS kind, c.id, concat('re-link ', c.id, ' from a spec, README, or evidence packet so the trace coverage holds') AS suggested_action FROM ({TRACE % ('edges_current', 'edges_current', 'nodes_current')}) c JOIN ({TRACE % ('edges_base', 'edges_base', 'nodes_base')}) b ON c.id = b.id WHERE b.good AND NOT c.good")
def regressions(spark, d):
    moved = M.transitions(M.trace_state(*_base(spark, d)), M.trace_state(*_now(spark, d)))
    return V.regressions({"newly_uncovered_story": moved}).select("kind", "id", "suggested_action")


@query("outcome", "SELECT p_partkey AS id, p_size % 4 = 0 AS blocking_error, CASE WHEN p_size % 5 = 0 AND p_size % 3 + p_size % 2 > 0 THEN 'review --base=HEAD --worktree --json' WHEN p_partkey % 6 = 0 THEN 'index' ELSE '' END AS next_command FROM part")
def outcome(spark, d):
    rows = frame(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.lit("scan").alias("subcommand"), F.expr("int(p_size % 4 = 0)").alias("errors"), F.lit(0).alias("warns"), F.expr("p_size % 5").alias("staged"), F.expr("p_size % 3").alias("dirty"), F.expr("p_size % 2").alias("untracked"),
        F.lit(True).alias("include_untracked"), F.lit("").alias("drift_verdict"), F.lit(0).alias("regressions"), F.lit(False).alias("truth_clarification"), F.expr("p_partkey % 6 = 0").alias("baseline_missing"),
    )
    return V.outcome(rows, "id").select("id", "blocking_error", "next_command")
