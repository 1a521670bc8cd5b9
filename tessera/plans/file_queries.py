"""Queries over virtual files: extractor passes, hashes, snapshots, rules, evaluation, watching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import evaluation as E
from ..operators import extract as X
from ..operators import golang
from ..operators import meters as M
from ..operators import rules as R
from ..operators import snapshot as S
from ..operators.storage import folder, keep
from .graph_queries import QUERIES, SQL, query
from .virtual import duckdb_sql, frame

MD = "regexp_matches(lower(path), '\\.(md|markdown)$')"
TEST_TS = "regexp_matches(path, '\\.(test|spec)\\.tsx?$')"
TEST_PY = "regexp_matches(path, '/test_[^/]*\\.py$')"
RULES = [
    {"id": "docs", "when": ["web/**/*.ts"], "expect_any": ["docs/never/*.md"], "severity": "warn", "message": "say so", "suggested_commands": ["make docs"]},
    {"id": "schema", "when": ["sql/*.sql", "sql/*.proto"], "expect_any": ["data/g?.json"], "severity": "error", "message": "regenerate", "suggested_commands": ["make gen"]},
    {"id": "met", "when": ["sql/*.sql"], "expect_any": ["data/f?.json"], "severity": "error", "message": "is there", "suggested_commands": ["make none"]},
    {"id": "quiet", "when": ["nothing/**"], "expect_any": ["x"], "severity": "warn", "message": "m", "suggested_commands": []},
]
WHEN = {"docs": "regexp_matches(path, '^web/(?:.*/)?[^/]*\\.ts$')", "schema": "regexp_matches(path, '^sql/[^/]*\\.(sql|proto)$')", "met": "regexp_matches(path, '^sql/[^/]*\\.sql$')"}


def repo(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "repo")


def written_repo(spark: SparkSession, d: str) -> DataFrame:
    """The files written once, for queries that read them often. Texts that are put together from keys look as
    small to Spark as the keys, so that joins would send them whole to the driver and every task."""
    return keep(repo(spark, d), "files")


@query("dir_ancestors", "WITH p AS (SELECT path, string_split(path, '/') AS s FROM {repo}), u AS (SELECT path, s, unnest(generate_series(0, len(s) - 1)) AS n FROM p) SELECT DISTINCT CASE WHEN n = 0 THEN 'dir:.' ELSE concat('dir:', array_to_string(s[1:n], '/')) END AS id FROM u")
def dir_ancestors(spark, d):
    return X.directories(repo(spark, d))[0].where("kind = 'directory'").select("id").distinct()


@query("contains_chain", "WITH p AS (SELECT string_split(path, '/') AS s FROM {repo}), u AS (SELECT s, unnest(generate_series(1, len(s))) AS n FROM p) SELECT DISTINCT CASE WHEN n = 1 THEN 'dir:.' ELSE concat('dir:', array_to_string(s[1:n-1], '/')) END AS src, concat(CASE WHEN n = len(s) THEN 'file:' ELSE 'dir:' END, array_to_string(s[1:n], '/')) AS dst FROM u")
def contains_chain(spark, d):
    return X.directories(repo(spark, d))[1].select("src", "dst").distinct()


@query("doc_title", f"SELECT path, CASE WHEN regexp_extract(body, '(?m)^title:\\s*(.+?)\\s*$', 1) <> '' THEN regexp_extract(body, '(?m)^title:\\s*(.+?)\\s*$', 1) ELSE trim(regexp_extract(body, '(?m)^#\\s+(.+)$', 1)) END AS label FROM {{repo}} WHERE {MD}")
def doc_title(spark, d):
    return X.docs(repo(spark, d))[0].select("path", "label")


OWN = f"SELECT path, body, coalesce(nullif(regexp_extract(body, '(?m)^id:\\s*((US|ADR|IDR)-\\d{{3}})\\s*$', 1), ''), nullif(regexp_extract(path, '((US|ADR|IDR)-\\d{{3}})', 1), '')) AS own FROM {{repo}} WHERE {MD}".replace("\\d{3}", "[0-9][0-9][0-9]")


@query("typed_ids", f"SELECT path, concat(lower(split_part(own, '-', 1)), ':', own) AS id FROM ({OWN}) WHERE own IS NOT NULL")
def typed_ids(spark, d):
    return X.typed_ids(repo(spark, d))[0].select("path", "id")


@query("relation_edges", f"WITH m AS (SELECT own, unnest(regexp_extract_all(body, '(?m)^supersedes:\\s*(.+?)\\s*$', 1)) AS v FROM ({OWN}) WHERE own IS NOT NULL), i AS (SELECT own, unnest(regexp_extract_all(v, '(US|ADR|IDR)-[0-9][0-9][0-9]', 0)) AS id FROM m) SELECT DISTINCT concat(lower(split_part(own, '-', 1)), ':', own) AS src, concat(lower(split_part(id, '-', 1)), ':', id) AS dst FROM i WHERE id <> own")
def relation_edges(spark, d):
    return X.relations(repo(spark, d)).where("kind = 'supersedes'").select("src", "dst").distinct()


LINKS = f"SELECT path, CASE WHEN raw LIKE '/%' THEN substring(raw, 2) WHEN raw LIKE '../%' THEN concat('docs/', substring(raw, 4)) ELSE concat(regexp_replace(path, '/[^/]*$', ''), '/', raw) END AS target FROM (SELECT path, unnest(regexp_extract_all(body, '\\[[^\\]]*\\]\\(([^)\\s#]+)(?:#[^)]*)?\\)', 1)) AS raw FROM {{repo}} WHERE {MD}) WHERE raw NOT LIKE 'https:%'"


@query("md_mentions", f"SELECT DISTINCT concat('doc:', path) AS src, concat(CASE WHEN regexp_matches(lower(target), '\\.(md|markdown)$') THEN 'doc:' ELSE 'file:' END, target) AS dst FROM ({LINKS}) WHERE target IN (SELECT path FROM {{repo}})")
def md_mentions(spark, d):
    return X.doc_mentions(repo(spark, d))[1].select("src", "dst").distinct()


@query("broken_links", f"SELECT DISTINCT path AS source, target FROM ({LINKS}) WHERE path LIKE '%.md' AND target NOT IN (SELECT path FROM {{repo}})")
def broken_links(spark, d):
    return M.broken_links(repo(spark, d))


@query("broken_page_links", "SELECT DISTINCT href AS target FROM (SELECT unnest(regexp_extract_all(html, 'href=\"/([A-Za-z0-9_.-]+)\"', 1)) AS href FROM pages) WHERE href NOT IN (SELECT path FROM {urls})")
def broken_page_links(spark, d):
    found = frame(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="/([A-Za-z0-9_.-]+)"'), 1)).alias("target")).distinct()
    return found.join(frame(spark, d, "urls").select(F.col("path").alias("target")), "target", "left_anti")


SLUG = "trim(regexp_replace(lower(trim({})), '[^a-z0-9]+', '-', 'g'), '-')"


@query("concepts", f"SELECT DISTINCT concat('doc:', path) AS src, concat('concept:', {SLUG.format('t')}) AS dst FROM (SELECT path, unnest(regexp_extract_all(body, '(?m)^##?\\s+(.+)$', 1)) AS t FROM {{repo}} WHERE {MD})")
def concepts(spark, d):
    return X.concepts(repo(spark, d))[1].select("src", "dst").distinct()


@query("claims_sha", f"SELECT DISTINCT concat('claim:', substring(sha256(t), 1, 12)) AS id FROM (SELECT trim(unnest(regexp_extract_all(body, '(?m)^\\s*[-*+]\\s+(.+)$', 1))) AS t FROM {{repo}} WHERE {MD}) WHERE rtrim(lower(split_part(t, ' ', 1)), '.,;:!?') IN ('must', 'should', 'shall', 'requires', 'require', 'ensures', 'ensure', 'guarantees', 'guarantee', 'cannot', 'will')")
def claims(spark, d):
    return X.claims(repo(spark, d))[0].select("id").distinct()


@query("metric_nodes", "SELECT concat('metric:', replace(regexp_extract(path, '([^/]*)\\.yaml$', 1), '_', '-')) AS id, regexp_extract(path, '([^/]*)\\.yaml$', 1) AS label FROM {repo} WHERE path LIKE 'metrics/%'")
def metric_nodes(spark, d):
    return X.metrics(repo(spark, d))[0].select("id", "label")


@query("test_pairing", f"WITH t AS (SELECT path, regexp_replace(path, '\\.(test|spec)\\.ts$', '') AS stem FROM {{repo}} WHERE {TEST_TS}), c AS (SELECT path, concat(stem, '.ts') AS a, concat(stem, '.tsx') AS b FROM t UNION ALL SELECT path, replace(path, '/test_', '/'), NULL FROM {{repo}} WHERE {TEST_PY}) SELECT concat('test:', path) AS src, concat('file:', CASE WHEN a IN (SELECT path FROM {{repo}}) THEN a ELSE b END) AS dst FROM c WHERE a IN (SELECT path FROM {{repo}}) OR b IN (SELECT path FROM {{repo}})")
def test_pairing(spark, d):
    return X.tests(repo(spark, d))[1].select("src", "dst")


@query("evidence_buckets", f"SELECT DISTINCT concat('evidence:', {SLUG.format('b')}) AS id, b AS label FROM (SELECT regexp_extract(path, '^docs/evidence/([^/]+)/', 1) AS b FROM {{repo}}) WHERE b <> ''")
def evidence(spark, d):
    return X.evidence(repo(spark, d))[0].select("id", "label")


@query("rule_file_theta", f"SELECT 'docs' AS rule, path FROM {{repo}} WHERE {WHEN['docs']} UNION ALL SELECT 'schema', path FROM {{repo}} WHERE {WHEN['schema']} UNION ALL SELECT 'met', path FROM {{repo}} WHERE {WHEN['met']}")
def rule_file_theta(spark, d):
    return R.theta(repo(spark, d), RULES, "when")


@query("glob_match", "SELECT path, regexp_matches(path, '^docs/(?:.*/)?[^/]*-0[^/][^/]\\.md$') AS a, regexp_matches(path, '^web/[^/]*$') AS b FROM {repo}")
def glob_match(spark, d):
    from ..functions.globs import matches_any

    return repo(spark, d).select("path", matches_any(F.col("path"), ["docs/**/*-0??.md"]).alias("a"), matches_any(F.col("path"), ["web/*"]).alias("b"))


FIRED = f"""SELECT 'docs' AS rule, 'warn' AS severity, 'make docs' AS command, path FROM {{repo}} WHERE {WHEN['docs']} AND NOT EXISTS (SELECT 1 FROM {{repo}} WHERE regexp_matches(path, '^docs/never/[^/]*\\.md$'))
UNION ALL SELECT 'schema', 'error', 'make gen', path FROM {{repo}} WHERE {WHEN['schema']} AND NOT EXISTS (SELECT 1 FROM {{repo}} WHERE regexp_matches(path, '^data/g[^/]\\.json$'))
UNION ALL SELECT 'met', 'error', 'make none', path FROM {{repo}} WHERE {WHEN['met']} AND NOT EXISTS (SELECT 1 FROM {{repo}} WHERE regexp_matches(path, '^data/f[^/]\\.json$'))"""


@query("rule_evaluate", f"SELECT rule, path AS triggered FROM ({FIRED})")
def rule_evaluate(spark, d):
    found = R.evaluate(repo(spark, d), RULES)
    return found.select("rule", F.explode("triggered_by").alias("triggered"))


@query("edge_breakage", f"SELECT count(DISTINCT rule) AS broken, 4::BIGINT AS rules, round(count(DISTINCT rule) / 4, 6) AS score FROM ({FIRED})")
def edge_breakage(spark, d):
    return M.edge_breakage(R.evaluate(repo(spark, d), RULES), len(RULES)).withColumn("score", F.round("score", 6))


@query("worst_severity", f"SELECT max(severity) FILTER (severity = 'error') AS severity, count(*) FILTER (severity = 'error') > 0 AS blocks FROM ({FIRED})")
def worst_severity(spark, d):
    return R.worst(R.evaluate(repo(spark, d), RULES)).select("severity", (F.col("exit_code") == 1).alias("blocks"))


@query("suggested_commands", f"SELECT DISTINCT command FROM ({FIRED})")
def suggested_commands(spark, d):
    return R.suggested(R.evaluate(repo(spark, d), RULES)).select("command")


@query("schema_entities", "WITH m AS (SELECT path, unnest(regexp_extract_all(body, '(?im)^\\s*CREATE(?:\\s+OR\\s+REPLACE)?\\s+(?:MATERIALIZED\\s+VIEW|TABLE|VIEW|TYPE)\\s+(?:IF\\s+NOT\\s+EXISTS\\s+)?(?:[A-Za-z0-9_]+\\.)?[\"`]?([A-Za-z_][A-Za-z0-9_]*)', 1)) AS n FROM {repo} WHERE path LIKE '%.sql' UNION ALL SELECT path, unnest(regexp_extract_all(body, '(?m)^\\s*(?:message|enum|service)\\s+([A-Za-z_]\\w*)', 1)) FROM {repo} WHERE path LIKE '%.proto' UNION ALL SELECT path, unnest(regexp_extract_all(body, '(?m)^\\s*(?:type|input|interface|enum|union)\\s+([A-Za-z_]\\w*)', 1)) FROM {repo} WHERE path LIKE '%.graphql') SELECT DISTINCT concat('file:', path) AS src, concat('data_model:', " + SLUG.format("n") + ") AS dst FROM m")
def schema_entities(spark, d):
    return X.schemas(repo(spark, d))[1].select("src", "dst")


@query("make_targets", "SELECT path, regexp_extract(l, '^ *([A-Za-z0-9_./+-]+)::?(\\s|$)', 1) AS name FROM (SELECT path, unnest(string_split(body, chr(10))) AS l FROM {repo} WHERE path LIKE '%Makefile') WHERE NOT regexp_matches(l, '^\\t|^ *#|^ *[A-Za-z0-9_.-]+\\s*(:=|\\?=|\\+=|!=|=)') AND regexp_extract(l, '^ *([A-Za-z0-9_./+-]+)::?(\\s|$)', 1) NOT IN ('', '.PHONY')")
def make_targets(spark, d):
    return X.make_targets(repo(spark, d)).select("path", "name")


CODE = "regexp_replace(body, '/\\*[\\s\\S]*?\\*/|//[^\\n]*', '', 'g')"
TS = f"regexp_matches(path, '\\.tsx?$') AND NOT {TEST_TS}"


@query("ts_exports", f"WITH c AS (SELECT path, {CODE} AS b FROM {{repo}} WHERE {TS}) SELECT path, n AS name, k AS what FROM (SELECT path, unnest(regexp_extract_all(b, '(?m)^\\s*export\\s+(?:default\\s+)?(?:async\\s+)?function\\s+(\\w+)', 1)) AS n, 'function' AS k FROM c UNION ALL SELECT path, unnest(regexp_extract_all(b, '(?m)^\\s*export\\s+(?:default\\s+)?(?:abstract\\s+)?class\\s+(\\w+)', 1)), 'class' FROM c UNION ALL SELECT path, unnest(regexp_extract_all(b, '(?m)^\\s*export\\s+const\\s+(\\w+)', 1)), 'const' FROM c)")
def ts_exports(spark, d):
    return X.ts_exports(repo(spark, d)).select("path", "name", "what")


SPECS = f"SELECT DISTINCT path, unnest(list_concat(regexp_extract_all(b, '(?m)^\\s*import\\b[^\\n;]*?from\\s*[''\"]([^''\"]+)[''\"]', 1), regexp_extract_all(b, '(?m)^\\s*import\\s*[''\"]([^''\"]+)[''\"]', 1))) AS spec FROM (SELECT path, {CODE} AS b FROM {{repo}} WHERE {TS})"
RESOLVED = f"""WITH s AS (SELECT path, spec, CASE WHEN spec LIKE './%' THEN concat(regexp_replace(path, '/[^/]*$', ''), '/', substring(spec, 3)) WHEN path LIKE 'web/sub/%' THEN concat('web/', substring(spec, 4)) ELSE substring(spec, 4) END AS j FROM ({SPECS}) WHERE spec LIKE '.%'),
c AS (SELECT path, spec, j AS t, 0 AS n FROM s UNION ALL SELECT path, spec, concat(j, e), k FROM s, (VALUES ('.ts', 1), ('.tsx', 2), ('.mts', 3), ('.cts', 4), ('.js', 5), ('.jsx', 6)) v(e, k) UNION ALL SELECT path, spec, concat(regexp_replace(j, '\\.js$', ''), e), k FROM s, (VALUES ('.ts', 7), ('.tsx', 8)) v(e, k) WHERE j LIKE '%.js'),
r AS (SELECT path, spec, t, row_number() OVER (PARTITION BY path, spec ORDER BY n) AS k FROM c WHERE t IN (SELECT path FROM {{repo}})) """


@query("import_resolution", RESOLVED + "SELECT path, spec, t AS target FROM r WHERE k = 1")
def import_resolution(spark, d):
    return X.resolve_ts(repo(spark, d))


PY = f"path LIKE '%.py' AND NOT {TEST_PY}"
PY_SPECS = f"SELECT DISTINCT path, unnest(regexp_extract_all(body, '(?m)^\\s*from\\s+([.\\w]+)\\s+import\\b', 1)) AS spec FROM {{repo}} WHERE {PY}"
PY_RESOLVED = f"SELECT path, spec, CASE WHEN spec = '.' THEN concat(dir, '/__init__.py') WHEN spec LIKE '..%' THEN concat('svc/', substring(spec, 3), '/__init__.py') ELSE concat(dir, '/', substring(spec, 2), '.py') END AS target FROM (SELECT path, spec, regexp_replace(path, '/[^/]*$', '') AS dir FROM ({PY_SPECS}))"


@query("py_imports", f"SELECT * FROM ({PY_RESOLVED}) WHERE target IN (SELECT path FROM {{repo}})")
def py_imports(spark, d):
    return X.resolve_py(repo(spark, d))


@query("dangling_imports", RESOLVED + f"SELECT path AS source, spec FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.path = s.path AND r.spec = s.spec) UNION ALL SELECT path, spec FROM ({PY_RESOLVED}) WHERE target NOT IN (SELECT path FROM {{repo}})")
def dangling_imports(spark, d):
    return M.dangling_imports(repo(spark, d))


@query("py_endpoints", f"WITH l AS (SELECT path, unnest(string_split(regexp_replace(body, '#[^\\n]*', '', 'g'), chr(10))) AS l FROM {{repo}} WHERE {PY}) SELECT path, regexp_extract(l, '\"(/[^\"]*)\"', 1) AS route, upper(trim(unnest(string_split(regexp_extract(l, 'methods=\\[([^\\]]+)\\]', 1), ',')), ' \"''')) AS method FROM l WHERE l LIKE '@app.route%' UNION ALL SELECT path, regexp_extract(l, '\"(/[^\"]*)\"', 1), 'GET' FROM l WHERE l LIKE '@r.get%'")
def py_endpoints(spark, d):
    return X.py_endpoints(repo(spark, d)).select("path", "route", "method")


@query("pending_claims_islands", f"""WITH l AS (SELECT path, i, string_split(body, chr(10))[i] AS t FROM (SELECT path, body, unnest(generate_series(1, len(string_split(body, chr(10))))) AS i FROM {{repo}} WHERE {TS})),
m AS (SELECT path, i, nullif(regexp_extract(t, '^\\s*export\\s+(?:default\\s+)?(?:async\\s+)?(?:(?:abstract\\s+)?class|interface|type|(?:const\\s+)?enum|function|const|let|var)\\s+([A-Za-z_$][\\w$]*)', 1), '') AS name, regexp_extract_all(t, '(?i)\\bimplements\\b[\\s:@-]*\\b((?:US|ADR|IDR)-[0-9]+)\\b', 1) AS ids FROM l),
n AS (SELECT a.path, a.i, unnest(a.ids) AS id FROM m a WHERE len(a.ids) > 0) SELECT DISTINCT n.path, (SELECT arg_min(b.name, b.i) FROM m b WHERE b.path = n.path AND b.i >= n.i AND b.name IS NOT NULL) AS name, n.id FROM n""")
def pending_claims(spark, d):
    from ..functions.patterns import TS_ANY_EXPORT

    return X.pending_claims(repo(spark, d).where(X.is_ts()), TS_ANY_EXPORT)


@query("shell_scripts", "SELECT path FROM {repo} WHERE path LIKE '%.sh' OR (path LIKE 'bin/%' AND regexp_matches(body, '^#!(/usr/bin/env bash|/bin/sh)'))")
def shell_scripts(spark, d):
    return repo(spark, d).where(X.is_shell()).select("path")


IDS = f"SELECT DISTINCT path, unnest(regexp_extract_all(regexp_replace(body, '\"[^\"\\n]*\"', '', 'g'), '\\b(?:US|ADR|IDR)-[0-9][0-9][0-9]\\b', 0)) AS id FROM {{repo}} WHERE NOT {MD}"


@query("code_mentions", f"SELECT DISTINCT concat('file:', path) AS src, concat(lower(split_part(id, '-', 1)), ':', id) AS dst FROM ({IDS}) WHERE id IN (SELECT own FROM ({OWN}))")
def code_mentions(spark, d):
    files = repo(spark, d)
    known = X.typed_ids(files)[0].select(F.col("id").alias("node")).distinct()
    return X.code_mentions(files, known)[1].select("src", "dst")


@query("unknown_ids", f"SELECT path, id FROM ({IDS}) WHERE NOT {TEST_TS} AND NOT {TEST_PY} AND id NOT IN (SELECT own FROM ({OWN}) WHERE own IS NOT NULL)")
def unknown_ids(spark, d):
    files = repo(spark, d)
    return M.unknown_ids(files, X.typed_ids(files)[0])


@query("unknown_id_scan", f"WITH k AS (SELECT DISTINCT regexp_extract(path, '(US-[0-9]+)', 1) AS id FROM {{repo}} WHERE path LIKE 'docs/user-stories/%' UNION SELECT regexp_extract(path, '(ADR-[0-9]+)', 1) FROM {{repo}} WHERE path LIKE 'docs/decisions/%' UNION SELECT regexp_extract(body, '(?m)^id: (IDR-[0-9]+)', 1) FROM {{repo}} WHERE path LIKE 'docs/decisions/%') SELECT concat('unknown-', lower(split_part(id, '-', 1)), '-id') AS rule, concat(id, ' mentioned in ', path, ' but no matching ', split_part(id, '-', 1), ' record exists') AS message FROM ({IDS}) WHERE NOT {TEST_TS} AND NOT {TEST_PY} AND id NOT IN (SELECT id FROM k)")
def unknown_id_scan(spark, d):
    files = repo(spark, d)
    return R.scan_ids(files.select("path", F.col("body").alias("text")), R.known_ids(files)).select("rule", "message")


@query("metric_mentions", "SELECT DISTINCT concat('file:', path) AS src, concat('metric:', replace(n, '_', '-')) AS dst FROM (SELECT path, unnest(regexp_extract_all(body, '\"([A-Za-z_][A-Za-z0-9_]*)\"', 1)) AS n FROM {repo} WHERE path NOT LIKE '%.md') WHERE concat('metrics/', n, '.yaml') IN (SELECT path FROM {repo})")
def metric_mentions(spark, d):
    files = repo(spark, d)
    return X.metric_mentions(files, X.metrics(files)[0].select("id", "label", "path"))[1].select("src", "dst")


@query("path_literals", f"WITH l AS (SELECT DISTINCT path, unnest(regexp_extract_all(body, '[\"''`]([^\"''`\\s]+)[\"''`]', 1)) AS lit FROM {{repo}} WHERE NOT {MD}), f AS (SELECT path, lit, regexp_replace(path, '/[^/]*$', '') AS dir FROM l WHERE regexp_matches(lit, '/|\\.[A-Za-z][A-Za-z0-9]{{0,4}}$') AND lit NOT LIKE '/%' AND lit NOT LIKE '%://%'), c AS (SELECT path, CASE WHEN lit LIKE './%' THEN concat(dir, '/', substring(lit, 3)) WHEN lit LIKE '../%' THEN concat(regexp_replace(dir, '/?[^/]*$', ''), CASE WHEN dir LIKE '%/%' THEN '/' ELSE '' END, substring(lit, 4)) ELSE concat(dir, '/', lit) END AS a, CASE WHEN lit LIKE '.%' THEN NULL ELSE lit END AS b FROM f), t AS (SELECT path, CASE WHEN a IN (SELECT path FROM {{repo}}) THEN a WHEN b IN (SELECT path FROM {{repo}}) THEN b END AS target FROM c) SELECT DISTINCT path, target FROM t WHERE target <> path".replace("{{0,4}}", "{0,4}"))
def path_literals(spark, d):
    return X.path_literals(repo(spark, d)).select("path", "target")


@query("content_hash", "SELECT path, sha256(body) AS content_hash, strlen(body) AS size FROM {files_current}")
def content_hash(spark, d):
    return S.take(frame(spark, d, "files_current")).select("path", "content_hash", "size")


@query("kind_classify", "SELECT CASE WHEN regexp_matches(path, '\\.(md|markdown)$') THEN 'markdown' WHEN regexp_matches(path, '\\.ya?ml$') THEN 'yaml' WHEN regexp_matches(path, '\\.(go|ts|tsx|js|jsx|py|sql|rb|rs|java|kt)$') THEN 'code' ELSE 'other' END AS kind, count(*) AS n FROM {repo} GROUP BY 1")
def kind_classify(spark, d):
    return repo(spark, d).select(S.kind_of("path").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


C_HASH = "sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '/\\*[\\s\\S]*?\\*/', '', 'g'), '//[^\\n]*', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n\\s*\\n', chr(10), 'g'), concat(' ', chr(9), chr(10), chr(13))))"


PY_HASH = C_HASH.replace("/\\*[\\s\\S]*?\\*/", "\"\"\"[\\s\\S]*?\"\"\"|''''''[\\s\\S]*?''''''").replace("//[^\\n]*", "#[^\\n]*")
# front matter, then lines numbered: a fence line, a line of code (an odd number of fences before it) or prose
MD_HASH = r"""WITH f AS (SELECT path, body, regexp_matches(body, '^---\n[\s\S]*?\n---(\n|$)') AS has FROM {%s} WHERE regexp_matches(lower(path), '\.(md|markdown)$')),
r AS (SELECT path, CASE WHEN has THEN concat('frontmatter:', chr(10), array_to_string(list_transform(string_split(regexp_extract(body, '^---\n([\s\S]*?)\n---(\n|$)', 1), chr(10)), lambda x: concat(rtrim(x, concat(' ', chr(9))), chr(10))), '')) ELSE '' END AS head, string_split(regexp_replace(CASE WHEN has THEN regexp_replace(body, '^---\n[\s\S]*?\n---(\n|$)', '') ELSE body END, '\n$', ''), chr(10)) AS xs FROM f),
l AS (SELECT path, head, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM r), t AS (SELECT *, trim(x, concat(' ', chr(9), chr(11), chr(12), chr(13))) AS t FROM l), g AS (SELECT *, CASE WHEN t LIKE '```%%' OR t LIKE '~~~%%' THEN 1 ELSE 0 END AS fence FROM t),
o AS (SELECT path, head, i, CASE WHEN fence = 1 THEN concat('fence:', trim(regexp_replace(t, '^[`~]+', '')), chr(10)) WHEN sum(fence) OVER (PARTITION BY path ORDER BY i) %% 2 = 1 THEN concat('code:', rtrim(x, concat(' ', chr(9))), chr(10))
ELSE concat(CASE WHEN t LIKE '#%%' THEN concat('heading:', trim(regexp_replace(t, '^#+', '')), chr(10)) ELSE '' END, array_to_string(list_transform(regexp_extract_all(x, '\[[^\]]*\]\(([^) \t\n\f\r]+)', 1), lambda u: concat('link:', u, chr(10))), ''), array_to_string(list_transform(regexp_extract_all(x, '^\[[^\]]+\]:[ \t\n\f\r]*([^ \t\n\f\r]+)', 1), lambda u: concat('reflink:', u, chr(10))), '')) END AS piece FROM g)
SELECT path, sha256(concat(any_value(head), string_agg(piece, '' ORDER BY i))) AS h FROM o GROUP BY path"""


@query("code_semantic_hash", rf"SELECT path, CASE WHEN path LIKE '%.py' THEN {PY_HASH.format('body')} ELSE {C_HASH.format('body')} END AS h FROM {{repo}} WHERE regexp_matches(path, '\.(tsx?|sql|py)$')")
def code_semantic_hash(spark, d):
    return S.take(repo(spark, d).where("path RLIKE '[.](tsx?|sql|py)$'")).select("path", F.col("semantic_hash").alias("h"))


@query("md_semantic_hash", MD_HASH % "repo")
def md_semantic_hash(spark, d):
    return S.take(repo(spark, d).where(X.is_markdown())).select("path", F.col("semantic_hash").alias("h"))


SNAP = f"SELECT f.path, sha256(body) AS c, CASE WHEN f.path LIKE '%%.ts' THEN {C_HASH.format('body')} WHEN f.path LIKE '%%.py' THEN {PY_HASH.format('body')} WHEN f.path LIKE '%%.md' THEN m.h ELSE sha256(body) END AS s FROM {{%s}} f LEFT JOIN ({MD_HASH}) m ON m.path = f.path"
SNAPS = f"b AS ({SNAP % ('files_base', 'files_base')}), c AS ({SNAP % ('files_current', 'files_current')})"


@query("snapshot_diff", f"WITH {SNAPS} SELECT * FROM (SELECT coalesce(b.path, c.path) AS path, CASE WHEN b.c IS NULL THEN 'added' WHEN c.c IS NULL THEN 'removed' WHEN b.s <> c.s THEN 'semantic_changed' WHEN b.c <> c.c THEN 'semantic_noop' END AS change_type FROM b FULL JOIN c ON b.path = c.path) WHERE change_type IS NOT NULL")
def snapshot_diff(spark, d):
    base, now = (S.take(frame(spark, d, n)) for n in ("files_base", "files_current"))
    return S.diff(base, now)


@query("semantic_movement", f"WITH {SNAPS} SELECT count(*) AS total, count(*) FILTER (b.c IS NULL OR b.s <> c.s) AS semantic, count(*) FILTER (b.s = c.s AND b.c <> c.c) AS noop, round(count(*) FILTER (b.c IS NULL OR b.s <> c.s) / count(*), 6) AS score FROM c LEFT JOIN b ON b.path = c.path WHERE c.path LIKE '%.md'")
def semantic_movement(spark, d):
    return M.semantic_movement(S.take(frame(spark, d, "files_base")), S.take(frame(spark, d, "files_current"))).withColumn("score", F.round("score", 6))


@query("semantic_changes", "SELECT c.path, CASE WHEN b.body IS NULL THEN 'semantic' ELSE 'noop' END AS change FROM {files_current} c LEFT JOIN {files_base} b ON b.path = c.path WHERE c.path LIKE '%.md' AND (b.body IS NULL OR b.body <> c.body)")
def semantic_changes(spark, d):
    return M.semantic_changes(S.take(frame(spark, d, "files_base")), S.take(frame(spark, d, "files_current")))


MERKLE = """WITH f AS (SELECT string_split(path, '/') AS s, sha256(body) AS h FROM {files_current}), l3 AS (SELECT s[1] AS a, s[2] AS b, sha256(string_agg(concat(s[3], ':', h, chr(10)), '' ORDER BY s[3])) AS h FROM f GROUP BY 1, 2), l2 AS (SELECT a, sha256(string_agg(concat(b, ':', h, chr(10)), '' ORDER BY b)) AS h FROM l3 GROUP BY 1)
SELECT concat(a, '/', b) AS path, h AS hash FROM l3 UNION ALL SELECT a, h FROM l2 UNION ALL SELECT '.', sha256(string_agg(concat(a, ':', h, chr(10)), '' ORDER BY a)) FROM l2"""


@query("merkle_dirs", MERKLE)
def merkle_dirs(spark, d):
    return S.merkle(S.take(frame(spark, d, "files_current"))).select("path", "hash")


PAIRS = f"WITH t AS (SELECT path, regexp_replace(path, '\\.(test|spec)\\.ts$', '.ts') AS src FROM {{repo}} WHERE regexp_matches(path, '\\.(test|spec)\\.ts$')), m AS (SELECT path, length(path) % 4 = 0 AS moved FROM {{repo}})"


def _edited(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The repository, its snapshot and one in which every path of a length divisible by 4 differs.

    The keys that texts are put together from are small tables of few tasks: the texts are hashed after they are spread."""
    files = repo(spark, d)
    now = keep(S.take(files.select("path", "body").repartition("path")), "now")
    was = now.withColumn("semantic_hash", F.when(F.length("path") % 4 == 0, F.lit("old")).otherwise(F.col("semantic_hash")))
    return files, was, now


@query("stale_tests", f"{PAIRS} SELECT t.path AS test, t.src AS source FROM t JOIN m a ON a.path = t.src JOIN m b ON b.path = t.path WHERE a.moved AND NOT b.moved UNION ALL SELECT p, replace(p, '/test_', '/') FROM (SELECT path AS p FROM {{repo}} WHERE {TEST_PY}) WHERE length(replace(p, '/test_', '/')) % 4 = 0 AND length(p) % 4 <> 0 AND replace(p, '/test_', '/') IN (SELECT path FROM {{repo}}) UNION ALL SELECT t.path, concat(t.src, 'x') FROM t WHERE t.src NOT IN (SELECT path FROM {{repo}}) AND concat(t.src, 'x') IN (SELECT path FROM {{repo}}) AND length(concat(t.src, 'x')) % 4 = 0 AND length(t.path) % 4 <> 0")
def stale_tests(spark, d):
    _, was, now = _edited(spark, d)
    # tests are known by their paths, which the snapshot has
    return M.stale_tests(X.tests(now)[1], was, now)


@query("truth_alignment", f"WITH docs AS (SELECT path AS doc, own FROM ({OWN}) WHERE own IS NOT NULL), c AS (SELECT i.path AS artifact, d.doc, d.own FROM ({IDS}) i JOIN docs d ON i.id = d.own WHERE regexp_matches(i.path, '\\.(tsx?|py|sql)$')) SELECT DISTINCT CASE WHEN length(artifact) % 4 = 0 THEN 'implementation_ahead' ELSE 'truth_ahead' END AS direction, doc AS authority_doc, artifact FROM c WHERE (length(doc) % 4 = 0) <> (length(artifact) % 4 = 0)")
def truth_alignment(spark, d):
    files, was, now = _edited(spark, d)
    nodes, typed = X.typed_ids(files)
    known = nodes.select(F.col("id").alias("node")).distinct()
    edges = keep(typed.unionByName(X.code_mentions(files, known)[1]), "typed-edges")
    empty = nodes.where("false")
    return M.truth_alignment(empty, edges, was, now).where("relation = 'mentions'").select("direction", "authority_doc", "artifact")


@query("orphaned_aliases", "SELECT DISTINCT path AS file, n AS name FROM {repo}, (SELECT concat('rate_', s_suppkey) AS n FROM supplier WHERE s_suppkey % 2 = 0) WHERE regexp_matches(path, '\\.(ts|tsx|json)$') AND contains(body, n)")
def orphaned_aliases(spark, d):
    files = written_repo(spark, d)
    base = X.metrics(files)[0]
    return M.orphaned_aliases(base, base.where("int(substring(label, 6)) % 2 = 1"), files)


@query("suggested_tests", "SELECT path, CASE WHEN path LIKE '%.py' THEN regexp_replace(path, '/([^/]*)$', '/test_\\1') WHEN regexp_matches(path, '\\.tsx?$') THEN regexp_replace(path, '\\.(tsx?)$', '.test.\\1') ELSE '' END AS test FROM {repo}")
def suggested_tests(spark, d):
    return repo(spark, d).select("path", X.suggest_test().alias("test"))


def _runs(spark, d) -> DataFrame:
    rows = frame(spark, d, "runs").withColumns({"expected": F.array_distinct(F.array("expected1", "expected2")), "actual": F.array_distinct(F.array("actual1", "actual2"))})
    return rows.withColumn("allowed", F.array(F.lit("m0")))


LISTS = "SELECT *, list_distinct([expected1, expected2]) AS e, list_distinct([actual1, actual2]) AS a FROM {runs}"
DIFFS = f"SELECT *, list_filter(e, lambda x: NOT list_contains(a, x)) AS fn, list_filter(a, lambda x: NOT list_contains(e, x) AND x <> 'm0') AS fp, len(list_filter(e, lambda x: list_contains(a, x))) AS hit FROM ({LISTS})"


@query("prf1", f"SELECT run_id, round(hit / len(a), 6) AS precision, round(hit / len(e), 6) AS recall, round(CASE WHEN hit = 0 THEN 0 ELSE 2.0 * hit / (len(a) + len(e)) END, 6) AS f1 FROM ({DIFFS})")
def prf1(spark, d):
    return _runs(spark, d).select("run_id", *[F.round(c, 6).alias(n) for n, c in E.prf("actual", "expected").items()])


@query("prf1_by_category", f"SELECT category, count(*) AS n, round(avg(hit / len(a)), 6) AS precision, round(avg(hit / len(e)), 6) AS recall, round(avg(CASE WHEN hit = 0 THEN 0 ELSE 2.0 * hit / (len(a) + len(e)) END), 6) AS f1 FROM ({DIFFS}) GROUP BY category")
def prf1_by_category(spark, d):
    rows = E.by_category(_runs(spark, d).withColumns(E.prf("actual", "expected")))
    return rows.select("category", "n", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("micro_metrics", f"SELECT sum(hit)::BIGINT AS tp, sum(len(a) - hit)::BIGINT AS fp, sum(len(e) - hit)::BIGINT AS fn, round(sum(hit) / sum(len(a)), 6) AS precision, round(sum(hit) / sum(len(e)), 6) AS recall FROM ({DIFFS})")
def micro_metrics(spark, d):
    return E.micro(_runs(spark, d)).select("tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("set_difference", f"SELECT run_id, array_to_string(list_sort(fn), ',') AS missing, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(e, x))), ',') AS unexpected FROM ({DIFFS})")
def set_difference(spark, d):
    rows = _runs(spark, d).withColumns(E.set_difference())
    return rows.select("run_id", F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected"))


CLASS = "CASE WHEN len(fn) > 0 THEN 'false_negative' WHEN len(fp) > 0 THEN 'false_positive' ELSE 'hit' END"


@query("classification", f"SELECT run_id, {CLASS} AS classification FROM ({DIFFS})")
def classification(spark, d):
    return _runs(spark, d).withColumns(E.classify()).select("run_id", "classification")


def _results(spark, d) -> DataFrame:
    rows = _runs(spark, d).withColumns(E.classify())
    return rows.withColumn("classification", F.when(F.col("skip") == 1, "skipped").otherwise(F.col("classification")))


RESULTS = f"SELECT *, CASE WHEN skip = 1 THEN 'skipped' ELSE {CLASS} END AS c FROM ({DIFFS})"
FIGURES = "count(*) AS total, count(*) FILTER (c = 'hit') AS hits, count(*) FILTER (c = 'skipped') AS skipped, count(*) FILTER (len(fn) > 0) AS with_fn, count(*) FILTER (len(fp) > 0) AS with_fp"


@query("summary_grouping_sets", f"SELECT 'all' AS grouping, '' AS key, {FIGURES} FROM ({RESULTS}) UNION ALL SELECT 'mutation', mutation_id, {FIGURES} FROM ({RESULTS}) GROUP BY mutation_id UNION ALL SELECT 'expected_meter', m, {FIGURES} FROM (SELECT *, unnest(e) AS m FROM ({RESULTS})) GROUP BY m")
def summary_grouping_sets(spark, d):
    return E.summarize(_results(spark, d)).select("grouping", "key", "total", "hits", "skipped", "with_fn", "with_fp")


@query("summary_by_meter", f"SELECT m AS meter, count(*) AS total, count(*) FILTER (c <> 'skipped' AND list_contains(fn, m)) AS false_negatives, count(*) FILTER (c <> 'skipped' AND NOT list_contains(fn, m) AND list_contains(fp, m)) AS false_positives, count(*) FILTER (c <> 'skipped' AND NOT list_contains(fn, m) AND NOT list_contains(fp, m)) AS hits FROM (SELECT *, unnest(list_distinct(list_concat(e, fp))) AS m FROM ({RESULTS})) GROUP BY m")
def summary_by_meter(spark, d):
    return E.by_meter(_results(spark, d))


@query("clusters", f"SELECT substring(sha256(concat_ws('|', 'edit', lang, array_to_string(list_sort(e), ','), array_to_string(list_sort(a), ','), '.py', 'python', '')), 1, 16) AS key, count(*) AS n, array_to_string(list_sort(list_distinct(list(mutation_id))), ',') AS mutations FROM ({RESULTS}) WHERE c NOT IN ('hit', 'skipped') GROUP BY key")
def clusters(spark, d):
    rows = _results(spark, d).withColumns({"operation": F.lit("edit"), "target_kind": F.col("lang"), "target_path": F.lit("a/b.py"), "error": F.lit("")})
    return E.clusters(rows).select("key", "n", F.array_join("mutations", ",").alias("mutations"))


def _cases(spark, d) -> DataFrame:
    rows = _runs(spark, d).withColumns({"case_type": F.when(F.col("skip") == 1, "known_limit").when(F.length("mutation_id") == 5, "negative_control").otherwise("positive"), "meter": F.col("expected1"), "verdicts": F.array(F.lit("warn")), "verdict": F.when(F.col("lang") == "en", "warn").otherwise("clean")})
    return rows.withColumns(E.oracle())


CASES = f"SELECT *, CASE WHEN skip = 1 THEN 'known_limit' WHEN length(mutation_id) = 5 THEN 'negative_control' ELSE 'positive' END AS t, lang <> 'en' AS wrong FROM ({DIFFS})"
JUDGED = f"SELECT *, len(fn) = 0 AND NOT (wrong AND t <> 'negative_control') AS sat, len(fp) = 0 AND NOT (wrong AND t = 'negative_control') AS spec FROM ({CASES})"


@query("oracle_cases", f"SELECT run_id, sat AS detection_hit, CASE WHEN sat AND spec THEN 'hit' WHEN sat AND t <> 'negative_control' THEN 'hit_with_false_positive' WHEN sat THEN 'false_positive' WHEN spec THEN 'false_negative' ELSE 'false_negative_with_false_positive' END AS classification FROM ({JUDGED})")
def oracle_cases(spark, d):
    return _cases(spark, d).select("run_id", "detection_hit", "classification")


@query("confusion_by_meter", f"WITH j AS ({JUDGED}), b AS (SELECT expected1 AS meter, count(*) FILTER (t = 'positive') AS positives, count(*) FILTER (t <> 'negative_control' AND sat) AS tp, count(*) FILTER (t <> 'negative_control' AND NOT sat) AS fn, count(*) FILTER (t = 'negative_control' AND NOT list_contains(fp, expected1)) AS tn FROM j GROUP BY 1), f AS (SELECT m AS meter, count(*) AS fp FROM (SELECT unnest(fp) AS m FROM j) GROUP BY 1) SELECT meter, coalesce(positives, 0) AS positives, coalesce(tp, 0) AS tp, coalesce(fn, 0) AS fn, coalesce(tn, 0) AS tn, coalesce(fp, 0) AS fp FROM b FULL JOIN f USING (meter)")
def confusion_by_meter(spark, d):
    return E.confusion(_cases(spark, d)).select("meter", "positives", "tp", "fn", "tn", "fp")


@query("evidence_rates", f"SELECT concat(count(*) FILTER (t <> 'known_limit' AND sat), '/', count(*) FILTER (t <> 'known_limit')) AS supported_recall, concat(count(*) FILTER (t = 'known_limit' AND NOT sat), '/', count(*) FILTER (t = 'known_limit')) AS known_limit_misses, concat(count(*) FILTER (sat), '/', count(*)) AS overall_recall FROM ({JUDGED})")
def evidence_rates(spark, d):
    return E.evidence_rates(_cases(spark, d))


@query("health_lanes", "SELECT r_regionkey AS step, greatest(0, 100 - 10 * r_regionkey - 15 * (r_regionkey % 2)) AS managed, greatest(0, 100 - 10 * sum(r_regionkey) OVER w - 15 * sum(r_regionkey % 2) OVER w)::BIGINT AS unmanaged FROM region WINDOW w AS (ORDER BY r_regionkey)")
def health_lanes(spark, d):
    rows = frame(spark, d, "region").select(F.col("r_regionkey").alias("step"), F.col("r_regionkey").alias("active"), (F.col("r_regionkey") % 2).alias("regressions"), F.lit(0).alias("warn"))
    return E.lanes(rows)


@query("mutations", "SELECT path, CASE WHEN path = 'data/f3.json' THEN concat(body, '!') ELSE replace(body, 'export async', 'export async') END AS body FROM {repo} WHERE path <> 'data/f4.json'")
def mutations(spark, d):
    files = E.mutate(repo(spark, d), "append_text", "data/f3.json", text="!")
    return E.mutate(files, "remove_file", "data/f4.json").select("path", "body")


@query("worktree_union", "SELECT path FROM {urls} WHERE length(path) % 2 = 0 UNION SELECT path FROM {urls} WHERE length(path) % 3 = 0")
def worktree_union(spark, d):
    from ..sources.repository import worktree

    urls = frame(spark, d, "urls")
    return worktree(urls.where("length(path) % 2 = 0").withColumn("area", F.lit("worktree")).unionByName(urls.where("length(path) % 3 = 0").withColumn("area", F.lit("untracked"))))


@query("latest_commits", "SELECT path, max(ts) AS ts FROM {commits} GROUP BY path")
def latest_commits(spark, d):
    return S.latest(frame(spark, d, "commits"))


@query("slugs", f"SELECT p_partkey AS id, {SLUG.format('p_name')} AS slug FROM part")
def slugs(spark, d):
    return frame(spark, d, "part").select(F.col("p_partkey").alias("id"), P.slugify("p_name").alias("slug"))


GO = "SELECT path, body, regexp_extract(body, '(?m)^package (\\w+)', 1) AS pkg FROM {go_repo} WHERE path LIKE '%.go' AND path NOT LIKE '%\\_test.go' ESCAPE '\\'"
GO_NAME = "concat('code_symbol:', pkg, '.', name)"


@query("go_edges", f"""WITH g AS ({GO}), n AS (SELECT path, pkg, unnest(regexp_extract_all(body, '(?m)^(?:func|type|const|var) ([A-Z]\\w*)', 1)) AS name FROM g), i AS (SELECT path, unnest(regexp_extract_all(body, '"ex\\.org/m/([^"]+)"', 1)) AS dir FROM g)
SELECT DISTINCT 'defines' AS kind, concat('file:', path) AS src, {GO_NAME} AS dst FROM n UNION SELECT 'defines', concat('file:', path), concat('endpoint:GET:', regexp_extract(body, 'mux\\.Get\\("([^"]+)"', 1)) FROM g
UNION SELECT 'depends_on', concat('file:', path), concat('dir:', dir) FROM i WHERE dir IN (SELECT regexp_replace(path, '/[^/]*$', '') FROM {{go_repo}}) UNION SELECT 'implements', concat('code_symbol:', pkg, '.', regexp_extract(body, 'func (Run\\d+)', 1)), concat('us:', regexp_extract(body, 'implements (US-\\d+)', 1)) FROM g""")
def go_edges(spark, d):
    return golang.symbols(frame(spark, d, "go_repo"))[1].select("kind", "src", "dst").distinct()


@query("go_symbols", f"SELECT DISTINCT {GO_NAME} AS id, concat(pkg, '.', name) AS label, path FROM (SELECT path, pkg, unnest(regexp_extract_all(body, '(?m)^(?:func|type|const|var) ([A-Z]\\w*)', 1)) AS name FROM ({GO}))")
def go_symbols(spark, d):
    return golang.symbols(frame(spark, d, "go_repo"))[0].where("kind = 'code_symbol'").select("id", "label", "path").distinct()


@query("go_calls", f"""WITH g AS ({GO}), n AS (SELECT pkg, unnest(regexp_extract_all(body, '(?m)^func (\\w+)\\(', 1)) AS name FROM g),
c AS (SELECT pkg AS from_pkg, regexp_extract(body, 'func (Run\\d+)', 1) AS from_func, pkg AS to_pkg, regexp_extract(body, '(?m)^\\t(helper\\d+)', 1) AS to_func, path AS file FROM g UNION ALL SELECT pkg, regexp_extract(body, 'func (Run\\d+)', 1), regexp_extract(body, '(?m)^\\t(pkg\\d+)\\.', 1), regexp_extract(body, '\\.(Run\\d+)', 1), path FROM g
UNION ALL SELECT pkg, concat(regexp_extract(body, '\\*(T\\d+)\\)', 1), '::', regexp_extract(body, '(Do\\d+)', 1)), pkg, regexp_extract(body, '{{ (helper\\d+)', 1), path FROM g) SELECT c.* FROM c SEMI JOIN n ON n.pkg = c.to_pkg AND n.name = c.to_func""")
def go_calls(spark, d):
    return golang.call_graph(frame(spark, d, "go_repo"))[1].select("from_pkg", "from_func", "to_pkg", "to_func", "file")


@query("node_selector", "SELECT id FROM {nodes_current} WHERE kind IN ('file', 'user_story') AND id LIKE 'file:%' AND path LIKE 'src/%7%.py' AND contains(lower(label), 'medium') AND id IN (SELECT dst FROM {edges_current} WHERE kind = 'verifies') AND id IN (SELECT src FROM {edges_current} WHERE kind = 'implements')")
def node_selector(spark, d):
    nodes, edges = frame(spark, d, "nodes_current"), frame(spark, d, "edges_current")
    return E.select_nodes(nodes, edges, id_prefix="file:", path_glob="src/*7*.py", path_contains="7", extensions=[".PY"], label_contains="Medium", incoming="verifies", outgoing="implements", kinds=("file", "user_story")).select("id")


@query("virtual_graph", None)
def virtual_graph(spark, d):
    """All passes over the virtual repository: counts by kind."""
    nodes, edges = X.build_graph(written_repo(spark, d), RULES, ["make all"])
    counts = [x.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(w).alias("what"), "kind", "n") for w, x in (("node", nodes), ("edge", edges))]
    return counts[0].unionByName(counts[1])


@query("watch_changes", MERKLE)
def watch_changes(spark, d):
    """The base files and then the current ones as a stream of versions: each directory's hash as the watch leaves it."""
    from ..streaming.watch import directories, watch

    base, now = (frame(spark, d, name).select("path", "body") for name in ("files_base", "files_current"))
    gone = base.join(now, "path", "left_anti").select("path", F.lit(None).cast("string").alias("body"))
    source, state, progress = (folder(spark, label) for label in ("versions", "watched", "progress"))
    for number, rows in enumerate((base, now.unionByName(gone))):
        rows.select("path", "body", F.lit(number).cast("long").alias("version")).write.mode("append").parquet(source)
        versions = spark.readStream.schema("path string, body string, version long").parquet(source)
        watch(spark, versions, state, progress, lambda files, root: None, None).awaitTermination()
    return directories(spark, state)


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    from ..streaming.watch import event_windows as windows

    return windows(frame(spark, d, "events")).withColumn("total", F.round("total", 4))


__all__ = ["QUERIES", "SQL", "duckdb_sql", "golang"]
