"""Extractors, graph and meters on small repositories."""

import hashlib

from pyspark.sql import functions as F

from tessera.operators import evaluation as E
from tessera.operators import extract as X
from tessera.operators import golang, graph, meters, rules, snapshot, traverse, verdict

FILES = {
    "docs/user-stories/US-101.md": "---\nid: US-101\nsupersedes: US-100\n---\n# Sign In\n- must lock after five tries\nsee [rec](../decisions/ADR-007.md) [lost](nope.md)\n",
    "docs/decisions/ADR-007.md": "# Tokens\nsupersedes:\n  - ADR-003\n",
    "docs/decisions/ADR-003.md": "# Cookies\n",
    "docs/guide.md": "# Guide\n[old](decisions/ADR-003.md)\n",
    "docs/evidence/US-101/run.txt": "ok",
    "web/login.ts": "import { a } from './util';\nimport './gone';\n/** implements US-101 */\nexport function login() {}\napp.post('/login', f)\nconst x = 1 // ADR-007\nq('rate_ok')\n",
    "web/util.ts": "export const a = 1;\n",
    "web/login.test.ts": "x",
    "svc/api.py": "from .db import q\nfrom .none import r\n@app.route('/v', methods=['GET','put'])\ndef view():\n    pass\nUS_LIMIT = 3\n# US-555\n",
    "svc/db.py": "class Db:\n    pass\n",
    "go.mod": "module ex.org/m\n",
    "cmd/main.go": 'package main\n\nimport (\n\t"net/http"\n\tst "ex.org/m/store"\n)\n\n// Serve starts. Implements US-101.\nfunc Serve() { http.HandleFunc("/go", h); st.Open(); helper() }\n\nfunc helper() {}\nfunc unused() {}\nfunc (s *Srv) Run() { helper() }\n',
    "store/store.go": 'package store\n\nimport "ex.org/m/cmd"\n\ntype Store struct { A int }\nconst (\n\tOne = 1\n\ttwo = 2\n)\nfunc Open() {}\n',
    "metrics/rate_ok.yaml": "x: 1",
    "schema/a.sql": "CREATE TABLE IF NOT EXISTS app.users (id int);",
    "Makefile": "build: x\n\tgo build\nV := 1\n.PHONY: z\n",
    "run": "#!/usr/bin/env bash\necho",
}
RULES = [{"id": "r1", "when": ["web/*.ts"], "expect_any": ["docs/**/*.md"], "severity": "error", "message": "m", "suggested_commands": ["make docs"]}]


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, body string")


def built(spark, files=FILES):
    nodes, edges = X.build_graph(frame(spark, files), RULES, ["make all"])
    return nodes.cache(), edges.cache()


def edge_set(edges, kind):
    return {(r["src"], r["dst"]) for r in edges.where(F.col("kind") == kind).collect()}


def test_build_graph(spark):
    nodes, edges = built(spark)
    ids = {r["id"]: r for r in nodes.collect()}
    assert ids["us:US-101"]["kind"] == "user_story" and ids["concept:sign-in"]["meta"] == {"level": "H1"}
    assert {"endpoint:POST:/login", "endpoint:GET:/v", "endpoint:PUT:/v", "endpoint:*:/go", "data_model:users", "command:make build", "command:bash run", "metric:rate-ok", "rule:r1"} <= set(ids)
    assert "claim:" + hashlib.sha256(b"must lock after five tries").hexdigest()[:12] in ids
    assert {"code_symbol:main.Serve", "code_symbol:store.Store", "code_symbol:store.One", "code_symbol:store.Open", "code_symbol:web/login.login", "code_symbol:svc/api.view"} <= set(ids)
    assert "code_symbol:store.two" not in ids and "code_symbol:main.helper" not in ids
    assert {("us:US-101", "us:US-100"), ("adr:ADR-007", "adr:ADR-003")} == edge_set(edges, "supersedes")
    assert {("code_symbol:web/login.login", "us:US-101"), ("code_symbol:main.Serve", "us:US-101")} == edge_set(edges, "implements")
    assert {("file:web/login.ts", "file:web/util.ts"), ("file:svc/api.py", "file:svc/db.py"), ("file:cmd/main.go", "dir:store"), ("file:store/store.go", "dir:cmd")} == edge_set(edges, "depends_on")
    assert ("evidence:us-101", "us:US-101") in edge_set(edges, "supports")
    assert edge_set(edges, "verifies") == {("test:web/login.test.ts", "file:web/login.ts")}
    assert {("file:web/login.ts", "adr:ADR-007"), ("file:web/login.ts", "metric:rate-ok")} <= edge_set(edges, "mentions")
    assert ("dir:.", "dir:docs") in edge_set(edges, "contains")


def test_meters(spark):
    files = frame(spark, FILES)
    nodes, edges = built(spark)
    assert {(r["source"], r["target"]) for r in meters.broken_links(files).collect()} == {("docs/user-stories/US-101.md", "docs/user-stories/nope.md")}
    assert {(r["source"], r["spec"]) for r in meters.dangling_imports(files).collect()} == {("web/login.ts", "./gone"), ("svc/api.py", ".none")}
    assert {(r["path"], r["id"]) for r in meters.unknown_ids(files, nodes).collect()} == {("svc/api.py", "US-555")}
    assert {(r["doc"], r["old"], r["new"]) for r in meters.stale_decisions(edges).collect()} == {("doc:docs/guide.md", "adr:ADR-003", "adr:ADR-007")}
    assert [sorted(r["ring"]) for r in meters.dependency_cycles(edges).collect()] == [["dir:cmd", "dir:store"]]
    good = {r["id"]: r["good"] for r in meters.endpoint_state(nodes, edges).collect()}
    assert good["endpoint:POST:/login"] and not good["endpoint:GET:/v"]
    reached = meters.supported(nodes, edges)
    assert {r["id"]: r["good"] for r in meters.support_state(nodes, reached, "concept").collect()}["concept:sign-in"]


def test_snapshot(spark):
    now = dict(FILES)
    now["web/util.ts"] = "// note\nexport const  a = 1;\n"
    now["svc/db.py"] = "class Db:\n    y = 2\n"
    now["docs/guide.md"] = FILES["docs/guide.md"] + "more prose\n"
    del now["run"]
    a, b = (snapshot.take(frame(spark, f)) for f in (FILES, now))
    assert {(r["path"], r["change_type"]) for r in snapshot.diff(a, b).collect()} == {("web/util.ts", "semantic_noop"), ("svc/db.py", "semantic_changed"), ("docs/guide.md", "semantic_noop"), ("run", "removed")}
    tree = {r["path"]: r["hash"] for r in snapshot.merkle(a).collect()}
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert tree["metrics"] == h(f"rate_ok.yaml:{h('x: 1')}\n")
    assert snapshot.root_hash(snapshot.merkle(a.where("false"))).first()[0] == h("")


def test_markdown_hash(spark):
    base = "---\na: 1  \n---\n# T\nprose\n```py\nx = 1\n```\n[l](u)\n[r]: w\n"
    cases = {"a.md": base, "b.md": base.replace("prose", "other words"), "c.md": base.replace("x = 1", "x = 2"), "d.md": base.replace("a: 1  ", "a: 1"), "e.md": base.replace("(u)", "(v)"), "f.md": base.replace("# T", "# U")}
    s = {r["path"]: r["semantic_hash"] for r in snapshot.take(frame(spark, cases)).collect()}
    want = "frontmatter:\na: 1\nheading:T\nfence:py\ncode:x = 1\nfence:\nlink:u\nreflink:w\n"
    assert s["a.md"] == hashlib.sha256(want.encode()).hexdigest()
    assert s["a.md"] == s["b.md"] == s["d.md"] and len({s["a.md"], s["c.md"], s["e.md"], s["f.md"]}) == 4


def test_rules(spark):
    fired = rules.evaluate(spark.createDataFrame([("web/a.ts",)], "path string"), RULES).collect()
    assert [(r["rule"], r["triggered_by"]) for r in fired] == [("r1", ["web/a.ts"])]
    assert rules.evaluate(spark.createDataFrame([("web/a.ts",), ("docs/x/y.md",)], "path string"), RULES).isEmpty()
    added = spark.createDataFrame([("svc/x.py", "US-101 US-777 \"US-888\""), ("docs/a.md", "US-999")], "path string, text string")
    found = rules.scan_ids(added, rules.known_ids(frame(spark, FILES))).collect()
    assert [r["rule"] for r in found] == ["unknown-us-id"] and "US-777" in found[0]["message"]
    assert rules.worst(rules.evaluate(spark.createDataFrame([("web/a.ts",)], "path string"), RULES)).first()["exit_code"] == 1


def test_first_writer_wins(spark):
    rows = [("n", "a", "first", None, {"x": "1"}, 0, "f", 0), ("n", "b", "second", None, {"x": "2", "y": "3"}, 1, "e", 0)]
    merged = graph.merge_nodes(spark.createDataFrame(rows, "id string, kind string, label string, path string, meta map<string,string>, pass_seq int, file_seq string, pos int")).first()
    assert (merged["kind"], merged["label"], merged["meta"]) == ("a", "first", {"x": "1", "y": "3"})


def test_reach_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e"), ("x", "y")], "src string, dst string")
    assert {r[0] for r in traverse.reach(spark.createDataFrame([("d",)], "node string"), edges).collect()} == {"a", "b", "c", "d"}
    assert {r[0] for r in traverse.reach(spark.createDataFrame([("d",)], "node string"), edges, directed=True).collect()} == {"d"}
    assert {r[0] for r in traverse.on_cycles(edges).collect()} == {"a", "b", "c", "e"}
    assert sorted(r[0] for r in traverse.reported_cycles(edges).collect()) == [["a", "b", "c"], ["e"]]
    far = traverse.hops(spark.createDataFrame([("a",)], "node string"), edges, 2).collect()
    assert {(r["target"], r["level"]) for r in far} == {("b", 1), ("c", 2)}


def test_verdict_is_the_first_match(spark):
    rows = spark.createDataFrame([(1, 1, 1, 0), (2, 0, 1, 0), (3, 0, 0, 1), (4, 0, 0, 0)], "id int, broken_links int, dangling_imports int, cycles int")
    assert [r["verdict"] for r in verdict.judge(rows).orderBy("id").collect()] == ["telemetry", "warn", "warn", "clean"]
    quiet = spark.createDataFrame([(3, 0.9, False)], "concepts int, path_loss_score double, path_loss_convention boolean")
    one = verdict.judge(quiet).first()
    assert one["verdict"] == "clean" and one["silenced_meters"] == ["path_loss"]


def test_calls_and_dead_code(spark):
    defs, calls = golang.call_graph(frame(spark, FILES))
    assert {(r["from_func"], r["to_pkg"], r["to_func"]) for r in calls.collect()} == {("Serve", "store", "Open"), ("Serve", "main", "helper"), ("Srv::Run", "main", "helper")}
    assert [r["symbol"] for r in golang.dead_code(defs, calls).collect()] == ["main.unused"]
    per = golang.callers(defs.where("name = 'helper'").select("pkg", "name", "file"), calls).first()
    assert (per["direct_callers"], per["transitive_callers"]) == (2, 2)


def test_mutations_and_scores(spark):
    files = frame(spark, {"a.py": "one\ntwo one\n", "b": "x"})
    get = lambda df: {r["path"]: r["body"] for r in df.collect()}
    assert get(E.mutate(files, "replace_text", "a.py", old="one", new="1"))["a.py"] == "1\ntwo one\n"
    assert get(E.mutate(files, "remove_line_containing", "a.py", text="two"))["a.py"] == "one\n"
    assert set(get(E.mutate(files, "rename_file", "b", new_path="c"))) == {"a.py", "c"}
    assert get(E.mutate(files, "add_file", "d", content="y"))["d"] == "y" and "b" not in get(E.mutate(files, "remove_file", "b"))
    row = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], [])], "gold array<string>, predicted array<string>")
    got = [tuple(r) for r in row.select(*[c.alias(n) for n, c in E.prf().items()]).collect()]
    assert got == [(0.5, 0.5, 0.5), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0)]
    shape = E.template_shape(spark.createDataFrame([("go.mod",), ("x/a.tf",)], "path string")).first()[0]
    assert shape == "go-cli"


def test_drift_end_to_end(spark):
    from datetime import datetime

    from tessera.plans import runs

    base = runs.index(frame(spark, FILES), RULES)
    changed = dict(FILES)
    changed["web/login.ts"] = changed["web/login.ts"].replace("export function login", "export function signin")
    del changed["docs/evidence/US-101/run.txt"]
    now = runs.index(frame(spark, changed), RULES)
    commits = spark.createDataFrame([("web/login.ts", datetime(2024, 1, 1))], "path string, ts timestamp")
    report, regressions = runs.drift(now, base, spark.createDataFrame([("web/login.ts",)], "path string"), RULES, commits, datetime(2024, 1, 2))
    row = report.first()
    assert row["verdict"] == "warn" and row["broken_rules"] == 1 and row["stale_tests"] == 1 and row["cycles"] == 1
    said, todo = ({(r["meter"]): r["line"] for r in row[k]} for k in ("explanations", "actions"))
    assert said["stale_tests"].startswith("1 tests stayed") and said["required_edge_breakage"].startswith("1 of ") and "dependency_cycles" in todo
    assert row["headline"].startswith("drift: warn") and not {m for m in todo} - {m for m in said}
    assert "stale_tests" in row["active_meters"] and regressions.columns == ["kind", "id", "suggested_action"]
    files_changed, nodes_changed, edges_changed = runs.compare(base, now)
    assert files_changed.count() == 2 and nodes_changed.count() > 0 and edges_changed.count() > 0


def test_watch(spark, tmp_path):
    from tessera.streaming import watch as W

    src = tmp_path / "in"
    schema = "path string, body string, version long"
    seen = []

    def run():
        versions = spark.readStream.schema(schema).json(str(src))
        W.watch(spark, versions, str(tmp_path / "state"), str(tmp_path / "ck"), lambda files, root: seen.append((files.count(), root)), None, initial=True).awaitTermination()

    spark.createDataFrame([("a", "1", 1), ("b", "2", 1)], schema).coalesce(1).write.json(str(src))
    run()
    spark.createDataFrame([("a", None, 2)], schema).coalesce(1).write.mode("append").json(str(src))
    run()
    assert [n for n, _ in seen] == [2, 1] and seen[0][1] != seen[1][1]
    poller = W.Poller(frame(spark, {"a": "1"}))
    assert not poller.tick(frame(spark, {"a": "1"})) and poller.tick(frame(spark, {"a": "2"}))


def test_watch_goes_on_after_restarts(spark, tmp_path):
    """Each run is a new stream over the same state: no first emit, but every change after it."""
    from tessera.streaming import watch as W

    src, schema, seen = tmp_path / "in", "path string, body string, version long", []
    for rows in ([("a", "1", 1), ("b", "2", 1)], [("a", "3", 2)], [("a", "0", 1)], [("b", None, 2)], [("b", "2", 1)], [("c", "4", 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(src))
        versions = spark.readStream.schema(schema).json(str(src))
        W.watch(spark, versions, str(tmp_path / "state"), str(tmp_path / "ck"), lambda files, root: seen.append({r["path"]: r["body"] for r in files.collect()}), None).awaitTermination()
    assert seen == [{"a": "3", "b": "2"}, {"a": "3"}, {"a": "3", "c": "4"}]  # older versions change nothing
    assert len(list((tmp_path / "state" / "lists").glob("batch=*"))) == 2


def test_collect_by_command(spark, tmp_path):
    import subprocess

    from tessera.sources import repository as R

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    for name, step in (("a", 1), ("b", 1)):
        (tmp_path / name).write_text(name * step)
        run("add", "."), run("commit", "-qm", name)
    (tmp_path / "a").write_text("dirty")
    (tmp_path / "s").write_text("staged")
    run("add", "s")
    (tmp_path / "u").write_text("untracked")
    got = lambda mode, **k: [r["path"] for r in R.collect_files(spark, str(tmp_path), mode, **k).orderBy("position").collect()]
    assert got("scan") == [] and got("scan", staged=True) == ["s"]
    assert set(got("check")) == {"a", "b", "s"} and got("check", include_untracked=True)[-1] == "u"
    assert set(got("review")) == {"a", "s"}
    assert got("review", staged=True)[0] == "s" and set(got("review", staged=True)) == {"a", "s"}
    assert got("review", of_worktree=True)[-1] == "u" and set(got("review", base="HEAD~1")) == {"a", "b", "s"}
    assert R.counts(R.changes(spark, str(tmp_path))).first().asDict() == {"staged": 1, "dirty": 2, "untracked": 1}


def test_rule_file():
    import pytest

    from tessera.sources.rulefile import parse

    good = "version: 1\ncommands: {t: [make t]}\nrules:\n- {id: a, when: [x], expect_any: [y], severity: warn, message: m}\n"
    assert parse(good)["commands"] == ["make t"]
    for bad in ("", good.replace("id: a, ", ""), good.replace("when: [x]", "when: []"), good.replace("warn", "fatal"), good.replace("message: m", "message: ''"), "a: ["):
        with pytest.raises(ValueError):
            parse(bad)


def test_git_source(spark, tmp_path):
    import subprocess

    from tessera.sources import repository as G

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.txt").write_text("one\n")
    run("add", ".")
    run("commit", "-qm", "x")
    (tmp_path / "a.txt").write_text("two\n")
    (tmp_path / "new.txt").write_text("n\n")
    changes = G.changes(spark, str(tmp_path))
    assert {(r["path"], r["area"]) for r in changes.collect()} == {("a.txt", "worktree"), ("new.txt", "untracked")}
    assert {r["path"] for r in G.worktree(changes).collect()} == {"a.txt", "new.txt"}
    assert {r["path"]: r["body"] for r in G.bodies(spark, str(tmp_path), G.tracked(spark, str(tmp_path))).collect()} == {"a.txt": "two\n"}
    assert G.commits(spark, str(tmp_path)).count() == 1
    assert G.git("/nowhere", "status") == ""


def test_staged_paths_and_hunks(spark, tmp_path):
    import subprocess

    from tessera.functions import text as T
    from tessera.sources import repository as G

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("".join(f"{i}\n" for i in range(9)))
    (tmp_path / "b.txt").write_text("one\n")
    run("add", ".")
    run("commit", "-qm", "x")
    (tmp_path / "docs/a.md").write_text("".join(f"{i}\n" if i != 4 else "four\n" for i in range(9)))
    (tmp_path / "b.txt").write_text("two\n")
    (tmp_path / "docs/c.md").write_text("new\n")
    run("add", "docs/a.md", "b.txt")
    rows = G.changes(spark, str(tmp_path), None, "docs").where("area IN ('staged', 'untracked')").select("path", "area", "hunk", T.added_lines("hunk").alias("added")).collect()
    assert {(r["path"], r["area"]) for r in rows} == {("docs/a.md", "staged"), ("docs/c.md", "untracked")}
    staged = next(r for r in rows if r["area"] == "staged")
    assert "\n 2\n 3\n-4\n+four\n 5\n 6" in staged["hunk"] and "\n 1\n" not in staged["hunk"] and staged["added"] == "four"
    assert {r["path"] for r in G.changes(spark, str(tmp_path)).where("area = 'staged'").collect()} == {"docs/a.md", "b.txt"}


def test_callers_of_every_callee(spark):
    from tessera import catalog

    d = "/root/testdata/sf0.001"
    callers = {}
    for r in spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_linenumber").collect():
        a, b = r["l_partkey"] + 3 * r["l_linenumber"] + r["l_suppkey"] % 5, r["l_partkey"]
        if b % 10 != 7:
            callers.setdefault(f"f{b}", set()).add(f"f{a}")
    want = {}
    for f, near in callers.items():
        for g in near:
            for h in callers.get(g, ()):
                want[f, h] = 2
        want.update({(f, g): 1 for g in near})
    rows = catalog.queries()["callers_khop"](spark, d).collect()
    assert {(r["node"], r["target"]): r["level"] for r in rows} == want and len(rows) == len(want)
    assert {r["node"] for r in rows} == set(callers) and len(callers) > 40


def test_graph_queries_over_all_of_lineitem(spark):
    import duckdb
    from tessera import catalog

    d = "/root/testdata/sf0.001"
    run, sql, db = catalog.queries(), catalog.oracle_sql(), duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    order = lambda rows: sorted((tuple(r) for r in rows), key=str)
    for name in ("graph_diff", "degree", "reachability", "path_loss", "trace_transitions", "regressions", "dead_code", "callers_khop"):
        got = run[name](spark, d)
        want = db.execute(sql[name])
        columns = [c[0] for c in want.description]
        rows = want.fetchall()
        assert rows and order(got.select(*columns).collect()) == order(rows), name
    kinds = {r["kind"]: r["n"] for r in run["edge_counts_by_kind"](spark, d).collect()}
    assert kinds["depends_on"] == db.execute("SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)").fetchone()[0]
    changes = {r["change"] for r in run["graph_diff"](spark, d).select("change").distinct().collect()}
    assert changes == {"added", "removed"}
    assert run["flagship"](spark, d).count() == 1


def test_orphaned_aliases_at_any_place(spark):
    """Labels within longer words, over several runs of characters, and of other characters only."""
    from tessera.operators import meters

    node = "id string, kind string, label string"
    names = ["rate_1", "a.b-long", "??", "kept", "é_x"]
    base = spark.createDataFrame([(f"m:{n}", "metric", n) for n in names], node)
    now = spark.createDataFrame([("m:kept", "metric", "kept")], node)
    files = spark.createDataFrame(
        [("a.ts", "use(rate_12) kept"), ("b.tsx", "x a.b-long y"), ("c.js", "long but a.b alone"), ("d.json", "what???"), ("e.py", "rate_1"), ("f.ts", ""), ("g.ts", None), ("h.ts", "cafeé_xy")],
        "path string, body string",
    )
    found = {tuple(r) for r in meters.orphaned_aliases(base, now, files).collect()}
    bodies = {r.path: r.body or "" for r in files.collect() if not r.path.endswith(".py")}
    assert found == {(p, n) for p, b in bodies.items() for n in names if n != "kept" and n in b}
    assert meters.orphaned_aliases(now, now, files).count() == 0


def test_markdown_hash_fences_in_order(spark):
    """The text is split before fence lines: state, content and a last line end as line by line."""
    import hashlib

    from tessera.operators.snapshot import markdown_hash

    texts = ["```\n# a\n```\n# b", "# x\n\n  ~~~ py\n[l](t)\n~~~\n[l](t)\n[r]: u", "", "\n", "a\n\n", "```\n\n\n", "---\nk: v  \n---\n# h\r\n```\r\n c \r\n"]

    def plain(body):
        out, inside = "", False
        if body.startswith("---\n"):
            front, body = body[4:].split("\n---\n", 1)
            out = "frontmatter:\n" + "".join(x.rstrip(" \t") + "\n" for x in front.split("\n"))
        body = body.replace("\r\n", "\n")
        for x in (body[:-1] if body.endswith("\n") else body).split("\n"):
            t = x.strip()
            if t.startswith(("```", "~~~")):
                out, inside = out + f"fence:{t.lstrip('`~').strip()}\n", not inside
            elif inside:
                out += f"code:{x.rstrip(chr(32) + chr(9))}\n"
            else:
                out += f"heading:{t.lstrip('#').strip()}\n" if t.startswith("#") else ""
                out += "link:t\n" if "(t)" in x else ""
                out += "reflink:u\n" if x.startswith("[r]:") else ""
        return hashlib.sha256(out.encode()).hexdigest()

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string")
    from pyspark.sql import functions as F

    got = {r.i: r.h for r in rows.select("i", markdown_hash(F.col("body")).alias("h")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def plain_rings(arcs):
    """Depth-first search in sorted order over the whole graph."""
    after = {}
    for a, b in sorted(set(arcs)):
        after.setdefault(a, []).append(b)
    colour, stack, rings, keys = {}, [], [], set()

    def visit(u):
        colour[u] = "grey"
        stack.append(u)
        for v in after.get(u, ()):
            if v not in colour:
                visit(v)
            elif colour[v] == "grey":
                ring = stack[stack.index(v) :]
                k = ring.index(min(ring))
                if tuple(ring[k:] + ring[:k]) not in keys:
                    keys.add(tuple(ring[k:] + ring[:k]))
                    rings.append(ring)
        stack.pop()
        colour[u] = "black"

    for u in sorted(after):
        if u not in colour:
            visit(u)
    return sorted(rings)


def plain_strong(arcs):
    nodes = {x for a in arcs for x in a}
    reach = {n: {n} for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in arcs:
            if not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                moved = True
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


def random_arcs(seed, groups=6, size=9, n=16):
    import random

    rng = random.Random(seed)
    return sorted({(f"{g}.{rng.randrange(size)}", f"{g}.{rng.randrange(size)}") for g in range(groups) for _ in range(n)})


def test_strong_components_and_rings(spark):
    """By tasks and by colours (parts of more than 14 arcs), against plain versions."""
    for seed, limit in ((1, 14),):
        arcs = random_arcs(seed)
        edges = spark.createDataFrame(arcs, "src string, dst string")
        assert dict(map(tuple, traverse.strong_components(edges, limit).collect())) == plain_strong(arcs)
        assert sorted(r[0] for r in traverse.reported_cycles(edges, limit).collect()) == plain_rings(arcs)
        assert {r[0] for r in traverse.on_cycles(edges).collect()} == {x for ring in plain_rings(arcs) for x in ring} | {a for a, b in arcs if plain_strong(arcs)[a] == plain_strong(arcs)[b]}
    none = edges.where("false")
    assert traverse.strong_components(none).count() == traverse.reported_cycles(none).count() == 0


def test_many_separate_cycles(spark):
    """Many parts: no part meets another in a task's walk (a million arcs take 80 s the same way)."""
    n = 50_000
    at = spark.range(n).select(F.floor(F.col("id") / 5).cast("string").alias("g"), (F.col("id") % 5).alias("k"))
    name = lambda k: F.concat("g", F.lit("/"), k.cast("string"))
    arcs = at.select(name(F.col("k")).alias("src"), name((F.col("k") + 1) % 5).alias("dst"))
    assert traverse._tarjan(arcs.where("src LIKE '7/%' OR src LIKE '8/%'").toPandas()).groupby("component").size().to_dict() == {"7/0": 5, "8/0": 5}
    rings = traverse.reported_cycles(arcs)
    assert rings.count() == n // 5


def test_build_constraints():
    tags = golang.build_tags(extra=("own",))
    for text, want in {
        "linux": True, "!linux": False, "windows || linux && !arm64": True, "(windows || linux) && arm64": False, "!(windows||arm64)": True, "own && go1.20 && unix": True, "go1.99": False,
        "": None, "linux &&": None, "(linux": None, "linux amd64": None, "!!linux": None, "a-b": None,
    }.items():
        assert golang.holds(text, tags) is want, text
    for path, want in {"a/x_linux_test.go": True, "x_windows.go": False, "linux.go": True, "windows_amd64.go": True, "x_linux_arm64.go": False, "x_arm64_linux.go": True, "x_amd64.go": True, "_x.go": False, "a/.x.go": False, "x_js_wasm.go": False, "x_foo.go": True}.items():
        assert golang.built(path, "package x\n", tags) is want, path
    for source, want in {
        "// text\n\n/* more\n */\n//go:build windows\n\npackage x\n": False, "package x\n//go:build windows\n": True, "//go:build windows &&\npackage x\n": True, "//go:buildwindows\npackage x\n": True,
        "// +build windows\n\npackage x\n": False, "// +build windows\npackage x\n": True, "// +build windows linux\n// +build !own,linux arm64\n\npackage x\n": False, "//go:build linux\n// +build windows\n\npackage x\n": True, "": True,
    }.items():
        assert golang.built("x.go", source, tags) is want, source
    assert not golang.built("x.go", "//go:build own\n\npackage x\n", golang.build_tags()) and golang.built("x.go", "//go:build darwin && unix\n\npackage x\n", golang.build_tags("ios", "arm64"))


def test_files_out_of_the_build_leave_the_call_graph(spark):
    files = {"a.go": "package m\n\nfunc A() { B(); C() }\n", "b.go": "//go:build windows && !cgo\n\npackage m\n\nfunc B() {}\n", "c_darwin.go": "package m\n\nfunc C() {}\n", "c_linux.go": "package m\n\nfunc C() {}\n"}
    defs, calls = golang.call_graph(frame(spark, files))
    assert {(r["file"], r["name"]) for r in defs.collect()} == {("a.go", "A"), ("c_linux.go", "C")}
    assert [(r["to_func"], r["file"]) for r in calls.collect()] == [("C", "a.go")]
    assert {r["name"] for r in golang.call_graph(frame(spark, files), tags=golang.build_tags("windows", "arm64") - {"cgo"})[0].collect()} == {"A", "B"}


def test_callsites_carry_files(spark):
    rows = [("b", "a", "x.go", 1), ("c", "a", "x.go", 2), ("c", "a", "y_test.go", 9), ("d", "b", "z.go", 4), ("a", "d", "x.go", 5), ("t", "c", "t_test.go", 1), ("e", "d", "z.go", 1)]
    calls = spark.createDataFrame([("p", f, "p", t, file, line) for f, t, file, line in rows], "from_pkg string, from_func string, to_pkg string, to_func string, file string, line int")
    changed = spark.createDataFrame([("p", "a", "x.go"), ("p", "e", "z.go"), ("p", "d", "z.go")], "pkg string, name string, file string")
    per = {r["symbol"]: r for r in golang.callers(changed, calls, depth=3, top=2).collect()}
    assert (per["p.a"]["direct_callers"], per["p.a"]["direct_production"], per["p.a"]["transitive_callers"], per["p.a"]["transitive_files"]) == (3, 2, 5, 2)  # b c d, then a again and e
    assert [(x["caller"], x["line"]) for x in per["p.a"]["top_callers"]] == [("p.b", 1), ("p.c", 2)] and per["p.e"]["top_callers"] == []
    one = golang.callsite_blast(changed, calls, most=2).first()
    assert (one["score"], one["top_symbols"], one["changed_symbols"], len(one["warnings"])) == (2, ["p.a", "p.d"], ["p.a", "p.d"], 1)
