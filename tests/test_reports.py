"""Documents, run log, review context, specs: round trips, crashes, plain versions."""

import json
import posixpath
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import meters, review, specs
from tessera.schema import EDGES, NODES, SNAPSHOT_DIRS, SNAPSHOT_FILES
from tessera.sources import documents, runlog

GRAPH = {"nodes": NODES, "edges": EDGES}


def rows(df):
    return sorted(map(repr, df.collect()))


def test_graph_document(spark, tmp_path):
    """Odd letters, nulls and line ends survive; the parts are one JSON file; lost parts and other formats are errors."""
    nodes = spark.createDataFrame([(f"n{i:03}", "file", ['a"b', "line\nend", "é…😀", "  ]", "}"][i % 5], None if i % 3 else f"p/{i}", {"k": "v"} if i % 2 else None) for i in range(200)], NODES)
    edges = spark.createDataFrame([("mentions", f"n{i:03}", f"n{(i * 7) % 200:03}", "md") for i in range(200)] * 2, EDGES)
    path = str(tmp_path / "graph")
    documents.write(path, "graph", {"nodes": nodes, "edges": edges}, {"generated_at": "2024-01-01", "root": None})
    head, read = documents.read(spark, path, "graph", GRAPH)
    assert head == {"format": 1, "kind": "graph", "generated_at": "2024-01-01", "root": None, "totals": {"nodes": 200, "edges": 200}}
    assert rows(read["nodes"]) == rows(nodes) and rows(read["edges"]) == rows(edges.distinct())
    documents.join_parts(spark, path, str(tmp_path / "graph.json"))
    whole = json.loads((tmp_path / "graph.json").read_text())
    assert [n["id"] for n in whole["nodes"]] == [f"n{i:03}" for i in range(200)] and whole["nodes"][0] == {"id": "n000", "kind": "file", "label": 'a"b', "path": "p/0"}
    assert whole["edges"] == sorted(whole["edges"], key=lambda e: (e["kind"], e["src"], e["dst"])) and len(whole["edges"]) == 200
    again, same = documents.read(spark, str(tmp_path / "graph.json"), "graph", GRAPH)  # the joined file reads the same
    assert again == head and rows(same["nodes"]) == rows(nodes)
    with pytest.raises(ValueError, match="instead of a snapshot"):
        documents.read(spark, path, "snapshot", {"files": SNAPSHOT_FILES, "directories": SNAPSHOT_DIRS})
    text = (tmp_path / "graph.json").read_text()
    for name, other, message in (("v", text.replace('"format": 1', '"format": 2'), "format 2"), ("c", text[: len(text) // 2], "not a whole"), ("l", text.replace('"id":"n003"', '"ix":"n003"'), "200 nodes were written")):
        (tmp_path / name).write_text(other)
        with pytest.raises(ValueError, match=message):
            documents.read(spark, str(tmp_path / name), "graph", GRAPH)


def test_empty_and_snapshot_documents(spark, tmp_path):
    files = spark.createDataFrame([("a/b", 1, "code", "h", "s")], SNAPSHOT_FILES)
    dirs = spark.createDataFrame([(".", "x", ["a"]), ("a", "y", [])], SNAPSHOT_DIRS)
    for name, f, d in (("some", files, dirs), ("none", files.where("false"), dirs.where("false"))):
        documents.write(str(tmp_path / name), "snapshot", {"files": f, "directories": d}, {"root_hash": "x"})
        head, read = documents.read(spark, str(tmp_path / name), "snapshot", {"files": SNAPSHOT_FILES, "directories": SNAPSHOT_DIRS})
        assert rows(read["files"]) == rows(f) and rows(read["directories"]) == rows(d) and head["root_hash"] == "x"
        documents.join_parts(spark, str(tmp_path / name), str(tmp_path / f"{name}.json"))
        assert len(json.loads((tmp_path / f"{name}.json").read_text())["files"]) == f.count()
    with pytest.raises(ValueError, match="has the arrays"):
        documents.write(str(tmp_path / "x"), "snapshot", {"files": files})


def point(spark, run, keys):
    return spark.createDataFrame([("meter", k, f"r{run:03}", None, 2, 1, 1, 0, 0, 0) for k in keys], runlog.POINT).withColumn("generated_at", F.timestamp_seconds(F.lit(run)))


def test_run_log(spark, tmp_path):
    """Repeated appends, a crash before the deletion, one in the writing; a rare key goes further back."""
    log = str(tmp_path)

    def state(most=3):
        return sorted((r.key, r.run_id) for r in runlog.read(spark, log, most).collect())

    assert state() == []
    for run in range(5):
        runlog.append(point(spark, run, ["often", "rare"] if run == 0 else ["often"]), log, f"r{run}")
    wanted = [("often", f"r{n:03}") for n in (2, 3, 4)] + [("rare", "r000")]
    assert state() == wanted
    runlog.append(point(spark, 4, ["often"]), log, "r4")
    assert state() == wanted

    def crash():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        runlog.compact(spark, log, 3, crash)
    assert state() == wanted and len(list((tmp_path / "runs").iterdir())) == 5
    half = tmp_path / "archive" / "2"  # an archive that was not finished is no archive
    half.mkdir()
    (half / "part-0.json").write_text('{"series":"meter","key":"wrong","run_id":"r9"}\n')
    assert state() == wanted
    runlog.compact(spark, log, 3)
    assert state() == wanted and not list((tmp_path / "runs").iterdir()) and [p.name for p in (tmp_path / "archive").iterdir()] == ["2"]
    runlog.append(point(spark, 5, ["often"]), log, "r5")
    assert state() == [("often", f"r{n:03}") for n in (3, 4, 5)] + [("rare", "r000")]
    with pytest.raises(ValueError):
        runlog.append(point(spark, 5, ["often"]), log, "a/b")


def test_points_of_results(spark):
    schema = "mutation_id string, expected array<string>, missing array<string>, unexpected array<string>, classification string"
    results = spark.createDataFrame([("m1", ["a", "b"], ["a"], ["c"], "false_negative"), ("m1", ["a"], [], [], "hit"), ("m2", ["b"], [], [], "skipped")], schema)
    found = {(r.series, r.key): (r.total, r.hits, r.false_negatives, r.false_positives, r.skipped, r.hit_rate) for r in runlog.rates(runlog.points_of(results, "r1", "2024-01-01")).collect()}
    assert found[("run", "")] == (3, 1, 1, 1, 1, 0.5) and found[("mutation", "m2")] == (1, 0, 0, 0, 1, 0.0)
    assert found[("meter", "c")] == (1, 0, 0, 1, 0, 0.0) and found[("meter", "a")] == (2, 1, 1, 0, 0, 0.5) and found[("expected_meter", "b")][:2] == (2, 0)


def plain_trim(text, most):
    data = text.encode()
    if len(data) <= most:
        return text
    half = most // 2
    return data[:half].decode(errors="ignore") + review.LEFT_OUT + re.sub(rb"^[\x80-\xbf]+", b"", data[-half:]).decode()


def test_trimmed_bytes(spark):
    texts = ["", "short", "x" * 100, "é" * 60, "a" + "é" * 60, "ab" + "…" * 40, "😀" * 30, "abc" + "😀" * 30, "x" * 49 + "😀" + "y" * 50]
    df = spark.createDataFrame([(t, n) for t in texts for n in (20, 21, 37, 50, 99, 120)], "t string, n int")
    for r in df.select("t", "n", review.trim_bytes("t", F.col("n")).alias("cut")).collect():
        assert r.cut == plain_trim(r.t, r.n), (r.t, r.n)


def test_review_context(spark):
    hunk = "@@ -1 +1 @@\n+see [a](b.md#x) and [w](https://e.org/a.md)\n-[gone](old.md)\n+++ [no](head.md)\r\n+[img](p.png) [r](docs/r.md) [u](../u.md)\n+[a again](b.md)"
    changes = spark.createDataFrame([("guide/x/s.md", hunk), ("top.md", "+[t](./t.md)"), ("none.md", "+text"), ("long.md", "+[l](far/l.md)\n" + "+é\n" * 2000)], "path string, hunk string")
    bodies = {"guide/x/b.md": "é" * 5000, "docs/r.md": "r" * 1000 + "ü" * 3000, "guide/u.md": "third"}
    files = spark.createDataFrame(list(bodies.items()), "path string, body string")
    found = {r.path: r for r in review.context(changes, files).collect()}
    assert found["guide/x/s.md"].cited == ["guide/x/b.md", "docs/r.md"] and found["top.md"].cited == ["t.md"] and found["none.md"].cited == []
    first = plain_trim(bodies["guide/x/b.md"], 2048)
    second = plain_trim(bodies["docs/r.md"], max(512, (4096 - len(first.encode())) // 2))
    assert found["guide/x/s.md"].context == f"# guide/x/b.md\n{first}\n\n# docs/r.md\n{second}"
    assert found["top.md"].context == "" and found["long.md"].cited == [posixpath.join("far", "l.md")] and found["long.md"].hunk == plain_trim("+[l](far/l.md)\n" + "+é\n" * 2000, 2048)


def test_each_constraint_of_specs(spark):
    good = {"id": "a", "operation": "replace_text", "target_kinds": ["file"], "expected_meters": ["path_loss"], "allowed_side_effect_meters": ["staleness"], "selector": {"extensions": [".md"], "has_incoming_edge": "mentions", "has_outgoing_edge": ""},
            "edit": {"path": "${target_dir}/x${target_ext}", "new_path": None, "old": "o", "text": None, "line_contains": None}, "skip_conditions": {"require_env": ["KEY"], "require_files": ["a/b"], "require_optional_engines": ["dead_code"]}}
    cases = [
        ("missing_id", {"id": ""}), ("missing_id", {"id": None}), ("operation:x", {"operation": "x"}), ("operation:", {"operation": None}), ("no_target_kinds", {"target_kinds": []}), ("no_target_kinds", {"target_kinds": None}),
        ("target_kind:x", {"target_kinds": ["file", "x"]}), ("expected_meter:x", {"expected_meters": ["x"]}), ("allowed_meter:x", {"allowed_side_effect_meters": ["x"]}),
        ("incoming_edge:x", {"selector": {"has_incoming_edge": "x"}}), ("outgoing_edge:x", {"selector": {"has_outgoing_edge": "x"}}), ("extension:md", {"selector": {"extensions": [".a", "md"]}}),
        ("env: ", {"skip_conditions": {"require_env": [" "]}}), ("required_file:../a", {"skip_conditions": {"require_files": ["../a"]}}), ("required_file:/a", {"skip_conditions": {"require_files": ["/a"]}}),
        ("required_file:b/../.git/x", {"skip_conditions": {"require_files": ["b/../.git/x"]}}), ("required_file:a/..", {"skip_conditions": {"require_files": ["a/.."]}}), ("engine:x", {"skip_conditions": {"require_optional_engines": ["x"]}}),
        ("edit_path:../${target_id}", {"edit": {"path": "../${target_id}", "old": "o"}}), ("edit_new_path:.git", {"edit": {"new_path": ".git", "old": "o"}}), ("no_edit_old", {"edit": {"old": ""}}),
        ("no_edit_text", {"operation": "append_text"}), ("no_edit_new_path", {"operation": "rename_file"}), ("no_edit_path", {"operation": "add_file", "edit": {"path": ""}}), ("no_edit_line_contains", {"operation": "remove_line_containing"}),
        (None, {}), (None, {"operation": "remove_file"}), (None, {"operation": "backdate_head", "target_kinds": []}),
    ]
    table = [json.dumps({**good, "id": f"s{n}", **change}) for n, (_, change) in enumerate(cases)]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(table)], "n int, t string").select("n", F.from_json("t", specs.SPEC).alias("s")).select("n", "s.*")
    for r in specs.violations(df).collect():
        want = cases[r.n][0]
        assert r.violations == ([want] if want else []), cases[r.n]
    twice = df.where("n = 25").unionByName(df.where("n = 25"))
    assert [r.violations for r in specs.violations(twice).collect()] == [["duplicate_id:s25"]] * 2
    assert specs.valid(df.where("n >= 25")).count() == 3
    with pytest.raises(ValueError, match="s2: operation:x"):
        specs.valid(df.where("n = 2"))


def test_aliases_in_one_long_run(spark):
    """A run of a million letters, labels at its seams; work is linear in the run."""
    node = "id string, kind string, label string"
    names = ["rate_" + "q" * n for n in range(1, 12)] + ["z" * 300]
    base = spark.createDataFrame([(f"m:{n}", "metric", n) for n in names], node)
    body = "".join("abcdefgh"[i % 8] for i in range(1_000_000))
    for at, name in ((0, names[0]), (295, names[2]), (600 - 4, names[4]), (500_000, names[-1]), (1_000_000 - len(names[6]), names[6])):
        body = body[:at] + name + body[at + len(name) :]
    files = spark.createDataFrame([("min.js", body), ("b.ts", "x rate_qqq y")], "path string, body string")
    found = {(r.file, r.name) for r in meters.orphaned_aliases(base, base.where("false"), files).collect()}
    assert found == {(p, n) for p, b in (("min.js", body), ("b.ts", "x rate_qqq y")) for n in names if n in b}


def test_shortlist_of_hot_meters(spark):
    import random

    from tessera.operators import explain

    draw = random.Random(5)
    rows = [(k, m, float(draw.randint(0, 3)), f"i{draw.randint(0, 40)}") for k in ("a", "b") for m, n in (("hot", 3000), ("two", 2), ("one", 1)) for _ in range(n)]
    want = {}
    for k, m, position, item in rows:
        want.setdefault((k, m), []).append((position, item))
    schema = "key string, meter string, position double, item string"
    got = explain.shortlist(spark.createDataFrame(rows, schema).repartition(7), "key").collect()
    assert {(r["key"], r["meter"]): (r["n"], r["first"]) for r in got} == {k: (len(v), [i for _, i in sorted(v)[:5]]) for k, v in want.items()}
    assert explain.shortlist(spark.createDataFrame([], schema), "key").count() == 0
    assert explain.shortlist(spark.createDataFrame([("a", "m", 0.0, None)], schema)).first()["first"] == [None]


def test_words_of_a_report(spark):
    from tessera.operators import explain
    from tessera.operators import verdict as V

    say = lambda report, found: explain.explain(explain.attach(V.judge(report), explain.shortlist(found, "id"), "id"))
    report = spark.createDataFrame([(1, 4, 0.75, False, 0), (2, 4, 0.75, True, 1), (3, None, None, None, None)], "id int, concepts long, path_loss_score double, path_loss_convention boolean, newly_orphaned_concepts long")
    bad = spark.createDataFrame([(k, f"c{i}") for k in (1, 2) for i in (3, 1, 2)], "id int, name string")
    found = bad.selectExpr("id", "'path_loss' AS meter", "0D AS position", "name AS item").unionByName(bad.where("id = 2 AND name = 'c1'").selectExpr("id", "'newly_orphaned_concept' AS meter", "0D AS position", "name AS item"))
    rows = {r["id"]: r for r in say(report, found).collect()}
    lines = lambda k, name: [tuple(x) for x in rows[k][name] if x["meter"] in ("path_loss", "silenced", "none")]
    assert lines(1, "explanations") == [("path_loss", "3 of 4 concepts reach no support (no concept here is supported, so the verdict leaves it out): c1, c2, c3")]
    assert lines(1, "actions")[0][0] == "silenced" and "path_loss" in lines(1, "actions")[0][1] and rows[1]["headline"] == "drift: clean; silenced: path_loss"
    assert [x[1] for x in lines(2, "explanations")] == ["3 of 4 concepts reach no support: c1, c2, c3", "1 concepts lost their support since the baseline: c1"]
    assert [x[0] for x in lines(2, "actions")] == ["path_loss", "path_loss"] and rows[2]["headline"] == "drift: telemetry, 1 regression(s); active: path_loss"
    assert lines(3, "explanations") == [] and lines(3, "actions") == [("none", "nothing to do")]
    said = explain.spoken(say(report, found), "id").where("id = 3 AND part = 'action'").collect()
    assert [(r["position"], r["line"]) for r in said] == [(0, "nothing to do")]


def test_triggered_globs_and_order_of_commands(spark):
    from tessera.functions import globs
    from tessera.operators import rules

    paths = spark.createDataFrame([("docs/a/b.md",), ("x.ts",), (None,)], "path string")
    assert [(r["position"], r["glob"]) for r in globs.triggered(paths, ["*.go", "*.ts", "docs/**/*.md"]).orderBy("position").collect()] == [(1, "*.ts"), (2, "docs/**/*.md")]
    assert globs.triggered(paths, []).count() == 0 and globs.triggered(paths.where("false"), ["*"]).count() == 0
    found = spark.createDataFrame([("z", ["c", "a"]), ("b", ["a", "d", "a"]), ("other", ["e", "c"]), ("b", ["a"])], "rule string, suggested_commands array<string>")
    got = rules.suggested_in_order(found, [{"id": "b"}, {"id": "z"}]).orderBy("position").collect()
    assert [(r["position"], r["command"]) for r in got] == [(0, "a"), (1, "d"), (2, "c"), (3, "e")]
    assert rules.suggested_in_order(found, []).count() == 4


def test_report_queries_equal_sql(spark):
    import duckdb
    from tessera import catalog

    d = "/root/testdata/sf0.001"
    run, sql, db = catalog.queries(), catalog.oracle_sql(), duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    order = lambda rows: sorted((tuple(r) for r in rows), key=str)
    for name in ("meter_explanations", "strict_promotion", "contradictions", "outcome_contract", "triggered_globs", "command_order", "gate"):
        want = db.execute(sql[name])
        columns, rows = [c[0] for c in want.description], want.fetchall()
        assert rows and order(run[name](spark, d).select(*columns).collect()) == order(rows), name
