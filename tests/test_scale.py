"""What must not grow faster than the input: how often a table is read, what comes to the driver."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import golang, graph, linked, meters, traverse
from tessera.operators.storage import keep
from tessera.plans import file_queries, graph_queries, virtual
from tessera.sources import documents


@pytest.fixture()
def counted(spark):
    """A table from rows, and a counter of how many rows of it were made."""

    def make(rows, schema):
        seen = spark.sparkContext.accumulator(0)

        def run(frames):
            for frame in frames:
                seen.add(len(frame))
                yield frame

        return spark.createDataFrame(rows, schema).mapInPandas(run, schema), seen

    return make


def test_components_read_the_edges_once(spark, counted):
    pairs = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(400)] + [("lone", "lone"), ("a", "b"), ("b", "a")]
    edges, seen = counted(pairs, "src string, dst string")
    found = {r["node"]: r["component"] for r in traverse.components(edges).collect()}
    assert found == {f"p{i:03d}": "p000" for i in range(401)} | {"lone": "lone", "a": "a", "b": "a"}
    assert seen.value == len(pairs)
    starts = spark.createDataFrame([("p399",), ("alone",)], "node string")
    assert {r["node"] for r in traverse.reach(starts, edges).collect()} == {f"p{i:03d}" for i in range(401)} | {"alone"}
    assert seen.value == 2 * len(pairs)


def test_diff_takes_equal_edges_as_equal(spark):
    """One aggregate over both graphs, as EXCEPT has it: an edge without an end is the same edge in both."""
    one = spark.createDataFrame([("e", "a", None), ("e", "a", "b"), ("e", "a", "b")], "kind string, src string, dst string")
    two = spark.createDataFrame([("e", "a", None), ("e", "a", "c")], one.schema)
    assert {tuple(r) for r in graph.diff_edges(one, two).collect()} == {("removed", "e", "a", "b"), ("added", "e", "a", "c")}


def test_blast_reads_each_graph_once(spark, counted):
    shape = "kind string, src string, dst string"
    base, seen_base = counted([("e", "a", "b"), ("e", "b", "c"), ("e", "x", "y"), ("e", "d", "x")], shape)
    now, seen = counted([("e", "b", "c"), ("f", "c", "b"), ("e", "b", "b"), ("e", "c", "d"), ("e", "x", "y"), ("e", "d", "x")], shape)
    per, one = meters.blast(base, now)
    # touched: a, b, c, d; beside them only x is untouched
    assert tuple(one.first()) == (1, 6, 4)
    assert {tuple(r) for r in per.collect()} == {("b", 0, 2), ("c", 0, 2), ("d", 1, 2)}
    assert (seen_base.value, seen.value) == (4, 6)


def test_aliases_do_not_send_texts_to_every_task(spark):
    files = spark.createDataFrame([("web/a.ts", "use(rate_12x)"), ("web/b.ts", "say a b-c")], "path string, body string")
    base = spark.createDataFrame([("m1", "metric", "rate_1"), ("m2", "metric", "a b")], "id string, kind string, label string")
    found = meters.orphaned_aliases(base, base.where("false"), files)
    assert {tuple(r) for r in found.collect()} == {("web/a.ts", "rate_1"), ("web/b.ts", "a b")}
    assert "rightHint=(strategy=merge)" in found._jdf.queryExecution().optimizedPlan().toString()


def test_go_files_are_read_once(spark, counted):
    rows = [("p/a.go", "package p\nfunc A() { b() }\n"), ("p/b.go", "package p\nfunc b() {}\n"), ("q/x.md", "none")]
    files, seen = counted(rows, "path string, body string")
    defs, calls = golang.call_graph(files)
    assert {r["name"] for r in defs.collect()} == {"A", "b"}
    assert [(r["from_func"], r["to_func"], r["file"]) for r in calls.collect()] == [("A", "b", "p/a.go")]
    assert seen.value == len(rows)


def shuffled(spark, df):
    """The rows of df, and how many rows its stages wrote for shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    had = {stages().apply(i).stageId() for i in range(stages().size())}
    rows = [tuple(r) for r in df.collect()]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = stages()
    return rows, sum(x.shuffleWriteRecords() for x in (found.apply(i) for i in range(found.size())) if x.stageId() not in had)


def test_truth_alignment_does_not_shuffle_pairs(spark):
    """Every document of an id conflicts with every artifact: 10,000 rows from 200, in cells of 10 by 10 or in one."""
    now = spark.createDataFrame([(f"d{i}.md", "doc", "x") for i in range(100)] + [(f"a{i}.py", "code", "y") for i in range(100)], "path string, kind string, semantic_hash string")
    was = now.withColumn("semantic_hash", F.when(F.col("kind") == "doc", "old").otherwise(F.col("semantic_hash")))
    edges = spark.createDataFrame([("defines", f"doc:d{i}.md", "us:US-001") for i in range(100)] + [("mentions", f"file:a{i}.py", "us:US-001") for i in range(100)] * 2, "kind string, src string, dst string")
    nodes = spark.createDataFrame([], "id string, kind string, path string")
    for cell in (10, 1000):
        rows, n = shuffled(spark, meters.truth_alignment(nodes, edges, was, now, cell))
        assert sorted(rows) == sorted(("truth_ahead", f"d{i}.md", "us:US-001", f"a{k}.py", "code", "mentions") for i in range(100) for k in range(100))
        assert n < 6000


def test_truth_alignment_has_each_relation_once(spark):
    """A test that both a link and an id lead to is found once; a document without an id has its links."""
    now = spark.createDataFrame([("d.md", "doc", "x"), ("e.md", "doc", "x"), ("a.py", "code", "y"), ("b.py", "code", "y"), ("test_a.py", "code", "y"), ("c.py", "code", "z")], "path string, kind string, semantic_hash string")
    was = spark.createDataFrame([("d.md", "old"), ("e.md", "old"), ("a.py", "y"), ("b.py", "y"), ("test_a.py", "y"), ("c.py", "old")], "path string, semantic_hash string")
    edges = [("defines", "doc:d.md", "us:US-001"), ("mentions", "file:a.py", "us:US-001"), ("mentions", "file:c.py", "us:US-001"), ("mentions", "doc:d.md", "file:a.py"), ("mentions", "doc:e.md", "file:a.py"), ("verifies", "test:test_a.py", "file:a.py"), ("implements", "code_symbol:s", "us:US-001")]
    edges = spark.createDataFrame(edges, "kind string, src string, dst string")
    nodes = spark.createDataFrame([("code_symbol:s", "code_symbol", "b.py")], "id string, kind string, path string")
    us, e = ("truth_ahead", "d.md", "us:US-001"), ("truth_ahead", "e.md", "doc:e.md")
    assert sorted(tuple(r) for r in meters.truth_alignment(nodes, edges, was, now).collect()) == sorted([
        (*us, "a.py", "code", "mentions"), (*us, "b.py", "code", "implements"), (*us, "a.py", "code", "doc_link"), (*us, "test_a.py", "test", "verifies"), (*e, "a.py", "code", "doc_link"), (*e, "test_a.py", "test", "verifies"),
    ])


def test_documents_are_parsed_once(spark, tmp_path):
    """What is read is a table, not the text, and a field's name as a value misleads nobody."""
    shape = {"nodes": "id string, label string", "edges": "kind string, src string, dst string"}
    nodes = spark.createDataFrame([("a", "src"), ("b", '"src":'), ("a", "src")], shape["nodes"])
    edges = spark.createDataFrame([("id", "a", "b"), ("id", "a", "b")], shape["edges"])
    path = str(tmp_path / "graph")
    documents.write(path, "graph", {"nodes": nodes, "edges": edges.distinct()})
    head, read = documents.read(spark, path, "graph", shape)
    assert head["totals"] == {"nodes": 2, "edges": 1}
    assert {tuple(r) for r in read["nodes"].collect()} == {("a", "src"), ("b", '"src":')}
    assert [tuple(r) for r in read["edges"].collect()] == [("id", "a", "b")]
    assert not any("FileScan text" in r._jdf.queryExecution().executedPlan().toString() for r in read.values())


def test_impact_shuffles_the_ends_of_edges_once(spark):
    """Seeds are looked for by the names that edges have; 2000 edges, of which two touch the seed."""
    edges = spark.range(0, 2000, 1, 4).selectExpr("'e' AS kind", "concat('file:', id) AS src", "concat('x:', id + 1) AS dst").unionByName(spark.createDataFrame([("e", "x:9000", "file:7"), ("e", "doc:src/7.py", "x:9001")], "kind string, src string, dst string"))
    nodes = spark.range(0, 9002, 1, 4).selectExpr("concat('x:', id) AS id", "'doc' AS kind", "concat('p', id) AS path")
    ids = spark.createDataFrame([("src/7.py", "file:7")], "path string, id string")
    rows, n = shuffled(spark, graph_queries.impact_by_id(ids, nodes.where("id IN ('x:8', 'x:9000', 'x:9001', 'x:1')"), edges))
    assert set(rows) == {("p8",), ("p9000",), ("p9001",)}
    assert n < 4500


def test_stale_decisions_take_only_what_superseded_ids_need(spark):
    """Of 2000 mentions of a document with other ids nothing goes on; a document that defines or mentions the new decision is fine."""
    named = [("supersedes", "adr:2", "adr:1"), ("supersedes", "adr:2", "adr:1"), ("defines", "doc:1", "adr:1"), ("defines", "doc:2", "adr:2"), ("defines", "doc:9", "us:1"), ("mentions", "doc:a", "doc:1"), ("mentions", "doc:a", "doc:1"), ("mentions", "doc:b", "doc:1"), ("mentions", "doc:b", "doc:2"), ("mentions", "doc:2", "doc:1")]
    edges = spark.createDataFrame(named, "kind string, src string, dst string").unionByName(spark.range(0, 2000, 1, 4).selectExpr("'mentions' AS kind", "concat('doc:', id) AS src", "'doc:9' AS dst"))
    rows, n = shuffled(spark, meters.stale_decisions(edges))
    assert rows == [("doc:a", "adr:1", "adr:2")]
    assert n < 3000


def test_hops_hold_the_pairs_of_a_level_once(spark):
    """The least level of each pair from one aggregate a level: pairs aren't joined with what was found before."""
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("a", "b")], "src string, dst string")
    found = traverse.hops(spark.createDataFrame([("a",)], "node string"), edges, 3)
    assert {tuple(r) for r in found.collect()} == {("a", "b", 1), ("a", "c", 1), ("a", "a", 2), ("a", "d", 2), ("a", "e", 3)}
    assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_stale_tests_reads_files_once_and_spreads_them(spark, counted, monkeypatch):
    """Files that come from one task are hashed by several, and no text is made again for the pairs."""
    rows = [("a/abc.py", "x"), ("a/test_abc.py", "y"), ("b/ab.py", "x"), ("b/test_ab.py", "y"), *((f"c/{i}.md", f"# {i}") for i in range(200))]
    files, seen = counted(rows, "path string, body string")
    monkeypatch.setattr(file_queries, "repo", lambda *_: files.coalesce(1))
    kept = []
    monkeypatch.setattr(file_queries, "keep", lambda df, label: kept.append(df) or keep(df, label))
    assert [tuple(r) for r in file_queries.stale_tests(spark, "").collect()] == [("a/test_abc.py", "a/abc.py")]
    assert seen.value == len(rows)
    assert "RepartitionByExpression [path" in kept[0]._jdf.queryExecution().optimizedPlan().toString()


def test_rings_of_small_parts_are_walked_without_trimming(spark, monkeypatch):
    """Strong components and walks back are for parts that no task takes whole; both ways find the same rings."""
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "b"), ("x", "a"), ("c", "z"), ("z", "y"), ("l", "l"), ("p", "q")]
    arcs = spark.createDataFrame(pairs, "src string, dst string")
    had = []
    strong = traverse.strong_components
    monkeypatch.setattr(traverse, "strong_components", lambda *a: had.append("strong") or strong(*a))
    rings = lambda limit: sorted(r["ring"] for r in traverse.reported_cycles(arcs, limit).collect())
    assert rings(200_000) == [["a", "b", "c"], ["b", "c"], ["l"]] and had == []
    # a task of small parts may hold no ring
    assert rings(1) == [["a", "b", "c"], ["b", "c"], ["l"]] and had == ["strong"]


def test_degree_counts_where_all_ends_of_a_node_are(spark):
    """Tasks that make edges distinct don't hold counts of their ends besides."""
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "c")], "src string, dst string").distinct()
    found = graph.degree(edges)
    assert {tuple(r) for r in found.collect()} == {("a", 1), ("b", 2), ("c", 3)}
    assert "RepartitionByExpression [node" in found._jdf.queryExecution().optimizedPlan().toString()


def most_read(spark, df):
    """The rows of df, and the most shuffled rows that one of its tasks read."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: (x.apply(i) for x in [store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)] for i in range(x.size()))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    had = {x.stageId() for x in stages()}
    rows = [tuple(r) for r in df.collect()]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    last = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 1)
    last[0] = 1.0
    of = [store.taskSummary(x.stageId(), x.attemptId(), last) for x in stages() if x.stageId() not in had]
    return rows, max(x.get().shuffleReadMetrics().readRecords().apply(0) for x in of if x.isDefined())


def test_degree_is_counted_by_as_many_tasks_as_rows_need(spark, monkeypatch):
    """6000 lines make 18,000 of the edges: no task holds them all, neither to make them distinct nor to count their ends."""
    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(virtual, "TASK_ROWS", 1000)
    for name, key in (("edges_current", ("src", "dst")), ("edges_base", ("src", "dst")), ("nodes_current", ("id",)), ("nodes_base", ("id",))):
        found, asked = virtual.dealt(spark, d, name, *key)[0], virtual.frame(spark, d, name)
        assert found.columns == asked.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, asked.collect()))
    ends = graph.sides(virtual.frame(spark, d, "edges_current")).groupBy("node").count()
    rows, most = most_read(spark, graph_queries.degree(spark, d))
    assert sorted(rows) == sorted(map(tuple, ends.collect()))
    assert most < 4000
    rows, most = most_read(spark, graph_queries.weighted_pick(spark, d))
    assert len(rows) == 1 and most < 4000


def _plain_reach(starts, pairs):
    beside = {}
    for a, b in pairs:
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    seen, todo = set(starts), list(starts)
    while todo:
        for x in beside.get(todo.pop(), ()):
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return seen


@pytest.mark.parametrize("cell", [60, 1_000_000])
def test_reach_of_numbered_ids_shuffles_stars_only(spark, monkeypatch, cell):
    """edges are contracted where they are read, in several turns if they don't fit; texts aren't shuffled."""
    import random

    draw = random.Random(cell)
    pairs = [(f"file:{draw.randrange(300)}", f"part:{draw.randrange(200)}") for _ in range(250)] + [(f"node:{i}", f"node:{i + 1}") for i in range(100)] + [("x:1", "x:1"), ("x:2", "x:3")]
    names = ["file:7", "node:50", "alone:0", "x:3"]
    monkeypatch.setattr(linked, "CELL", cell)
    monkeypatch.setattr(traverse, "_linked", None)  # the way by texts isn't taken
    edges = spark.createDataFrame(pairs + [("file:1", None)], "src string, dst string")
    starts = spark.createDataFrame([(n,) for n in names], "node string")
    want = _plain_reach(names, pairs)
    got = [r["node"] for r in traverse.reach(starts, edges).collect()]
    assert sorted(got) == sorted(want)
    of = ["node:3", "x:1", "x:2", "alone:0", "file:7", "other:5", "not a number", None]
    got = [r["node"] for r in traverse.reach(starts, edges, of=spark.createDataFrame([(n,) for n in of], "node string")).collect()]
    assert sorted(got) == sorted(want & set(of))
    assert traverse.reach(starts.where("false"), edges).isEmpty()


def test_ids_that_numbers_do_not_say_stay_texts(spark):
    pairs = [("a:1", "a:01"), ("a:2", "a:+2"), ("a:3\n", "a:4"), ("a:", "b:1"), ("a:99999999999999999999", "c:1:2")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    starts = spark.createDataFrame([(pairs[0][0],), (pairs[2][1],), (pairs[4][0],)], "node string")
    assert {r["node"] for r in traverse.reach(starts, edges).collect()} == {*pairs[0], *pairs[2], *pairs[4]}
    alone = spark.createDataFrame([(None,), ("q:1",)], "node string")
    assert {r["node"] for r in traverse.reach(alone, spark.createDataFrame([("a:1", "a:2")], "src string, dst string")).collect()} == {None, "q:1"}


def test_blast_compares_and_pairs_in_one_shuffle(spark, monkeypatch):
    """numbered ids and texts give the same; ends that are null count as touched; one shuffle compares the sides."""
    shape = "kind string, src string, dst string, side int"
    rows = [("e", "a", "b", 1), ("e", "b", "c", 2), ("f", "c", "b", 3), ("e", "b", "b", 2), ("e", "c", "d", 3), ("e", "x", "y", 1), ("e", "x", "y", 2), ("e", "y", "d", 3), ("e", "b", "z", 3), ("g", "z", "b", 3)]
    numbered = [(k, f"n:{ord(s)}", f"n:{ord(t)}", side) for k, s, t, side in rows]
    plans, kept = [], meters.keep
    monkeypatch.setattr(meters, "keep", lambda df, label: (plans.append((label, df._jdf.queryExecution().executedPlan().toString())), kept(df, label))[1])
    for given, name in ((rows, str), (numbered, lambda c: f"n:{ord(c)}")):
        per, one = meters.blast_sides(spark.createDataFrame(given, shape))
        # touched: a, b, c; d and z are beside them
        assert tuple(one.first()) == (2, 5, 3)
        assert {tuple(r) for r in per.collect()} == {(name("b"), 1, 3), (name("c"), 1, 2)}
    assert [p.count("Exchange hashpartitioning") for label, p in plans if label == "compared"] == [1, 1]
    opened = spark.createDataFrame([("e", "a", None, 1), ("e", "a", "b", 3)], shape)
    assert tuple(meters.blast_sides(opened)[1].first()) == (1, 1, 2)


def test_sides_of_the_virtual_edges_are_read_at_once(spark):
    from collections import Counter

    d = "/root/testdata/sf0.001"
    sides = {r[:3]: r["side"] for r in virtual.sided(spark, d, "edges_base", "edges_current").groupBy("kind", "src", "dst").agg(F.bit_or("side").alias("side")).collect()}
    base, now = ({tuple(r) for r in virtual.frame(spark, d, n).collect()} for n in ("edges_base", "edges_current"))
    assert sides == {e: (e in base) + 2 * (e in now) for e in base | now}
    assert Counter(sides.values()).keys() == {1, 2, 3}


def test_neighborhood_compares_only_edges_with_weight(spark, counted):
    """edges of kinds without weight change nothing, and aren't shuffled."""
    shape = "kind string, src string, dst string"
    base = spark.createDataFrame([("defines", "a", "b"), ("verifies", "a", "b"), (None, "a", "b")], shape)
    now = spark.createDataFrame([("mentions", "a", "b"), ("depends_on", "c", "b")], shape)
    nodes = spark.createDataFrame([("a", "x")], "id string, kind string")
    got = meters.neighborhood(nodes, base, nodes, now)
    assert tuple(got.first()) == (3.5, 0, 0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("kind#") and plan.count("IN (contains,mentions,defines,suggests)") + plan.count("INSET contains") == 2
