"""Drift meters over a base and a current graph and snapshot: detail rows, and scores of one row."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import patterns as R
from . import extract as X
from . import linked
from .graph import diff_edges, diff_nodes, sides
from .storage import keep
from .traverse import reach, reported_cycles


def _kind(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("kind") == kind).select("id")


def _edge(edges: DataFrame, *kinds: str) -> DataFrame:
    return edges.where(F.col("kind").isin(*kinds)).select("src", "dst")


def _ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(empty))


def transitions(base: DataFrame | None, current: DataFrame) -> DataFrame:
    """id, change of what has another state in both: base and current have id and good."""
    if base is None:
        return current.select("id", F.lit("newly_bad").alias("change")).where("false")
    both = base.select("id", F.col("good").alias("was")).join(current, "id")
    return both.where("was <> good").select("id", F.when(F.col("good"), "newly_good").otherwise("newly_bad").alias("change"))


def edge_breakage(fired: DataFrame, rules: int) -> DataFrame:
    """fired: findings with their rule."""
    return fired.agg(F.count_distinct("rule").alias("broken")).select("broken", F.lit(rules).cast("long").alias("rules"), _ratio(F.col("broken").cast("double"), F.lit(rules)).alias("score"))


def trace_state(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, good: stories that a mentioned node defines."""
    mentioned = _edge(edges, "mentions").select(F.col("dst").alias("src")).distinct()
    covered = _edge(edges, "defines").join(mentioned, "src", "left_semi").select(F.col("dst").alias("id")).distinct().withColumn("good", F.lit(True))
    return _kind(nodes, "user_story").join(covered, "id", "left").select("id", F.coalesce("good", F.lit(False)).alias("good"))


def coverage(state: DataFrame) -> DataFrame:
    """total, good, score: with nothing to cover all is covered."""
    return state.agg(F.count(F.lit(1)).alias("total"), F.count_if("good").alias("good")).select("total", "good", _ratio(F.col("good").cast("double"), F.col("total"), 1.0).alias("score"))


def neighborhood(base_nodes, base_edges, nodes, edges) -> DataFrame:
    """Weighted edges removed, half of those added, and nodes."""
    weight = F.coalesce(F.create_map(*[F.lit(y) for k, v in R.EDGE_WEIGHTS.items() for y in (k, v)])[F.col("kind")], F.lit(0.0))
    heavy = F.col("kind").isin(*R.EDGE_WEIGHTS)  # edges of other kinds weigh nothing and needn't be compared
    e = diff_edges(base_edges.where(heavy), edges.where(heavy)).agg(F.coalesce(F.sum(F.when(F.col("change") == "removed", weight)), F.lit(0.0)).alias("removed"), F.coalesce(F.sum(F.when(F.col("change") == "added", weight)), F.lit(0.0)).alias("added"))
    n = diff_nodes(base_nodes, nodes).agg(F.count_if(F.col("change") == "added").alias("nodes_added"), F.count_if(F.col("change") == "removed").alias("nodes_removed"))
    return e.join(F.broadcast(n)).select((F.col("removed") + 0.5 * F.col("added") + 0.25 * F.col("nodes_added") + 0.5 * F.col("nodes_removed")).alias("score"), "nodes_added", "nodes_removed")


def semantic_changes(base: DataFrame, current: DataFrame) -> DataFrame:
    """path, change of Markdown files: 'semantic' or 'noop'; deletions don't count."""
    was = base.select("path", F.col("content_hash").alias("c"), F.col("semantic_hash").alias("s"))
    rows = current.where("kind = 'markdown'").join(was, "path", "left")
    return rows.select("path", F.when(F.col("c").isNull() | (F.col("s") != F.col("semantic_hash")), "semantic").when(F.col("c") != F.col("content_hash"), "noop").alias("change")).where("change IS NOT NULL")


def semantic_movement(base: DataFrame, current: DataFrame) -> DataFrame:
    total = current.where("kind = 'markdown'").agg(F.count(F.lit(1)).alias("total"))
    moved = semantic_changes(base, current).agg(F.count_if(F.col("change") == "semantic").alias("semantic"), F.count_if(F.col("change") == "noop").alias("noop"))
    return total.join(F.broadcast(moved)).select("total", "semantic", "noop", _ratio(F.col("semantic").cast("double"), F.col("total")).alias("score"))


def supported(nodes: DataFrame, edges: DataFrame, kind: str | None = None) -> DataFrame:
    """Nodes (of a kind) with a path to an artifact. Paths have no direction, so one search from all artifacts answers for all."""
    starts = nodes.where(F.col("kind").isin(R.SUPPORT_KINDS)).select(F.col("id").alias("node"))
    return reach(starts, _edge(edges, *R.SUPPORT_EDGES), of=None if kind is None else _kind(nodes, kind).select(F.col("id").alias("node")))


def support_state(nodes: DataFrame, reached: DataFrame, kind: str) -> DataFrame:
    """id, good of concepts (path loss) or claims (claim support)."""
    hit = reached.select(F.col("node").alias("id")).distinct().withColumn("good", F.lit(True))
    return _kind(nodes, kind).join(hit, "id", "left").select("id", F.coalesce("good", F.lit(False)).alias("good"))


def loss(state: DataFrame, base_state: DataFrame | None = None) -> DataFrame:
    """total, lost, score, convention (something is supported, now or in the base)."""
    now = state.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("good")).alias("lost"), F.coalesce(F.bool_or("good"), F.lit(False)).alias("now"))
    was = (state.where("false") if base_state is None else base_state).agg(F.coalesce(F.bool_or("good"), F.lit(False)).alias("was"))
    return now.join(F.broadcast(was)).select("total", "lost", _ratio(F.col("lost").cast("double"), F.col("total")).alias("score"), (F.col("now") | F.col("was")).alias("convention"))


def touched(base_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """node: ends of added or removed edges."""
    return sides(diff_edges(base_edges, edges)).select("node").distinct()


def blast(base_edges: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per touched node its impacted neighbours (node, impact, degree), and the one-row score."""
    key = ["kind", "src", "dst"]
    return blast_sides(base_edges.select(*key, F.lit(1).alias("side")).unionByName(edges.select(*key, F.lit(2).alias("side"))))


def blast_sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``blast`` of edges with their side: 1 (in the base), 2 (in the current graph) or 3. An edge may have several rows.

    The graphs are read once, and their ids become numbers where those say the same. All edges between two nodes meet in
    one task, which compares them and gives the pair; nothing is shuffled for the comparison besides. Each pair of
    neighbours learns of both ends whether they are touched, and one sum by node does the rest."""
    read = keep(rows.select("kind", *linked.split("src", "src"), *linked.split("dst", "dst"), "side"), "sides")
    known = linked.prefixes((read, ["src", "dst"]))
    code = linked.joined if known is None else lambda c: linked.number(c, known)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-read.count() // linked.CELL))
    way = F.when(F.col("src").isNull(), 3).when(F.col("dst").isNull(), 2).when(F.col("src") > F.col("dst"), 1).otherwise(0)
    both = read.select("kind", code("src").alias("src"), code("dst").alias("dst"), "side").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "kind", way.alias("way"), "side")
    both = both.repartition(tasks, "a", "b").groupBy("a", "b", "kind", "way").agg(F.bit_or("side").alias("sides"))
    # rows of two nodes are in one task already
    both = both.groupBy("a", "b").agg(F.max(F.expr("sides <> 3")).alias("changed"), F.max(F.expr("sides >= 2")).alias("now"), F.max(F.expr("sides <> 3 AND way > 1")).alias("open"))
    both = keep(both, "compared")
    changed_ends = F.when(F.col("open"), F.array("a", "b", F.lit(None))).otherwise(F.array("a", "b"))
    hit = keep(both.where("changed").select(F.explode(changed_ends).alias("node")).distinct(), "touched")
    pairs = both.where("now").select("a", "b")
    for end, name in (("a", "in_a"), ("b", "in_b")):
        pairs = pairs.join(hit.select(F.col("node").alias(end), F.lit(True).alias(name)), end, "left").fillna(False, [name])
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("in_a").alias("own"), F.col("in_b").alias("other")), F.struct(F.col("b").alias("node"), F.col("in_b").alias("own"), F.col("in_a").alias("other")))
    rows = pairs.where("in_a OR in_b").select(F.explode(F.when(F.col("a") == F.col("b"), F.slice(ends, 1, 1)).otherwise(ends)).alias("x")).select("x.*")
    near = keep(rows.groupBy("node").agg(F.max("own").alias("own"), F.count_if(~F.col("other")).alias("impact"), F.count(F.lit(1)).alias("degree")), "near")
    # an untouched node is here only for a touched neighbour
    one = near.agg(F.count_if(~F.col("own")).alias("score"), F.coalesce(F.sum(F.when(F.col("own"), F.col("degree"))), F.lit(0)).alias("centrality")).join(F.broadcast(hit.agg(F.count(F.lit(1)).alias("touched"))))
    return near.where("own").select(F.col("node") if known is None else linked.text("node", known).alias("node"), "impact", "degree"), one


def blast_top(per: DataFrame, most: int = 5) -> DataFrame:
    return per.where("impact >= 1").orderBy(F.desc("impact"), "node").limit(most).select("node", "impact")


def staleness_rows(files: DataFrame, commits: DataFrame, edges: DataFrame, now: datetime, days: int = 90) -> DataFrame:
    """path, weight, age_days (null without history), stale.

    A file weighs as much as the most described concept that it describes, 1 at least."""
    from .snapshot import latest

    described = edges.where("kind = 'describes'").select("src", "dst")
    fame = described.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    weight = described.join(fame, "dst").groupBy(F.expr("regexp_replace(src, '^doc:', '')").alias("path")).agg(F.max("n").alias("weight"))
    age = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("ts")
    rows = files.select("path").join(latest(commits), "path", "left").join(weight, "path", "left")
    return rows.select("path", F.coalesce("weight", F.lit(1)).cast("long").alias("weight"), F.floor(age / 86400).cast("long").alias("age_days"), F.coalesce(age >= days * 86400, F.lit(False)).alias("stale"))


def staleness(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("files"), F.count_if("stale").alias("stale"), _ratio(F.sum(F.when(F.col("stale"), F.col("weight")).otherwise(0)).cast("double"), F.sum("weight")).alias("score"))


def stalest(rows: DataFrame, most: int = 5) -> DataFrame:
    return rows.where("stale").orderBy(F.desc("age_days"), "path").limit(most).select("path", "age_days")


def contradiction(findings: DataFrame) -> DataFrame:
    """Findings of the language-model review: how many contradict, and over how many files."""
    files = candidates(findings).agg(F.count(F.lit(1)).alias("candidates"))
    return findings.agg(F.count_if(F.col("rule") == "llm-contradiction").alias("score")).join(F.broadcast(files))


def candidates(findings: DataFrame) -> DataFrame:
    """path of the files that findings are about, each once."""
    return findings.select(F.explode("triggered_by").alias("path")).distinct()


def stale_decisions(edges: DataFrame) -> DataFrame:
    """doc, old, new: documents that mention a document of a superseded decision, and none of the new one's."""
    over = _edge(edges, "supersedes").select(F.col("src").alias("new"), F.col("dst").alias("old")).distinct()
    # what a document of a decision, or one that mentions it, says about a pair: it has the old one (fine is false) or the new one
    either = F.explode(F.array(F.struct(F.col("old").alias("id"), F.lit(False).alias("fine")), F.struct(F.col("new").alias("id"), F.lit(True).alias("fine"))))
    pairs = over.select("old", "new", either.alias("x")).select("old", "new", "x.id", "x.fine")
    definers = pairs.join(_edge(edges, "defines").select(F.col("src").alias("definer"), F.col("dst").alias("id")), "id").select("definer", "old", "new", "fine").distinct()
    said = definers.join(_edge(edges, "mentions").select(F.col("src").alias("doc"), F.col("dst").alias("definer")), "definer").select("doc", "old", "new", "fine")
    said = said.unionByName(definers.where("fine").withColumnRenamed("definer", "doc"))
    return said.groupBy("doc", "old", "new").agg(F.max(F.expr("fine AND doc IS NOT NULL")).alias("fine")).where("NOT fine").select("doc", "old", "new")


def broken_chains(edges: DataFrame) -> DataFrame:
    """src, dst of implements edges to what no evidence supports."""
    return _edge(edges, "implements").distinct().join(_edge(edges, "supports").select("dst").distinct(), "dst", "left_anti").select("src", "dst")


def directory_arcs(edges: DataFrame) -> DataFrame:
    """Imports lifted to directories: only edges from a file to a directory count."""
    rows = _edge(edges, "depends_on").where(F.col("src").startswith("file:") & F.col("dst").startswith("dir:"))
    return rows.select(F.concat(F.lit("dir:"), P.dirname(F.substring("src", 6, 1 << 30))).alias("src"), "dst").distinct()


def dependency_cycles(edges: DataFrame) -> DataFrame:
    return reported_cycles(directory_arcs(edges))


def endpoint_state(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, source, good: an endpoint is good if a test verifies the (last) file that defines it."""
    source = _edge(edges, "defines").groupBy(F.col("dst").alias("id")).agg(F.max("src").alias("source"))
    verified = _edge(edges, "verifies").select(F.col("dst").alias("source")).distinct().withColumn("good", F.lit(True))
    return _kind(nodes, "endpoint").join(source, "id").join(verified, "source", "left").select("id", "source", F.coalesce("good", F.lit(False)).alias("good"))


def unimplemented(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _kind(nodes, "user_story").join(_edge(edges, "implements").select(F.col("dst").alias("id")), "id", "left_anti")


def has_kind(kind: str, *edge_sets: DataFrame | None) -> DataFrame:
    """One row, convention: whether any of the graphs has an edge of the kind."""
    some = None
    for edges in edge_sets:
        if edges is not None:
            rows = _edge(edges, kind)
            some = rows if some is None else some.union(rows)
    return some.agg((F.count(F.lit(1)) > 0).alias("convention"))


def broken_links(files: DataFrame, on_disk: DataFrame | None = None) -> DataFrame:
    """source, target of inline links in .md files to nothing tracked or on disk (path)."""
    met = X.links(files, P.ext("path") == ".md").select(F.col("path").alias("source"), "target").distinct()
    there = files.select(F.col("path").alias("target"))
    there = there if on_disk is None else there.union(on_disk.select("path"))
    return met.join(there.distinct(), "target", "left_anti").select("source", "target")


def unknown_ids(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, id in code that the graph has no record of."""
    p = F.concat(F.lit("/"), F.regexp_replace("path", r"\\", "/"))
    fixture = F.lit(False)
    for d in R.FIXTURE_DIRS:
        fixture = fixture | p.contains("/" + d)
    rows = files.where(~X.is_test("path") & ~F.col("path").startswith(".agents/") & ~fixture)
    known = nodes.where(F.col("kind").isin("user_story", "adr", "idr")).select(F.col("id").alias("node"))
    return X.code_ids(rows).join(known, "node", "left_anti").select("path", "id")


def changed_paths(base: DataFrame, current: DataFrame) -> DataFrame:
    """path, changed (semantically) of files in both snapshots."""
    return current.select("path", "semantic_hash").join(base.select("path", F.col("semantic_hash").alias("was")), "path").select("path", (F.col("semantic_hash") != F.col("was")).alias("changed"))


def stale_tests(edges: DataFrame, base: DataFrame, current: DataFrame) -> DataFrame:
    """test, source: the source changed and its test did not."""
    pairs = _edge(edges, "verifies").select(F.regexp_replace("src", "^test:", "").alias("test"), F.regexp_replace("dst", "^file:", "").alias("source")).distinct()
    moved = changed_paths(base, current)
    sources = moved.where("changed").select(F.col("path").alias("source"))
    still = moved.where("changed").select(F.col("path").alias("test"))
    return pairs.join(sources, "source", "left_semi").join(still, "test", "left_anti").select("test", "source")


def _truth_sides(nodes: DataFrame, edges: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc, authority), artifacts (authority, artifact, what, relation) and rows of both that come
    from links of documents (doc, authority, artifact, what, relation); each row once.

    Every document of an authority meets every artifact of it; the links' rows are none of these pairs."""
    typed = lambda c: F.col(c).rlike("^(us|adr|idr):")
    docs = _edge(edges, "defines").where(F.col("src").startswith("doc:") & typed("dst")).select(F.substring("src", 5, 1 << 30).alias("doc"), F.col("dst").alias("authority")).distinct()
    own = nodes.where("kind = 'code_symbol' AND path <> ''").select("id", F.col("path").alias("own"))
    by_edge = _edge(edges, "defines").where(F.col("src").startswith("file:") & F.col("dst").startswith("code_symbol:")).groupBy(F.col("dst").alias("id")).agg(F.substring(F.min("src"), 6, 1 << 30).alias("other"))
    places = own.join(by_edge, "id", "full_outer").select(F.col("id").alias("src"), F.coalesce("own", "other").alias("artifact"))
    code = current.where("kind = 'code'").select(F.col("path").alias("artifact")).distinct().withColumn("code", F.lit(True))
    verifies = edges.where("kind = 'verifies'").where(F.col("src").startswith("test:") & F.col("dst").startswith("file:")).select(F.substring("src", 6, 1 << 30).alias("test"), F.substring("dst", 6, 1 << 30).alias("artifact")).distinct()

    def kinds(rows: DataFrame) -> DataFrame:
        what = F.when(X.is_test("artifact"), "test").when(F.col("code"), "code")
        return rows.join(code, "artifact", "left").withColumn("what", what).where("what IS NOT NULL").drop("code")

    def derived(rows: DataFrame) -> DataFrame:
        return rows.where("what = 'code'").join(verifies, "artifact").withColumns({"artifact": F.col("test"), "what": F.lit("test"), "relation": F.lit("verifies")}).drop("test").distinct()

    implements = edges.where("kind = 'implements'").where(typed("dst")).select("src", F.col("dst").alias("authority")).join(places, "src").select("authority", "artifact", F.lit("implements").alias("relation"))
    mentions = edges.where("kind = 'mentions'")
    coded = mentions.where(F.col("src").startswith("file:") & typed("dst")).select(F.col("dst").alias("authority"), F.substring("src", 6, 1 << 30).alias("artifact"), F.lit("mentions").alias("relation"))
    first = docs.groupBy("doc").agg(F.min("authority").alias("authority"))
    linked = mentions.where(F.col("src").startswith("doc:") & F.col("dst").startswith("file:")).select(F.substring("src", 5, 1 << 30).alias("doc"), F.substring("dst", 6, 1 << 30).alias("artifact")).distinct().join(first, "doc", "left")
    linked = kinds(linked.select("doc", F.coalesce("authority", F.concat(F.lit("doc:"), F.col("doc"))).alias("authority"), "artifact", F.lit("doc_link").alias("relation")))
    direct = kinds(implements.unionByName(coded).distinct())
    tests = derived(direct)
    links = linked.unionByName(derived(linked).join(tests.select("authority", "artifact"), ["authority", "artifact"], "left_anti").select(*linked.columns))
    return docs, direct.unionByName(tests), links


def truth_relations(nodes: DataFrame, edges: DataFrame, current: DataFrame) -> DataFrame:
    """doc, authority, artifact, what (code or test), relation."""
    docs, artifacts, links = _truth_sides(nodes, edges, current)
    return docs.join(artifacts, "authority").select("doc", "authority", "artifact", "what", "relation").unionByName(links)


def truth_alignment(nodes, edges, base: DataFrame, current: DataFrame, cell: int = 1000) -> DataFrame:
    """Conflicts: of a document and its artifact only one changed. What is new counts as changed, what is gone doesn't count.

    An authority with many documents and artifacts has a row for each pair that conflicts. Its documents and artifacts are dealt
    into blocks of about ``cell`` rows, and each block of ones meets each of the others in a place of its own, so
    no task holds an authority whole. Only pairs in conflict are made, each once, and they aren't shuffled."""
    was = base.select("path", F.col("semantic_hash").alias("was"))
    moved = current.select("path", "semantic_hash").join(was, "path", "left").select("path", F.coalesce(F.col("semantic_hash") != F.col("was"), F.lit(True)).alias("changed")).distinct()
    docs, artifacts, links = _truth_sides(nodes, edges, current)
    of = lambda rows, c: rows.join(moved.select(F.col("path").alias(c), F.col("changed").alias(f"{c}_changed")), c)
    docs, artifacts, links = keep(of(docs, "doc"), "truth-docs"), keep(of(artifacts, "artifact"), "truth-artifacts"), of(of(links, "doc"), "artifact").where("doc_changed <> artifact_changed")
    count = lambda rows, c: rows.groupBy("authority", c).agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias(f"{c}_blocks"))
    blocks = count(docs, "doc_changed").join(count(artifacts, "artifact_changed"), "authority").where("doc_changed <> artifact_changed")
    blocks = keep(blocks, "truth-blocks")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(f"{c}_changed_blocks") - 1))
    mine = lambda c: F.pmod(F.xxhash64(c), F.col(f"{c}_changed_blocks")).cast("int")
    docs = docs.join(blocks, ["authority", "doc_changed"]).select("authority", "doc_changed", "doc", mine("doc").alias("row"), every("artifact").alias("column"))
    artifacts = artifacts.join(blocks, ["authority", "artifact_changed"]).select("authority", (~F.col("artifact_changed")).alias("doc_changed"), "artifact", "what", "relation", every("doc").alias("row"), mine("artifact").alias("column"))
    met = artifacts.join(docs.hint("merge"), ["authority", "doc_changed", "row", "column"]).select("doc", "authority", "artifact", "what", "relation", (~F.col("doc_changed")).alias("artifact_changed"))
    direction = F.when(F.col("artifact_changed"), "implementation_ahead").otherwise("truth_ahead")
    return met.unionByName(links.select(*met.columns)).select(direction.alias("direction"), F.col("doc").alias("authority_doc"), F.col("authority").alias("authority_id"), "artifact", F.col("what").alias("artifact_kind"), "relation")


def orphaned_aliases(base_nodes: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """file, name: frontend files that hold the label of a metric that is gone, at any place.

    A label's longest run of word characters (or of others that aren't white space) lies within such
    a run of a text that holds the label. Runs are split into chunks at least as long as any label,
    and each chunk with the one after it is a piece, so the work is linear in a run. The distinct
    pieces of all texts are cut to the lengths that occur, joined with the labels' runs by equality,
    and only labels of several runs are looked up in the texts that hold their run."""
    gone = base_nodes.where("kind = 'metric'").select(F.col("label").alias("name")).distinct().join(nodes.where("kind = 'metric'").select(F.col("label").alias("name")), "name", "left_anti")
    runs = lambda c: F.regexp_extract_all(c, F.lit(r"\w+|[^\w\s]+"), 0)
    longest = F.array_max(F.transform(runs(F.col("name")), lambda x: F.struct(F.length(x).alias("n"), x.alias("run"))))
    gone = gone.select("name", longest["run"].alias("key")).where("key IS NOT NULL")
    lengths = sorted(r[0] for r in gone.select(F.length("key")).distinct().collect())
    front = files.where(P.lower_ext("path").isin(R.FRONTEND)).select(F.col("path").alias("file"), "body")
    chunk = max([256, *lengths])
    chunks = F.transform(runs(F.col("body")), lambda x: F.regexp_extract_all(x, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)))
    pieces = F.flatten(F.transform(chunks, lambda c: F.transform(c, lambda x, i: F.concat(x, F.coalesce(F.try_element_at(c, i + 2), F.lit(""))))))
    held = front.select("file", F.explode(F.array_distinct(pieces)).alias("piece"))
    if not lengths:
        return held.select("file", F.col("piece").alias("name")).where("false")
    starts = lambda n: F.sequence(F.lit(1), F.least(F.lit(chunk), F.length("piece") - n + 1))
    cuts = lambda n: F.when(F.length("piece") >= n, F.transform(starts(n), lambda i: F.substring("piece", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    met = held.select("piece").distinct().select("piece", F.explode(F.array_distinct(F.concat(*[cuts(n) for n in lengths]))).alias("key")).join(gone, "key")
    found = held.join(met, "piece").select("file", "name", (F.col("key") == F.col("name")).alias("whole")).distinct()
    # texts are never sent to every task: sizes of made-up or packed columns are guessed too low
    looked = found.where("NOT whole").join(front.hint("merge"), "file").where("contains(body, name)").select("file", "name")
    return found.where("whole").select("file", "name").unionByName(looked).distinct()


def dangling_imports(files: DataFrame) -> DataFrame:
    """source, spec of relative TypeScript and Python imports that lead nowhere."""
    ts, py = X.ts_import_specs(files), X.py_import_specs(files)
    lost = [specs.where(F.col("spec").startswith(".")).join(found.select("path", "spec"), ["path", "spec"], "left_anti") for specs, found in ((ts, X.resolve_ts(files, ts)), (py, X.resolve_py(files, py)))]
    return lost[0].unionByName(lost[1]).select(F.col("path").alias("source"), "spec").distinct()


def changed_functions(base: DataFrame, current: DataFrame, defs: DataFrame) -> DataFrame:
    """pkg, name, file of top-level functions in Go files that are new or changed."""
    go = current.where(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go"))
    moved = go.join(base.select("path", F.col("semantic_hash").alias("was")), "path", "left").where("was IS NULL OR was <> semantic_hash").select(F.col("path").alias("file"))
    return defs.where("NOT method").join(moved, "file", "left_semi").select("pkg", "name", "file")
