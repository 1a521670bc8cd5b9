"""Traversals: reachability from many sources, bounded hops, nodes on cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linked
from .storage import keep


def reach(starts: DataFrame, edges: DataFrame, directed: bool = False, of: DataFrame | None = None) -> DataFrame:
    """All nodes with a path to a start (column ``node``), starts included; with ``of`` (node) only those of them.

    Undirected reachability is equality of components, so nothing is walked hop by hop. Edges needn't be distinct."""
    if directed:
        found = _walk(starts, edges)
        return found if of is None else found.join(of.distinct(), "node", "left_semi")
    # ids are read once, as prefixes and numbers
    pairs = keep(edges.where("src IS NOT NULL AND dst IS NOT NULL").select(*linked.split("src", "a"), *linked.split("dst", "b")), "pairs")
    marked = keep(starts.select(*linked.split("node", "node")).distinct(), "starts")
    none = marked.where("node IS NULL").select("node")  # a start without an id is linked with nothing
    known = linked.prefixes((pairs, ["a", "b"]), (marked.where("node IS NOT NULL"), ["node"]))
    if known is not None:
        asked = None if of is None else of.select(*linked.split("node", "node"))
        found = linked.linked(pairs, marked.where("node IS NOT NULL"), known, asked, _ends)
        return found.unionByName(none) if of is None else found
    parts = _linked(pairs.select(linked.joined("a").alias("src"), linked.joined("b").alias("dst")), marked.select(linked.joined("node").alias("node")))
    hit = parts.where("marked").select("component").distinct()
    found = parts.join(hit, "component", "left_semi").select("node")
    return found if of is None else found.join(of.distinct(), "node", "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest id of its component)."""
    pairs = keep(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"), "pairs")
    known = _linked(pairs, pairs.select(F.col("src").alias("node")).where("false"))
    least = known.groupBy("component").agg(F.min("node").alias("least"))
    return known.join(least, "component").select("node", F.col("least").alias("component"))


def _linked(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """node, marked, component (a number) of the ends of pairs (src, dst; a written table) and of the marked nodes.

    Ids become 64-bit numbers, by a hash whose seed changes until no two ids
    share a number. Then graphs of numbers are contracted: each number goes to the least one beside
    it, in an order that changes with the round, and what is left is the graph of those. A fixed
    share of the numbers leaves in each round, however long its paths, so all rounds together
    cost little more than the first."""
    seed = 0
    while True:
        number = lambda c: F.xxhash64(c, F.lit(seed))  # noqa: E731,B023
        rows = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("node"), number("dst").alias("beside")), F.struct(F.col("dst").alias("node"), number("src").alias("beside")))).alias("x")).select("x.node", "x.beside", F.lit(False).alias("marked"))
        rows = rows.unionByName(marked.select("node", number("node").alias("beside"), F.lit(True).alias("marked")))
        names = rows.groupBy("node", number("node").alias("number")).agg(F.min("beside").alias("beside"), F.max("marked").alias("marked"))
        names = keep(names.select("node", "number", F.least("number", "beside").alias("parent"), "marked"), "names")
        if names.agg(F.count(F.lit(1)) == F.count_distinct("number")).first()[0]:
            break
        seed += 1
    left = _contracted(pairs.select(number("src").alias("a"), number("dst").alias("b")), names.select("number", "parent"))
    ends = _ends(left)
    if ends is None:
        return names.select("node", "marked", F.col("parent").alias("component"))
    later = ends.select(F.col("number").alias("parent"), F.col("parent").alias("end"))
    return keep(names.join(later, "parent", "left").select("node", "marked", F.coalesce("end", "parent").alias("component")), "linked")


def _ends(left: DataFrame) -> DataFrame | None:
    """number, parent (one for all numbers of a component) of pairs (a, b); None without pairs.

    They are contracted in rounds until they fit in a task."""
    rounds = []
    while (n := left.count()) > linked.CELL:
        turn, flip = 7 + 11 * len(rounds) % 56, F.lit((len(rounds) + 1) * 0x1E3779B97F4A7C15 % (1 << 62))
        mixed = lambda c: (F.shiftleft(c, turn).bitwiseOR(F.shiftrightunsigned(c, 64 - turn))).bitwiseXOR(flip)  # noqa: E731,B023
        plain = lambda c: F.shiftrightunsigned(c.bitwiseXOR(flip), turn).bitwiseOR(F.shiftleft(c.bitwiseXOR(flip), 64 - turn))  # noqa: E731,B023
        both = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", mixed(F.col("x.b")).alias("b"))
        step = both.groupBy(F.col("a").alias("number")).agg(F.min("b").alias("b")).select("number", plain(F.least("b", mixed(F.col("number")))).alias("parent"))
        rounds.append(keep(step, "round"))
        left = _contracted(left, rounds[-1])
    if not n and not rounds:
        return None
    # back from the last round: where each number ended
    ends = keep(linked.solved(left), "solved") if n else rounds.pop()
    while rounds:
        step, later = rounds.pop(), ends.select(F.col("number").alias("parent"), F.col("parent").alias("end"))
        ends = keep(step.join(later, "parent", "left").select("number", F.coalesce("end", "parent").alias("parent")), "ends")
    return ends


def _contracted(pairs: DataFrame, parents: DataFrame) -> DataFrame:
    """Pairs (a, b) between the parents of their ends, each once and without loops."""
    at = pairs.where("a <> b").join(parents.select(F.col("number").alias("a"), F.col("parent").alias("x")), "a").select("b", "x")
    at = at.join(parents.select(F.col("number").alias("b"), F.col("parent").alias("y")), "b").where("x <> y")
    return keep(at.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "left")


def _walk(starts: DataFrame, edges: DataFrame) -> DataFrame:
    seen = keep(starts.select("node").distinct(), "seen")
    frontier = seen
    while True:
        step = edges.join(frontier, edges["src"] == frontier["node"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = keep(step, "frontier")
        if frontier.isEmpty():
            return seen
        seen = keep(seen.union(frontier), "seen")


def hops(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """node, target, level: targets within ``depth`` directed hops of each start, at their least level.

    A start is found again if an edge leads back to it."""
    level = starts.select("node").distinct().withColumn("at", F.col("node"))
    found = None
    for n in range(1, depth + 1):
        step = level.join(edges, level["at"] == edges["src"]).select("node", F.col("dst").alias("target"), F.lit(n).alias("level"))
        # one aggregate makes the pairs distinct and keeps the least level; an anti-join besides would hold and sort all pairs again
        found = (step if found is None else found.unionByName(step)).groupBy("node", "target").agg(F.min("level").alias("level"))
        level = found.where(F.col("level") == n).select("node", F.col("target").alias("at"))
    return found


def weak_components(arcs: DataFrame, task_arcs: int) -> tuple[DataFrame, DataFrame, int]:
    """arcs (src, dst, component), (component, n arcs) and how many tasks of about ``task_arcs`` arcs
    hold the components that are no larger."""
    of = components(arcs)
    own = keep(arcs.join(of.select(F.col("node").alias("src"), "component"), "src").select("src", "dst", "component"), "component-arcs")
    sizes = keep(own.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component-sizes")
    small = sizes.where(F.col("n") <= task_arcs).agg(F.sum("n")).first()[0] or 0
    return own, sizes, max(1, -(-small // task_arcs))


def _tarjan(pdf):
    """node, component (its smallest node) of the strong components of a graph that fits in a task."""
    import pandas as pd

    after: dict[str, list[str]] = {}
    for a, b in zip(pdf["src"], pdf["dst"]):
        after.setdefault(a, []).append(b)
    number, low, open_, waiting = {}, {}, [], set()
    out = []
    for first in after:
        if first in number:
            continue
        number[first] = low[first] = len(number)
        open_.append(first)
        waiting.add(first)
        todo = [(first, iter(after[first]))]
        while todo:
            node, rest = todo[-1]
            nxt = next(rest, None)
            if nxt is None:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
                if low[node] == number[node]:
                    group = [open_.pop()]
                    while group[-1] != node:
                        group.append(open_.pop())
                    waiting.difference_update(group)
                    least = min(group)
                    out += [(x, least) for x in group]
            elif nxt not in number:
                number[nxt] = low[nxt] = len(number)
                open_.append(nxt)
                waiting.add(nxt)
                todo.append((nxt, iter(after.get(nxt, ()))))
            elif nxt in waiting:
                low[node] = min(low[node], number[nxt])
    return pd.DataFrame(out, columns=["node", "component"])


def _spread(labels: DataFrame, arcs: DataFrame, least: bool) -> DataFrame:
    """Pass labels (node, label) along arcs until none changes: each node's best of all that reach it."""
    best = F.min if least else F.max
    pick = F.least if least else F.greatest
    while True:
        come = arcs.join(labels, arcs["src"] == labels["node"]).groupBy(F.col("dst").alias("at")).agg(best("label").alias("new"))
        met = labels.join(come, labels["node"] == come["at"], "left").select("node", F.col("label").alias("was"), pick("label", "new").alias("label"))
        met = keep(met, "labels")
        labels = met.select("node", "label")
        if met.where("label <> was").isEmpty():
            return labels


def _by_colours(arcs: DataFrame) -> DataFrame:
    """Strong components of graphs of any size, forward and backward: each node's colour is the largest
    node that reaches it; what reaches a colour's own node within the colour is one component.
    The rest goes on without these, until nothing is left."""
    left, done = keep(arcs.where("src <> dst").distinct(), "arcs"), None
    nodes = keep(arcs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
    while not nodes.isEmpty():
        colour = _spread(nodes.select("node", F.col("node").alias("label")), left, least=False)
        own = left.join(colour.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
        own = keep(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "turned")
        # backward from each colour's own node: true spreads
        back = _spread(colour.select("node", (F.col("node") == F.col("label")).alias("label")), own, least=False)
        found = keep(back.where("label").select("node").join(colour, "node"), "found")
        least = found.groupBy("label").agg(F.min("node").alias("component"))
        now = found.join(least, "label").select("node", "component")
        done = now if done is None else done.unionByName(now)
        nodes = keep(nodes.join(found.select("node"), "node", "left_anti"), "nodes")
        left = keep(left.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"), "arcs")
    return done if done is not None else arcs.select(F.col("src").alias("node"), F.col("src").alias("component")).where("false")


def strong_components(edges: DataFrame, task_arcs: int = 200_000) -> DataFrame:
    """node, component: nodes that reach each other share their smallest node.

    Weakly connected parts of up to ``task_arcs`` arcs go to tasks by the bucketful; larger ones
    are solved by all tasks together, with colours."""
    arcs = keep(edges.select("src", "dst").distinct(), "arcs")
    own, sizes, tasks = weak_components(arcs, task_arcs)
    small = own.join(sizes.where(F.col("n") <= task_arcs).select("component"), "component", "left_semi")
    out = small.withColumn("task", F.pmod(F.xxhash64("component"), F.lit(tasks))).groupBy("task").applyInPandas(_tarjan, "node string, component string")
    large = own.join(sizes.where(F.col("n") > task_arcs).select("component"), "component", "left_semi").select("src", "dst")
    if not large.isEmpty():
        out = out.unionByName(_by_colours(large))
    return keep(out, "strong")


def cycle_arcs(edges: DataFrame) -> DataFrame:
    """src, dst, component: arcs that lie on a directed cycle, those within a strong component."""
    of = strong_components(edges)
    arcs = edges.select("src", "dst").distinct()
    both = arcs.join(of.select(F.col("node").alias("src"), "component"), "src").join(of.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst")
    return both.where("component = other").select("src", "dst", "component")


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes on a directed cycle."""
    return cycle_arcs(edges).select(F.col("src").alias("node")).distinct()


def _walk_rings(pdf):
    import pandas as pd

    after: dict[str, list[str]] = {}
    for a, b in sorted(zip(pdf["src"], pdf["dst"])):
        after.setdefault(a, []).append(b)
    done, rings, keys = set(), [], set()
    for first in sorted(after):
        if first in done:
            continue
        path, place = [first], {first: 0}
        todo = [iter(after[first])]
        while todo:
            nxt = next(todo[-1], None)
            if nxt is None:
                todo.pop()
                gone = path.pop()
                del place[gone]
                done.add(gone)
            elif nxt in place:
                ring = path[place[nxt] :]
                k = ring.index(min(ring))
                key = tuple(ring[k:] + ring[:k])
                if key not in keys:
                    keys.add(key)
                    rings.append(ring)
            elif nxt not in done:
                place[nxt] = len(path)
                path.append(nxt)
                todo.append(iter(after.get(nxt, ())))
    return pd.DataFrame({"ring": pd.Series(rings, dtype=object)})  # of a bucket without rings too


def reported_cycles(edges: DataFrame, task_arcs: int = 200_000) -> DataFrame:
    """ring (array): the rings that a depth-first search in sorted order meets at its back edges,
    each once whatever its first node.

    The walk enters a strong component where it comes to it first, so what leads to cycles must
    be walked too, and what leads to none need not. Walks of parts that aren't connected don't
    meet: each is a walk of its own. Parts of up to ``task_arcs`` arcs are walked whole, several
    to a task. Of larger ones only connected parts of arcs that lead to a cycle are walked, each
    in one task."""
    arcs = keep(edges.select("src", "dst").distinct(), "arcs")
    own, sizes, tasks = weak_components(arcs, task_arcs)
    small = own.join(sizes.where(F.col("n") <= task_arcs).select("component"), "component", "left_semi")
    out = _rings(small.select("src", "dst", _bucket(tasks).alias("task")))
    if not sizes.where(F.col("n") > task_arcs).isEmpty():
        large = own.join(sizes.where(F.col("n") > task_arcs).select("component"), "component", "left_semi")
        own, sizes, tasks = weak_components(_leading(keep(large.select("src", "dst"), "large")), task_arcs)
        task = F.when(F.col("n") <= task_arcs, _bucket(tasks)).otherwise(F.concat(F.lit("c"), "component"))
        out = out.unionByName(_rings(own.join(sizes, "component").select("src", "dst", task.alias("task"))))
    return out


def _bucket(tasks: int):
    return F.concat(F.lit("t"), F.pmod(F.xxhash64("component"), F.lit(tasks)).cast("string"))


def _rings(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("task").applyInPandas(_walk_rings, "ring array<string>")


def _leading(arcs: DataFrame) -> DataFrame:
    """The arcs back from the cycles: those that lead to one."""
    ring = cycle_arcs(arcs).select(F.col("src").alias("node")).distinct()
    turned = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    leads = _walk(ring, turned)
    return keep(arcs.join(leads.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"), "leading")
