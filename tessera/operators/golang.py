"""Go sources without a Go parser: a lexer over Arrow batches.

What it knows: package and imports, top-level functions, methods, types, constants and
variables with the comments above them, HTTP registrations with a literal path, and calls
by name. It does not check types, and a file that wouldn't parse still gives what it shows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import patterns as R
from .storage import keep

_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'|[^\W\d]\w*|\d[\w.]*|\.\.\.|[^\s\w]", re.S)
#: Methods of routers and the verbs they register.
VERBS = {"Get": "GET", "Post": "POST", "Put": "PUT", "Delete": "DELETE", "Patch": "PATCH", "Head": "HEAD", "Options": "OPTIONS"}
_KEYWORDS = {"func", "if", "for", "switch", "select", "return", "go", "defer", "range", "map", "chan", "struct", "interface", "case", "type", "var", "const"}


#: Systems and architectures that a file name or a tag may name.
SYSTEMS = frozenset("aix android darwin dragonfly freebsd hurd illumos ios js linux nacl netbsd openbsd plan9 solaris wasip1 windows zos".split())
UNIX = frozenset("aix android darwin dragonfly freebsd hurd illumos ios linux netbsd openbsd solaris".split())
MACHINES = frozenset("386 amd64 amd64p32 arm armbe arm64 arm64be loong64 mips mipsle mips64 mips64le mips64p32 mips64p32le ppc ppc64 ppc64le riscv riscv64 s390 s390x sparc sparc64 wasm".split())
#: Systems that count as another one too.
ALSO = {"android": "linux", "illumos": "solaris", "ios": "darwin"}


def build_tags(system: str = "linux", machine: str = "amd64", release: int = 24, extra: tuple[str, ...] = ()) -> frozenset[str]:
    """The tags that hold when building for a system: itself and what it counts as, its machine, the
    compiler, cgo, language releases up to ``release``, and any of one's own."""
    own = {system, machine, "gc", "cgo", *extra, *(f"go1.{n}" for n in range(1, release + 1))}
    return frozenset(own | ({"unix"} if system in UNIX else set()) | ({ALSO[system]} if system in ALSO else set()))


_PART = re.compile(r"\s*(\|\||&&|!|\(|\)|[\w.]+)")


def holds(expression: str, tags: frozenset[str]) -> bool | None:
    """The truth of a constraint such as ``linux && (amd64 || !cgo)``; None if it can't be read.

    Or binds less than and, and less than not."""
    parts, at, text = [], 0, expression.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            return None
        parts.append(m.group(1))
        at = m.end()
    parts.append("")
    place = 0

    def one() -> bool:
        nonlocal place
        part = parts[place]
        place += 1
        if part == "!":
            if parts[place] == "!":
                raise ValueError("not of not")
            return not one()
        if part == "(":
            inside = any_of()
            if parts[place] != ")":
                raise ValueError("open bracket")
            place += 1
            return inside
        if not part or part in ("||", "&&", ")"):
            raise ValueError("a tag is missing")
        return part in tags

    def chain(sign: str, of):
        nonlocal place
        values = [of()]
        while parts[place] == sign:
            place += 1
            values.append(of())
        return values

    def all_of() -> bool:
        return all(chain("&&", one))

    def any_of() -> bool:
        return any(chain("||", all_of))

    try:
        truth = any_of()
    except ValueError:
        return None
    return truth if parts[place] == "" else None


def named_for(path: str, tags: frozenset[str]) -> bool:
    """Whether the endings of a file's name (_system, _machine, _system_machine, before _test) hold."""
    name = path.rsplit("/", 1)[-1].split(".", 1)[0]
    words = name.split("_")[1:]
    if words and words[-1] == "test":
        words.pop()
    if len(words) > 1 and words[-2] in SYSTEMS and words[-1] in MACHINES:
        return words[-2] in tags and words[-1] in tags
    return not words or words[-1] not in SYSTEMS | MACHINES or words[-1] in tags


_HEAD = re.compile(r"\s*(?://([^\n]*)(?:\n|$)|/\*.*?\*/)", re.S)


def built(path: str, source: str, tags: frozenset[str]) -> bool:
    """Whether a Go file belongs to a build: its name fits, and the constraint above its package
    clause holds. A ``//go:build`` line that can't be read leaves the file in; older ``+build``
    lines count where there is none: all lines, of a line any word, of a word all its parts.
    They must stand before a blank line."""
    if path.rsplit("/", 1)[-1][:1] in ("_", ".") or not named_for(path, tags):
        return False
    at, older = 0, []
    while m := _HEAD.match(source, at):
        text = m.group(1)
        if text is not None and (text == "go:build" or text.startswith(("go:build ", "go:build\t"))):
            return holds(text[8:], tags) is not False
        if text is not None and text.split()[:1] == ["+build"]:
            older.append((m.end(), text.split()[1:]))
        at = m.end()
    cut = max((k.end() for k in re.finditer(r"\n[ \t\r]*\n", source[: at + 1])), default=-1)
    lines = [words for end, words in older if end < cut]
    true = lambda word: all((w[1:] not in tags) if w.startswith("!") else w in tags for w in word.split(","))
    return all(any(true(w) for w in words) for words in lines)


def read(source: str) -> dict:
    """package, imports {alias: path}, decls (name, kind, receiver, line, doc), routes, calls."""
    tokens, line, at = [], 1, 0
    for m in _TOKEN.finditer(source):
        line += source.count("\n", at, m.start())
        at = m.start()
        tokens.append((m.group(), line))
    comment = lambda t: t.startswith("//") or t.startswith("/*")
    code = [(t, n) for t, n in tokens if not comment(t)]
    ends = {}  # the last line of each comment: its text and first line
    for t, n in tokens:
        if comment(t):
            ends[n + t.count("\n")] = (n, t)

    def doc(first_line: int) -> str:
        out = []
        while first_line - 1 in ends:
            first_line, text = ends[first_line - 1]
            out.append(text[2:] if text.startswith("//") else text[2:-2])
        return "\n".join(reversed(out))

    word = re.compile(r"[^\W\d]\w*$")
    pkg = next((code[i + 1][0] for i in range(len(code) - 1) if code[i][0] == "package"), "")
    imports, decls, routes, calls = {}, [], [], []

    def add_import(i: int) -> None:
        path = code[i][0].strip('"`')
        before = code[i - 1][0] if i else ""
        alias = before if (word.match(before) and before != "import") or before in ("_", ".") else path.rsplit("/", 1)[-1]
        imports[alias] = path

    depth, i, inside = 0, 0, None  # inside: the function whose body is being read
    while i < len(code):
        t, n = code[i]
        if depth == 0 and t == "import" and i + 1 < len(code):
            if code[i + 1][0] == "(":
                i += 2
                while i < len(code) and code[i][0] != ")":
                    if code[i][0][0] in "\"`":
                        add_import(i)
                    i += 1
            else:
                while code[i][0][0] not in "\"`" and i + 1 < len(code):
                    i += 1
                add_import(i)
        elif depth == 0 and t == "func" and i + 1 < len(code):
            receiver, k = None, i + 1
            if code[k][0] == "(":
                level, names = 0, []
                while k < len(code):
                    level += (code[k][0] == "(") - (code[k][0] == ")")
                    if word.match(code[k][0]):
                        names.append(code[k][0])
                    k += 1
                    if not level:
                        break
                receiver = names[1] if len(names) > 1 else names[0] if names else "?"
            name = code[k][0] if k < len(code) else ""
            if word.match(name):
                decls.append((name, "func", receiver, n, doc(n)))
                inside = f"{receiver}::{name}" if receiver else name
            i = k
        elif depth == 0 and t in ("type", "const", "var"):
            above = doc(n)
            if i + 1 < len(code) and code[i + 1][0] == "(":
                level, i, last = 1, i + 2, -1
                while i < len(code) and level:
                    u, m = code[i]
                    if level == 1 and m != last and word.match(u):
                        k = i
                        decls.append((u, t, None, m, above + "\n" + doc(m)))
                        while t != "type" and k + 2 < len(code) and code[k + 1][0] == "," and code[k + 1][1] == m:
                            k += 2
                            decls.append((code[k][0], t, None, m, above + "\n" + doc(m)))
                    last = m
                    level += (u in "([{") - (u in ")]}")
                    i += 1
                continue
            k = i + 1
            while k < len(code) and word.match(code[k][0]):
                decls.append((code[k][0], t, None, n, above))
                if t == "type" or k + 1 >= len(code) or code[k + 1][0] != ",":
                    break
                k += 2
            inside = None
        elif t in "{}":
            depth += 1 if t == "{" else -1
            if not depth:
                inside = None
        if word.match(t) and i + 1 < len(code) and code[i + 1][0] == "(" and t not in _KEYWORDS and not (depth == 0 and i and code[i - 1][0] in ("func", ")")):
            dotted = i >= 2 and code[i - 1][0] == "."
            owner = code[i - 2][0] if dotted and word.match(code[i - 2][0]) and (i < 3 or code[i - 3][0] != ".") else None
            literal = code[i + 2][0] if i + 3 < len(code) and code[i + 2][0][0] in "\"`" and code[i + 3][0] == "," else ""
            route = literal[1:-1]
            if dotted and route:
                if owner == "http" and t in ("HandleFunc", "Handle"):
                    routes.append(("*", route))
                elif t in VERBS:
                    routes.append((VERBS[t], route))
            if inside and (owner or not dotted):
                calls.append((inside, owner, t, n))
        i += 1
    return {"package": pkg, "imports": imports, "decls": decls, "routes": routes, "calls": calls}


_READ = "path string, pkg string, imports map<string,string>, decls array<struct<name:string,kind:string,receiver:string,line:int,doc:string>>, routes array<struct<method:string,route:string>>, calls array<struct<caller:string,owner:string,callee:string,line:int>>"


def in_build(files: DataFrame, tags: frozenset[str] | None = None) -> DataFrame:
    """The Go files (path, body) that a build with these tags compiles."""
    own = build_tags() if tags is None else tags

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [built(p, b or "", own) for p, b in zip(batch.column("path").to_pylist(), batch.column("body").to_pylist())]
            yield batch.filter(pa.array(fits, pa.bool_()))

    return files.where(P.ext("path") == ".go").select("path", "body").mapInArrow(run, "path string, body string")


def lex(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read(b or "") for b in batch.column("body").to_pylist()]
            text, number = pa.string(), pa.int32()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("path"),
                    pa.array([r["package"] for r in rows], text),
                    pa.array([list(r["imports"].items()) for r in rows], pa.map_(text, text)),
                    pa.array([[dict(zip(("name", "kind", "receiver", "line", "doc"), d)) for d in r["decls"]] for r in rows], pa.list_(pa.struct([("name", text), ("kind", text), ("receiver", text), ("line", number), ("doc", text)]))),
                    pa.array([[dict(zip(("method", "route"), d)) for d in r["routes"]] for r in rows], pa.list_(pa.struct([("method", text), ("route", text)]))),
                    pa.array([[dict(zip(("caller", "owner", "callee", "line"), d)) for d in r["calls"]] for r in rows], pa.list_(pa.struct([("caller", text), ("owner", text), ("callee", text), ("line", number)]))),
                ],
                names=["path", "pkg", "imports", "decls", "routes", "calls"],
            )

    return files.where(P.ext("path") == ".go").select("path", "body").mapInArrow(run, _READ)


def module_name(files: DataFrame):
    """The module path of go.mod, as a one-row DataFrame."""
    return files.where("path = 'go.mod'").select(F.trim(F.regexp_extract("body", r"(?m)^[ \t]*module[ \t]+(.*)$", 1)).alias("module"))


def symbols(files: DataFrame):
    """Exported functions, types, constants and variables; endpoints; imports of this module's directories."""
    from . import extract as X

    # files spread over all tasks, and each is read once
    read_ = keep(lex(files.where(X.is_go()).select("path", "body").repartition("path")), "go-read")
    decls = read_.select("path", "pkg", F.posexplode("decls").alias("pos", "d")).select("path", "pkg", "pos", "d.*").where("receiver IS NULL AND name RLIKE '^[A-Z]'").withColumnRenamed("kind", "what")
    nodes, edges = X._symbols(decls, "go", "package", F.col("pkg"))
    claims = decls.select("path", "pkg", "name", F.explode(F.regexp_extract_all(F.regexp_replace("doc", R.BACKTICKS, ""), F.lit(R.GO_IMPLEMENTS), 1)).alias("id")).distinct()
    routes = read_.select("path", F.posexplode("routes").alias("pos", "r")).select("path", "pos", "r.*").where("route <> ''")
    more_nodes, more_edges = X._endpoints(routes)
    dirs = files.where(P.ext("path") == ".go").select(P.dirname("path").alias("target")).distinct()
    imports = read_.select("path", F.explode(F.map_values("imports")).alias("import")).join(F.broadcast(module_name(files))).where("module <> '' AND startswith(import, concat(module, '/'))")
    met = imports.withColumn("target", F.expr("substring(import, length(module) + 2)")).join(dirs, "target", "left_semi")
    depends = X._edges(met, "depends_on", X._cat("file:", "$path"), X._cat("dir:", "$target"), X._cat("$path", " (import ", "$import", ")"), pos=40_000)
    return nodes.unionByName(more_nodes), edges.unionByName(more_edges).unionByName(depends).unionByName(X._implements(claims, F.col("pkg"), " (doc comment implements "))


def call_graph(files: DataFrame, tests: bool = False, tags: frozenset[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Definitions and the calls that lead to one, by package name and last part of an import path.
    Files that a build with ``tags`` (by default for linux on amd64) leaves out take no part."""
    skipped = r"(^|/)(\.[^/]*|node_modules|vendor)/"
    own = files.where(~F.col("path").rlike(skipped))
    chosen = own if tests else own.where(~F.col("path").endswith("_test.go"))
    read_ = keep(lex(in_build(chosen.where(P.ext("path") == ".go").select("path", "body").repartition("path"), tags)), "go-read")
    defs = read_.select("pkg", F.col("path").alias("file"), F.explode("decls").alias("d")).where("d.kind = 'func'").select(
        "pkg", F.when(F.col("d.receiver").isNull(), F.col("d.name")).otherwise(F.concat("d.receiver", F.lit("::"), "d.name")).alias("name"), F.col("d.receiver").isNotNull().alias("method"), "file", F.col("d.line").alias("line")
    )
    rows = read_.select("pkg", "path", "imports", F.explode("calls").alias("c"))
    to_pkg = F.when(F.col("c.owner").isNull(), F.col("pkg")).otherwise(F.element_at(F.split(F.try_element_at("imports", F.col("c.owner")), "/"), -1))
    calls = rows.select(F.col("pkg").alias("from_pkg"), F.col("c.caller").alias("from_func"), to_pkg.alias("to_pkg"), F.col("c.callee").alias("to_func"), F.col("path").alias("file"), F.col("c.line").alias("line"))
    known = defs.select(F.col("pkg").alias("to_pkg"), F.col("name").alias("to_func")).distinct()
    return defs, calls.join(known, ["to_pkg", "to_func"], "left_semi").select("from_pkg", "from_func", "to_pkg", "to_func", "file", "line")


def callers(changed: DataFrame, calls: DataFrame, depth: int = 2, most: int | None = 50, top: int = 10) -> DataFrame:
    """Per changed function (pkg, name, file): symbol, file, direct_callers and direct_production
    (call sites), transitive_callers (functions that reach it in ``depth`` calls outside tests),
    transitive_files (their files) and top_callers (caller, file, line; the first by file and line).

    A frontier of (changed function, caller reached) goes out one call a round and carries the
    files of the calls; a caller that was reached before doesn't go on. The first callers are
    kept by an aggregate that never holds more than ``top`` of them for a function."""
    picked = changed.withColumn("symbol", F.concat_ws(".", "pkg", "name")).select("symbol", "file").distinct()
    if most is not None:
        picked = picked.orderBy("file", "symbol").limit(most)
    symbols_ = picked.select("symbol").distinct()
    arcs = calls.select(F.concat_ws(".", "to_pkg", "to_func").alias("src"), F.concat_ws(".", "from_pkg", "from_func").alias("caller"), "file", *([F.col("line")] if "line" in calls.columns else [F.lit(0).alias("line")]))
    prod = ~F.col("file").endswith("_test.go")
    near = arcs.join(symbols_, F.col("src") == F.col("symbol"), "left_semi")
    direct = near.groupBy(F.col("src").alias("symbol")).agg(F.count(F.lit(1)).alias("direct_callers"), F.count_if(prod).alias("direct_production"))
    order = Window.partitionBy("src").orderBy("file", "line", "caller")
    first = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top).groupBy(F.col("src").alias("symbol"))
    first = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "caller", "file", "line"))), lambda x: F.struct(x["caller"].alias("caller"), x["file"].alias("file"), x["line"].alias("line"))).alias("top_callers"))

    steps = arcs.where(prod).groupBy("src", "caller").agg(F.min(F.struct("line", "file"))["file"].alias("file"))
    front, reached = symbols_.withColumn("at", F.col("symbol")), None
    for _ in range(depth):
        came = front.join(steps, F.col("at") == F.col("src")).groupBy("symbol", "caller").agg(F.min("file").alias("file"))
        if reached is not None:
            came = came.join(reached.select("symbol", "caller"), ["symbol", "caller"], "left_anti")
        reached = came if reached is None else reached.unionByName(came)
        front = came.select("symbol", F.col("caller").alias("at"))
    far = reached.groupBy("symbol").agg(F.count(F.lit(1)).alias("transitive_callers"), F.countDistinct("file").alias("transitive_files"))
    zero = {"direct_callers": 0, "direct_production": 0, "transitive_callers": 0, "transitive_files": 0}
    none = F.array().cast("array<struct<caller:string,file:string,line:int>>")
    return picked.join(direct, "symbol", "left").join(far, "symbol", "left").join(first, "symbol", "left").fillna(zero).withColumn("top_callers", F.coalesce(F.col("top_callers").cast("array<struct<caller:string,file:string,line:int>>"), none))


def callsite_blast(changed: DataFrame, calls: DataFrame, depth: int = 2, most: int = 50) -> DataFrame:
    """One row: score (the most production call sites of a changed function), top_symbols (up to five
    with any, the most first, then by file and name), changed_symbols in order, and warnings (that
    only the first ``most`` changed functions were looked at)."""
    n = changed.select("pkg", "name", "file").distinct().agg(F.count(F.lit(1)).alias("changed"))
    per = callers(changed, calls, depth, most)
    best = per.where("direct_production > 0").orderBy(F.desc("direct_production"), "file", "symbol").limit(5)
    top = best.agg(F.coalesce(F.max("direct_production"), F.lit(0)).alias("score"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("direct_production")).alias("n"), "file", "symbol"))), lambda x: x["symbol"]).alias("top_symbols"))
    names = per.agg(F.array_sort(F.collect_list("symbol")).alias("changed_symbols"))  # at most ``most``
    warning = F.when(F.col("changed") > most, F.array(F.format_string(f"%d changed functions, of which the first {most} by file and name are looked at", "changed"))).otherwise(F.array().cast("array<string>"))
    return top.join(F.broadcast(names)).join(F.broadcast(n)).select("score", "top_symbols", "changed_symbols", warning.alias("warnings"))


def dead_code(defs: DataFrame, calls: DataFrame, most: int = 50) -> DataFrame:
    """Unexported functions nobody calls, by file and line."""
    own = defs.where("NOT method AND NOT name RLIKE '^[A-Z]' AND name NOT IN ('main', 'init')")
    unused = own.join(calls.select(F.col("to_pkg").alias("pkg"), F.col("to_func").alias("name")).distinct(), ["pkg", "name"], "left_anti")
    return unused.select(F.concat_ws(".", "pkg", "name").alias("symbol"), "file", "line").orderBy("file", "line", "symbol").limit(most)
