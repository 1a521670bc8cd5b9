"""Extractor passes: from files (path, body) to emitted nodes and edges.

Each pass returns (nodes, edges) with the place of emission (file_seq: the file that was
read; pos: the order there), or None for what it doesn't make. Patterns are projected out
of a body with one regexp_extract_all and exploded, so a pass is a scan and needs a shuffle
only to join paths or ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as R
from ..functions import paths as P
from ..functions import text as T
from .snapshot import first_by

Pass = tuple[DataFrame | None, DataFrame | None]


def _s(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _nodes(df: DataFrame, id, kind, label, path=None, meta: dict | None = None, pos=None, seq="path") -> DataFrame:
    filled = F.create_map(*[y for k, v in meta.items() for y in (F.lit(k), _s(v))]) if meta else F.lit(None).cast("map<string,string>")
    return df.select(
        _s(id).alias("id"), _s(kind).alias("kind"), _s(label).cast("string").alias("label"), (_s(path) if path is not None else F.lit(None)).cast("string").alias("path"),
        filled.alias("meta"), F.col(seq).alias("file_seq"), (F.lit(0) if pos is None else _s(pos)).cast("long").alias("pos"),
    )


def _edges(df: DataFrame, kind, src, dst, provenance=None, pos=None, seq="path") -> DataFrame:
    return df.select(
        _s(kind).alias("kind"), _s(src).alias("src"), _s(dst).alias("dst"), (_s(provenance) if provenance is not None else F.lit("")).alias("provenance"),
        F.col(seq).alias("file_seq"), (F.lit(0) if pos is None else _s(pos)).cast("long").alias("pos"),
    )


def _cat(*parts) -> Column:
    return F.concat(*[F.col(p[1:]) if isinstance(p, str) and p.startswith("$") else _s(p) for p in parts])


def _found(df: DataFrame, text, groups: dict[str, int], pattern: str) -> DataFrame:
    """A row for each match, with the wanted groups."""
    names = list(groups)
    all_ = F.arrays_zip(*[F.regexp_extract_all(_s(text), F.lit(pattern), groups[n]).alias(n) for n in names])
    return df.select("*", F.posexplode(all_).alias("pos", "m")).select("*", *[F.col("m")[n].alias(n) for n in names]).drop("m")


def is_markdown(path="path") -> Column:
    return P.lower_ext(path).isin(R.MARKDOWN)


def is_test(path="path") -> Column:
    p = F.col(path) if isinstance(path, str) else path
    e, stem = P.lower_ext(p), P.stem(p)
    by_name = (
        ((e == ".go") & stem.endswith("_test"))
        | ((e == ".py") & (stem.startswith("test_") | stem.endswith("_test")))
        | (e.isin(".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs") & F.lower(P.ext(stem)).isin(".test", ".spec"))
    )
    by_dir = (p.startswith("tests/") | p.startswith("test/")) & e.isin(".py", ".ts", ".tsx", ".js", ".jsx", ".rs")
    beside = (p.startswith("__tests__/") | p.contains("/__tests__/")) & e.isin(".ts", ".tsx", ".js", ".jsx")
    return by_name | by_dir | beside


def is_metric(path="path") -> Column:
    p = F.col(path)
    return P.lower_ext(p).isin(".yaml", ".yml") & reduce(lambda a, b: a | b, [p.startswith(d) for d in R.METRIC_DIRS])


def is_ts(path="path") -> Column:
    return P.lower_ext(path).isin(".ts", ".tsx", ".mts", ".cts") & ~is_test(path) & ~F.lower(F.col(path)).endswith(".d.ts")


def is_python(path="path") -> Column:
    return (P.ext(path) == ".py") & ~is_test(path)


def is_go(path="path") -> Column:
    return (P.ext(path) == ".go") & ~F.col(path).endswith("_test.go")


def _first_tracked(rows: DataFrame, candidates: Column, tracked: DataFrame) -> DataFrame:
    """Of each row's candidate paths the first that is tracked (column ``target``); rows without one go.

    rows has a unique ``row_key``."""
    tried = rows.select("*", F.posexplode(candidates).alias("nth", "target"))
    met = tried.join(tracked.select(F.col("path").alias("target")), "target", "left_semi")
    return first_by(met, ["row_key"], ["nth"]).drop("nth")


def directories(files: DataFrame) -> Pass:
    """File nodes, the directories above them, and the contains chain."""
    file_nodes = _nodes(files, _cat("file:", "$path"), "file", P.basename("path"), F.col("path"))
    up = files.select("path", F.explode(P.ancestors("path")).alias("dir"))
    dir_id = lambda d: F.concat(F.lit("dir:"), F.when(d == "", ".").otherwise(d))
    dirs = _nodes(up, dir_id(F.col("dir")), "directory", F.when(F.col("dir") == "", ".").otherwise(F.col("dir")), F.col("dir"), pos=1)
    parent = lambda p: F.when(P.dirname(p) == ".", "").otherwise(P.dirname(p))
    own = _edges(files, "contains", dir_id(parent("path")), _cat("file:", "$path"))
    chain = _edges(up.where("dir <> ''"), "contains", dir_id(parent("dir")), dir_id(F.col("dir")), pos=1)
    return file_nodes.unionByName(dirs), own.unionByName(chain)


def docs(files: DataFrame) -> Pass:
    md = files.where(is_markdown())
    title = F.trim(F.regexp_extract("body", R.TITLE, 1))
    heading = F.trim(F.regexp_extract("body", R.FIRST_HEADING, 1))
    label = F.when(F.col("body").rlike(R.TITLE), title).when(F.col("body").rlike(R.FIRST_HEADING), heading).otherwise(P.basename("path"))
    return (
        _nodes(md, _cat("doc:", "$path"), "doc", label, F.col("path"), pos=2),
        _edges(md, "contains", F.concat(F.lit("dir:"), P.dirname("path")), _cat("doc:", "$path"), pos=2),
    )


def _own_id(files: DataFrame) -> DataFrame:
    """Markdown files with the id they define (own) and where it stands (how)."""
    name = P.basename("path")
    in_name = [F.nullif(F.regexp_extract(name, rf"{R.B_BEFORE}({x}-[0-9]{{3}}){R.B_AFTER}", 1), F.lit("")) for x in ("US", "ADR", "IDR")]
    in_body = F.nullif(F.regexp_extract("body", R.ID_LINE, 1), F.lit(""))
    rows = files.where(is_markdown()).withColumns({"in_body": in_body, "in_name": F.coalesce(*in_name)})
    return rows.withColumns({"own": F.coalesce("in_body", "in_name"), "how": F.when(F.col("in_body").isNotNull(), " (frontmatter id)").otherwise(" (filename)")}).where("own IS NOT NULL")


def _id_node(id) -> Column:
    return F.concat(F.lower(F.substring_index(id, "-", 1)), F.lit(":"), id)


def typed_ids(files: DataFrame) -> Pass:
    """Stories and decision records, and the relations that their documents state."""
    own = _own_id(files)
    label = F.substring_index("own", "-", 1)
    kind = F.when(label == "US", "user_story").when(label == "ADR", "adr").otherwise("idr")
    nodes = _nodes(own, _id_node(F.col("own")), kind, F.col("own"), F.col("path"), pos=3)
    defines = _edges(own, "defines", _cat("doc:", "$path"), _id_node(F.col("own")), _cat("$path", "$how"), pos=3)
    return nodes, defines.unionByName(relations(files))


def relations(files: DataFrame) -> DataFrame:
    stated = _found(_own_id(files), F.col("body"), {"key": 1, "value": 2}, R.RELATION_LINE).withColumnRenamed("pos", "at")
    ids = _found(stated, F.col("value"), {"id": 1}, R.BARE_ID).where("id <> own")
    return _edges(ids, F.col("key"), _id_node(F.col("own")), _id_node(F.col("id")), _cat("$path", " (frontmatter ", "$key", ")"), pos=F.lit(1000) + F.col("at"))


def links(files: DataFrame, markdown: Column | None = None) -> DataFrame:
    """path, target of inline links; schemes and // are left out."""
    md = files.where(is_markdown() if markdown is None else markdown)
    raw = _found(md.select("path", "body"), F.col("body"), {"raw": 1}, R.LINK).where(~F.col("raw").rlike(R.SCHEME) & ~F.col("raw").startswith("//"))
    return raw.select("path", "pos", P.resolve_link("path", F.col("raw")).alias("target"))


def doc_mentions(files: DataFrame) -> Pass:
    met = links(files).join(files.select(F.col("path").alias("target")), "target", "left_semi")
    to = F.concat(F.when(is_markdown("target"), "doc:").otherwise("file:"), F.col("target"))
    return None, _edges(met, "mentions", _cat("doc:", "$path"), to, _cat("$path", " (markdown link)"), pos=F.col("pos") + 10_000)


def concepts(files: DataFrame) -> Pass:
    heads = _found(files.where(is_markdown()).select("path", "body"), F.col("body"), {"marks": 1, "title": 2}, R.HEADING).where("length(marks) <= 2")
    heads = heads.withColumns({"label": F.trim(F.regexp_replace("title", r"^\s+|\s+$", "")), "level": F.concat(F.lit("H"), F.length("marks").cast("string"))})
    heads = first_by(heads.withColumn("slug", P.slugify("label")).where("slug <> ''"), ["path", "slug"], ["pos"])
    id_ = _cat("concept:", "$slug")
    return (
        _nodes(heads, id_, "concept", F.col("label"), meta={"level": F.col("level")}, pos=F.col("pos") + 20_000),
        _edges(heads, "describes", _cat("doc:", "$path"), id_, _cat("$path", " (", "$level", ")"), pos=F.col("pos") + 20_000),
    )


def claims(files: DataFrame) -> Pass:
    bullets = _found(files.where(is_markdown()).select("path", "body"), F.col("body"), {"raw": 1}, R.BULLET)
    said = bullets.withColumn("claim", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    verb = F.rtrim(F.lower(F.substring_index("claim", " ", 1)), F.lit(".,;:!?"))
    said = said.where((F.col("claim") != "") & verb.isin(R.CLAIM_VERBS))
    id_ = F.concat(F.lit("claim:"), F.substring(F.sha2("claim", 256), 1, 12))
    return (
        _nodes(said, id_, "claim", P.cut_bytes("claim", 120), pos=F.col("pos") + 30_000),
        _edges(said, "defines", _cat("doc:", "$path"), id_, _cat("$path", " (claim bullet)"), pos=F.col("pos") + 30_000),
    )


def rule_nodes(spark, rules: list[dict], commands: list[str]) -> Pass:
    """Rules, their commands and the commands of the rule file."""
    rows = spark.createDataFrame([(n, r["id"], r["severity"], r["message"], r.get("suggested_commands", [])) for n, r in enumerate(rules)], "n int, rule string, severity string, message string, commands array<string>").withColumn("path", F.lit("ontology.yml"))
    alone = spark.createDataFrame([(n, c) for n, c in enumerate(commands)], "n int, command string").withColumn("path", F.lit("ontology.yml"))
    each = rows.select("*", F.explode("commands").alias("command"))
    node = _nodes(rows, _cat("rule:", "$rule"), "rule", F.col("rule"), F.lit("ontology.yml"), {"severity": F.col("severity"), "message": F.col("message")}, pos=F.col("n"))
    told = [_nodes(x, _cat("command:", "$command"), "command", F.col("command"), pos=F.col("n")) for x in (alone, each)]
    return node.unionByName(told[0]).unionByName(told[1]), _edges(each, "suggests", _cat("rule:", "$rule"), _cat("command:", "$command"), "ontology.yml (suggested_commands)", pos=F.col("n"))


def metrics(files: DataFrame) -> Pass:
    own = files.where(is_metric()).withColumn("name", P.stem("path")).withColumn("slug", P.slugify("name")).where("slug <> ''")
    id_ = _cat("metric:", "$slug")
    return _nodes(own, id_, "metric", F.col("name"), F.col("path")), _edges(own, "defines", _cat("file:", "$path"), id_, _cat("$path", " (metric file)"))


def source_candidates(path="path") -> Column:
    """Where the source of a test could be, best first."""
    p = F.col(path)
    e, stem = P.lower_ext(p), P.stem(p)
    at = lambda name: P.join(P.dirname(p), name)
    cut = lambda n: F.substring(stem, F.lit(1), F.length(stem) - n)
    bare = F.regexp_replace(stem, r"(?i)\.(test|spec)$", "")
    script = F.lower(P.ext(stem)).isin(".test", ".spec")
    sibling = F.when(e == ".tsx", ".ts").when(e == ".ts", ".tsx").when(e == ".jsx", ".js").otherwise(".jsx")
    python = F.when(stem.startswith("test_"), F.substring(stem, 6, 1 << 30)).when(stem.endswith("_test"), cut(5)).otherwise("")
    return (
        F.when((e == ".go") & stem.endswith("_test"), F.array(at(F.concat(cut(5), F.lit(".go")))))
        .when((e == ".py") & (python != ""), F.array(at(F.concat(python, F.lit(".py")))))
        .when(e.isin(".ts", ".tsx", ".js", ".jsx") & script, F.array(at(F.concat(bare, e)), at(F.concat(bare, sibling))))
        .otherwise(F.array().cast("array<string>"))
    )


def suggest_test(path="path") -> Column:
    """The test file that a source should have, '' if there is no custom for it."""
    p = F.col(path)
    e, stem = P.lower_ext(p), P.stem(p)
    name = (
        F.when(e == ".go", F.concat(stem, F.lit("_test.go")))
        .when(e.isin(".ts", ".tsx", ".mts", ".cts", ".js", ".jsx"), F.concat(stem, F.lit(".test"), e))
        .when(e == ".py", F.concat(F.lit("test_"), stem, F.lit(".py")))
    )
    return F.when(name.isNull(), "").otherwise(P.join(P.dirname(p), F.coalesce(name, F.lit(""))))


def tests(files: DataFrame) -> Pass:
    own = files.where(is_test()).select("path", F.col("path").alias("row_key"))
    met = _first_tracked(own, source_candidates(), files)
    id_ = _cat("test:", "$path")
    return _nodes(own, id_, "test", P.basename("path"), F.col("path")), _edges(met, "verifies", id_, _cat("file:", "$target"), _cat("$path", " (test → source pair)"))


def evidence(files: DataFrame) -> Pass:
    """Evidence folders; where two have one slug the first name in order is the label."""
    rows = files.select(F.regexp_extract("path", R.EVIDENCE, 1).alias("bucket")).where("bucket <> ''").distinct()
    rows = rows.withColumn("slug", P.slugify("bucket")).where("slug <> ''").withColumn("path", F.concat(F.lit("docs/evidence/"), F.col("bucket")))
    named = rows.where(F.col("bucket").rlike("^(US|ADR|IDR)-[0-9]{3}$"))
    id_ = _cat("evidence:", "$slug")
    return _nodes(rows, id_, "evidence", F.col("bucket"), F.col("path")), _edges(named, "supports", id_, _id_node(F.col("bucket")), _cat("$path", " (typed-id bucket)"))


def artifacts(files: DataFrame, rules: list[dict]) -> Pass:
    from .rules import theta

    made, asked = theta(files, rules, "expect_any"), theta(files, rules, "when")
    id_ = _cat("artifact:", "$path")
    edges = _edges(made, "generates", _cat("rule:", "$rule"), id_, _cat("ontology.yml (", "$rule", ".expect_any)"))
    return _nodes(made, id_, "generated_artifact", P.basename("path"), F.col("path")), edges.unionByName(_edges(asked, "expects", _cat("rule:", "$rule"), _cat("file:", "$path"), _cat("ontology.yml (", "$rule", ".when)")))


def _endpoints(rows: DataFrame) -> Pass:
    """rows: path, method, route, pos."""
    id_ = _cat("endpoint:", "$method", ":", "$route")
    return (
        _nodes(rows, id_, "endpoint", _cat("$method", " ", "$route"), F.col("path"), {"http_method": F.col("method"), "http_path": F.col("route")}, pos=F.col("pos") + 50_000),
        _edges(rows, "defines", _cat("file:", "$path"), id_, _cat("$path", " (http registration)"), pos=F.col("pos") + 50_000),
    )


def _symbols(rows: DataFrame, language: str, unit: str, pkg: Column) -> Pass:
    """rows: path, name, what, pos; each (path, name, what) once."""
    rows = first_by(rows.withColumn("pkg", pkg), ["path", "name", "what"], ["pos"])
    id_ = _cat("code_symbol:", "$pkg", ".", "$name")
    return (
        _nodes(rows, id_, "code_symbol", _cat("$pkg", ".", "$name"), F.col("path"), {f"{language}_kind": F.col("what"), unit: F.col("pkg")}, pos=F.col("pos")),
        _edges(rows, "defines", _cat("file:", "$path"), id_, _cat("$path", f" ({language} ", "$what", ")"), pos=F.col("pos")),
    )


def pending_claims(rows: DataFrame, symbol: str) -> DataFrame:
    """path, name, id: 'implements' claims and the next symbol line after them (or the same line).

    Gaps and islands: a line's island is the number of symbol lines before it, so an island
    ends with its symbol; one without a symbol claims nothing."""
    lines = rows.select("path", F.posexplode(F.split("body", "\n", -1)).alias("line", "text"))
    lines = lines.withColumns({"name": F.nullif(F.regexp_extract("text", symbol, 1), F.lit("")), "ids": F.regexp_extract_all(T.strip_backticks("text"), F.lit(R.IMPLEMENTS), 1)})
    some = lines.where("name IS NOT NULL OR size(ids) > 0")
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    island = some.withColumn("island", F.coalesce(F.count("name").over(before), F.lit(0)))
    claimed = island.groupBy("path", "island").agg(F.max("name").alias("name"), F.flatten(F.collect_list("ids")).alias("ids")).where("name IS NOT NULL")
    return claimed.select("path", "name", F.explode(F.array_distinct("ids")).alias("id")).distinct()


def _implements(rows: DataFrame, pkg: Column, note: str = " (implements ") -> DataFrame:
    return _edges(rows.withColumn("pkg", pkg), "implements", _cat("code_symbol:", "$pkg", ".", "$name"), _id_node(F.col("id")), _cat("$path", note, "$id", ")"), pos=90_000)


def schemas(files: DataFrame) -> Pass:
    parts = []
    for source, exts in (("sql", [".sql"]), ("proto", [".proto"]), ("graphql", [".graphql", ".gql"])):
        rows = _found(files.where(P.lower_ext("path").isin(exts)).select("path", "body"), F.col("body"), {"name": 1}, R.SCHEMA_ENTITIES[exts[0]])
        parts.append(rows.select("path", "pos", "name", F.lit(source).alias("source")))
    rows = reduce(DataFrame.unionByName, parts).withColumn("slug", P.slugify("name")).where("slug <> ''")
    rows = first_by(rows, ["path", "slug"], ["pos"])
    id_ = _cat("data_model:", "$slug")
    return (
        _nodes(rows, id_, "data_model", F.col("name"), meta={"source_kind": F.col("source")}, pos=F.col("pos")),
        _edges(rows, "defines", _cat("file:", "$path"), id_, _cat("$path", " (", "$source", " schema)"), pos=F.col("pos")),
    )


def make_targets(files: DataFrame) -> DataFrame:
    """path, pos, name of Makefile targets."""
    own = files.where(P.basename("path").isin(R.MAKE_NAMES) | (P.lower_ext("path") == ".mk"))
    rows = own.select("path", F.posexplode(F.split("body", "\r?\n", -1)).alias("pos", "line")).where(~F.col("line").startswith("\t"))
    rows = rows.withColumn("text", F.ltrim("line")).where((F.col("text") != "") & ~F.col("text").startswith("#") & ~F.col("text").rlike(R.MAKE_ASSIGN))
    rows = rows.withColumn("text", F.when(F.instr("text", " #") > 1, F.trim(F.substring_index("text", " #", 1))).otherwise(F.col("text")))
    return rows.select("path", "pos", F.regexp_extract("text", R.MAKE_TARGET, 1).alias("name")).where("name <> '' AND NOT startswith(name, '.') AND NOT contains(name, '%')")


def makefiles(files: DataFrame) -> Pass:
    rows = make_targets(files)
    command = _cat("command:make ", "$name")
    return _nodes(rows, command, "command", _cat("make ", "$name"), pos=F.col("pos")), _edges(rows, "defines", _cat("file:", "$path"), command, _cat("$path", " (makefile target)"), pos=F.col("pos"))


def ts_exports(files: DataFrame) -> DataFrame:
    """path, pos, name, what of TypeScript exports."""
    rows = files.where(is_ts()).select("path", T.strip_ts_comments("body").alias("body"))
    parts = [_found(rows, F.col("body"), {"name": 1}, p).select("path", (F.col("pos") + 1000 * n).alias("pos"), "name", F.lit(what).alias("what")) for n, (what, p) in enumerate(R.TS_EXPORTS.items())]
    return reduce(DataFrame.unionByName, parts)


def ts_import_specs(files: DataFrame) -> DataFrame:
    rows = files.where(is_ts()).select("path", T.strip_ts_comments("body").alias("body"))
    return reduce(DataFrame.union, [_found(rows, F.col("body"), {"spec": 1}, p).select("path", "spec") for p in R.TS_IMPORTS]).distinct()


def ts_candidates() -> Column:
    """Where the relative import ``spec`` of ``path`` could lead, best first."""
    at = P.join(P.dirname("path"), F.col("spec"))
    plus = lambda base, *ends: [F.concat(base, F.lit(e)) for e in ends]
    exts = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx")
    swap = (
        F.when(at.endswith(".js"), F.array(*plus(P.without_ext(at), ".ts", ".tsx", ".mts", ".cts")))
        .when(at.endswith(".jsx"), F.array(*plus(P.without_ext(at), ".tsx", ".ts")))
        .when(at.endswith(".mjs"), F.array(*plus(P.without_ext(at), ".mts")))
        .when(at.endswith(".cjs"), F.array(*plus(P.without_ext(at), ".cts")))
        .otherwise(F.array().cast("array<string>"))
    )
    inside = F.when(at == ".", F.lit("index")).otherwise(F.concat(at, F.lit("/index")))
    return F.concat(F.array(at), F.array(*plus(at, *exts)), swap, F.array(*plus(inside, *exts)))


def resolve_ts(files: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """path, spec, target of relative imports that lead to a tracked file."""
    specs = ts_import_specs(files) if specs is None else specs
    rows = specs.where(F.col("spec").startswith(".")).withColumn("row_key", F.struct("path", "spec"))
    return _first_tracked(rows, ts_candidates(), files).select("path", "spec", "target")


def typescript(files: DataFrame) -> Pass:
    nodes, edges = _symbols(ts_exports(files), "ts", "module", P.without_ext("path"))
    imports = resolve_ts(files).select("path", "target").distinct()
    code = files.where(is_ts()).select("path", T.strip_ts_comments("body").alias("body"))
    routes = _found(code, F.col("body"), {"verb": 1, "route": 2}, R.TS_ENDPOINT).withColumn("method", F.upper("verb"))
    more_nodes, more_edges = _endpoints(routes)
    claims_ = pending_claims(files.where(is_ts()), R.TS_ANY_EXPORT)
    edges = edges.unionByName(_edges(imports, "depends_on", _cat("file:", "$path"), _cat("file:", "$target"), _cat("$path", " (ts import ", "$target", ")"), pos=40_000))
    return nodes.unionByName(more_nodes), edges.unionByName(more_edges).unionByName(_implements(claims_, P.without_ext("path")))


def py_symbols(files: DataFrame) -> DataFrame:
    rows = files.where(is_python()).select("path", T.strip_python_comments("body").alias("body"))
    return reduce(DataFrame.unionByName, [_found(rows, F.col("body"), {"name": 1}, p).select("path", (F.col("pos") + 1000 * n).alias("pos"), "name", F.lit(what).alias("what")) for n, (what, p) in enumerate(R.PY_SYMBOLS.items())])


def py_endpoints(files: DataFrame) -> DataFrame:
    """path, pos, method, route of decorators; a route without methods has '*'."""
    rows = files.where(is_python()).select("path", T.strip_python_comments("body").alias("body"))
    found = _found(rows, F.col("body"), {"verb": 1, "args": 2}, R.PY_DECORATOR).withColumn("route", F.regexp_extract("args", R.PY_ROUTE_PATH, 1)).where("route <> ''")
    listed = F.transform(F.split(F.regexp_extract("args", R.PY_ROUTE_METHODS, 1), ","), lambda m: F.upper(F.regexp_replace(F.trim(m), "^[\"']+|[\"']+$", "")))
    methods = F.when(F.col("verb") != "route", F.array(F.upper("verb"))).when(F.col("args").rlike(R.PY_ROUTE_METHODS), F.filter(listed, lambda m: m != "")).otherwise(F.array(F.lit("*")))
    return found.select("path", "pos", "route", F.explode(methods).alias("method"))


def py_import_specs(files: DataFrame) -> DataFrame:
    rows = files.where(is_python()).select("path", T.strip_python_comments("body").alias("body"))
    return _found(rows, F.col("body"), {"spec": 1}, R.PY_FROM_IMPORT).select("path", "spec").distinct()


def py_candidates() -> Column:
    """Where the relative import ``spec`` of ``path`` could lead; none if it has an empty part."""
    dots = F.length(F.regexp_extract("spec", r"^(\.*)", 1))
    rest = F.regexp_replace("spec", r"^\.+", "")
    parent = F.filter(F.split(P.dirname("path"), "/"), lambda x: x != ".")
    kept = F.slice(parent, F.lit(1), F.greatest(F.size(parent) - (dots - 1), F.lit(0)))
    names = F.split(rest, r"\.", -1)
    at = lambda tail: F.array_join(F.concat(kept, tail), "/")
    module = at(F.concat(F.slice(names, F.lit(1), F.size(names) - 1), F.array(F.concat(F.element_at(names, -1), F.lit(".py")))))
    package = at(F.concat(names, F.array(F.lit("__init__.py"))))
    broken = F.exists(names, lambda x: x == "")
    return F.when(rest == "", F.array(at(F.array(F.lit("__init__.py"))))).when(broken, F.array().cast("array<string>")).otherwise(F.array(module, package))


def resolve_py(files: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    specs = py_import_specs(files) if specs is None else specs
    rows = specs.where(F.col("spec").startswith(".")).withColumn("row_key", F.struct("path", "spec"))
    return _first_tracked(rows, py_candidates(), files).select("path", "spec", "target")


def python(files: DataFrame) -> Pass:
    nodes, edges = _symbols(py_symbols(files), "py", "module", P.without_ext("path"))
    more_nodes, more_edges = _endpoints(py_endpoints(files))
    imports = resolve_py(files).select("path", "target").distinct()
    edges = edges.unionByName(_edges(imports, "depends_on", _cat("file:", "$path"), _cat("file:", "$target"), _cat("$path", " (py import ", "$target", ")"), pos=40_000))
    return nodes.unionByName(more_nodes), edges.unionByName(more_edges).unionByName(_implements(pending_claims(files.where(is_python()), R.PY_ANY_DEF), P.without_ext("path")))


def is_shell(path="path", body="body") -> Column:
    """By extension, or without one by the first line (of the first 256 bytes)."""
    line = F.regexp_replace(F.substring_index(F.substring(F.col(body), 1, 256), "\n", 1), r"[ \r]+$", "")
    words = F.filter(F.split(F.trim(F.substring(line, 3, 256)), r"[ \t\r\f]+"), lambda w: w != "")
    direct = F.coalesce(P.basename(F.try_element_at(words, F.lit(1))).isin(R.SHELL_NAMES), F.lit(False))
    by_env = F.coalesce(F.try_element_at(words, F.lit(2)).isin(R.SHELL_NAMES), F.lit(False))
    env = F.trim(F.substring(line, 3, 256)).startswith("/usr/bin/env")
    return P.lower_ext(path).isin(R.SHELL_EXTENSIONS) | ((P.ext(path) == "") & line.startswith("#!") & F.when(env, by_env).otherwise(direct))


def shells(files: DataFrame) -> Pass:
    own = files.where(is_shell())
    command = _cat("command:bash ", "$path")
    return _nodes(own, command, "command", _cat("bash ", "$path"), F.col("path")), _edges(own, "defines", _cat("file:", "$path"), command, _cat("$path", " (shell script)"))


def code_ids(files: DataFrame) -> DataFrame:
    """path, id, node of typed ids in files other than Markdown, outside quotes and backticks."""
    other = files.where(~is_markdown()).select("path", T.hide_quoted("body").alias("body"))
    return _found(other, F.col("body"), {"id": 1}, R.TYPED_ID).select("path", "id", _id_node(F.col("id")).alias("node")).distinct()


def code_mentions(files: DataFrame, known: DataFrame) -> Pass:
    """known: node."""
    met = code_ids(files).join(known, "node", "left_semi")
    return None, _edges(met, "mentions", _cat("file:", "$path"), F.col("node"), _cat("$path", " (code typed-id reference)"))


def metric_mentions(files: DataFrame, metric_nodes: DataFrame) -> Pass:
    """metric_nodes: id, label, path."""
    other = files.where(~is_markdown()).join(metric_nodes.select("path"), "path", "left_anti")
    names = _found(other.select("path", "body"), F.col("body"), {"label": 1}, R.QUOTED_NAME).select("path", "label").distinct()
    met = names.join(metric_nodes.select("label", F.col("id").alias("node")), "label").select("path", "node").distinct()
    return None, _edges(met, "mentions", _cat("file:", "$path"), F.col("node"), _cat("$path", " (metric name literal)"))


def path_literals(files: DataFrame) -> DataFrame:
    """path, literal, target of quoted paths that lead to another tracked file."""
    other = files.where(~is_markdown()).select("path", "body")
    lit = F.col("literal")
    quoted = _found(other, F.col("body"), {"literal": 1}, R.QUOTED_PATH)
    like = quoted.where(~lit.startswith("/") & ~lit.startswith("~") & ~lit.contains("://") & (F.octet_length(lit) <= 200) & (lit.contains("/") | lit.rlike(R.PATH_EXTENSION)))
    rows = like.groupBy("path", "literal").agg(F.min("pos").alias("pos")).withColumn("row_key", F.struct("path", "literal"))
    here = P.join(P.dirname("path"), lit)
    target = _first_tracked(rows, F.when(lit.startswith("./") | lit.startswith("../"), F.array(here)).otherwise(F.array(here, P.clean(lit))), files)
    return first_by(target.where("target <> path"), ["path", "target"], ["pos"]).select("path", "literal", "target")


def file_references(files: DataFrame) -> Pass:
    return None, _edges(path_literals(files), "mentions", _cat("file:", "$path"), _cat("file:", "$target"), _cat("$path", " (path literal ", "$literal", ")"))


def build_graph(files: DataFrame, rules: list[dict] | None = None, commands: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """All passes over files (path, body), in order; nodes and edges of the property graph."""
    from . import golang, graph

    rules = rules or []
    metric, typed = metrics(files), typed_ids(files)
    known = typed[0].select(F.col("id").alias("node")).distinct()
    passes = [
        directories(files), docs(files), typed, doc_mentions(files), concepts(files), claims(files), rule_nodes(files.sparkSession, rules, commands or []), metric, tests(files), evidence(files),
        artifacts(files, rules), golang.symbols(files), schemas(files), makefiles(files), typescript(files), python(files), shells(files), code_mentions(files, known),
        metric_mentions(files, metric[0].select("id", "label", "path")), file_references(files),
    ]
    return graph.build(passes)
