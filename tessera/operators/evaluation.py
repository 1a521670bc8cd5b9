"""Evaluation: set scores, classification of runs, roll-ups, clusters, mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.globs import glob_to_regex
from ..functions.patterns import MOVEMENT_METERS
from .graph import degree, sides


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a, b) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(_c(a).cast("double") / F.nullif(_c(b), F.lit(0)), F.lit(0.0))


def prf(predicted="predicted", gold="gold") -> dict[str, Column]:
    """precision, recall, f1 of two arrays; with no gold all are 1."""
    hit = F.size(F.array_intersect(predicted, gold))
    p = ratio(hit, F.size(F.array_distinct(predicted)))
    r = ratio(hit, F.size(F.array_distinct(gold)))
    none = F.size(gold) == 0
    f1 = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    return {"precision": F.when(none, 1.0).otherwise(p), "recall": F.when(none, 1.0).otherwise(r), "f1": F.when(none, 1.0).otherwise(f1)}


def by_category(scored: DataFrame) -> DataFrame:
    """Means by category; rows with an error stay out."""
    rows = scored.where("error IS NULL OR error = ''") if "error" in scored.columns else scored
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def set_difference(expected="expected", actual="actual") -> dict[str, Column]:
    missing, unexpected = F.array_sort(F.array_except(expected, actual)), F.array_sort(F.array_except(actual, expected))
    return {"missing": missing, "unexpected": unexpected, "pass": (F.size(missing) == 0) & (F.size(unexpected) == 0)}


def micro(rows: DataFrame, predicted="actual", gold="expected") -> DataFrame:
    """tp, fp, fn over all rows, and their precision, recall and f1."""
    s = rows.agg(F.sum(F.size(F.array_intersect(predicted, gold))).alias("tp"), F.sum(F.size(F.array_except(predicted, gold))).alias("fp"), F.sum(F.size(F.array_except(gold, predicted))).alias("fn"))
    p, r = ratio("tp", F.expr("tp + fp")), ratio("tp", F.expr("tp + fn"))
    return s.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"))


def seed_nodes(seeds: DataFrame) -> DataFrame:
    """node: the file, doc and test nodes that seed paths (path) may have."""
    return seeds.select(F.explode(F.array(*[F.concat(F.lit(k), F.col("path")) for k in ("file:", "doc:", "test:")])).alias("node"))


def impact(seeds: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths one hop, either way, from the file, doc or test nodes of seed paths (path)."""
    return beside(seeds, seed_nodes(seeds), nodes, edges)


def beside(seeds: DataFrame, starts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths one hop, either way, from starts (node), without those of the seeds.

    Both ends of the edges are shuffled once, by the node that may be a start; only what is beside one goes on."""
    near = sides(edges).join(starts, "node", "left_semi").select(F.col("other").alias("id")).distinct()
    found = near.join(nodes.where("kind <> 'directory' AND path IS NOT NULL AND path <> ''").select("id", "path"), "id").select("path").distinct()
    return found.join(seeds.select("path"), "path", "left_anti")


def classify(expected="expected", actual="actual", allowed="allowed") -> dict[str, Column]:
    """Misses outrank extras; meters of movement are always allowed."""
    fine = F.array_union(allowed, F.array(*[F.lit(m) for m in MOVEMENT_METERS]))
    fn = F.array_sort(F.array_except(expected, actual))
    fp = F.array_sort(F.array_except(F.array_except(actual, expected), fine))
    return {"false_negatives": fn, "false_positives": fp, "classification": F.when(F.size(fn) > 0, "false_negative").when(F.size(fp) > 0, "false_positive").otherwise("hit")}


def summarize(results: DataFrame) -> DataFrame:
    """grouping (all, expected_meter, mutation), key, counts and rates.

    Grouping sets over one explode: rows of several expected meters count once in the
    groupings that don't name the meter."""
    rows = results.select("mutation_id", "classification", "false_negatives", "false_positives", F.posexplode_outer("expected").alias("nth", "meter"))
    rows = rows.withColumn("first", F.coalesce(F.col("nth"), F.lit(0)) == 0)
    rows = rows.select("meter", "mutation_id", "first", F.col("classification").alias("c"), (F.size("false_negatives") > 0).alias("fn"), (F.size("false_positives") > 0).alias("fp"))
    sets = rows.groupingSets([[], ["meter"], ["mutation_id"]], "meter", "mutation_id").agg(
        F.grouping("meter").alias("gm"), F.grouping("mutation_id").alias("gu"),
        *[F.count_if(F.expr(c)).alias(n) for n, c in {"total_all": "true", "hits_all": "c = 'hit'", "skipped_all": "c = 'skipped'", "errored_all": "c = 'errored'", "fn_all": "fn", "fp_all": "fp"}.items()],
        *[F.count_if(F.expr(f"first AND {c}")).alias(n) for n, c in {"total_one": "true", "hits_one": "c = 'hit'", "skipped_one": "c = 'skipped'", "errored_one": "c = 'errored'", "fn_one": "fn", "fp_one": "fp"}.items()],
    )
    pick = lambda n: F.when(F.col("gm") == 0, F.col(f"{n}_all")).otherwise(F.col(f"{n}_one"))
    out = sets.where("NOT (gm = 0 AND meter IS NULL)").select(
        F.when(F.col("gm") == 0, "expected_meter").when(F.col("gu") == 0, "mutation").otherwise("all").alias("grouping"),
        F.coalesce("meter", "mutation_id", F.lit("")).alias("key"),
        *[pick(a).alias(b) for a, b in (("total", "total"), ("hits", "hits"), ("skipped", "skipped"), ("errored", "errored"), ("fn", "with_fn"), ("fp", "with_fp"))],
    )
    return out.withColumns({"hit_rate": ratio("hits", "total"), "fn_rate": ratio("with_fn", "total"), "fp_rate": ratio("with_fp", "total")})


def by_meter(results: DataFrame) -> DataFrame:
    """Per meter that was expected or fired wrongly: total, hits, misses, extras."""
    rows = results.select("classification", "expected", "false_negatives", "false_positives", F.explode(F.array_union("expected", "false_positives")).alias("meter"))
    live = ~F.col("classification").isin("skipped", "errored")
    fn, fp = F.expr("array_contains(false_negatives, meter)"), F.expr("array_contains(false_positives, meter)")
    return rows.groupBy("meter").agg(F.count(F.lit(1)).alias("total"), F.count_if(live & fn).alias("false_negatives"), F.count_if(live & ~fn & fp).alias("false_positives"), F.count_if(live & ~fn & ~fp).alias("hits"))


def family(path) -> Column:
    e = P.lower_ext(path)
    return (
        F.when(e == ".go", "go").when(e.isin(".ts", ".tsx", ".js", ".jsx", ".mts", ".cts"), "typescript").when(e == ".py", "python")
        .when(e.isin(".md", ".markdown"), "markdown").when(e.isin(".yaml", ".yml"), "yaml").when(e.isin(".sql", ".proto", ".graphql"), "schema").otherwise("generic")
    )


def error_class(error) -> Column:
    e = _c(error)
    return F.when(F.coalesce(e, F.lit("")) == "", "").when(F.instr(e, ":") > 1, F.substring_index(e, ":", 1)).when(F.trim(e) == "", "error").otherwise(F.substring_index(F.trim(e), " ", 1))


def cluster_key(operation="operation", kind="target_kind", expected="expected", actual="actual", path="target_path", error="error") -> Column:
    parts = [_c(operation), _c(kind), F.array_join(F.array_sort(expected), ","), F.array_join(F.array_sort(actual), ","), P.lower_ext(path), family(path), error_class(error)]
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 16)


def clusters(results: DataFrame) -> DataFrame:
    """Misses of one kind: key, n and the mutations, largest first."""
    rows = results.where(~F.col("classification").isin("hit", "skipped")).withColumn("key", cluster_key())
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("mutation_id")).alias("mutations"), F.array_sort(F.collect_set("target_kind")).alias("kinds"))


def select_nodes(nodes: DataFrame, edges: DataFrame, id_prefix="", path_glob="", path_contains="", path_suffix="", extensions=(), label_contains="", incoming="", outgoing="", kinds=()) -> DataFrame:
    """Nodes that meet all that is given."""
    rows = nodes
    if kinds:
        rows = rows.where(F.col("kind").isin(*kinds))
    if id_prefix:
        rows = rows.where(F.col("id").startswith(id_prefix))
    if path_glob:
        rows = rows.where(F.col("path").rlike(glob_to_regex(path_glob)))
    if path_contains:
        rows = rows.where(F.col("path").contains(path_contains))
    if path_suffix:
        rows = rows.where(F.col("path").endswith(path_suffix))
    if extensions:
        rows = rows.where(P.lower_ext("path").isin(*[e.lower() for e in extensions]))
    if label_contains:
        rows = rows.where(F.lower("label").contains(label_contains.lower()))
    if incoming:
        rows = rows.join(edges.where(F.col("kind") == incoming).select(F.col("dst").alias("id")), "id", "left_semi")
    if outgoing:
        rows = rows.join(edges.where(F.col("kind") == outgoing).select(F.col("src").alias("id")), "id", "left_semi")
    return rows


def weighted_pick(nodes: DataFrame, edges: DataFrame, draw: float, tasks: int | None = None) -> DataFrame:
    """The node at ``draw`` (0 to 1) of the weights degree + 1, by degree (largest first) and id; ``tasks`` as in ``degree``.

    A degree's whole weight is summed first, so the running sums are over distinct degrees and
    then over the ids of one of them, not over all nodes in one task."""
    w = nodes.select("id").join(degree(edges, tasks).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    per = w.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum(F.expr("n * (degree + 1)")).over(Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(F.expr("n * (degree + 1)")).over(Window.partitionBy())
    band = per.select("degree", upto.alias("upto"), F.expr("n * (degree + 1)").alias("own"), total.alias("total")).withColumn("at", F.lit(draw) * F.col("total"))
    hit = band.where("at < upto AND at >= upto - own").select("degree", F.floor((F.col("at") - (F.col("upto") - F.col("own"))) / (F.col("degree") + 1)).alias("nth"))
    within = w.join(F.broadcast(hit), "degree").withColumn("n", F.row_number().over(Window.partitionBy("degree").orderBy("id")))
    return within.where("n = nth + 1").select("id", "degree")


def mutate(files: DataFrame, operation: str, path: str, **edit) -> DataFrame:
    """Files (path, body) after one edit: replace_text (old, new), append_text (text), remove_file,
    rename_file (new_path), add_file (content), remove_line_containing (text)."""
    here = F.col("path") == path
    body = F.col("body")
    if operation == "replace_text":
        at = F.instr(body, edit["old"])
        once = F.concat(F.substring(body, F.lit(1), at - 1), F.lit(edit["new"]), F.substring(body, at + len(edit["old"]), F.length(body)))
        return files.withColumn("body", F.when(here & (at > 0), once).otherwise(body))
    if operation == "append_text":
        return files.withColumn("body", F.when(here, F.concat(body, F.lit(edit["text"]))).otherwise(body))
    if operation == "remove_file":
        return files.where(~here)
    if operation == "rename_file":
        return files.withColumn("path", F.when(here, edit["new_path"]).otherwise(F.col("path")))
    if operation == "add_file":
        return files.where(~here).unionByName(files.sparkSession.createDataFrame([(path, edit["content"])], "path string, body string"), allowMissingColumns=True)
    if operation == "remove_line_containing":
        kept = F.array_join(F.filter(F.split(body, "\n", -1), lambda x: ~F.contains(x, F.lit(edit["text"]))), "\n")
        return files.withColumn("body", F.when(here, kept).otherwise(body))
    raise ValueError(f"unknown operation {operation}")


def backdate(commits: DataFrame, days: int) -> DataFrame:
    """All history moved back."""
    return commits.withColumn("ts", F.col("ts") - F.expr(f"INTERVAL {int(days)} DAYS"))


def refinements(found: DataFrame) -> DataFrame:
    """What to try next for each cluster."""
    return found.select("key", "n", F.when(F.col("n") >= 3, "extend the extractor that these have in common").when(F.size("mutations") > 1, "compare the mutations of this cluster").otherwise("write a test for this one case").alias("suggestion"))


def oracle(expected="expected", allowed="allowed", actual="actual", verdicts="verdicts", verdict="verdict", case="case_type") -> dict[str, Column]:
    """A case of the oracle protocol: what was missed, what was extra, and which of five classes it is."""
    missing = F.array_sort(F.array_except(expected, actual))
    extra = F.array_sort(F.array_except(F.array_except(actual, expected), allowed))
    wrong = (F.size(verdicts) > 0) & ~F.expr(f"array_contains({verdicts}, {verdict})")
    silent = (F.size(expected) == 0) | (F.col(case) == "negative_control")
    satisfied = (F.size(missing) == 0) & ~(wrong & ~silent)
    specific = (F.size(extra) == 0) & ~(wrong & silent)
    name = (
        F.when(satisfied & specific, "hit").when(satisfied & ~silent, "hit_with_false_positive").when(satisfied, "false_positive")
        .when(specific, "false_negative").otherwise("false_negative_with_false_positive")
    )
    return {"missing": missing, "unexpected": extra, "detection_hit": (F.size(expected) > 0) & satisfied, "specificity_clean": specific, "oracle_hit": (F.col(case) != "known_limit") & satisfied & specific, "classification": name}


def repaired(expected="post_expected", allowed="post_allowed", actual="post_actual", verdicts="post_verdicts", verdict="post_verdict") -> Column:
    right = (F.size(verdicts) == 0) | F.expr(f"array_contains({verdicts}, {verdict})")
    return right & (F.size(F.array_except(expected, actual)) == 0) & (F.size(F.array_except(F.array_except(actual, expected), allowed)) == 0)


def confusion(cases: DataFrame) -> DataFrame:
    """Per meter: positives found and missed, quiet controls, and false positives, which count
    for the meter that fired and not for the one under test."""
    own = F.coalesce(F.nullif("meter", F.lit("")), F.lit("unscoped"))
    control, positive = F.col("case_type") == "negative_control", F.col("case_type") == "positive"
    base = cases.withColumn("meter", own).groupBy("meter").agg(
        F.count_if(positive).alias("positives"), F.count_if(control).alias("controls"), F.count_if(~positive & ~control).alias("known_limits"),
        F.count_if(~control & F.col("detection_hit")).alias("tp"), F.count_if(~control & ~F.col("detection_hit")).alias("fn"), F.count_if(positive & F.col("detection_hit")).alias("supported"),
        F.count_if(control & ~F.expr("array_contains(unexpected, meter)")).alias("tn"),
    )
    fp = cases.select(F.explode("unexpected").alias("meter")).groupBy("meter").agg(F.count(F.lit(1)).alias("fp"))
    rows = base.join(fp, "meter", "full_outer").fillna(0)
    return rows.withColumns({"recall": ratio("tp", F.expr("tp + fn")), "supported_recall": ratio("supported", "positives"), "precision": ratio("tp", F.expr("tp + fp")), "fpr": ratio("fp", F.expr("fp + tn"))})


def evidence_rates(cases: DataFrame) -> DataFrame:
    """Fractions as text."""
    rows = cases.where("size(expected) > 0")
    limit = F.col("case_type") == "known_limit"
    hit = F.col("detection_hit")
    frac = lambda a, b: F.concat(F.count_if(a).cast("string"), F.lit("/"), F.count_if(b).cast("string"))
    return rows.agg(frac(~limit & hit, ~limit).alias("supported_recall"), frac(limit & ~hit, limit).alias("known_limit_misses"), frac(hit, F.lit(True)).alias("overall_recall"))


def health(active="active", regressions="regressions", warn="warn") -> Column:
    return F.greatest(F.lit(0), 100 - 10 * _c(active) - 15 * _c(regressions) - 20 * _c(warn))


def lanes(steps: DataFrame) -> DataFrame:
    """Two lanes over the steps of a life cycle: one repairs after each step, the other piles up."""
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("step", health("active", "regressions", "warn").alias("managed"), health(F.sum("active").over(w), F.sum("regressions").over(w), F.max("warn").over(w)).alias("unmanaged"))


def template_shape(files: DataFrame) -> DataFrame:
    """Which template suits a repository, by the files it has; the first that fits."""
    p = F.col("path")
    at = lambda *names: F.coalesce(F.bool_or(p.isin(*names)), F.lit(False))
    under = lambda name: F.coalesce(F.bool_or(p.startswith(f"{name}/")), F.lit(False))
    top = lambda e: F.count_if(~p.contains("/") & F.lower(p).endswith(e))
    shape = (
        F.when(at("pnpm-workspace.yaml", "turbo.json", "nx.json") | (under("packages") & under("apps")), "monorepo")
        .when(at("package.json") & (at("tsconfig.json") | under("src")), "typescript-app")
        .when(at("go.mod"), "go-cli")
        .when(at("pyproject.toml", "setup.py"), "python-package")
        .when(at("dbt_project.yml") | under("migrations") | under("rill"), "data-pipeline")
        .when((top(".tf") > 0) | under("terraform"), "infra-terraform")
        .when(under("docs") & (top(".md") >= 5), "docs-site")
        .when(under(".agents") | under("agents"), "agent-repo")
        .otherwise("generic")
    )
    return files.agg(shape.alias("template"))


def review_candidates(base: DataFrame, current: DataFrame, most: int = 3) -> DataFrame:
    """Markdown files that are new or changed in meaning: the first few by path, for a language-model review."""
    from .meters import semantic_changes

    return semantic_changes(base, current).where("change = 'semantic'").select("path").orderBy("path").limit(most)
