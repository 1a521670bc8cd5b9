"""The rule gate: which rules a set of changed files fires, and ids nobody defines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..functions.globs import matches_any
from ..functions.patterns import B_AFTER, B_BEFORE, MARKDOWN, TYPED_ID
from .extract import is_test

#: Where records of each kind live, and how bad a finding is.
RECORD_DIRS = {"US": "user-stories", "ADR": "decisions", "IDR": "decisions"}
SEVERITY = {"warn": 1, "error": 2}


def evaluate(changed: DataFrame, rules: list[dict]) -> DataFrame:
    """Findings: a rule fires if a changed file matches one of ``when`` and none matches ``expect_any``.

    The globs are literals, so one scan of the changed files tests all rules without a join."""
    spark = changed.sparkSession
    schema = "rule string, severity string, message string, triggered_by array<string>, expected_any_of array<string>, suggested_commands array<string>"
    if not rules:
        return spark.createDataFrame([], schema)
    path = F.col("path")
    tests = [F.struct(F.lit(k).alias("k"), matches_any(path, r["when"]).alias("starts"), matches_any(path, r["expect_any"]).alias("meets")) for k, r in enumerate(rules)]
    hits = changed.select("path", F.explode(F.array(*tests)).alias("t")).where("t.starts OR t.meets")
    by_rule = hits.groupBy("t.k").agg(F.bool_or("t.meets").alias("met"), F.array_sort(F.collect_set(F.when(F.col("t.starts"), F.col("path")))).alias("triggered_by"))
    table = spark.createDataFrame([(k, r["id"], r["severity"], r["message"], r["expect_any"], r.get("suggested_commands", [])) for k, r in enumerate(rules)], "k int, rule string, severity string, message string, expected_any_of array<string>, suggested_commands array<string>")
    fired = by_rule.where(~F.col("met") & (F.size("triggered_by") > 0)).join(table, "k")
    return fired.select(*[c.split()[0] for c in schema.split(", ")])


def theta(files: DataFrame, rules: list[dict], field: str) -> DataFrame:
    """rule, path for every file that matches one of a rule's globs in ``field``."""
    pairs = [F.struct(F.lit(r["id"]).alias("rule"), matches_any(F.col("path"), r[field]).alias("hit")) for r in rules]
    if not pairs:
        return files.sparkSession.createDataFrame([], "rule string, path string")
    return files.select("path", F.explode(F.array(*pairs)).alias("t")).where("t.hit").select("t.rule", "path")


def suggested(findings: DataFrame) -> DataFrame:
    """Commands of the findings, each once."""
    return findings.select(F.explode("suggested_commands").alias("command")).distinct()


def suggested_in_order(findings: DataFrame, rules: list[dict]) -> DataFrame:
    """command, position: each once, where it first comes in the order of the rules and of a rule's commands.

    Findings of no rule in the list come after those, by name. There are no more commands than rules give."""
    ids = F.array(*[F.lit(r["id"]) for r in rules]).cast("array<string>")
    place = F.array_position(ids, F.col("rule"))
    rows = findings.select(F.when(place > 0, place).otherwise(len(rules) + 1).alias("a"), "rule", F.posexplode("suggested_commands").alias("b", "command"))
    first = rows.groupBy("command").agg(F.min(F.struct("a", "rule", "b")).alias("at"))
    return first.select("command", (F.row_number().over(Window.orderBy("at", "command")) - 1).cast("long").alias("position"))


def known_ids(files: DataFrame) -> DataFrame:
    """Typed ids of records: from names of stories, from names or id lines of decisions."""
    name = P.basename("path")
    found = []
    for label, folder in RECORD_DIRS.items():
        rows = files.where(F.col("path").startswith(f"docs/{folder}/"))
        own = rf"{B_BEFORE}({label}-[0-9]{{3}}){B_AFTER}"
        ids: list[Column] = [F.regexp_extract(name, own, 1)]
        if label != "US":
            ids.append(F.regexp_extract("body", rf"(?dm)^id:[ \t\n\f\r]*({label}-[0-9]{{3}})[ \t\n\f\r]*$", 1))
        found.append(rows.select(F.explode(F.array(*ids)).alias("id")))
    return reduce(lambda a, b: a.union(b), found).where("id <> ''").distinct()


def scan_ids(added: DataFrame, known: DataFrame) -> DataFrame:
    """Findings for ids in added lines (path, text) that no record has; Markdown and tests are exempt."""
    rows = added.where(~P.lower_ext("path").isin(MARKDOWN) & ~is_test("path"))
    ids = rows.select("path", F.explode(F.regexp_extract_all(T.hide_quoted("text"), F.lit(TYPED_ID), 1)).alias("id")).distinct()
    label = F.substring_index("id", "-", 1)
    folder = F.when(label == "US", "user-stories").otherwise("decisions")
    return ids.join(known, "id", "left_anti").select(
        F.format_string("unknown-%s-id", F.lower(label)).alias("rule"),
        F.lit("warn").alias("severity"),
        F.format_string("%s mentioned in %s but no matching %s record exists", "id", "path", label).alias("message"),
        F.array("path").alias("triggered_by"),
        F.array(F.format_string("docs/%s/**/%s*.md", folder, "id")).alias("expected_any_of"),
        F.array().cast("array<string>").alias("suggested_commands"),
    )


def worst(findings: DataFrame) -> DataFrame:
    """One row: the highest severity (null if there is none) and the exit code."""
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warn", 1).otherwise(0)
    top = findings.agg(F.max(rank).alias("r"))
    return top.select(F.when(F.col("r") == 2, "error").when(F.col("r") == 1, "warn").alias("severity"), F.when(F.col("r") == 2, 1).otherwise(0).alias("exit_code"))
