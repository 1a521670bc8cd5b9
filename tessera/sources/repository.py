"""A git working tree as tables. git runs on the driver only; bodies are read by Spark."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CHANGES, COMMITS


def git(root: str, *args: str) -> str:
    """Output of a git command, '' on any failure."""
    try:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True).stdout
    except (OSError, subprocess.CalledProcessError):
        return ""


def _names(text: str) -> list[str]:
    return [x for x in text.replace("\r\n", "\n").split("\n") if x]


def top(cwd: str = ".") -> str:
    return git(cwd, "rev-parse", "--show-toplevel").strip() or cwd


def tracked(spark: SparkSession, root: str, *paths: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in _names(git(root, "ls-files", *paths))], "path string")


def untracked(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in _names(git(root, "ls-files", "--others", "--exclude-standard"))], "path string")


def bodies(spark: SparkSession, root: str, paths: DataFrame | None = None) -> DataFrame:
    """path, body of the files under ``root`` (any file system Spark knows), or of ``paths`` there.

    A path that can't be read has no row."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    rows = read.select(F.regexp_replace("path", r"^\w+:/+(?=/)", "").alias("full"), F.col("content").cast("string").alias("body"))
    plain = base if not base.startswith("file:") else base[5:]
    rows = rows.select(F.substring_index("full", "/" + plain.strip("/") + "/", -1).alias("path"), "body").where("path NOT LIKE '.git/%'")
    return rows if paths is None else rows.join(paths.select("path").distinct(), "path", "left_semi")


def changes(spark: SparkSession, root: str, base: str | None = None, *paths: str) -> DataFrame:
    """path, area (staged, worktree, untracked, or range), status, hunk; deletions are left out of the areas' names.

    With ``paths`` (git's pathspecs) only what they hold. Hunks are those of staged files, with two lines of context."""
    rows: list[tuple] = []
    areas = {"staged": ["diff", "--cached"], "worktree": ["diff", "HEAD"]}
    if base:
        areas["range"] = ["diff", base]
    for area, command in areas.items():
        for line in _names(git(root, *command, "--name-status", "--diff-filter=ACMR", "--", *paths)):
            status, *names = line.split("\t")
            hunk = git(root, "diff", "--cached", "--unified=2", "--", names[-1]) if area == "staged" else None
            rows.append((names[-1], area, status[0], hunk))
    rows += [(p, "untracked", "A", None) for p in _names(git(root, "ls-files", "--others", "--exclude-standard", "--", *paths))]
    return spark.createDataFrame(rows, CHANGES)


def commits(spark: SparkSession, root: str) -> DataFrame:
    """path, ts of every change in the history: one log, not one call a file."""
    from datetime import datetime, timezone

    rows, ts = [], None
    for line in _names(git(root, "log", "--format=%x01%ct", "--name-only")):
        if line.startswith("\x01"):
            ts = datetime.fromtimestamp(int(line[1:]), timezone.utc)
        else:
            rows.append((line, ts))
    return spark.createDataFrame(rows, COMMITS)


def worktree(changed: DataFrame) -> DataFrame:
    """What is dirty or untracked, each path once."""
    return changed.where("area IN ('worktree', 'untracked')").select("path").distinct()


def ordered_union(*tables: DataFrame) -> DataFrame:
    """path, position: every path once, in order of its first table and its place there (a column
    ``position``, or by name)."""
    rows = None
    for k, table in enumerate(tables):
        at = F.col("position") if "position" in table.columns else F.lit(0)
        own = table.select("path", F.struct(F.lit(k).alias("k"), at.cast("long").alias("at"), F.col("path").alias("p")).alias("order"))
        rows = own if rows is None else rows.unionByName(own)
    first = rows.groupBy("path").agg(F.min("order").alias("order"))
    return first.select("path", (F.row_number().over(Window.orderBy("order")) - 1).cast("long").alias("position"))


#: The revision a command compares with if it isn't told one.
DEFAULT_BASE = {"check": "HEAD~1", "review": "HEAD"}


def collect(changed: DataFrame, mode: str, staged: bool = False, of_worktree: bool = False, include_untracked: bool = False) -> DataFrame:
    """path, position of what feeds the gate; ``changed`` has the range from the command's base.

    scan: what is staged if ``staged`` is set, else nothing. check: the range, and what is
    untracked if asked for. review: the range; with ``staged`` what is staged before it; with
    ``of_worktree`` what is untracked after it."""
    area = lambda name: changed.where(F.col("area") == name).select("path")
    if mode == "scan":
        return ordered_union(area("staged") if staged else area("staged").where("false"))
    if mode == "check":
        return ordered_union(area("range"), *([area("untracked")] if include_untracked else []))
    if mode == "review":
        if staged:
            return ordered_union(area("staged"), area("range"))
        return ordered_union(area("range"), *([area("untracked")] if of_worktree else []))
    raise ValueError(f"no such command: {mode}")


def collect_files(spark: SparkSession, root: str, mode: str, base: str | None = None, **flags: bool) -> DataFrame:
    """``collect`` over the working tree at ``root``, with the command's own base unless told another."""
    return collect(changes(spark, root, base or DEFAULT_BASE.get(mode)), mode, **flags)


def counts(changed: DataFrame) -> DataFrame:
    """One row: how many paths are staged, dirty and untracked."""
    n = lambda name: F.count_distinct(F.when(F.col("area") == name, F.col("path")))
    return changed.agg(n("staged").alias("staged"), n("worktree").alias("dirty"), n("untracked").alias("untracked"))
